"""A FLAC column codec: 8-bit mono streams, written and read with numpy, many frames in lock step.

Encoding picks for each frame a constant, a verbatim or a fixed-predictor subframe (orders 0 to 4) with one Rice
parameter. Decoding reads Rice residuals (any partition order, escape codes), fixed and LPC predictors, verifies the
CRC-8 of each header, the CRC-16 of each frame and the MD5 of the samples, and gives PCM blocks with sample offsets.

Defined results: a null text is the empty payload; a stream that fails a checksum, or has more channels or bits than
this codec's one and eight, raises ValueError; equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

BLOCK = 512
RATE = 8000
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@lru_cache(2)
def _crc_table(bits: int, poly: int) -> np.ndarray:
    x = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        x = np.where(x >> (bits - 1) & 1, x << 1 ^ poly, x << 1) & ((1 << bits) - 1)
    return x


def crcs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: int, poly: int) -> np.ndarray:
    """The CRC of many byte ranges at once."""
    table, crc = _crc_table(bits, poly), np.zeros(len(begin), np.uint32)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # those with more than i bytes
        byte = data[begin[:n] + i]
        crc[:n] = (crc[:n] << 8 ^ table[crc[:n] >> (bits - 8) ^ byte]) & ((1 << bits) - 1)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(numbers: np.ndarray) -> list[bytes]:
    """Frame numbers in FLAC's extension of UTF-8."""
    out = []
    for n in numbers.tolist():
        if n < 0x80:
            out.append(bytes([n]))
            continue
        tail = []
        limit = 0x20
        while True:
            tail.append(0x80 | n & 0x3F)
            n >>= 6
            if n < limit or len(tail) == 6:
                break
            limit >>= 1
        lead = (0xFF << (7 - len(tail))) & 0xFF
        out.append(bytes([lead | n, *reversed(tail)]))
    return out


def _frames(samples: np.ndarray, width: int, numbers: np.ndarray, last: int) -> list[bytes]:
    """Frames of one length: samples has a row for each. last: 0, or the block size to state in the header."""
    n = len(samples)
    x = samples.astype(np.int16)
    residuals = [x]
    for k in range(1, 5):
        residuals.append(np.diff(residuals[-1], axis=1) if width > k else None)  # type: ignore[arg-type]
    cost = np.stack([np.full(n, np.iinfo(np.int64).max) if r is None else np.abs(r[:, 4 - k if width > 4 else 0 :]).sum(1, dtype=np.int32).astype(np.int64) for k, r in enumerate(residuals)])
    order = cost.argmin(0)
    constant = (x == x[:, :1]).all(1)
    out: list[bytes] = [b""] * n
    heads = [bytes([0xFF, 0xF8, 0x70, 0x02]) + u + bytes([width - 1 >> 8, width - 1 & 255]) for u in _utf8(numbers)]
    head = np.frombuffer(b"".join(heads), np.uint8)
    size = np.array([len(h) for h in heads])
    check = crcs(head, np.cumsum(size) - size, size, 8, 7)
    heads = [h + bytes([c]) for h, c in zip(heads, check.tolist())]
    bodies: list[bytes] = [b""] * n
    raw = (x & 255).astype(np.uint8)
    for i in np.flatnonzero(constant).tolist():
        bodies[i] = bytes([0, raw[i, 0]])
    best = np.take_along_axis(cost, order[None], 0)[0]
    # zigzag codes have twice the mean of the magnitudes; the parameter is about the logarithm of 0.7 of that
    rice = np.clip(np.ceil(np.log2(np.maximum(best * (1.4 / max(1, width - 4)), 1e-9))), 0, 14).astype(np.int64)
    for k, r in {(int(a), int(b)) for a, b in zip(order[~constant], rice[~constant])}:
        rows = np.flatnonzero((order == k) & (rice == r) & ~constant)
        e = residuals[k][rows]
        z = (e << 1 ^ e >> 15).astype(np.uint16)
        unary = (z >> r).astype(np.int32)
        length = unary + (1 + r)
        lead = 8 + 8 * k + 10  # subframe header, warm-up, method and partition order (6), parameter (4)
        bits = lead + length.sum(1, dtype=np.int64)
        keep = bits < 8 + 8 * width
        for i in rows[~keep].tolist():
            bodies[i] = b"\x02" + raw[i].tobytes()
        if not keep.all():
            z, unary, length, bits, rows = z[keep], unary[keep], length[keep], bits[keep], rows[keep]
            if not len(rows):
                continue
        nbytes = (bits + 7) // 8
        start = np.cumsum(nbytes) - nbytes
        stream = np.zeros(int(nbytes.sum()) * 8, np.uint8)
        stop = (start[:, None] * 8 + lead + np.cumsum(length, 1) - 1 - r).ravel()
        stream[stop] = 1
        low = z.ravel()
        for j in range(r):
            stream[stop + (1 + j)] = low >> (r - 1 - j) & 1
        packed = np.packbits(stream)
        packed[start] = (8 + k) << 1
        for j in range(k):
            packed[start + 1 + j] = raw[rows, j]
        packed[start + 1 + k] |= np.uint8(r >> 2)  # 6 zero bits, then 4 of the parameter
        packed[start + 2 + k] |= np.uint8((r & 3) << 6)
        for i, a, b in zip(rows.tolist(), start.tolist(), (start + nbytes).tolist()):
            bodies[i] = packed[a:b].tobytes()
    whole = [h + b for h, b in zip(heads, bodies)]
    size = np.array([len(w) for w in whole])
    check = crcs(np.frombuffer(b"".join(whole), np.uint8), np.cumsum(size) - size, size, 16, 0x8005)
    for i, (w, c) in enumerate(zip(whole, check.tolist())):
        out[i] = w + c.to_bytes(2, "big")
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes are the samples plus 128."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8)
    begins = np.cumsum(sizes) - sizes
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = begins[owner] + number * BLOCK
    width = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    frames: list[bytes] = [b""] * len(owner)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for i, f in zip(rows.tolist(), _frames(data[begin[rows, None] + np.arange(w)], w, number[rows], 0)):
            frames[i] = f
    out, k = [], 0
    for p, n, b in zip(payloads, sizes.tolist(), blocks.tolist()):
        mine = frames[k : k + b]
        k += b
        lengths = [len(f) for f in mine]
        info = BLOCK.to_bytes(2, "big") * 2 + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        at = np.cumsum([0, *lengths])
        seek = b"".join((i * BLOCK).to_bytes(8, "big") + int(at[i]).to_bytes(8, "big") + min(BLOCK, n - i * BLOCK).to_bytes(2, "big") for i in range(b))
        table = b"\x83" + len(seek).to_bytes(3, "big") + seek if b else b""
        out.append(b"fLaC" + (b"\x00" if b else b"\x80") + b"\x00\x00\x22" + info + table + b"".join(mine))
    return out


class _Bits:
    """Reads of up to 32 bits at many positions of one byte string."""

    def __init__(self, data: np.ndarray):
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.bytes = data
        self.words = np.zeros(len(data) - 7, np.uint64)
        for i in range(8):
            self.words = self.words << np.uint64(8) | data[i : len(data) - 7 + i]

    def read(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        shift = (64 - (at & 7) - n).astype(np.uint64)
        value = self.words[at >> 3] >> np.minimum(shift, np.uint64(63)) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        return value.astype(np.int64)


def decode(streams: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The signed samples of each stream, and the first sample of each of its blocks."""
    sizes = np.array([len(s) for s in streams], np.int64)
    data = np.frombuffer(b"".join(streams), np.uint8)
    begins = np.cumsum(sizes) - sizes
    bits = _Bits(data)
    unpacked = np.unpackbits(bits.bytes)
    ones = np.append(np.flatnonzero(unpacked), len(unpacked)).astype(np.int32)
    upto = np.cumsum(unpacked, dtype=np.int32)
    upto -= unpacked
    nearest = ones[upto]  # the first one bit at or after each bit
    del unpacked, ones, upto
    totals, digests, owner, position, sample, unknown = [], [], [], [], [], []
    for i, (s, b) in enumerate(zip(streams, begins.tolist())):
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at = 4
        info, seek = b"", b""
        while True:
            kind, n = s[at], int.from_bytes(s[at + 1 : at + 4], "big")
            if kind & 127 == 0:
                info = s[at + 4 : at + 4 + n]
            elif kind & 127 == 3:
                seek = s[at + 4 : at + 4 + n]
            at += 4 + n
            if kind & 128:
                break
        packed = int.from_bytes(info[10:18], "big")
        if packed >> 41 & 7 or packed >> 36 & 31 != 7:
            raise ValueError("only streams with one channel of 8 bits")
        totals.append(packed & (1 << 36) - 1)
        digests.append(info[18:34])
        points = np.frombuffer(seek, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        ends = points["sample"].astype(np.int64) + points["n"]
        if len(points) and points["sample"][0] == 0 and (points["sample"][1:] == ends[:-1]).all() and ends[-1] == totals[-1]:
            owner += [i] * len(points)
            position += (points["byte"].astype(np.int64) + b + at).tolist()
            sample += points["sample"].astype(np.int64).tolist()
        elif totals[-1]:
            owner, position, sample = [*owner, i], [*position, b + at], [*sample, 0]
            unknown.append(i)
    total = np.array(totals, np.int64)
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.int8)
    starts: list[list[int]] = [[] for _ in streams]
    lane, at_, first = np.array(owner, np.int64), np.array(position, np.int64), np.array(sample, np.int64)
    # all frames of the seek tables in lock step; without a table, a stream's next frame begins where its last one ended
    while len(lane):
        samples, width, end = _frame(bits, nearest, at_)
        for i, d in zip(lane.tolist(), first.tolist()):
            starts[i].append(d)
        keep = np.arange(samples.shape[1]) < width[:, None]
        spot = (base[lane] + first)[:, None] + np.arange(samples.shape[1])
        out[spot[keep]] = samples[keep]
        more = np.isin(lane, unknown) & (first + width < total[lane])
        lane, at_, first = lane[more], end[more], (first + width)[more]
    whole = [out[b : b + n] for b, n in zip(base.tolist(), totals)]
    for w, d in zip(whole, digests):
        if any(d) and hashlib.md5(w.tobytes()).digest() != d:
            raise ValueError("MD5 of the samples differs")
    return whole, [np.array(s, np.int64) for s in starts]


def _frame(bits: _Bits, nearest: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One frame at each byte position: samples, how many, and the byte after it."""
    d, n = bits.bytes, len(at)
    if (d[at] != 0xFF).any() or (d[at + 1] & 0xFE != 0xF8).any():
        raise ValueError("no frame where one should begin")
    code = (d[at + 2] >> 4).astype(np.int64)
    lead = d[at + 4]
    full = np.ones(n, bool)
    length = np.zeros(n, np.int64)
    for k in range(8):  # leading ones of the coded number
        full &= (lead >> (7 - k) & 1) == 1
        length += full
    p = at + 4 + np.maximum(length, 1)
    width = np.where(code == 1, 192, np.where(code >= 8, 256 << np.maximum(code - 8, 0), 576 << np.maximum(code - 2, 0)))
    width = np.where(code == 6, d[p].astype(np.int64) + 1, np.where(code == 7, (d[p].astype(np.int64) << 8 | d[p + 1]) + 1, width))
    p += np.where(code == 6, 1, np.where(code == 7, 2, 0))
    rate = d[at + 2] & 15
    p += np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    if (crcs(d, at, p - at, 8, 7) != d[p]).any():
        raise ValueError("CRC-8 of a frame header differs")
    p += 1
    kind = (d[p] >> 1 & 63).astype(np.int64)
    if (d[p] & 129).any():
        raise ValueError("wasted bits and padding are not in 8-bit streams of this codec")
    pos = (p + 1) * 8
    widest = int(width.max())
    x = np.zeros((widest + 32, n), np.int32)  # 32 rows of history before the first sample
    lpc = kind >= 32
    order = np.where(lpc, (kind & 31) + 1, np.where((kind >= 8) & (kind <= 12), kind & 7, 0))
    coded = lpc | ((kind >= 8) & (kind <= 12))
    eight = np.full(n, 8)
    for i in range(int(order.max(initial=0))):
        some = np.flatnonzero(order > i)
        x[32 + i, some] = bits.read(pos[some], eight[some]).astype(np.uint8).view(np.int8)
        pos[some] += 8
    coefficients, shift = np.zeros((max(1, int(order.max(initial=0))), n), np.int64), np.zeros(n, np.int64)
    for k, c in enumerate(FIXED):
        for j, v in enumerate(c):
            if (mine := kind == 8 + k).any():
                coefficients[j, mine] = v
    some = np.flatnonzero(lpc)
    if len(some):
        precision = bits.read(pos[some], np.full(len(some), 4)) + 1
        shift[some] = bits.read(pos[some] + 4, np.full(len(some), 5))
        pos[some] += 9
        for j in range(int(order[some].max())):
            own = order[some] > j
            v = bits.read(pos[some[own]], precision[own])
            coefficients[j, some[own]] = v - (v >> (precision[own] - 1) << precision[own])
            pos[some[own]] += precision[own]
    flat = np.flatnonzero(~coded)
    for i in flat.tolist():  # constant or verbatim: whole bytes
        q, w = int(pos[i] >> 3), int(width[i])
        if kind[i] == 0:
            x[32 : 32 + w, i], pos[i] = d[q : q + 1].view(np.int8)[0], pos[i] + 8
        elif kind[i] == 1:
            x[32 : 32 + w, i], pos[i] = d[q : q + w].view(np.int8), pos[i] + 8 * w
        else:
            raise ValueError("reserved subframe type")
    plain = coded & ~lpc
    some = np.flatnonzero(plain)
    head = bits.read(pos[some], np.full(len(some), 10))
    rice = head & 15
    plain[some] = (head >> 4 == 0) & (rice != 15)
    for k in np.unique(order[plain]).tolist():
        rows = np.flatnonzero(plain & (order == k))
        _plain(bits, nearest, k, rows, width[rows], pos, x)
    rows = np.flatnonzero(coded & ~plain)
    if len(rows):
        method = bits.read(pos[rows], np.full(len(rows), 2))
        parts = bits.read(pos[rows] + 2, np.full(len(rows), 4))
        pos[rows] += 6
        wide = np.where(method == 1, 5, 4)
        rice, raw = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        for i in range(widest):
            live = np.flatnonzero((i < width[rows]) & (i >= order[rows]))
            if not len(live):
                continue
            span = width[rows[live]] >> parts[live]
            new = live[(i % span == 0) | (i == order[rows[live]])]
            if len(new):
                rice[new] = bits.read(pos[rows[new]], wide[new])
                pos[rows[new]] += wide[new]
                escape = new[rice[new] == (1 << wide[new]) - 1]
                raw[new] = -1
                if len(escape):
                    raw[escape] = bits.read(pos[rows[escape]], np.full(len(escape), 5))
                    pos[rows[escape]] += 5
            at_ = pos[rows[live]]
            stop = nearest[at_].astype(np.int64)
            k = rice[live]
            low = bits.read(stop + 1, k)
            value = (stop - at_) << k | low
            value = value >> 1 ^ -(value & 1)
            after = stop + 1 + k
            esc = raw[live] >= 0
            if esc.any():
                v = bits.read(at_, np.where(esc, raw[live], 0))
                b = np.where(esc, raw[live], 1)
                value = np.where(esc, v - (v >> np.maximum(b - 1, 0) << b), value)
                after = np.where(esc, at_ + raw[live], after)
            lanes = rows[live]
            pos[lanes] = after
            guess = np.zeros(len(lanes), np.int64)
            for j in range(coefficients.shape[0]):
                guess += coefficients[j, lanes] * x[31 + i - j, lanes]
            x[32 + i, lanes] = value + (guess >> shift[lanes])
    end = (pos + 7) >> 3
    if (crcs(d, at, end - at, 16, 0x8005) != (d[end].astype(np.uint32) << 8 | d[end + 1])).any():
        raise ValueError("CRC-16 of a frame differs")
    return x[32:].T.astype(np.int8), width, end + 2


def _plain(bits: _Bits, nearest: np.ndarray, k: int, rows: np.ndarray, width: np.ndarray, pos: np.ndarray, x: np.ndarray) -> None:
    """Fixed predictors of order k with one Rice parameter: the ends of the unary codes in lock step, all else at once."""
    rice = bits.read(pos[rows] + 6, np.full(len(rows), 4))
    n = width - k
    most, limit = int(n.max()), len(nearest) - 1
    stop = np.empty((most, len(rows)), np.int32)
    skip = (rice + 1).astype(np.int32)
    at = (pos[rows] + 10).astype(np.int32)
    begin = at.copy()
    for i in range(most):  # a row that has ended reads on; what it reads is not used
        s = nearest.take(at, mode="clip")
        stop[i] = s
        np.add(s, skip, out=at)
    start = np.empty_like(stop)
    start[0] = begin
    start[1:] = stop[:-1] + skip
    unary = stop - start
    after = np.minimum(stop + 1, limit - 64)
    shift = (64 - (after & 7) - rice).astype(np.uint64)
    low = (bits.words[after >> 3] >> np.minimum(shift, np.uint64(63))).astype(np.int32) & ((1 << rice.astype(np.int32)) - 1)
    z = unary << rice.astype(np.int32) | low
    now = z >> 1 ^ -(z & 1)
    last = n - 1
    pos[rows] = stop[last, np.arange(len(rows))] + skip
    warm = [x[32 + i, rows] for i in range(k)]
    for level in range(k - 1, -1, -1):  # sums undo the differences, from the highest order down
        first = warm
        for _ in range(level):
            first = [b - a for a, b in zip(first, first[1:])]
        now = first[-1] + np.cumsum(now, 0, dtype=np.int32)
    x[32 + k : 32 + k + most, rows] = now


def feature(samples: np.ndarray, starts: np.ndarray) -> str:
    """Blocks, mean, root mean square, peak, zero crossings of the samples."""
    x = samples.astype(np.int64)
    n = max(1, len(x))
    return f"blocks={len(starts)};mean={x.sum() / n:.6f};rms={(float((x * x).sum()) / n) ** 0.5:.6f};peak={int(np.abs(x).max(initial=0))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, payload: UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    zeros = F.expr("cast(unhex(repeat('00', 64)) as binary)")
    return docs.select(F.col(key), n.cast("long").alias("n_bytes"), F.concat(raw, F.substring(zeros, F.lit(1), pad)).alias("payload"))


def to_flac(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of df, with the payload replaced by media: a FLAC stream."""
    keep = [c for c in df.columns if c != payload]
    src = df.select(*keep, payload)
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + ", media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(len(keep))
            for a, b in slices(np.array([len(x) for x in data.to_pylist()]), 1_000_000):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(encode(part.column(len(keep)).to_pylist()), pa.binary())], [*keep, "media"])

    return in_arrow(src, run, schema)


def from_flac(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of df, and what its streams hold: pcm binary (unsigned 8-bit samples), block_offsets array<bigint> (the
    first sample of each block), feature string."""
    keep = list(df.columns)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", pcm binary, block_offsets array<bigint>, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(media)
            for a, b in slices(np.array([len(x) for x in batch.column(at).to_pylist()]), 900_000):
                part = batch.slice(a, b - a)
                whole, starts = decode(part.column(at).to_pylist())
                edges = np.cumsum([0, *map(len, starts)]).astype(np.int32)
                offsets = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(starts).astype(np.int64)))
                pcm = pa.array([(w.view(np.uint8) ^ 128).tobytes() for w in whole], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pcm, offsets, pa.array([feature(w, f) for w, f in zip(whole, starts)], pa.string())], [*keep, "pcm", "block_offsets", "feature"])

    return in_arrow(df, run, schema)


def blocks(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The PCM blocks of from_flac() as rows: key, block, offset, samples; a reader can seek to a sample by its offset."""
    ends = F.concat(F.slice("block_offsets", 2, F.greatest(F.size("block_offsets") - 1, F.lit(0))), F.array(F.octet_length("pcm").cast("bigint")))
    pairs = df.select(F.col(key), "pcm", F.posexplode(F.arrays_zip(F.col("block_offsets").alias("a"), ends.alias("b"))).alias("block", "x"))
    return pairs.select(key, "block", F.col("x.a").alias("offset"), F.substring("pcm", (F.col("x.a") + 1).cast("int"), (F.col("x.b") - F.col("x.a")).cast("int")).alias("samples"))


def features(docs: DataFrame) -> DataFrame:
    """Per document: sizes and digests of the payload as read back from its FLAC stream, of the stream itself, and the feature."""
    read = from_flac(to_flac(payloads(docs)))
    tail = F.expr("substring(pcm, -64, 64)")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("block_offsets").alias("n_blocks"),
    )
