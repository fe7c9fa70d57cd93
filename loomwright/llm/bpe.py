"""Byte-level BPE.

A text is cut into pieces with no regular expression. Each code point gets a class, each class with a look at its
neighbours a symbol, and each symbol is a transition function of a small automaton. Functions compose associatively, so
a prefix scan over the ids of their monoid gives the automaton's state before every code point, and with it the piece
boundaries. Pieces go through a bounded cache of merged ids. Byte offsets of the tokens are kept for decoding.

Defined results: a null text is the empty text and has no tokens; special tokens are ordinary text; any string without
lone surrogates decodes to its exact UTF-8 bytes; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_arrow, slices, texts_of

CACHE_ENTRIES = 120_000
#: Bytes; longer pieces are merged one by one.
LONG_PIECE = 64
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols of the automaton; +8: the first code point of a text.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_RUN, S_GLUE, S_LAST = range(8)
#: States: what the current piece is. GLUE: a space that the next piece takes in; LEFT2, LEFT1: letters that a
#: contraction still takes; DONE: nothing can be added.
LETTERS, NUMBERS, OTHERS, RUN, GLUE, LEFT2, LEFT1, DONE = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: letters (L*), numbers (N*), white space (White_Space), others."""
    out = np.full(0x110000, OTHER, np.uint8)
    cats = [unicodedata.category(chr(i))[0] for i in range(0x32400)]
    out[: len(cats)] = [LETTER if c == "L" else NUMBER if c == "N" else OTHER for c in cats]
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts here."""
    if symbol >= 8:
        state, symbol = DONE, symbol - 8
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return DONE, False
    if symbol in (S_QUOTE1, S_QUOTE2):
        if state not in (OTHERS, GLUE):
            return (LEFT1 if symbol == S_QUOTE1 else LEFT2), True
        symbol = S_OTHER
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        same = (LETTERS, NUMBERS, OTHERS)[symbol]
        return same, state not in (same, GLUE)
    if symbol == S_RUN:
        return RUN, state != RUN
    return (GLUE if symbol == S_GLUE else DONE), True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, ...]:
    """The transition functions that the symbols generate: table of compositions, constant or not, value at DONE, each symbol's function, piece starts."""
    found: dict[tuple[int, ...], int] = {}
    todo = []
    for s in range(16):
        f = tuple(_step(q, s)[0] for q in range(8))
        todo.append(f)
    gens = list(todo)
    order: list[tuple[int, ...]] = []
    while todo:
        f = todo.pop(0)
        if f in found:
            continue
        found[f] = len(order)
        order.append(f)
        todo += [tuple(g[q] for q in f) for g in gens]
    comp = np.array([[found[tuple(g[q] for q in f)] for g in order] for f in order], np.uint16)
    start = np.array([[_step(q, s)[1] for s in range(16)] for q in range(8)])
    gen = np.array([found[g] for g in gens], np.uint16)
    constant = np.array([len(set(f)) == 1 for f in order])
    value = np.array([f[DONE] for f in order], np.uint8)
    return comp, constant, value, gen, start


def piece_starts(text: str, firsts: np.ndarray) -> np.ndarray:
    """Where the pieces of the concatenated texts start; firsts: the first code point of each text that is not empty."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    symbol = np.where(kind == SPACE, S_RUN, kind).astype(np.uint8)
    ends = np.zeros(n, bool)  # the last code point of its text
    ends[firsts[1:] - 1] = True
    ends[-1] = True
    last = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~ends[:-1]
    symbol[:-1][last] = np.where(points[:-1][last] == 32, S_GLUE, S_LAST)
    quotes = np.flatnonzero((points == 39) & ~ends)
    if len(quotes):
        one = points[quotes + 1]
        symbol[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        far = (quotes + 2 < n) & ~ends[np.minimum(quotes + 1, n - 1)]
        quotes, one = quotes[far], one[far]
        two = points[quotes + 2]
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quotes[pair]] = S_QUOTE2
    symbol[firsts] += 8
    comp, constant, value, gen, start = monoid()
    flat, m = comp.ravel(), len(comp)
    f, d = gen[symbol], 1
    while d < n and not constant[f].all():  # Hillis-Steele; a function that is constant no longer changes
        f[d:] = flat[f[:-d].astype(np.intp) * m + f[d:]]
        d *= 2
    before = np.empty(n, np.uint8)
    before[0] = DONE
    before[1:] = value[f[:-1]]
    return np.flatnonzero(start.ravel()[before.astype(np.intp) * 16 + symbol])


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merges the adjacent pair of the lowest rank, leftmost first, until none is left; a heap keeps very long pieces fast."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := right[i]) >= n or len(parts[i]) + len(parts[j]) != size:  # type: ignore[arg-type]
            continue
        parts[i] += parts[j]  # type: ignore[operator]
        parts[j], right[i] = None, right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:  # type: ignore[operator]
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))  # type: ignore[arg-type]
    return tuple(ranks[p] for p in parts if p is not None)


class PairTable:
    """Rank of each pair of ids that can merge, as arrays that answer many lookups at once."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        found = [(a, b, r) for w, r in ranks.items() for i in range(1, len(w)) if (a := get(w[:i])) is not None and (b := get(w[i:])) is not None]
        a, b, r = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
        keys = a << 32 | b
        self.bits = max(4, int(keys.size * 2).bit_length())
        order = np.argsort(self._slot(keys), kind="stable")
        self.keys, self.ranks = keys[order], r[order]
        slots = self._slot(self.keys)
        self.first = np.searchsorted(slots, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        out = np.full(keys.shape, self.NONE)
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids of one length, merged in lock step: the ids, packed to the left, and how many are left in each row."""
        n, width = ids.shape
        ids, count = ids.copy(), np.full(n, width)
        if width < 2:
            return ids, count
        rank = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            now = rank[rows]
            at = now.argmin(1)
            best = now[np.arange(len(rows)), at]
            more = best < self.NONE
            rows, at, best = rows[more], at[more], best[more]
            if not len(rows):
                break
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids[rows] = np.take_along_axis(ids[rows], shift, 1)
            shift = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 2)
            rank[rows] = np.take_along_axis(rank[rows], shift, 1)
            ids[rows, at] = best
            count[rows] -= 1
            rank[rows, np.maximum(count[rows] - 1, 0)] = self.NONE
            some = np.flatnonzero(at > 0)
            rank[rows[some], at[some] - 1] = self.lookup(ids[rows[some], at[some] - 1], best[some])
            some = np.flatnonzero(at < count[rows] - 1)
            rank[rows[some], at[some]] = self.lookup(best[some], ids[rows[some], at[some] + 1])
        return ids, count


class Vocabulary:
    """Ranks, a bounded cache of merged pieces, and arrays for decoding."""

    def __init__(self, raw: bytes, reserved: dict[int, bytes] | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        size = 1 + max([*self.ranks.values(), *(reserved or {})])
        words = [b""] * size
        for w, i in chain(self.ranks.items(), ((w, i) for i, w in (reserved or {}).items())):
            words[i] = w
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self._forget()
        self.pairs = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Merges pieces that the cache lacks: those of one length in lock step, very long ones each by a heap."""
        names: list[str] = []
        flat, counts = [self.flat], [self.counts]
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for p in set(pieces):
            by_length.setdefault(len(b := p.encode("utf-8", "surrogatepass")), []).append((p, b))
        for n, group in by_length.items():
            names += [p for p, _ in group]
            if n > LONG_PIECE:
                for _, b in group:
                    flat.append(np.array(merged(b, self.ranks), np.int32))
                    counts.append(np.array([len(flat[-1])], np.int32))
                continue
            whole = [self.ranks.get(b, -1) for _, b in group]
            raw = np.frombuffer(b"".join(b for _, b in group), np.uint8).reshape(-1, n)
            ids, count = self.pairs.merge(self.single[raw])
            ready = np.array(whole)
            ids[ready >= 0, 0], count[ready >= 0] = ready[ready >= 0], 1
            flat.append(ids[np.arange(n) < count[:, None]].astype(np.int32))
            counts.append(count.astype(np.int32))
        self.cache.update(zip(names, range(len(self.counts), len(self.counts) + len(names))))
        self.flat, self.counts = np.concatenate(flat), np.concatenate(counts)
        self.upto = np.cumsum(self.counts, dtype=np.int64) - self.counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        text = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        starts = piece_starts(text, begins[lengths > 0])
        cuts = starts.tolist()
        pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        if len(self.cache) > CACHE_ENTRIES or len(self.flat) > 8 * CACHE_ENTRIES:
            self._forget()
        found = np.fromiter(map(self.cache.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(found < 0)):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(new)
            found[missing] = [self.cache[p] for p in new]
        sizes = self.counts[found].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.upto[found] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, np.append(begins, len(text)))])

    def _forget(self) -> None:
        """Empties the cache: piece -> its number; the ids of all pieces stand one after the other in flat."""
        self.cache: dict[str, int] = {}
        self.flat, self.counts, self.upto = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte offset of each token in its text."""
        sizes = self.lengths[ids]
        at = np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        has = counts > 0
        return at - np.repeat(at[first[has]], counts[has])

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        at = np.cumsum(sizes) - sizes
        return self.bytes[np.repeat(self.begins[ids] - at, sizes) + np.arange(total)].tobytes()


@lru_cache(2)
def vocabulary(raw: bytes, reserved: tuple[tuple[int, bytes], ...] = ()) -> Vocabulary:
    return Vocabulary(raw, dict(reserved))


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, about 1 MB: a vocabulary's size is fixed, so it may be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", with_offsets: bool = True) -> DataFrame:
    """key, ids array<int> and, on request, offsets array<int>: each token's first byte in the text's UTF-8 form."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    src = docs.select(F.col(key), F.col(text).alias("text"))
    kind = src.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value)
        ids, counts = v.encode(texts_of(batch.column(1)))
        cols = [batch.column(0), lists(ids, counts)]
        if with_offsets:
            cols.append(lists(v.offsets(ids, counts), counts))
        yield pa.RecordBatch.from_arrays(cols, [key, "ids", "offsets"][: len(cols)])

    return map_arrow(src, run, f"{key} {kind}, ids array<int>" + ", offsets array<int>" * with_offsets, 500_000)


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns named in keep, and decoded binary: the bytes of the ids, whole batches at a time."""
    raw = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    src = tokens.select(key, *keep, "ids")
    fields = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value)
        for batch in batches:
            for a, b in slices(np.diff(np.asarray(batch.column(len(keep) + 1).offsets)), 1_000_000):
                part = batch.slice(a, b - a)
                ids = part.column(len(keep) + 1)
                edges = np.asarray(ids.offsets).astype(np.int64)
                flat = np.asarray(ids.values)[edges[0] : edges[-1]]
                data = v.decode(flat)
                ends = np.concatenate([[0], np.cumsum(v.lengths[flat])])[edges - edges[0]]
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep) + 1], out], [key, *keep, "decoded"])

    return in_arrow(src, run, f"{fields}, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the decimal ids joined by a space, SHA-256 of the bytes that the ids decode to.

    Both directions run in one worker, a piece of a batch at a time, so that no task needs two."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value)
        ids, counts = v.encode(texts_of(batch.column(1)))
        data, sizes = v.decode(ids), np.concatenate([[0], np.cumsum(v.lengths[ids])])
        ends = sizes[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        decoded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, counts), decoded], ["doc_id", "ids", "decoded"])

    both = map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary", 500_000)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
