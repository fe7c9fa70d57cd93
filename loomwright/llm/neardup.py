"""Near-duplicate documents by improved consistent weighted sampling.

Texts become shingles of five words, weighted by TF-IDF: how often a text has the shingle, times the mean inverse
document frequency of its words. Word frequencies are counted over all documents in a hashed table of fixed size. Samples
of a text's weighted shingles are banded; what shares a band is verified by weighted Jaccard similarity.

Copies with equal words are one representative from the start. In each of LEADER_ROUNDS rounds a bucket's members are
compared with one leader; the next leader is one of those that no leader has linked yet, and meets the linked members
too. So large groups of copies are linked without pairing them with themselves. What is still apart in a bucket after
that, linked or not, meets by an exact join that loses no pair of THRESHOLD: two texts must share one of the shingles that
come first in an order common to all texts, rare ones first, and what follows it in each must suffice. In HEAD_ROUNDS
rounds the texts of a shingle first meet one of them, for which it comes early; all pairs are made only of classes that
this leaves apart. Classes are the connected components of the verified links.

Defined results: words are runs of ASCII letters and digits or non-ASCII characters, in lower case; a text of one to four
words is one shingle; a text that is null or has no word is a class of its own; a class is named by its smallest id, by
null if no member has one. Rows are told apart by id and text: those with null or repeated ids keep their texts, and each
class has one representative (or several equal rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_arrow, map_arrow, slices, stored, texts_of

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at exactly THRESHOLD shares no band with probability (1 - 0.8 ** 4) ** 20, about 3 in 100,000.
BANDS, ROWS = 20, 4
#: Leaders of a bucket before the exact join.
LEADER_ROUNDS = 2
#: Rounds in which the texts of a shingle meet one of them, before all pairs of the classes that are left do.
HEAD_ROUNDS = 2
#: Hashed counts that order shingles by how rare they are; any order loses nothing.
ORDER_BUCKETS = 1 << 18
#: Hashed counts of words: a count is that of the word and of the rare words that fall on it.
DF_BITS = 18
DF_BUCKETS = 1 << DF_BITS
#: Bytes of text that are hashed at a time.
SLICE = 500_000
#: Weights are rounded to 4 steps an octave, from 1/4 to 1/4 * 2 ** (LEVELS / 4).
LEVELS = 72
DRAWS = 1 << 13
#: Leaders that are held at once, and members of them in a group.
HEADS, SALT_ROWS = 64, 256
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 0x9E3779B97F4A7C15
    inverse = pow(p, -1, 1 << 64)
    up, down = np.full(n, p, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(1)
def _word_bytes() -> np.ndarray:
    return np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in order, and how many words each text has."""
    rows = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0" + b"\0".join(rows) + b"\0", np.uint8)
    inside = _word_bytes()[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    size = 1 << max(12, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    hashes = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
    first = np.cumsum([0, *(len(r) + 1 for r in rows)])
    return hashes, np.diff(np.searchsorted(begin, first))


def shingles(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts the distinct shingles: text << 48 | hash, in order, the weight's level, and how many each text has.

    At most 65,536 texts at a time."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - (ends - counts)[text]
    weight = idf[(hashes >> U(64 - DF_BITS)).astype(np.int64)]
    parts = []
    for n in range(1, SHINGLE + 1):
        at = np.flatnonzero(place + SHINGLE <= counts[text]) if n == SHINGLE else np.flatnonzero((counts[text] == n) & (place == 0))
        h, w = np.full(len(at), n, U), np.zeros(len(at))
        for i in range(n):
            h = h * U(0xD6E8FEB86659FD93) + hashes[at + i]
            w += weight[at + i]
        parts.append(((text[at].astype(U) << U(48)) | (_mix(h) >> U(16)), w / n))
    key, w = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key, w = key[new], w[new]
    level = np.clip(np.rint(4 * np.log2(w * times * 4)), 0, LEVELS - 1).astype(np.uint8) if len(key) else np.zeros(0, np.uint8)
    return key, level, np.bincount((key >> U(48)).astype(np.int64), minlength=len(counts))


def level_weights() -> np.ndarray:
    return 2.0 ** (np.arange(LEVELS) / 4) / 4


@lru_cache(1)
def draws() -> np.ndarray:
    """For each level and each of DRAWS triples (r, c, beta) of the sampling scheme, the order of its hash value, in the high 32 bits.

    With ln y = r (t - beta) and t = floor(ln S / r + beta), the value is c / (y e^r); it differs where t does, so a
    shingle whose weight changed much gives another sample."""
    g = np.random.Generator(np.random.PCG64(20240101))
    r, c, beta = g.gamma(2, 1, DRAWS), g.gamma(2, 1, DRAWS), g.random(DRAWS)
    t = np.floor(np.log(level_weights())[:, None] / r + beta)
    value = np.log(c) - r * (t - beta) - r
    ranks = np.clip((value + 600) * (2**32 / 1200), 0, 2**32 - 1).astype(U)
    return (ranks << U(32)).ravel()


def samples(key: np.ndarray, level: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent samples of each text that has shingles (a row for each)."""
    table = draws()
    h = _mix(key & U((1 << 48) - 1))
    base = level.astype(np.int64) * DRAWS
    begin = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((BANDS * ROWS, len(begin)), U)
    for i in range(BANDS * ROWS):
        x = h * U(2 * i + 0x9E3779B97F4A7C15)
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        value = table[base + (x >> U(64 - 13)).astype(np.int64)] | (x & U(0xFFFFFFFF))
        out[i] = np.minimum.reduceat(value, begin) if len(begin) else 0
    return out.T


def word_idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by hashed word, from all documents: DF_BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_BUCKETS + 1, np.int64)
        for batch in batches:
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0)), SLICE):
                hashes, counts = word_hashes(texts_of(batch.column(0).slice(a, b - a)))
                seen = np.unique(np.repeat(np.arange(len(counts)), counts) << DF_BITS | (hashes >> U(64 - DF_BITS)).astype(np.int64))
                bucket, n = np.unique(seen & (DF_BUCKETS - 1), return_counts=True)
                total[bucket] += n
            total[-1] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = in_arrow(docs.select("text"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DF_BUCKETS + 1)
    df[found["bucket"]] = found["n"]
    return np.log(2 + df[-1] / (1 + df[:-1])).astype(np.float64)


def signatures(docs: DataFrame, idf) -> DataFrame:  # noqa: ANN001  a broadcast
    """row, id, fp1 and fp2 (of the words in order), bands (null if the text has no word)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, counts = word_hashes(texts_of(batch.column(1)))
        some = counts > 0
        begin = np.cumsum(counts) - counts
        place = np.arange(len(hashes)) - np.repeat(begin, counts)
        fp = []
        for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
            x = _mix(hashes ^ _mix(place.astype(U) * U(salt) + U(salt)))
            total = np.zeros(len(counts), U)
            total[some] = np.add.reduceat(x, begin[some]) if some.any() else 0
            fp.append(pa.array(total.view(np.int64)))
        found = samples(*shingles(hashes, counts, idf.value)).reshape(-1, BANDS, ROWS)
        band = np.zeros(found.shape[:2], U)
        for i in range(ROWS):
            band = _mix(band * U(0xD6E8FEB86659FD93) + found[:, :, i] + U(i + 1))
        edges = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(edges, mask=np.append(~some, False)), pa.array(band.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *fp, bands], ["row", "id", "fp1", "fp2", "bands"])

    return map_arrow(docs, run, f"row bigint, id {docs.schema['id'].dataType.simpleString()}, fp1 bigint, fp2 bigint, bands array<bigint>", SLICE)


def shingle_sets(docs: DataFrame, idf) -> DataFrame:  # noqa: ANN001
    """id (that of a row), keys (sorted hashes of 48 bits, each with its weight's level in the lowest 8)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, level, counts = shingles(*word_hashes(texts_of(batch.column(1))), idf.value)
        packed = (key << U(16)) >> U(8) | level
        edges = np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int32)
        sets = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(packed.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "keys"])

    return map_arrow(docs, run, "id bigint, keys binary", SLICE)


def similarity(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    wa, wb = weights[(a & U(255)).astype(np.int64)], weights[(b & U(255)).astype(np.int64)]
    _, i, j = np.intersect1d(a >> U(8), b >> U(8), assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """leader, member for the pairs (leader, member, via) that are similar enough.

    Pairs with one `via` are verified in blocks: about HEADS leaders are held, and members are streamed past them, each
    with the leaders that it is paired with, so that a member's set is sent once for a block and not for each pair. A via
    may have any number of leaders and members: they are dealt out by chunk (leaders) and salt (members)."""
    sized = pairs.groupBy("via").agg(F.countDistinct("leader").alias("leaders"), F.countDistinct("member").alias("members"))
    sized = sized.select("via", F.ceil(F.col("leaders") / HEADS).alias("chunks"), F.ceil(F.col("members") / SALT_ROWS).alias("salts"))
    place = pairs.join(sized.repartition(F.xxhash64("via")), "via").withColumn("chunk", F.pmod(F.xxhash64("leader"), F.col("chunks")).cast("int"))
    salt = F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt")
    members = place.groupBy("via", "chunk", salt, F.col("member").alias("id")).agg(F.collect_list("leader").alias("leaders"))  # at most a chunk
    heads = place.select("via", "chunk", "leader", "salts").distinct().select("via", "chunk", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), F.col("leader").alias("id"))
    both = heads.withColumn("leaders", F.lit(None).cast("array<bigint>")).unionByName(members)
    keys = ["via", "chunk", "salt"]
    rows = both.join(sets, "id").repartition(*keys).sortWithinPartitions(*keys, F.col("leaders").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, at, held = level_weights(), None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            via, chunk, salt, ids, leaders, sets = (batch.column(c) for c in (*keys, "id", "leaders", "keys"))
            places = zip(via.to_pylist(), chunk.to_pylist(), salt.to_pylist())
            for i, (now, own_id, paired) in enumerate(zip(places, ids.to_pylist(), leaders.to_pylist())):
                if now != at:
                    at, held = now, {}
                own = np.frombuffer(sets[i].as_buffer(), U)
                if paired is None:
                    held[own_id] = own
                else:
                    found += [(x, own_id) for x in paired if similarity(held[x], own, weights) >= THRESHOLD]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["leader", "member"])

    return in_arrow(rows.select(*keys, "id", "leaders", "keys"), run, "leader bigint, member bigint")


def components(links: DataFrame) -> DataFrame:
    """id, class for every end of a link: the smallest id that links lead to; labels are written once a round."""
    edges = stored(links.select(F.col("leader").alias("a"), F.col("member").alias("b")).union(links.select("member", "leader")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        step = labels.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("id").alias("class"), F.col("class").alias("root"))
        now = stored(step.join(jump, "class", "left").select("id", "was", F.least("class", F.coalesce("root", "class")).alias("class")), "labels")
        changed = not now.where("was <> class").isEmpty()
        dropped(labels)
        labels = now.select("id", "class")
        if not changed:
            dropped(edges)
            return labels


def shingle_order(sets: DataFrame) -> np.ndarray:
    """How many texts have a shingle, by its hash: ORDER_BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for keys in batch.column(0):
                np.add.at(total, (np.frombuffer(keys.as_buffer(), U) >> U(8)).astype(np.int64) % ORDER_BUCKETS, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = in_arrow(sets.select("keys"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ORDER_BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, order) -> DataFrame:  # noqa: ANN001  a broadcast
    """id, class, weight, shingle, rest, first: the shingles one of which a text must share with a similar one.

    Of two texts with weights a <= b, similar ones have at least t / (1 + t) * (a + b) in common, so 2t / (1 + t) of a and t
    of b. If they share nothing among each one's first shingles, all they share comes after these in one of the two, and
    weighs less than that. `rest` is what weighs the text from a shingle on: all that two texts share comes from their first
    shared shingle on. `first` marks the shorter list, which counts for the lighter text."""
    short, long = 2 * THRESHOLD / (1 + THRESHOLD) - 1e-9, THRESHOLD - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = level_weights()
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part, sizes, sums, found, rests = batch.slice(a, 2000), [], [], [], []
                for keys in part.column(2):
                    own = np.frombuffer(keys.as_buffer(), U)
                    shingle, w = own >> U(8), weights[(own & U(255)).astype(np.int64)]
                    at = np.lexsort((shingle, order.value[shingle.astype(np.int64) % ORDER_BUCKETS]))
                    total = w.sum()
                    rest = total - np.concatenate([[0], np.cumsum(w[at])[:-1]])
                    n = int((rest >= long * total).sum())
                    sizes.append(n)
                    sums.append(total)
                    found.append(shingle[at[:n]].astype(np.int64))
                    rests.append(rest[:n])
                at, weight, rest = np.repeat(np.arange(part.num_rows), sizes), np.repeat(sums, sizes), np.concatenate(rests)
                columns = [part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), *(pa.array(x) for x in (weight, np.concatenate(found), rest, rest >= short * weight))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "class", "weight", "shingle", "rest", "first"])

    return in_arrow(sets.select("id", "class", "keys"), run, "id bigint, class bigint, weight double, shingle bigint, rest double, first boolean")


def mixed_prefixes(shared: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """prefixes() of the texts whose bucket has more than one class."""
    rows = classed(shared.withColumnRenamed("rep", "id"), labels)
    mixed = rows.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    ids = rows.join(mixed.repartition("low"), ["band", "key"]).select("id", "class").distinct()
    some = stored(sets.join(ids, "id"), "apart")
    order = shared.sparkSession.sparkContext.broadcast(shingle_order(some))  # bounded: ORDER_BUCKETS numbers
    found = stored(prefixes(some, order), "prefixes")
    dropped(some)
    return found


def classed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (id) with their class of now: a text without a link is its own."""
    return rows.drop("class").join(labels, "id", "left").withColumn("class", F.coalesce("class", "id"))


def _enough(weights: tuple[Column, Column], rests: tuple[Column, Column]) -> Column:
    """Whether two texts can have so much in common as similar ones need, if a shingle is the first that they share."""
    need = THRESHOLD / (1 + THRESHOLD) * (weights[0] + weights[1]) - 1e-6
    return (rests[0] >= need) & (rests[1] >= need)


def head_pairs(found: DataFrame, k: int) -> DataFrame:
    """leader, member, via: the texts of each shingle with one of them, another in each round k; no more rows than found has."""
    # one for which the shingle comes early, so that many others can be similar to it
    chosen = F.max_by(F.struct("id", "class", "weight", "rest"), F.struct(F.floor(F.col("rest") / F.col("weight") * 32), F.xxhash64("id", F.lit(k))))
    heads = found.groupBy("shingle").agg(chosen.alias("h"), F.count("*").alias("n")).where("n > 1").select("shingle", *[F.col(f"h.{c}").alias(f"head_{c}") for c in ("id", "class", "weight", "rest")])
    # dealt anew, so that a shingle of many texts can be split in the join
    met = found.join(heads.repartition("head_id"), "shingle").where(F.col("class") != F.col("head_class"))
    alike = F.least("weight", "head_weight") >= (THRESHOLD - 1e-9) * F.greatest("weight", "head_weight")
    close = alike & _enough((F.col("weight"), F.col("head_weight")), (F.col("rest"), F.col("head_rest")))
    return met.where(close).groupBy(F.col("head_id").alias("leader"), F.col("id").alias("member")).agg(F.min("shingle").alias("via"))


def all_pairs(found: DataFrame) -> DataFrame:
    """leader, member, via (a shingle that both have): all pairs of two classes that may be similar."""
    light = found.where("first").select("shingle", *[F.col(c).alias(f"light_{c}") for c in ("id", "class", "weight", "rest")])
    # of the lighter and the heavier text; equal ones by id
    close = (F.col("class") != F.col("light_class")) & (F.struct("light_weight", "light_id") < F.struct("weight", "id")) & (F.col("light_weight") >= (THRESHOLD - 1e-9) * F.col("weight"))
    enough = _enough((F.col("light_weight"), F.col("weight")), (F.col("light_rest"), F.col("rest")))
    return light.join(found, "shingle").where(close & enough).groupBy(F.col("light_id").alias("leader"), F.col("id").alias("member")).agg(F.min("shingle").alias("via"))


def apart(shared: DataFrame, labels: DataFrame, sets: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """all_pairs() of the texts whose bucket has more than one class; found: their mixed_prefixes(), if they are known."""
    now = stored(classed(mixed_prefixes(shared, labels, sets) if found is None else found, labels), "classed")
    pairs = stored(all_pairs(now), "apart-pairs")
    dropped(now)
    return pairs


def row_key(key: str, text: str) -> "F.Column":
    """What tells rows apart: a hash of id and text, as ids may be null or repeated."""
    return F.xxhash64(F.col(key), F.col(text))


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, doc_id, class_id, representative for each document."""
    spark = docs.sparkSession
    src = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text"), F.col(key).alias("id"))
    idf = spark.sparkContext.broadcast(word_idf(src))  # bounded: DF_BUCKETS numbers
    every = stored(signatures(src, idf), "signatures")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    reps = stored(every.where("bands is not null").groupBy("fp1", "fp2", "bands").agg(F.min(name).alias("name")).select("fp1", "fp2", "bands", F.col("name.row").alias("rep"), "name"), "representatives")
    live = reps.select("rep", F.posexplode("bands").alias("band", "key"), F.lit(True).alias("open"))
    links: DataFrame | None = None
    tested: DataFrame | None = None
    shared = sets = None
    done: list[DataFrame] = []
    for k in range(LEADER_ROUNDS):
        heads = live.groupBy("band", "key").agg(F.min(F.when(F.col("open"), F.col("rep"))).alias("leader"), F.count("*").alias("n")).where("leader is not null and n > 1").drop("n")
        # dealt anew, so that a bucket of many members can be split in the join
        led = live.join(heads.repartition("leader"), ["band", "key"])
        led = stored(led if shared is None else led.where("rep <> leader"), f"led{k}")
        done.append(led)
        if led.isEmpty():
            break
        if shared is None:
            shared, led = led.select("band", "key", "rep"), led.where("rep <> leader")
        pairs = led.select("leader", F.col("rep").alias("member")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["leader", "member"], "left_anti"), f"pairs{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        done.append(pairs)
        if sets is None:  # later rounds have no other members
            ids = shared.select(F.col("rep").alias("row")).distinct()
            # texts are dealt by row at every size; only ids are hashed, and no text is sorted
            wanted = src.join(ids.hint("shuffle_hash"), "row", "left_semi")
            made = shingle_sets(wanted, idf)
            # repeated rows have equal sets; sets are sorted to find them only where a row is repeated
            repeated = not every.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
            sets = stored(made.dropDuplicates(["id"]) if repeated else made, "sets")
            done.append(sets)
        new = verified(pairs.withColumn("via", F.col("leader")), sets)
        links = stored(new if links is None else links.unionByName(new), f"links{k}")
        done.append(links)
        linked = links.select("leader", F.col("member").alias("rep"), F.lit(True).alias("linked"))
        live = led.join(linked, ["leader", "rep"], "left").withColumn("open", F.col("open") & F.col("linked").isNull()).drop("leader", "linked")
    own = every.join(reps.select("fp1", "fp2", "rep", "name"), ["fp1", "fp2"], "left").withColumn("none", F.col("bands").isNull())
    own = own.select("row", "id", F.when(F.col("none"), F.col("row")).otherwise(F.col("rep")).alias("rep"), F.when(F.col("none"), name).otherwise(F.col("name")).alias("name"))
    if links is not None:
        labels = components(links)
        found = mixed_prefixes(shared, labels, sets)
        done.append(found)
        # one text of each shingle first: what its texts' links join needs no pairs of its own; then all pairs that are left
        for k in range(HEAD_ROUNDS + 1):
            more = stored(head_pairs(classed(found, labels), k), "head-pairs") if k < HEAD_ROUNDS else apart(shared, labels, sets, found)
            done.append(more)
            if not more.isEmpty():
                links = stored(links.unionByName(verified(more, sets)), "links")
                done.append(links)
                dropped(labels)
                labels = components(links)
        labels = labels.withColumnRenamed("id", "rep")
        names = reps.select("rep", "name").join(labels, "rep").groupBy("class").agg(F.min("name").alias("first"))
        named = stored(labels.join(names, "class").select("rep", "first"), "named")
        done.append(labels)
        own = own.join(named, "rep", "left").withColumn("name", F.coalesce("first", "name"))
    for df in done:
        dropped(df)
    return own.select("row", F.col("id").alias("doc_id"), F.col("name.id").alias("class_id"), (F.col("row") == F.col("name.row")).alias("representative"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id, representative (whether it names the class)."""
    return _classes(docs, key, text).drop("row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one that names it; of rows with one doc_id and text, one."""
    keep = stored(_classes(docs, "doc_id", "text").where("representative").groupBy("row").agg(F.count("*").alias("n")), "keep")
    # dealt by row at every size, as in classes()
    kept = docs.withColumn("row of text", row_key("doc_id", "text")).join(keep.select(F.col("row").alias("row of text")).hint("shuffle_hash"), "row of text", "left_semi")
    # texts are sorted to find repeated rows only where one is repeated
    return (kept if keep.where("n > 1").isEmpty() else kept.dropDuplicates(["row of text"])).select(*[F.col(f"`{c}`") for c in docs.columns])
