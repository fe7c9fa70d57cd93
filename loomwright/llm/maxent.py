"""Language-model scoring with a hashed maximum-entropy model.

Words have leaves of a two-level tree, CLASSES classes of WITHIN leaves, ordered by frequency: the most frequent OWN - 1
words and the end of a text a leaf of their own, the rest by a hash of how they begin. A token's probability is
P(class | context) P(leaf | class, context) P(word | leaf): two softmaxes over the factored tree, and absolute
discounting within a leaf, where all unknown words together are one more word.

A context is the two leaves before a token. Its features are hashed: the leaf before (n-gram), the leaf before that (skip)
and both (n-gram). Each feature has a row of scores for the classes and, hashed together with a class, a row for the
leaves in it, so that a context reads a few rows whatever the number of words.

Texts are split into tokens once, where they lie: a chunk of documents keeps its distinct words and its texts as numbers
of these, and all later steps work on the numbers. All training texts are counted: words exactly, and what followed each
context in pieces, which meet by a hash of the context, so that each context of the corpus is trained once a round however
often it occurs. The softmaxes start at a model of the leaf before, in closed form, and are trained by distributed gradient
updates: each task sums what its contexts expect, Spark sums these vectors (of fixed size) in blocks. Scoring takes the
distinct contexts of a chunk once each.

Words meet their corpus counts per chunk, so that a frequent word is one row for each chunk and no vocabulary is ever in
one place. Defined results: a null text is one end token; repeated and null ids are rows like any other, each scored;
columns other than id and text are left out; with nothing to learn from, every token is unknown and the leaves are equally
likely; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, held_out, in_arrow, released, slices, stored, texts_of

CLASSES, WITHIN = 32, 64
LEAVES = CLASSES * WITHIN
#: Leaves of one word: the end of a text, and the most frequent words.
OWN = LEAVES - 256
#: Rows of scores for classes: no feature, the leaf before, the leaf before that, and hashed pairs.
PAIRS = 1 << 13
TOP_ROWS = 1 + 2 * LEAVES + PAIRS
#: Rows of scores within classes: no feature, and features hashed together with the class.
HASHED = 1 << 14
LOW_ROWS = CLASSES + HASHED
ROUNDS = 2
RATE = 0.6
#: Counts that a weight is held back by.
HOLD = 3.0
DISCOUNT = 0.75
CHUNK_BYTES = 6_000_000
#: Rows of packed numbers in a file: a reader may hold all of them.
PACKED_A_FILE = 12
PIECE_TOKENS = 2_000_000
BATCH_ROWS = 200_000
CONTEXTS = 8_000
BLOCK = 8192
END = ""


def words(text: str) -> list[bytes]:
    """Lower case for A-Z, split at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers: first all their lowest bytes, then all the next, which compress well, as far as any is not 0."""
    planes = np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T
    return planes[: max(1, -(-int(x.max(initial=0)).bit_length() // 8))].tobytes()


def unpacked(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    planes = np.frombuffer(b, np.uint8).reshape(-1, size)
    out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


def chunked(docs: DataFrame) -> DataFrame:
    """doc_ids, held_out, n_tokens, ids, words, of doc_id, held_out, text: a row for about CHUNK_BYTES of texts. The ids are
    numbers of words, each text's with its end; each word has its count in training texts."""

    def chunk(rows: list[pa.RecordBatch], found: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        held = whole.column("held_out").to_numpy()
        lengths = np.array([len(x) for x in found], np.int32)
        ids = np.concatenate(found)
        often = np.argsort(-np.bincount(ids, minlength=len(names)), kind="stable")
        number = np.empty(len(names), np.int32)
        number[often] = np.arange(len(names), dtype=np.int32)
        ids = number[ids]
        n = np.bincount(ids[~np.repeat(held, lengths)], minlength=len(names))
        spelt = pa.array([names[i] for i in often.tolist()], pa.binary()).cast(pa.string())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [one(whole.column("doc_id").combine_chunks()), one(pa.array(held)), one(pa.array(lengths)), pa.array([packed(ids)], pa.binary()), one(pa.StructArray.from_arrays([spelt, pa.array(n, pa.int64())], ["word", "n"]))]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["doc_ids", "held_out", "n_tokens", "ids", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple[list[pa.RecordBatch], list[np.ndarray], defaultdict[bytes, int], int]:
            index: defaultdict[bytes, int] = defaultdict()
            index.default_factory = index.__len__  # a new word has the next number
            index[b""] = 0  # the end
            return [], [], index, 0

        rows, found, index, size = fresh()
        for batch in batches:
            sizes = 50 + np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64)
            for a, b in slices(sizes, CHUNK_BYTES // 8):
                part = batch.slice(a, b - a)
                rows.append(part.select(["doc_id", "held_out"]).take(pa.array(range(b - a))))  # a copy: a slice would keep the texts
                for t in texts_of(part.column("text")):
                    ws = words(t)
                    ws.append(b"")
                    found.append(np.fromiter(map(index.__getitem__, ws), np.int32, len(ws)))
                size += int(sizes[a:b].sum())
                if size >= CHUNK_BYTES:
                    yield chunk(rows, found, list(index))
                    rows, found, index, size = fresh()
        if rows:
            yield chunk(rows, found, list(index))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs, run, f"doc_ids array<{kind}>, held_out array<boolean>, n_tokens array<int>, ids binary, words array<struct<word: string, n: bigint>>")


def leaf_of(word: bytes, own: dict[bytes, int]) -> int:
    return own.get(word, OWN + zlib.crc32(word[:2]) % (LEAVES - OWN))


class Model(NamedTuple):
    """Scores of classes and of leaves within classes; or counts, in the same places."""

    top: np.ndarray
    low: np.ndarray

    @classmethod
    def zero(cls, kind: type = np.float64) -> Model:
        return cls(np.zeros((TOP_ROWS, CLASSES), kind), np.zeros((LOW_ROWS, WITHIN), kind))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.top.ravel(), self.low.ravel()])


def _hash(x: np.ndarray, salt: int, rows: int) -> np.ndarray:
    mixed = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % rows


def top_features(context: np.ndarray) -> list[np.ndarray]:
    """The rows of contexts (leaf before * LEAVES + leaf before that) but for row 0, which all have."""
    last, skip = context // LEAVES, context % LEAVES
    return [1 + last, 1 + LEAVES + skip, 1 + 2 * LEAVES + _hash(context, 0, PAIRS)]


def low_features(context: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """The same within a class, where row `of` is the one that all contexts have."""
    last, skip = context // LEAVES, context % LEAVES
    return [CLASSES + _hash(x * CLASSES + of, salt, HASHED) for salt, x in ((1 << 50, last), (1 << 51, skip), (1 << 52, context))]


def _gathered(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The sum of a few rows of a table for each context."""
    out = table[rows[0]]
    for r in rows[1:]:
        out += table[r]
    return out


def _class_scores(model: Model, context: np.ndarray) -> np.ndarray:
    out = _gathered(model.top, top_features(context))
    out += model.top[0]
    return out


def _leaf_scores(model: Model, context: np.ndarray, of: np.ndarray) -> np.ndarray:
    return _gathered(model.low, [of, *low_features(context, of)])


def _softmax(score: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probabilities times a count for each row; works in place."""
    score -= score.max(1, keepdims=True)
    np.exp(score, out=score)
    score *= (total / score.sum(1))[:, None]
    return score


def _chosen(score: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Logs of probabilities at some places."""
    most = score.max(1)
    at = score[row, column] - most[row]
    score -= most[:, None]
    np.exp(score, out=score)
    return at - np.log(score.sum(1))[row]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = _starts(rows)
    table[rows[at]] += np.add.reduceat(values[order], at)


def observe(into: Model, context: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> None:
    """Adds how often each class and leaf came with each feature."""
    of = leaf // WITHIN
    for table, features, target in ((into.top, [np.zeros_like(context), *top_features(context)], of), (into.low, [of, *low_features(context, of)], leaf % WITHIN)):
        for rows in features:
            np.add.at(table.reshape(-1), rows * table.shape[1] + target, n.astype(table.dtype))


def expect(into: Model, model: Model, context: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> None:
    """Adds how often the model expects them; rows are sorted by context, leaf. Observed less expected is the gradient
    of the log likelihood."""
    at = _starts(context)
    total = np.add.reduceat(n, at).astype(model.top.dtype)
    for i in range(0, len(at), CONTEXTS):
        some = context[at[i : i + CONTEXTS]]
        p = _softmax(_class_scores(model, some), total[i : i + CONTEXTS])
        into.top[0] += p.sum(0)
        for rows in top_features(some):
            _add_rows(into.top, rows, p)
    of = leaf // WITHIN
    at = _starts(context * CLASSES + of)
    total = np.add.reduceat(n, at).astype(model.low.dtype)
    for i in range(0, len(at), CONTEXTS):
        rows = at[i : i + CONTEXTS]
        p = _softmax(_leaf_scores(model, context[rows], of[rows]), total[i : i + CONTEXTS])
        for rows in [of[rows], *low_features(context[rows], of[rows])]:
            _add_rows(into.low, rows, p)


def start(seen: Model) -> Model:
    """The model of the leaf before, in closed form from what was observed."""
    model = Model.zero()
    for weights, count, bias, last in ((model.top, seen.top, slice(0, 1), slice(1, 1 + LEAVES)), (model.low, seen.low, slice(0, CLASSES), None)):
        smooth = count[bias] + 0.5
        weights[bias] = np.log(smooth)
        if last:
            share = smooth / smooth.sum(1, keepdims=True)
            some = count[last].sum(1) > 0
            part = count[last][some]
            weights[last][some] = np.log((part + 20 * share) / (part.sum(1, keepdims=True) + 20) / share)
    return model


def stepped(model: Model, seen: Model, expected: Model) -> Model:
    """A gradient step, scaled for each weight by its curvature as the mean of observed and expected counts."""
    return Model(*(w + RATE * (o - e) / ((o + e) / 2 + HOLD) for w, o, e in zip(model, seen, expected)))


def log10s(model: Model, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 of P(class | context) P(leaf | class, context) for each token; equal contexts are computed once."""
    key = context * LEAVES + leaf
    order = np.argsort(key)
    context, of, inner = context[order], leaf[order] // WITHIN, leaf[order] % WITHIN
    out = np.empty(len(key))
    for scores, group, column in ((lambda at: _class_scores(model, context[at]), context, of), (lambda at: _leaf_scores(model, context[at], of[at]), context * CLASSES + of, inner)):
        edges = np.append(_starts(group), len(group))
        for i in range(0, len(edges) - 1, CONTEXTS):
            ends = edges[i : i + CONTEXTS + 1]
            a, b = ends[0], ends[-1]
            logs = _chosen(scores(ends[:-1]), np.repeat(np.arange(len(ends) - 1), np.diff(ends)), column[a:b])
            out[order[a:b]] = logs if column is of else out[order[a:b]] + logs
    return out / np.log(10)


def contexts(leaves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token: leaf before * LEAVES + leaf before that. Leaf 0, an end, stands twice before a text."""
    out = np.zeros(len(leaves), np.int64)
    out[1:] = leaves[:-1] * LEAVES
    out[2:] += leaves[:-2]
    out[first] = 0
    return out


def _leaves_of(names: list[str], own: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((leaf_of(w.encode(), own) for w in names), np.int64, len(names))


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n."""
    if n is None:
        key = np.sort(key)
        at = _starts(key)
        return key[at], np.diff(np.append(at, len(key)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _starts(key)
    return key[at], np.add.reduceat(n[order], at) if len(at) else n


def followers(chunks: DataFrame, own: dict[bytes, int], tokens: int) -> DataFrame:
    """What followed each context in training texts: rows of `size` packed contexts, leaves, n, sorted; each pair of context
    and leaf once. Counted in pieces where the chunks lie, which then meet by a hash of the context."""
    blocks = max(1, -(-tokens // PIECE_TOKENS))
    schema = "size int, context binary, leaf binary, n binary"

    def rows(key: np.ndarray, n: np.ndarray, edges: np.ndarray) -> dict[str, pa.Array]:
        columns = {c: pa.array([packed(x[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()) for c, x in (("context", key // LEAVES), ("leaf", key % LEAVES), ("n", n))}
        return {"size": pa.array(np.diff(edges), pa.int32())} | columns

    def piece(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = _counted(np.concatenate(keys))
        block = _hash(key // LEAVES, 1 << 53, blocks)
        order = np.argsort(block, kind="stable")
        block = block[order]
        edges = np.append(_starts(block), len(block))
        return pa.RecordBatch.from_pydict({"block": pa.array(block[edges[:-1]], pa.int32())} | rows(key[order], n[order], edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                held, lengths = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("held_out", "n_tokens"))
                leaves = _leaves_of(batch.column("words")[i].values.to_pylist(), own)[unpacked(batch.column("ids")[i].as_py(), int(lengths.sum()))]
                keys.append((contexts(leaves, np.cumsum(lengths) - lengths) * LEAVES + leaves)[~np.repeat(held, lengths)])
                size += len(keys[-1])
                if size >= PIECE_TOKENS:
                    yield piece(keys)
                    keys, size = [], 0
        if size:
            yield piece(keys)

    def merged(found: pa.Table) -> pa.Table:
        pairs = zip(*(found.column(c).to_pylist() for c in ("size", "context", "leaf", "n")))
        keys, ns = zip(*((unpacked(context, size) * LEAVES + unpacked(leaf, size), unpacked(n, size)) for size, context, leaf, n in pairs))
        key, n = _counted(np.concatenate(keys), np.concatenate(ns))
        out = pa.table(rows(key, n, np.append(np.arange(0, len(key), BATCH_ROWS), len(key))))
        released()
        return out

    parts = in_arrow(chunks.select("held_out", "n_tokens", "ids", F.col("words.word").alias("words")), run, f"block int, {schema}")
    return parts.groupBy("block").applyInArrow(merged, schema)


def _summed(table: DataFrame, add) -> Model:
    """The sum over all tasks of what `add` puts into a model's places: each task sends blocks that are not zero, which Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = Model.zero()
        for batch in batches:
            for size, *row in zip(*(batch.column(c) for c in ("size", "context", "leaf", "n"))):
                add(into, *(unpacked(x.as_py(), size.as_py()) for x in row))
        flat = into.flat().astype(np.float32)
        blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
        some = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "part"])

    def total(rows: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(b, np.float32).astype(float) for b in rows.column("part").to_pylist())
        return pa.table({"block": rows.column("block").slice(0, 1), "part": pa.array([out.tobytes()], pa.binary())})

    # as many vectors as the cluster has cores, however many files there are
    few = table.coalesce(table.sparkSession.sparkContext.defaultParallelism)
    sums = in_arrow(few, run, "block int, part binary").groupBy("block").applyInArrow(total, "block int, part binary")
    flat = np.zeros(TOP_ROWS * CLASSES + LOW_ROWS * WITHIN)
    for r in sums.collect():  # bounded: the places of one model
        part = np.frombuffer(r["part"])
        flat[r["block"] * BLOCK :][: len(part)] = part
    cut = TOP_ROWS * CLASSES
    return Model(flat[:cut].reshape(TOP_ROWS, CLASSES), flat[cut:].reshape(LOW_ROWS, WITHIN))


def trained(table: DataFrame) -> Model:
    """The model of a table of packed context, leaf, n, each of whose rows is sorted."""
    seen = _summed(table, observe)
    if not seen.top.any():
        return Model.zero(np.float32)
    model = start(seen)
    for _ in range(ROUNDS):
        now = table.sparkSession.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in model)))  # bounded: the places of one model
        model = stepped(model, seen, _summed(table, lambda into, c, leaf, n, now=now: expect(into, now.value, c, leaf, n)))
        now.destroy()
    return Model(*(x.astype(np.float32) for x in model))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score; both scores in log10."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("doc_id"), held_out(key, 7).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = stored(chunked(src).withColumn("chunk", F.monotonically_increasing_id()), "chunks", PACKED_A_FILE)
    # a word's count meets its chunks in one shuffle: a word is one row of a chunk, and is written out in the first only
    same = Window.partitionBy("word")
    lists = chunks.select("chunk", F.posexplode("words").alias("pos", "of")).select("chunk", "pos", "of.word", "of.n")
    met = lists.select("chunk", "pos", F.sum("n").over(same).alias("c"), F.when(F.min("chunk").over(same) == F.col("chunk"), F.col("word")).alias("word"))
    met = stored(met, "words")
    counts = met.where("word is not null and c > 0").select("word", "c")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = row["n"], row["v"]
    frequent = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(OWN - 1).collect()
    own = {b"": 0} | {r["word"].encode(): i + 1 for i, r in enumerate(frequent)}
    sizes = np.zeros((2, LEAVES))
    known = F.broadcast(spark.createDataFrame([(w.decode(), i) for w, i in own.items()], "word string, own int"))  # bounded: OWN rows
    tail = F.lit(OWN) + F.crc32(F.substring(F.col("word").cast("binary"), 1, 2)) % (LEAVES - OWN)
    for r in counts.join(known, "word", "left").groupBy(F.coalesce("own", tail.cast("int")).alias("leaf")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sizes[:, r["leaf"]] = r["n"], r["v"]
    table = stored(followers(chunks, own, n), "followers", PACKED_A_FILE)
    trained_model = trained(table)
    dropped(table)
    model = spark.sparkContext.broadcast((own, sizes, trained_model))  # bounded: the places of one model

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own, sizes, model_ = model.value
        names = left.column("words")[0].values.to_pylist()
        c = np.zeros(len(names), np.int64)
        c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
        leaf = _leaves_of(names, own)
        del names
        many, kinds = sizes[0][leaf], sizes[1][leaf]
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(c > 0, np.log10((c - DISCOUNT) / many), np.where(many > 0, np.log10(DISCOUNT * kinds / many), 0.0))
        inner[leaf < len(own)] = 0.0  # a leaf of one word
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        lengths = left.column("n_tokens")[0].values.to_numpy()
        at = unpacked(left.column("ids")[0].as_py(), int(lengths.sum()))
        size = len(lengths)
        first = np.cumsum(lengths) - lengths
        by_text = lambda x: np.add.reduceat(x, first)
        s = inner[at] + log10s(model_, contexts(leaf[at], first), leaf[at])
        out = pa.table({
            "doc_id": left.column("doc_ids")[0].values, "held_out": left.column("held_out")[0].values, "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(by_text((c[at] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([n] * size, pa.int64()), "base_score": pa.array(by_text(base[at]), pa.float64()), "score": pa.array(by_text(s), pa.float64()),
        })
        released()
        return out

    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    numbers = chunks.select("chunk", "doc_ids", "held_out", "n_tokens", "ids", F.col("words.word").alias("words"))
    return numbers.groupBy("chunk").cogroup(met.where("c > 0").select("chunk", "pos", "c").groupBy("chunk")).applyInArrow(score, schema)
