"""Quality rules and a classifier that speaks where they are silent.

The classifier is a logistic regression over hashed n-grams: words, pairs of words, and characters in runs of two to four.
A feature is an n-gram's share of its kind in the text, so that a text's length does not matter. Weights are learned from
labelled documents by distributed gradients; a fold that they are not learned from calibrates the probabilities. Texts are
scored whole, in Arrow batches, against a fixed threshold."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, in_arrow, map_arrow, stored, table

#: The classifier is fitted on about so many labelled documents at most, chosen by the hash of their ids.
MOST_LABELLED = 6_000
#: One in so many of them calibrates.
FOLDS = 5
#: A document stays with a calibrated probability of good quality of at least this.
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
KINDS, BITS = 5, 16
BUCKETS = KINDS << BITS
STEPS, RATE, DECAY = 20, 2.0, 1e-6
#: Tasks that share the sample, at most; each sends one gradient (BUCKETS numbers) a step.
TASKS = 6
#: Characters in one step of numpy.
PIECE = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MIX = np.uint32(0x9E3779B1)


def _hashed(values: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of a kind, by multiplication and shift."""
    mixed = (values ^ (values >> np.uint32(15))) * _MIX
    return (mixed >> np.uint32(32 - BITS)).astype(np.intp) + (kind << BITS)


def word_ids(found: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the distinct words in the order of these numbers."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
    return ids, list(numbers)


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words within windows of three that occur twice or more, the first occurrence included."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    again = np.zeros(len(ids), bool)
    for i in range(3):
        again[i : len(twice) + i] |= twice
    return int(again.sum())


def grams(raw: bytes, ids: np.ndarray, distinct: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Kinds and buckets of a text's n-grams, in pieces."""
    hashes = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[ids] if len(ids) else np.zeros(0, np.uint32)
    yield 0, _hashed(hashes, 0)
    yield 1, _hashed(hashes[:-1] * np.uint32(31) + hashes[1:], 1)
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    for start in range(0, len(points), PIECE):
        piece = points[start : start + PIECE + 3]
        run = piece
        for n in range(2, 5):
            run = run[: len(piece) - n + 1] * np.uint32(0x01000193) ^ piece[n - 1 :]
            yield n, _hashed(run[:PIECE], n)


def profile(raw: bytes, ids: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: buckets and shares."""
    pieces = [np.unique(buckets, return_counts=True) for _, buckets in grams(raw, ids, distinct)]
    some, at = np.unique(np.concatenate([b for b, _ in pieces]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([n for _, n in pieces]), len(some))
    kinds = some >> BITS
    return some.astype(np.int32), (counts / np.bincount(kinds, counts, KINDS)[kinds]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50))))

    def margin(self, raw: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
        sums, many = np.zeros(KINDS), np.zeros(KINDS)
        for kind, buckets in grams(raw, ids, distinct):
            sums[kind] += self.weights[buckets].sum(dtype=np.float64)
            many[kind] += len(buckets)
        return float(self.bias + (sums / np.maximum(many, 1)).sum())


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = []
    for raw in batch.column(0).cast(pa.binary()).to_pylist():
        out.append(profile(raw, *word_ids(raw.split())))
    buckets, shares = ([x[i].tobytes() for x in out] for i in (0, 1))
    yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["good", "calibrates", "buckets", "shares"])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled documents, MOST_LABELLED on average at most: good (0 to 1; the mean of an id's labels), calibrates."""
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg((F.col("quality") > 0).cast("double")).alias("good"))
    many = good.count()
    dealt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(1 << 20))
    some = good.where(dealt < int(min(1.0, MOST_LABELLED / max(many, 1)) * (1 << 20))).withColumnRenamed("doc_id", "of")
    # a bounded sample of ids (16 bytes each) meets the texts where they lie
    met = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("of")).where(F.col("text").isNotNull())
    calibrates = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(FOLDS)) == 0
    rows = map_arrow(met.select("text", "good", calibrates.alias("calibrates")), _features, "good double, calibrates boolean, buckets binary, shares binary", 1_000_000)
    return stored(rows.repartition(TASKS), "quality-sample")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, buckets and shares of a batch's features, and its labels."""
    buckets = [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()]
    row = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    return row, np.concatenate(buckets), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32), batch.column(0).to_numpy()


def _margins(model: Model, rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    row, buckets, shares, good = rows
    return model.bias + np.bincount(row, model.weights[buckets] * shares, minlength=len(good))


def trained(rows: DataFrame) -> Model:
    """Gradient steps with a rate of its own for each weight; the classes weigh the same. TASKS gradients at most meet the driver a step."""
    row = rows.where(~F.col("calibrates")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")).head()
    n, good = row["n"], row["good"]
    model = Model(np.zeros(BUCKETS, np.float32), 0.0)
    if not 0 < good < n:
        return model
    weigh = np.array([n / (2 * (n - good)), n / (2 * good)]) / n
    # a reader splits files as it likes, and each of its splits would send a gradient
    few = rows.where(~F.col("calibrates")).select("good", "buckets", "shares").coalesce(TASKS)
    seen, seen_bias = np.full(BUCKETS, 1e-12), 1e-12
    for _ in range(STEPS):

        def gradient(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total, bias, some = np.zeros(BUCKETS), 0.0, False
            for batch in batches:
                if batch.num_rows:
                    found, some = _rows(batch), True
                    y = found[3]
                    wrong = (1 / (1 + np.exp(-np.clip(_margins(model, found), -50, 50))) - y) * (weigh[0] * (1 - y) + weigh[1] * y)
                    total += np.bincount(found[1], wrong[found[0]] * found[2], minlength=BUCKETS)
                    bias += wrong.sum()
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["total", "bias"])

        parts = in_arrow(few, gradient, "total binary, bias double").collect()
        g = sum(np.frombuffer(p["total"], np.float32).astype(float) for p in parts) + DECAY * model.weights
        g_bias = sum(p["bias"] for p in parts)
        seen, seen_bias = seen + g * g, seen_bias + g_bias * g_bias
        model = Model((model.weights - RATE * g / np.sqrt(seen)).astype(np.float32), model.bias - 0.1 * RATE * g_bias / np.sqrt(seen_bias))
    return model


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Slope and shift of the probabilities, fitted to the fold that the weights were not learned from."""

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_margins(model, _rows(batch))), batch.column(0)], names=["margin", "good"])

    found = in_arrow(rows.where("calibrates").select("good", "buckets", "shares"), margins, "margin double, good double")
    # margins in steps of 0.05 meet the driver: as many rows as there are such values
    counted = found.groupBy((F.round(F.col("margin") * 20) / 20).alias("margin")).agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    x, good, n = (np.array([r[c] for r in counted], float) for c in ("margin", "good", "n"))
    if not len(x) or not 0 < good.sum() < n.sum():
        return model
    # targets a little inside 0 and 1, so that a fold without an error has a finite slope
    inside = (good * (good.sum() + 1) / (good.sum() + 2) + (n - good) / (n.sum() - good.sum() + 2)) / n
    fit = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ fit, -50, 50)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        fit = fit + np.clip(np.linalg.solve(hessian, design.T @ (n * (inside - p))), -1, 1)
    return Model(model.weights, model.bias, *map(float, fit)) if fit[0] > 0 else model


def learned(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The calibrated model, or None where labels of both kinds are missing."""
    rows = sample(docs, labels)
    model = trained(rows)
    model = calibrated(model, rows) if model.weights.any() else None
    dropped(rows)
    return model


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rules, probability and verdict for every row of columns doc_id, text; other columns are left out.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Edges: a null text has no words, as an empty one. Repeated rows are returned each. Without a model (no labels of both
    kinds) probability is null, and what the rules pass is kept. Long texts are taken whole, n-grams in pieces. An empty
    table gives an empty one."""

    def verdicts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for raw in batch.column(1).cast(pa.binary()).to_pylist():
            raw = raw or b""
            found = raw.split()  # at the bytes 9 to 13 and 32
            ids, distinct = word_ids(found)
            octets = np.frombuffer(raw, np.uint8)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            chars = len(octets) - int(((octets & 0xC0) == 0x80).sum()) - int(((octets == 32) | ((octets >= 9) & (octets <= 13))).sum())
            repeats = repeated_words(ids, len(distinct))
            failed = len(found) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(found)
            p = model.probability(model.margin(raw, ids, distinct)) if model else None
            out.append((len(found), chars, int(_SYMBOL[octets].sum()), len(lines) - len(set(lines)), repeats, failed, p, not failed and (p is None or p >= THRESHOLD)))
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"
    return map_arrow(docs.select("doc_id", "text"), verdicts, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned(docs, table(spark, sf_dir, "labels")))
