"""Language identification by rank-order profiles.

A language's profile ranks its most frequent letter n-grams (1 to 3, word ends marked). A document's own ranking is
compared with each profile by the out-of-place distance: the sum over the document's n-grams of how far their ranks are
apart, or a fixed maximum where the profile lacks one. Profiles are counted over all rows to learn from.

Defined results: a text that is null or has no letter (combining marks alone are none) is `und` with score 0, as is every
text if there is nothing to learn from; equal counts rank by n-gram code, equal distances by language name; rows whose
language is null teach nothing. Repeated rows count, and are answered, each. Texts of any length are read whole, a piece of
a batch at a time. Columns of docs other than the key, text and language are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, held_out, map_arrow, stored, texts_of

#: n-grams in a profile and in a document's ranking.
PROFILE = 400
#: Longer profiles than this would mean that the language column is no language column.
MAX_LANGUAGES = 2_000
SALTS = 16
#: Bytes of text that are counted at a time: a worker holds some forty times as much.
SLICE = 500_000


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point itself for letters and marks, 0 for the rest."""
    out = np.zeros(0x110000, np.uint32)
    i = np.array([i for i in range(0x32400) if unicodedata.category(chr(i))[0] in "LM"])
    out[i] = i
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct n-grams with their counts: number of the text, code of the n-gram, count; sorted by the first two.

    A code holds three letters of 21 bits, 0 at a word's end or where the n-gram is shorter; bit 63 marks three letters.
    """
    low = ("\0" + "\0".join(texts) + "\0").lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(points == 0) if not any("\0" in t for t in texts) else np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])
    c = letters()[points]
    # the few distinct letters of a batch become small numbers, so that an n-gram of a text is one small integer
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    small = np.zeros(0x110000, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    c = small[c]
    row = np.repeat(np.arange(len(texts)), np.diff(breaks))
    a, b, d, row = c[:-2], c[1:-1], c[2:], row[: len(c) - 2]
    size = len(alphabet)
    wide = alphabet.astype(np.uint64)
    middle = np.flatnonzero(b > 0)
    a, b, d, row = a[middle], b[middle], d[middle], row[middle]
    out = []
    for key, code in (
        (row * size + b, lambda k: wide[k]),
        ((row * size + a) * size + b, lambda k: wide[k // size] << np.uint64(21) | wide[k % size] | np.uint64(1 << 62)),
        (((row * size + a) * size + b) * size + d, lambda k: wide[k // size**2] << np.uint64(42) | wide[k // size % size] << np.uint64(21) | wide[k % size] | np.uint64(1 << 63)),
    ):
        each = size ** (len(out) + 1)
        if each * len(texts) <= 4 * len(key) + 65536:
            n = np.bincount(key, minlength=0)
            key = np.flatnonzero(n)
            n = n[key]
        else:
            key = np.sort(key)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(key)))
            key = key[first]
        out.append((key // each, code(key % each), n))
    r, g, n = (np.concatenate(x) for x in zip(*out))
    return r, g, n


def learned(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The profile of each language: codes of its PROFILE most frequent n-grams, best first."""
    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, lang = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        r, g, n = ngrams(texts_of(batch.column(1)))
        codes, inverse = np.unique(g, return_inverse=True)
        total = np.bincount(lang[r] * max(1, len(codes)) + inverse, n, len(names) * len(codes)) if len(g) else np.zeros(0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[some // max(1, len(codes))].tolist(), pa.string()), pa.array(codes[some % max(1, len(codes))].view(np.int64)), pa.array(total[some].astype(np.int64))], ["lang", "gram", "n"]
        )

    counts = map_arrow(src, run, "lang string, gram bigint, n bigint", SLICE).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each salt, then the best of all: no window holds more than SALTS * PROFILE rows or one salt's n-grams
    first = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= PROFILE)
    best = stored(salted.select("lang", "gram", "n"), "profiles")
    if best.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = best.withColumn("k", F.row_number().over(last)).where(F.col("k") <= PROFILE).select("lang", "gram", "k").toPandas()  # at most MAX_LANGUAGES x PROFILE
    dropped(best)
    return {str(name): x.sort_values("k")["gram"].to_numpy(np.int64) for name, x in rows.groupby("lang", sort=True)}


def predicted(texts: list[str], names: list[str], codes: np.ndarray, ranks: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ranks: for each code (sorted) and language its rank, PROFILE where it is missing."""
    n_texts = len(texts)
    if not names:
        return ["und"] * n_texts, np.zeros(n_texts)
    r, g, n = ngrams(texts)
    order = np.lexsort((g, -n, r))
    r, g = r[order], g[order]
    counts = np.bincount(r, minlength=n_texts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(r)) - first[r]
    keep = place < PROFILE
    r, g, place = r[keep], g[keep], place[keep]
    at = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
    known = codes[at] == g
    far = np.full((len(r), len(names)), PROFILE, np.int32)
    there = ranks[at[known]]
    far[known] = np.where(there < PROFILE, np.abs(there - place[known, None]), PROFILE)
    total = np.stack([np.bincount(r, far[:, i], n_texts) for i in range(len(names))], 1)
    best = total.argmin(1)
    # marks join the n-grams of their words, but are no letters themselves
    some = np.array([n > 0 and any(map(str.isalpha, t)) for n, t in zip(counts.tolist(), texts)], bool)
    worst = np.maximum(np.bincount(r, minlength=n_texts) * PROFILE, 1)
    score = np.where(some, 1 - total[np.arange(n_texts), best] / worst, 0)
    return [names[b] if s else "und" for b, s in zip(best, some)], np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], row: str, text: str = "text") -> DataFrame:
    """row (a struct column with the text among its fields), lang_pred string, score double."""
    names = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[x].view(np.uint64) for x in names])) if names else np.zeros(0, np.uint64)
    ranks = np.full((len(codes), len(names)), PROFILE, np.int32)
    for i, x in enumerate(names):
        ranks[np.searchsorted(codes, profiles[x].view(np.uint64)), i] = np.arange(len(profiles[x]))
    model = docs.sparkSession.sparkContext.broadcast((names, codes, ranks))  # bounded: MAX_LANGUAGES x PROFILE
    src = docs.select(row)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(0)
        lang, score = predicted(texts_of(pc.struct_field(column, text)), *model.value)
        yield pa.RecordBatch.from_arrays([column, pa.array(lang, pa.string()), pa.array(score)], [row, "lang_pred", "score"])

    return map_arrow(src, run, f"`{row}` {src.schema[row].dataType.simpleString()}, lang_pred string, score double", SLICE, f"{row}.{text}")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all documents, learning from those not held out."""
    held = docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), "text", "lang")
    rows = held.select(F.struct("doc_id", "held_out", "text").alias("row"))
    found = identify(rows, learned(held.where(~F.col("held_out"))), "row")
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")
