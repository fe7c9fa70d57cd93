"""Titles of two sides compared within blocks of bounded size: pairs are counted where they meet and never shuffled."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import matching as M

#: Articles whose tokens are in use at a time, bytes of their table, bytes of counts, and articles of a step that fills the table.
AT_A_TIME, TABLE, COUNTS, FILLED = 1_024, 1 << 25, 1 << 18, 64
UNDATED = np.iinfo(np.int32).min


def _inside(inner: list[str], outer: list[str]) -> tuple[list[int], list[int]]:
    """Places of the tokens of one list that lie in tokens of another, and those of the others.

    Inner tokens of one length are looked up at each place of the outer token, or one by one if they are fewer."""
    sizes: dict[int, dict[str, int]] = defaultdict(dict)
    for i, t in enumerate(inner):
        sizes[len(t)][t] = i
    known, found, where = sorted(sizes.items()), [], []
    for o, t in enumerate(outer):
        met: set[int] = set()
        for size, some in known:
            places = len(t) - size + 1
            if places <= 0:
                break
            if len(some) < places:
                met.update(i for s, i in some.items() if s in t)
            else:
                met.update(some[s] for k in range(places) if (s := t[k : k + size]) in some)
        found.extend(met)
        where.extend([o] * len(met))
    return found, where


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each start, so many numbers from it on."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _coded(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of lists, and of each list's tokens their numbers, where the list starts and how many it has."""
    lists = pa.concat_arrays(column.chunks)
    tokens = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return tokens.dictionary.to_pylist(), tokens.indices.to_numpy().astype(np.int64), np.cumsum(counts) - counts, counts


def _days(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int32()).fill_null(UNDATED).to_numpy().astype(np.int64)


class _Links:
    """Which tokens of releases each token of an article contains or is contained in."""

    def __init__(self, left: list[str], right: list[str]):
        l, r = _inside(left, right)
        y, x = _inside(right, left)
        pairs = np.unique(np.array(r + y, np.int64) * len(left) + np.array(l + x, np.int64))
        self.l, self.counts = pairs % len(left), np.bincount(pairs // len(left), minlength=len(right))
        self.starts = np.cumsum(self.counts) - self.counts

    def table(self, size: int, tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """size x articles: 1 where an article meets a release's token."""
        met = np.zeros((size, len(starts)), np.uint8)
        for k in range(0, len(starts), FILLED):
            n = counts[k : k + FILLED]
            r = tokens[_spread(starts[k : k + FILLED], n)]
            met[self.l[_spread(self.starts[r], self.counts[r])], np.repeat(np.repeat(np.arange(k, k + len(n)), n), self.counts[r])] = 1
        return met


class _Best:
    """The best release so far of some articles; releases are seen by rising gap."""

    def __init__(self, n: int):
        self.score, self.gap, self.seq, self.at = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)

    def take(self, who: np.ndarray, here: np.ndarray, hits: np.ndarray, n: int, gap: int, seq: np.ndarray, at: np.ndarray, least_hits: int) -> None:
        """hits: of releases (by seq) with n tokens and so many days from the articles."""
        most = hits.max(axis=0)
        score = most / n
        good = score >= M.STRONG_MATCH_SCORE if gap > M.NEAR_DAYS else (score >= M.NEAR_MIN_SCORE) & ((score >= M.NEAR_TRUST_SCORE) | here & (most >= least_hits))
        cols = np.flatnonzero(good & ((score > self.score[who]) | (score == self.score[who]) & (gap == self.gap[who])))
        first = (hits[:, cols] == most[cols]).argmax(axis=0)
        own = who[cols]
        new = (score[cols] > self.score[own]) | (seq[first] < self.seq[own])
        own, first = own[new], first[new]
        self.score[own], self.gap[own], self.seq[own], self.at[own] = score[cols][new], gap, seq[first], at[first]


def best_releases(releases: pa.Table, articles: pa.Table, before: int, after: int, least_hits: int) -> pa.Table:
    """g, newsId, seq, score, gap: the best release (newsId, seq, rd, rt) of each article (g, ad, here, at) that has one.

    An article's tokens become a column of bits over the releases' tokens; the bits of a release's tokens, added for many
    articles at once, are how many of them are met. Releases go by gap, number of tokens and seq."""
    if not (releases.num_rows and articles.num_rows):
        return pa.schema([articles.schema.field("g"), releases.schema.field("newsId"), releases.schema.field("seq"), ("score", pa.float64()), ("gap", pa.int32())]).empty_table()
    names, tokens, starts, counts = _coded(releases["rt"])
    words, their_tokens, their_starts, their_counts = _coded(articles["at"])
    links = _Links(names, words)
    rd, ad, seq, here = _days(releases["rd"]), _days(articles["ad"]), releases["seq"].to_numpy(), articles["here"].to_numpy()
    width = min(AT_A_TIME, max(FILLED, TABLE // (len(names) + 1)))
    rows, chosen, scores, gaps = [], [], [], []
    for day in np.unique(ad):
        apart = np.where(rd == UNDATED, M.NO_GAP, abs(day - rd)) if day != UNDATED else np.full(len(rd), M.NO_GAP)
        band = np.flatnonzero((rd == UNDATED) | (day == UNDATED) | (rd - before <= day) & (day <= rd + after))
        order = band[np.lexsort((seq[band], counts[band], apart[band]))]
        cuts = np.flatnonzero(np.diff(apart[order]) | np.diff(counts[order])) + 1
        groups = [g for g in np.split(order, cuts) if len(g)]
        today = np.flatnonzero(ad == day)
        for k in range(0, len(today), width):
            some = today[k : k + width]
            best, who = _Best(len(some)), np.arange(len(some))
            table = links.table(len(names), their_tokens, their_starts[some], their_counts[some])
            last = -1
            for group in groups:
                n, gap = int(counts[group[0]]), int(apart[group[0]])
                if gap > last:  # no release further off is better than one that is met whole
                    last, left = gap, best.score[who] < 1
                    if not left.any():
                        break
                    if 2 * left.sum() <= len(who):
                        table, who = np.ascontiguousarray(table[:, left]), who[left]
                step = max(1, COUNTS // len(who))
                for j in range(0, len(group), step):
                    part = group[j : j + step]
                    hits = table[tokens[starts[part]]].astype(np.uint8 if n < 256 else np.int64, copy=False)
                    for i in range(1, n):
                        hits += table[tokens[starts[part] + i]]
                    best.take(who, here[some[who]], hits, n, gap, seq[part], part, least_hits)
            has = np.flatnonzero(best.at >= 0)
            rows.append(some[has])
            chosen.append(best.at[has])
            scores.append(best.score[has])
            gaps.append(np.where((day == UNDATED) | (rd[best.at[has]] == UNDATED), UNDATED, best.gap[has]))
    one = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    took, gap = releases.take(pa.array(one(chosen).astype(np.int64))), one(gaps).astype(np.int32)
    return pa.table({"g": articles["g"].take(pa.array(one(rows).astype(np.int64))), "newsId": took["newsId"], "seq": took["seq"], "score": pa.array(one(scores), pa.float64()), "gap": pa.array(gap, pa.int32(), mask=gap == UNDATED)})
