"""Runs: maximal stretches of words that repeat with a period, in every text on its own.

A run is a stretch of consecutive words with smallest period q, at least max(least, 2 * q) words
long, that no neighbouring word extends keeping the period. Runs are enumerated on harmonic grids:
for each period p the words at two neighbouring multiples of p are compared, since a run of period p
holds such a pair of equal words. How far a pair can be extended to either side is a longest common
extension (LCE) of the text and of the text read backwards. LCE works on a difference cover: of the
suffixes only those at sampled places are sorted; two places are compared word by word for less than
COVER_MODULUS words, until both meet samples at the same distance, and a sparse table over the common
prefixes of neighbouring samples gives the rest. The table of a text is built when a pair needs it.

A text of n words costs n log n steps and memory of about 40 n bytes; texts are independent, so no
group of texts meets in one task. Words are compared exactly. Null and empty texts have no runs;
repeated rows get the same runs; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.hashing import sub_batches

#: A perfect difference set: every difference modulo COVER_MODULUS comes from exactly one pair of residues.
COVER_MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Pairs of the harmonic grid that are worked on at a time, and the longest text whose grid is kept ready.
PAIRS, READY = 1 << 18, 4096
RUN = T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")])


@lru_cache(1)
def _anchors() -> np.ndarray:
    """For each difference d modulo COVER_MODULUS, a residue r of the cover with r + d in the cover too."""
    out = np.zeros(COVER_MODULUS, np.int64)
    for r in COVER:
        for s in COVER:
            out[(s - r) % COVER_MODULUS] = r
    return out


class Extensions:
    """Longest common extensions of places of a word sequence (ids, none negative)."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.full(COVER_MODULUS, -1, words.dtype)])
        self.rank: np.ndarray | None = None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i < j <= n, pair by pair, how many words from i on equal those from j on."""
        steps = (_anchors()[(j - i) % COVER_MODULUS] - i) % COVER_MODULUS
        got = np.zeros(len(i), np.int64)
        live = np.flatnonzero(steps > 0)
        t = 0
        while len(live):
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            t += 1
            got[live] = t
            live = live[steps[live] > t]
        far = np.flatnonzero((got == steps) & (j + steps < self.n))
        if len(far):
            got[far] += self._of_samples(i[far] + steps[far], j[far] + steps[far])
        return got

    def _of_samples(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.rank is None:
            self._sort()
        a, b = self.rank[self.index(i)], self.rank[self.index(j)]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k)) + 1])
        return out

    def index(self, place: np.ndarray) -> np.ndarray:
        """Number of a sampled place among the samples."""
        return place // COVER_MODULUS * len(COVER) + np.searchsorted(COVER, place % COVER_MODULUS)

    def _sort(self) -> None:
        """Ranks of the sampled suffixes by doubling blocks of COVER_MODULUS words, and minima of their common prefixes."""
        size = len(COVER)
        places = (np.arange(-(-self.n // COVER_MODULUS))[:, None] * COVER_MODULUS + np.array(COVER)).ravel()
        places = places[places < self.n]
        m = len(places)
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, COVER_MODULUS)[places]
        rank = np.unique(np.ascontiguousarray(blocks).view(np.dtype((np.void, blocks.dtype.itemsize * COVER_MODULUS))).ravel(), return_inverse=True)[1]
        ranks, step = [rank], size
        while rank.max() < m - 1:
            after = np.zeros(m, np.int64)
            after[:-step] = rank[step:] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
            ranks.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(m, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            step, end = size << k, np.maximum(a, b) < m
            same = np.flatnonzero(end)
            same = same[ranks[k][a[same]] == ranks[k][b[same]]]
            a[same] += step
            b[same] += step
            common[same + 1] += COVER_MODULUS << k
        # less than one block is left: word by word
        at, other = places[order[:-1]] + common[1:], places[order[1:]] + common[1:]
        live = np.arange(m - 1)
        while len(live):
            p, q = at[live], other[live]
            inside = np.maximum(p, q) < self.n
            live = live[inside]
            live = live[self.words[p[inside]] == self.words[q[inside]]]
            at[live] += 1
            other[live] += 1
            common[live + 1] += 1
        self.least = [common]
        width = 1
        while 2 * width <= m:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2


@lru_cache(1)
def _ready_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) with j < READY whose distance divides j, by j, and the number of pairs before each j."""
    period = np.repeat(np.arange(1, READY), (READY - 1) // np.arange(1, READY))
    first = np.concatenate([[0], np.cumsum((READY - 1) // np.arange(1, READY))[:-1]])
    j = period * (np.arange(len(period)) - np.repeat(first, (READY - 1) // np.arange(1, READY)) + 1)
    order = np.argsort(j, kind="stable")
    j, period = j[order], period[order]
    return j - period, j, np.searchsorted(j, np.arange(READY + 1))


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Neighbouring multiples (i, j) of every period, j < n, in parts of about PAIRS pairs."""
    if n <= READY:
        i, j, before = _ready_grid()
        yield i[: before[n]], j[: before[n]]
        return
    low = 1
    while low <= n // 2:
        high = min(n // 2 + 1, low + max(1, PAIRS * low // n))
        periods = np.arange(low, high)
        many = (n - 1) // periods
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        period = np.repeat(periods, many)
        j = period * (np.arange(len(period)) - np.repeat(first, many) + 1)
        yield j - period, j
        low = high


def runs_of(words: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of every run of a sequence of word ids, by start, then period."""
    n = len(words)
    found = []
    if n >= max(least, 2):
        ahead, back = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
        # words just before the first and after the last equal nothing
        ringed = np.concatenate([[-2], words, [-1]])
        for i, j in grid(n):
            at = np.flatnonzero(words[i] == words[j])
            i, j = i[at], j[at]
            if least > 3:  # such a run has another equal pair beside this one
                at = np.flatnonzero((ringed[i + 2] == ringed[j + 2]) | (ringed[i] == ringed[j]))
                i, j = i[at], j[at]
            if len(i):
                after, before, period = ahead(i, j), back(n - j, n - i), j - i
                at = np.flatnonzero(after + before >= np.maximum(period, least - period))
                found.append(np.stack([i - before, after + before + period, period], 1)[at])
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if len(rows):
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]  # the smallest period of a stretch first
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """df with runs (array of start, length, period; words are numbered from 0) and collapsed, the words that stay when each run keeps its first period.

    Words are what ASCII white space parts. Columns of df named runs and collapsed are replaced, all others stay.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    df = df.drop("runs", "collapsed")
    schema = T.StructType([*df.schema.fields, T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text):
                rows, many, left = [], [0], []
                for t in part.column(part.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist():
                    words = (t or b"").split()
                    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                    runs = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)
                    if len(runs):
                        words = [w for w, stays in zip(words, kept_words(len(words), runs), strict=True) if stays]
                    rows.append(runs)
                    many.append(many[-1] + len(runs))
                    left.append(b" ".join(words).decode())
                flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(k, pa.int64(), False) for k in RUN.names])
                lists = pa.ListArray.from_arrays(pa.array(many, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(left, pa.string())], names=schema.names)

    return df.mapInArrow(work, schema)
