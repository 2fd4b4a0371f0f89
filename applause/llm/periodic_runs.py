"""Periodic runs of words, found by uniting suffix classes in order of decreasing common prefix.

A run is a stretch of words with smallest period ``p`` that no neighbouring word extends. Its start ``s`` and ``s + p``
share a prefix of exactly ``length - p`` words, and no position between them shares as much. So if the suffixes of a
text are united from the longest common prefix down, as Kruskal's algorithm takes edges, ``s`` and ``s + p`` become
neighbours in the ordered position set of their class at just that value. Every pair that becomes adjacent at a value
not below its distance, with different words before it, is the seed of one run.

A run of at least ``repeats`` periods and ``least`` words needs a common prefix of ``floor_of(least, repeats)`` words.
Uniting stops there, and only positions whose words of that number occur twice in their text are sorted at all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .packing import give_back

LEAST, REPEATS = 6, 4
BYTES_PER_STEP = 1 << 20  # of texts handled at a time; a longer text is a step of its own
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def floor_of(least: int, repeats: int) -> int:
    """Smallest common prefix of a run's first two positions: its length less its period."""
    return min(max(least, repeats * p) - p for p in range(1, least + 1))


def refined(rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Ranks by (``rank``, ``after``), where equal ones share the place of their first, as in ``rank``."""
    order = np.lexsort((after, rank))
    sorted_rank, sorted_after = rank[order], after[order]
    place = np.arange(len(rank))
    opens = np.ones(len(rank), bool)
    opens[1:] = sorted_rank[1:] != sorted_rank[:-1]
    parts = opens.copy()
    parts[1:] |= sorted_after[1:] != sorted_after[:-1]
    first, part = np.maximum.accumulate(np.where(opens, place, 0)), np.maximum.accumulate(np.where(parts, place, 0))
    out = np.empty(len(rank), np.int64)
    out[order] = sorted_rank + part - first
    return out


class Suffixes:
    """The positions of some texts whose next ``depth`` words occur more than once in their text, in suffix order.

    ``words`` are word numbers of all texts, ``text`` the text of each; a suffix ends with its text.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, depth: int):
        self.n, self.text, self.depth = len(words), text, depth
        nought = np.zeros(self.n, np.int64)
        self.words = refined(refined(nought, text), words)  # equal words of different texts differ
        rank, length = self.words, 1
        while length < depth:
            step = min(length, depth - length)
            rank, length = refined(rank, self.ahead(rank, np.arange(self.n), step)), length + step
        sizes = np.bincount(rank, minlength=1)
        ends = np.searchsorted(text, text, "right") if self.n else nought
        shared = np.flatnonzero((sizes[rank] > 1) & (np.arange(self.n) + depth <= ends))
        self.levels = []  # (length, rank of every position by its next ``length`` words, as far as they are shared)
        while len(shared):
            self.levels.append((length, rank))
            if np.bincount(rank[shared]).max() == 1:
                break
            finer = rank.copy()
            finer[shared] = refined(rank[shared], self.ahead(rank, shared, length))
            rank, length = finer, 2 * length
        self.order = shared[np.argsort(rank[shared], kind="stable")]

    def ahead(self, rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Rank of the position ``step`` words on, -1 beyond the text."""
        to = np.minimum(at + step, self.n - 1)
        return np.where((at + step < self.n) & (self.text[to] == self.text[at]), rank[to], -1)

    def prefixes(self) -> np.ndarray:
        """Common prefix of each suffix with the next in order; 0 where it is shorter than ``depth``."""
        a, b = self.order[:-1], self.order[1:]
        far = np.zeros(len(a), np.int64)
        for length, rank in self.levels[::-1]:
            far += np.where(self.same(rank, a + far, b + far), length, 0)
        met = far >= self.depth
        for _ in range(self.depth - 1 if len(a) else 0):
            met = met & self.same(self.words, a + far, b + far)
            far += met
        return np.where(far >= self.depth, far, 0)

    def same(self, rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        inside = (x < self.n) & (y < self.n)
        return inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])


def seeds(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, prefix`` of the positions that become neighbours in a class at a common prefix not below ``b - a``."""
    prefix = suffixes.prefixes()
    edges = np.argsort(-prefix, kind="stable")
    edges = edges[prefix[edges] > 0]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    if not len(edges):
        return tuple(np.zeros(0, np.int64) for _ in out)
    order = suffixes.order.tolist()
    parent = list(range(len(order)))
    members: list[list[int] | None] = [[p] for p in order]  # ordered positions of each class, kept at its root
    found: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def settle(value: int) -> None:
        """Of the pairs met at a value those count that nothing has come between since."""
        for a, b, i in found:
            own = members[root(i)]
            at = bisect_left(own, a)
            if own[at + 1] == b:
                for column, x in zip(out, (a, b, value)):
                    column.append(x)
        found.clear()

    last = 0
    for e, value in zip(edges.tolist(), prefix[edges].tolist()):
        if value != last:
            settle(last)
            last = value
        i, j = root(e), root(e + 1)
        if len(members[i]) < len(members[j]):
            i, j = j, i
        big, small = members[i], members[j]
        parent[j], members[j] = i, None
        places = [bisect_left(big, x) for x in small]
        for k, (x, at) in enumerate(zip(small, places)):
            if at and (k == 0 or places[k - 1] != at) and x - big[at - 1] <= value:
                found.append((big[at - 1], x, i))
            if at < len(big) and (k + 1 == len(small) or places[k + 1] != at) and big[at] - x <= value:
                found.append((x, big[at], i))
        if len(small) * 8 < len(big):
            for x, at in zip(reversed(small), reversed(places)):
                big.insert(at, x)
        else:
            members[i] = list(merge(big, small)) if len(big) > 64 else sorted(big + small)
    settle(last)
    return tuple(np.array(column, np.int64) for column in out)


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs of all texts, by start, then period; starts count from the first text's first word."""
    a, b, prefix = seeds(Suffixes(words, text, max(1, floor_of(least, repeats))))
    period, length = b - a, prefix + b - a
    before = np.maximum(a - 1, 0)
    left_open = (a > 0) & (text[before] == text[a]) & (words[before] == words[np.maximum(b - 1, 0)]) if len(a) else np.zeros(0, bool)
    keep = (length >= np.maximum(least, repeats * period)) & ~left_open
    a, length, period = a[keep], length[keep], period[keep]
    order = np.lexsort((period, a))
    return a[order], length[order], period[order]


def steps_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BYTES_PER_STEP:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def analysed(texts: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> tuple[list[int], np.ndarray, tuple, list[bytes]]:
    """Word counts, the number of runs and the runs (``start, length, period``) of each text, and the collapsed texts."""
    split = [t.split() for t in texts]  # bytes: ASCII white space only
    lens = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(lens) - lens
    every = [w for words in split for w in words]
    codes = pa.array(every, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(split)), lens)
    a, length, period = runs(codes, text, least, repeats)
    of = text[a] if len(a) else np.zeros(0, np.int64)
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, a + period, 1)
    np.add.at(marks, a + length, -1)
    kept = np.cumsum(marks[:-1]) == 0
    collapsed = []
    touched = set(of.tolist())
    for i, words in enumerate(split):
        if i in touched:
            words = [w for w, k in zip(words, kept[starts[i] : starts[i] + lens[i]].tolist()) if k]
        collapsed.append(b" ".join(words))
    counts = np.bincount(of, minlength=len(split))
    return lens.tolist(), counts, (a - starts[of], length, period), collapsed


def find_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``, one row per row of ``docs``.

    Words are maximal stretches without ASCII white space, numbered from 0. ``runs`` (``start, length, period``) holds
    every stretch with smallest period ``period`` of at least ``least`` words and ``repeats`` periods that no neighbouring
    word extends, by start, then period. ``collapsed`` (UTF-8 bytes) joins by one space the words that no run holds after its first
    period. Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated rows and ids are rows of their
    own; other columns are not read. A text is handled whole by one task, texts of a task about a megabyte at a time.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = StructType([rows.schema["doc_id"]]).add("n_words", LongType()).add("runs", ArrayType(RUN)).add("collapsed", BinaryType())
    run = pa.struct([(name, pa.int64()) for name in RUN.names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [x or b"" for x in batch.column("text").to_pylist()]
            for i, j in steps_of(sizes):
                lens, counts, found, collapsed = analysed(sizes[i:j], least, repeats)
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(run))
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(lens, pa.int64()), pa.ListArray.from_arrays(edges, values),
                     pa.array(collapsed, pa.binary())],
                    out.names,
                )
        give_back()

    return rows.mapInArrow(work, out)
