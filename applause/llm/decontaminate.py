"""Benchmark passages in documents, found with a bounded number of edits.

Text is lower-cased and reduced to words joined by one space. A test item of ``m`` characters may differ in
``m // CHARS_PER_EDIT`` edits, from ``FLOOR_FROM`` characters on in enough to lose its longest word, as far as that is one
edit in ``FLOOR_PER_EDIT`` characters. It is cut into one piece more than that, so any occurrence within the budget holds
one piece unchanged. One automaton finds all pieces of a block of items in one pass over a text; around each hit, Myers'
bit-parallel distance verifies the whole item. An item without edits must stand between word borders. Items travel in
blocks of bounded size, each with its own pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from .packing import give_back, steps

CHARS_PER_EDIT = 16
FLOOR_FROM, FLOOR_PER_EDIT = 32, 10
BLOCK_CHARS = 4_000_000  # characters of test items that are broadcast at a time
WORD = re.compile(r"\w+")


def normalised(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def budget(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    edits = len(item) // chars_per_edit
    if len(item) < FLOOR_FROM:
        return edits
    return max(edits, min(max(map(len, item.split())) + 1, len(item) // FLOOR_PER_EDIT))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` parts of near equal length with their offsets."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any part of ``text``, and the first end of such a part (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up, down = (minus | ~(d | plus)) & full, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(x | up)) & full, up & x
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT):
        self.items, self.found = [], ahocorasick.Automaton()
        parts: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            clean = normalised(text)
            if not clean:
                continue
            masks: dict[str, int] = {}
            for i, c in enumerate(clean):
                masks[c] = masks.get(c, 0) | 1 << i
            edits = budget(clean, chars_per_edit)
            for offset, piece in pieces(clean, edits) if edits else [(0, f" {clean} ")]:
                parts.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, len(clean), edits, masks))
        for piece, uses in parts.items():
            self.found.add_word(piece, (len(piece), uses))
        if parts:
            self.found.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item_id, edits, start, end`` of the best place of every item within its budget; places in ``normalised``."""
        if not self.items:
            return []
        clean = normalised(text)
        spans: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}  # first end of items without edits
        for last, (length, uses) in self.found.iter(f" {clean} "):
            last -= 1  # as a place in ``clean``
            for which, offset in uses:
                _, m, edits, _ = self.items[which]
                if not edits:
                    exact.setdefault(which, last)
                    continue
                start = last + 1 - length - offset - edits
                end = start + m + 2 * edits
                of = spans.setdefault(which, [])
                if of and start <= of[-1][1] and start >= of[-1][0]:
                    of[-1][1] = max(of[-1][1], end)
                else:
                    of.append([start, end])
        out = [(self.items[which][0], 0, end - self.items[which][1], end) for which, end in exact.items()]
        for which, windows in spans.items():
            item_id, m, edits, masks = self.items[which]
            best = None
            windows.sort()
            merged: list[list[int]] = []
            for a, b in windows:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                a = max(a, 0)
                score, end = nearest(masks, m, clean[a:b])
                if score <= edits and (best is None or score < best[0]):
                    best = (score, a + end)
            if best:
                out.append((item_id, best[0], max(0, best[1] - m), best[1]))
        return sorted(out, key=lambda x: (x[0] is None, x))


def find(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, key: str = "doc_id", text: str = "text",
         item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, span_start, span_end``: each item found in a document within its budget, its best place.

    Places count characters of the normalised text; ``span_start`` is ``span_end`` less the item's length. Null and
    wordless texts and items match nothing; items with equal texts are each reported, and so are repeated documents.
    A document in which several places are equally near reports the first. Without items or documents there are no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    schema = StructType([rows.schema["doc_id"], items.schema["item_id"]])
    for name in ("edits", "span_start", "span_end"):
        schema = schema.add(name, IntegerType())
    kind = to_arrow_type(items.schema["item_id"].dataType)
    out = None
    for block in blocks(items):

        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block.value, chars_per_edit)
            kept = None
            for batch in steps(batches):
                docs_of = batch.column("doc_id")
                found = [(i, *hit) for i, t in enumerate(batch.column("text").to_pylist()) for hit in matcher.hits(t)]
                at, ids, edits, starts, ends = zip(*found) if found else ((),) * 5
                kept = pa.RecordBatch.from_arrays(
                    [docs_of.take(pa.array(at, pa.int64())), pa.array(ids, kind), *(pa.array(x, pa.int32()) for x in (edits, starts, ends))],
                    ["doc_id", "item_id", "edits", "span_start", "span_end"],
                )
                yield kept
            give_back()

        found = rows.mapInArrow(work, schema)
        out = found if out is None else out.unionByName(found)
    return out


def blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The items (``item_id, text``) in parts of about ``BLOCK_CHARS`` characters, each broadcast."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // BLOCK_CHARS + 1
    for number in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number)
        yield items.sparkSession.sparkContext.broadcast([tuple(x) for x in part.collect()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, text: str = "text",
                      item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Each row is judged by its own text, whatever its id. Null and wordless texts hold no item.
    """
    at = docs.columns.index(text)
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    for block in blocks(items):

        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block.value, chars_per_edit)
            for batch in steps(batches):
                yield batch.filter(pa.array([not (t and matcher.hits(t)) for t in batch.column(at).to_pylist()], pa.bool_()))
            give_back()

        docs = docs.mapInArrow(work, docs.schema)
    return docs
