"""Token counts per document without token ids.

Documents are taken in blocks. A block lists its distinct pre-tokens once, dealt into buckets, and how often each
document uses each of them. Buckets meet by hash: there every distinct pre-token is split into pieces once, and the
counts go back to the blocks that asked, where they are summed over the documents' frequencies.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from applause.session import scratch_path

from .packing import give_back, packed, packed_words, unpacked, unpacked_words

BLOCK_BYTES = 1 << 23  # text of a block; one longer text is a block of its own
DOCS_PER_BUCKET = 4096
CUTS_PER_CALL = 20_000

BLOCKS = "block string, words array<binary>, doc_ids array<{key}>, sizes binary, lens binary, ids binary, freqs binary"


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PreTokens:
    """Pre-tokens as the library's own normaliser and pre-tokeniser give them.

    A text is cut at white space first, and each distinct cut is handed to the library once, many in one call:
    pre-tokens hold no white space, and neither normal forms nor lower case reach over a space. Special strings are
    found in the raw text, as the library does, and stand for one token each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.odd = re.compile("[\x1c-\x1f]")  # white space to Python, not to the library

    def cuts(self, text: str) -> list[str]:
        return text.split(" ") if self.odd.search(text) else text.split()

    def of_cuts(self, cuts: list[str]) -> list[list[str]]:
        """Pre-tokens of each cut."""
        out: list[list[str]] = [[] for _ in cuts]
        odd = re.compile(r"\s|" + "|".join(map(re.escape, self.special)) if self.special else r"\s")
        plain = [i for i, c in enumerate(cuts) if c and not odd.search(c)]
        for start in range(0, len(plain), CUTS_PER_CALL):
            part = plain[start : start + CUTS_PER_CALL]
            text = self.normal("\n".join([cuts[i] for i in part]))
            spaces = np.array([m.start() for m in re.finditer(" ", text)], np.int64)
            if len(spaces) != len(part) - 1:  # a normal form with a space in it
                for i in part:
                    out[i] = self.of_text(cuts[i])
                continue
            found = self.library.pre_tokenizer.pre_tokenize_str(text)
            which = np.searchsorted(spaces, np.array([span[0] for _, span in found], np.int64))
            for i, (word, _) in zip(which.tolist(), found):
                out[part[i]].append(word)
        for i in sorted({i for i, c in enumerate(cuts) if c}.difference(plain)):
            out[i] = self.of_text(cuts[i])
        return out

    def normal(self, text: str) -> str:
        return text if self.library.normalizer is None else self.library.normalizer.normalize_str(text)

    def of_text(self, text: str) -> list[str]:
        """Pre-tokens of any text, special strings included."""
        parts = [text]
        for mark in self.special:
            parts = [y for x in parts for y in ([x] if x in self.special else self.around(x, mark))]
        plain = lambda x: [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.normal(x))]
        return [y for x in parts if x for y in ([x] if x in self.special else plain(x))]

    @staticmethod
    def around(text: str, mark: str) -> list[str]:
        first, *others = text.split(mark)
        return [first, *(y for x in others for y in (mark, x))]

    def pieces(self, words: Iterable[str]) -> list[int]:
        split = self.library.model.tokenize
        return [1 if w in self.special else len(split(w)) for w in words]


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def summed(owner: np.ndarray, item: np.ndarray, n: np.ndarray | None, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of owner and item, in order, with the sums of their counts."""
    keys, inverse = np.unique(owner * max(items, 1) + item, return_inverse=True)
    return keys // max(items, 1), keys % max(items, 1), np.bincount(inverse, n, len(keys)).astype(np.int64)


def block_row(name: str, docs: list[tuple], source: PreTokens, buckets: int) -> dict:
    """One row with the block's pre-tokens by bucket and each document's frequencies; ids number the buckets' lists."""
    numbers = Numbering()
    found = [np.fromiter(map(numbers.__getitem__, source.cuts(t)), np.int64) for _, t in docs]
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in found])
    doc, cut, n = summed(owner, np.concatenate(found), None, len(numbers))
    words = Numbering()
    of_cuts = [[words[w] for w in own] for own in source.of_cuts(list(numbers))]
    lens = np.array([len(x) for x in of_cuts], np.int64)
    flat = np.array([w for own in of_cuts for w in own], np.int64)
    first = np.cumsum(lens) - lens
    # a cut's counts go to each of its pre-tokens
    wide = lens[cut] if len(cut) else np.zeros(0, np.int64)
    step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    used = flat[np.repeat(first[cut], wide) + step] if len(cut) else flat[:0]
    listed = list(words)
    dealt = np.fromiter((bucket_of(w, buckets) for w in listed), np.int64, len(listed))
    order = np.argsort(dealt, kind="stable")
    place = np.empty(len(listed), np.int64)
    place[order] = np.arange(len(listed))
    doc, word, n = summed(np.repeat(doc, wide), place[used], np.repeat(n, wide), len(listed))
    gaps = np.diff(word, prepend=0)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    gaps[starts] = word[starts]
    edges = np.searchsorted(dealt[order], np.arange(buckets + 1))
    return {
        "block": name,
        "words": [packed_words(listed[i] for i in order[a:z]) if a < z else None for a, z in zip(edges, edges[1:])],
        "doc_ids": [d for d, _ in docs],
        "sizes": packed(np.array([len(t.encode("utf-8", "surrogatepass")) for _, t in docs], np.int64)),
        "lens": packed(np.bincount(doc, minlength=len(docs)).astype(np.int64)),
        "ids": packed(gaps.astype(np.uint32)),  # the first of a document, then the gaps
        "freqs": packed(n.astype(np.uint32)),
    }


def blocks(docs: DataFrame, path: str, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = BLOCKS.format(key=rows.schema["doc_id"].dataType.simpleString())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held, size, made = PreTokens(path), [], 0, 0
        part, kind = TaskContext.get().partitionId(), pa.int64()

        def row() -> pa.RecordBatch:
            one = block_row(f"{part}-{made}", held, source, buckets)
            types = {n: pa.binary() for n in one} | {"block": pa.string(), "words": pa.list_(pa.binary()), "doc_ids": pa.list_(kind)}
            return pa.RecordBatch.from_arrays([pa.array([one[n]], t) for n, t in types.items()], list(types))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):
                doc, t = batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py() or ""
                held.append((doc, t))
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield row()
                    held, size, made = [], 0, made + 1
                    give_back()
        if held:
            yield row()
        held = []
        give_back()

    return rows.mapInArrow(work, schema)


def piece_counts(table: DataFrame, path: str) -> DataFrame:
    """``block, bucket, pieces``: the number of pieces of each pre-token a block listed for a bucket, in its order."""

    def work(group: pa.Table) -> pa.Table:
        source, numbers, asked = PreTokens(path), Numbering(), []
        for words in group.column("words").to_pylist():
            asked.append(np.fromiter(map(numbers.__getitem__, unpacked_words(words)), np.int64))
        counts = np.array(source.pieces(numbers), np.uint32)
        return pa.table({
            "block": group.column("block"), "bucket": group.column("bucket"),
            "pieces": pa.array([packed(counts[a]) for a in asked], pa.binary()),
        })

    asked = table.select("block", F.posexplode("words").alias("bucket", "words")).filter("words is not null")
    return asked.groupBy("bucket").applyInArrow(work, "block string, bucket int, pieces binary")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, buckets: int | None = None, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the library's file at ``path`` without begin, end or added special tokens. Null and empty texts
    have no tokens. ``buckets`` follows the number of documents, so a bucket's words fit a task at any size.
    """
    spark = docs.sparkSession
    buckets = buckets or docs.count() // DOCS_PER_BUCKET + 8
    kind = docs.schema[key].dataType.simpleString()
    # written once: a block has the same rows wherever it is read
    out = scratch_path(spark, "blocks")
    made = blocks(docs, path, buckets, key, text)
    made.write.parquet(out)
    table = spark.read.schema(made.schema).parquet(out)

    def work(asked: pa.Table, counted: pa.Table) -> pa.Table:
        replies = sorted(counted.to_pylist(), key=lambda r: r["bucket"])
        pieces = np.concatenate([np.zeros(0, np.uint32), *(unpacked(r["pieces"], np.uint32) for r in replies)]).astype(np.int64)
        one = asked.to_pylist()[0]
        lens = unpacked(one["lens"], np.int64)
        ends = np.cumsum(lens)
        ids = np.cumsum(unpacked(one["ids"], np.uint32).astype(np.int64))
        ids -= np.repeat(np.concatenate([[0], ids])[ends - lens], lens)  # gaps start anew with every document
        sums = np.concatenate([[0], np.cumsum(pieces[ids] * unpacked(one["freqs"], np.uint32))]).astype(np.int64)
        return pa.table({
            "doc_id": asked.column("doc_ids").combine_chunks().flatten(), "n_bytes": pa.array(unpacked(one["sizes"], np.int64)),
            "n_tokens": pa.array(sums[ends] - sums[ends - lens], pa.int64()),
        })

    uses = table.select("block", "doc_ids", "sizes", "lens", "ids", "freqs").groupBy("block")
    summed = uses.cogroup(piece_counts(table, path).groupBy("block")).applyInArrow(
        work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
