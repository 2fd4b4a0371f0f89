"""Byte-level BPE: encoding by recursive queries over token rows, decoding by ordered aggregation.

Spark deals out the documents; inside a task DuckDB holds the merge table. Each distinct pre-token of the task is
spelt as rows ``word, pos, pair`` (a token and the next one in one number) and a recursive query contracts every word's leftmost pair of minimum rank, all
words at a time, until no pair has a rank. That query keeps the rows of every step, so words are handed over in batches
bounded by the sum of their squared lengths. Longer words go through a recursive query that keeps the last step of a
word alone and contracts all places of its pair of minimum rank in one step, unless the token that this makes could start
a pair of lower rank (then the leftmost alone). Decoding joins id rows with the vocabulary and concatenates in order.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .packing import give_back, kept, steps

ROWS_PER_QUERY = 2_000_000  # token rows of all steps of a query
IDS_PER_QUERY = 400_000
DISTINCT_KEPT = 300_000  # pre-tokens remembered inside a task
ROWS_PER_STEP = 512  # a query costs the same for few words, so many rows share one
LONG_WORD = 128  # bytes; beyond it only the last step is kept
NO_TOKEN = 0x7FFFFFFF  # after the last token of a word
HEAP_WORD = 1024  # bytes; a step passes over the whole word, so steps times rows grow too fast for words beyond it

CONTRACT = """
WITH RECURSIVE s(step, w, pos, pair) AS (
  SELECT 0, w, pos, pair FROM spelt
  UNION ALL
  SELECT s.step + 1, s.w, s.pos - (s.pos > b.at)::INT,
         CASE s.pos - b.at WHEN 1 THEN b.merged | (s.pair & 4294967295)
                           WHEN -1 THEN (s.pair & -4294967296) | (b.merged >> 32) ELSE s.pair END
  FROM s JOIN (
    SELECT w, best & -4294967296 AS merged, (best & 4294967295)::INT AS at
    FROM (SELECT s.w, min(p.merged | s.pos) AS best FROM s JOIN pairs p ON s.pair = p.pair GROUP BY s.w)
  ) b ON s.w = b.w
  WHERE s.pos <> b.at)
SELECT w, pos, (pair >> 32)::INT AS tok
FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step)
"""

CONTRACT_LONG = """
WITH RECURSIVE s(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM spelt
  UNION
  SELECT w, list(tok ORDER BY pos) AS toks
  FROM (
    SELECT w, pos, CASE WHEN met THEN merged ELSE tok END AS tok, lag(met, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT w, pos, tok, merged, odd AND (alone OR pos = min(CASE WHEN odd THEN pos END) OVER (PARTITION BY w)) AS met
      FROM (
        SELECT w, pos, tok, merged, alone,  -- of pairs that overlap, as in a a a, every other one from the left
               merged IS NOT NULL AND (pos - max(CASE WHEN merged IS NULL THEN pos END) OVER (PARTITION BY w ORDER BY pos)) % 2 = 1 AS odd
        FROM (
          SELECT w, pos, tok, alone, least, CASE WHEN merged = least THEN merged END AS merged
          FROM (
            SELECT w, pos, tok, merged, alone, min(merged) OVER (PARTITION BY w) AS least
            FROM (
              SELECT w, pos, tok, m.merged, m.alone
              FROM (
                SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt
                FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM s)
              ) LEFT JOIN merges m ON tok = m.l AND nxt = m.r
              UNION ALL SELECT w, 0, NULL, NULL, NULL FROM s
            )
          ) WHERE least IS NOT NULL
        )
      )
    ) WHERE pos > 0
  ) WHERE NOT gone GROUP BY w)
SELECT w, toks AS ids FROM s
"""

JOIN_UP = """
SELECT i.doc, string_agg(v.piece, '' ORDER BY i.pos) AS pieces
FROM ids i JOIN vocabulary v ON i.id = v.id GROUP BY i.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file, which every executor has at ``path``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Splitter:
    """Pre-tokens of a text by a pattern in which only letters, numbers and white space classes occur.

    A single space between two other characters always starts a pre-token of such a pattern, so a text is cut there
    first, and each distinct cut is matched once. Texts with other arrangements of spaces are matched as a whole.
    """

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.uneven = re.compile(r"\A | \Z| \s|\s ")
        self.other_space = [c for c in map(chr, range(128)) if c.isspace() and c != " "]

    def whole(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def cuts(self, text: str) -> list[str] | None:
        """The cuts of a text, each with its leading space; None if it can't be cut."""
        if text.isascii() and not any(c in text for c in self.other_space):  # the same rule by plain search
            uneven = text[:1] == " " or text[-1:] == " " or "  " in text
        else:
            uneven = self.uneven.search(text) is not None
        return None if uneven else text.split(" ")

    def pieces(self, cut: str, first: bool) -> list[str]:
        """Pre-tokens of a cut, with its leading space unless it starts a text; letters alone are one."""
        cut = cut if first else " " + cut
        return [cut] if cut.isalpha() or not first and cut[1:].isalpha() else self.whole(cut)


class Tokenizer:
    """Encoder and decoder of one task, or of a single process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.ranks, self.split = ranks, Splitter(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids of pre-tokens, four bytes each
        self.starts: dict[str, bytes] = {}  # of cuts that start a text
        self.cuts: dict[str, bytes] = {}  # of cuts after a space
        pairs = [
            (ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        columns = list(zip(*pairs)) or [(), (), ()]
        lowest: dict[int, int] = {}  # rank of the first pair that a token is a part of
        for a, b, m in pairs:
            lowest[a], lowest[b] = min(m, lowest.get(a, m)), min(m, lowest.get(b, m))
        merges = pa.table({
            **{n: pa.array(c, pa.int32()) for n, c in zip(("l", "r", "merged"), columns)},
            "alone": pa.array([lowest.get(m, m) >= m for m in columns[2]], pa.bool_()),  # no pair that this makes comes before it
        })
        vocabulary = pa.table({
            "id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string()),
        })
        left, right, merged = (np.array(c, np.int64) for c in columns)
        in_one = pa.table({"pair": left << 32 | right, "merged": merged << 32})  # the rank above, room for a place below
        self.tables = {"merges": merges, "pairs": in_one, "vocabulary": vocabulary}

    @functools.cached_property
    def db(self) -> duckdb.DuckDBPyConnection:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        for name, rows in self.tables.items():
            db.register("given", rows)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        db.unregister("given")
        return db

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), by the recursive queries."""
        out = [b""] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        for many, longer in ((lens <= LONG_WORD, False), (lens > LONG_WORD, True)):
            which = np.flatnonzero(many)
            rows = np.cumsum(16 * lens[which] if longer else lens[which] * (lens[which] + 1) // 2 + 1)
            for part in np.split(which, np.flatnonzero(np.diff(rows // ROWS_PER_QUERY)) + 1):
                if len(part):
                    for i, ids in zip(part.tolist(), self.contract_batch([words[i] for i in part.tolist()], longer)):
                        out[i] = ids
        return out

    def contract_batch(self, words: list[bytes], longer: bool = False) -> list[bytes]:
        lens = np.array([len(w) for w in words])
        ends = np.cumsum(lens)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        numbers = np.arange(len(words), dtype=np.int32)
        if longer:
            edges = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            self.db.register("spelt", pa.table({"w": numbers, "toks": pa.ListArray.from_arrays(edges, pa.array(tok))}))
            found = self.db.sql(CONTRACT_LONG).to_arrow_table().combine_chunks()
            lists = found.column("ids").combine_chunks()
            order = found.column("w").to_numpy()
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()[1:]
        else:
            following = np.roll(tok, -1).astype(np.int64)
            following[ends - 1] = NO_TOKEN
            pos = np.arange(len(tok), dtype=np.int32) - np.repeat(ends - lens, lens).astype(np.int32)
            pair = tok.astype(np.int64) << 32 | following
            self.db.register("spelt", pa.table({"w": np.repeat(numbers, lens), "pos": pos, "pair": pair}))
            found = self.db.sql(CONTRACT).to_arrow_table()
            w = found.column("w").to_numpy()
            flat = found.column("tok").to_numpy()[np.argsort(w.astype(np.int64) << 32 | found.column("pos").to_numpy())]
            order, ends = numbers, np.cumsum(np.bincount(w, minlength=len(words)))
        out, raw, start = [b""] * len(words), flat.tobytes(), 0
        for i, end in zip(order.tolist(), (ends * 4).tolist()):
            out[i] = raw[start:end]
            start = end
        return out

    def contract_heap(self, word: bytes) -> bytes:
        """The same contraction of one very long word with a heap of its pairs."""
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def pair(i: int) -> int | None:
            return ranks.get(parts[i] + parts[after[i]]) if after[i] < len(parts) else None

        heap = [(r, i) for i in range(len(parts)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or pair(i) != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j], after[i] = None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([ranks[p] for p in parts if p is not None], np.int32).tobytes()

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens."""
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        within = [i for i, c in enumerate(coded) if len(c) <= HEAP_WORD]
        out = [b""] * len(coded)
        for i, ids in zip(within, self.contract([coded[i] for i in within])):
            out[i] = ids
        for i, c in enumerate(coded):
            if len(c) > HEAP_WORD:
                out[i] = self.contract_heap(c)
        return out

    def forget(self) -> None:
        """Let go of what was remembered and of the database's memory; the merge table stays."""
        for memory in (self.known, self.starts, self.cuts):
            memory.clear()
        if "db" in vars(self):
            self.db.close()
            del self.db

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes each; a null text is empty."""
        split, starts, others = self.split, self.starts, self.cuts
        for memory in (self.known, starts, others):
            if len(memory) > DISTINCT_KEPT:
                memory.clear()
        cut = [split.cuts(t) if t else [] for t in texts]
        whole = {i: split.whole(texts[i]) for i, cuts in enumerate(cut) if cuts is None}
        first = {c[0]: split.pieces(c[0], True) for c in cut if c and c[0] not in starts}
        new = {x for c in cut if c for x in set(c[1:]).difference(others)}
        plain = [x for x in new if x.isalpha()]  # one pre-token each, remembered as a cut alone
        mixed = {x: split.pieces(x, False) for x in new.difference(plain)}
        others.update(zip(plain, self.ids_of([" " + x for x in plain])))
        known = self.known
        pieces = {p for own in (*first.values(), *mixed.values(), *whole.values()) for p in own}.difference(known)
        known.update(zip(pieces, self.ids_of(list(pieces))))
        starts.update((c, b"".join([known[p] for p in own])) for c, own in first.items())
        others.update((c, b"".join([known[p] for p in own])) for c, own in mixed.items())
        return [
            b"".join([known[p] for p in whole[n]]) if c is None else starts[c[0]] + b"".join(map(others.__getitem__, c[1:])) if c else b""
            for n, c in enumerate(cut)
        ]

    def encoded(self, texts: pa.Array) -> pa.ListArray:
        """``encode`` from and to Arrow."""
        ids = self.encode(texts.to_pylist())
        offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32()))

    def decode(self, ids: pa.ChunkedArray | pa.Array) -> list[bytes]:
        """Bytes of each list of ids; a null list is empty."""
        lists = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        out = [b""] * len(lists)
        start = 0
        while start < len(lists):
            end, total = start, 0
            while end < len(lists) and (end == start or total < IDS_PER_QUERY):
                total += len(lists[end]) if lists[end].is_valid else 0
                end += 1
            part = lists.slice(start, end - start)
            flat = part.flatten()
            rows = pa.table({"doc": part.value_parent_indices(), "pos": np.arange(len(flat)), "id": flat})
            self.db.register("ids", rows)
            found = self.db.sql(JOIN_UP).to_arrow_table()
            for i, spelt in zip(found.column("doc").to_pylist(), found.column("pieces").to_pylist()):
                out[start + i] = spelt.encode("latin-1")
            start = end
        return out


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The one of this worker process; reading the ranks takes longer than a small task."""
    return kept(("tokenizer", path, pattern), lambda: Tokenizer(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: token ids of each whole text, each match of ``pattern`` contracted by itself, no special tokens.

    Null and empty texts have no ids. One row per row of ``docs``.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        for batch in steps(batches, ROWS_PER_STEP):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), coder.encoded(batch.column("text"))], ["doc_id", "ids"])
        coder.forget()
        give_back()

    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ids; the ids must be in the vocabulary. Null lists give no bytes."""
    given = rows.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        for batch in steps(batches):
            plain = coder.decode(batch.column("ids"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(plain, pa.binary())], ["doc_id", "ids", "decoded"]
            )
        coder.forget()
        give_back()

    return given.mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: both directions in one task, so that the ids need not travel in between."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        for batch in steps(batches, ROWS_PER_STEP):
            ids = coder.encoded(batch.column("text"))
            plain = pa.array(coder.decode(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, plain], ["doc_id", "ids", "decoded"])
        coder.forget()
        give_back()

    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded binary")
