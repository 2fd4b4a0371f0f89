"""Removal of byte strings that an earlier document already holds.

Documents are dealt into blocks. Inside every window of ``length`` bytes the ``GRAM``-byte string with the smallest hash
is the window's anchor, so equal windows have equal anchors wherever they lie. Blocks send their anchors' hashes to
buckets; anchors of a single document need no further look. For the others, the run of windows that an anchor owns is a
context of at most ``2 * length - GRAM`` bytes. The distinct contexts of an anchor, each with the smallest id that holds
it in a block, meet in a bucket. There a suffix array of the contexts gives their Burrows-Wheeler transform; intervals of
it are extended backwards, breadth first, which sets the lengths of common prefixes in increasing order and stops at
``length``. What no shorter prefix has cut off shares ``length`` bytes, and the smallest id of such a class goes back
to the blocks.

Only distinct contexts leave a block, so copies meet once per block. An anchor in very many documents is not gathered
under one key: its windows travel singly, each under its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .packing import give_back, packed, restored, unpacked

LENGTH = 50
GRAM = 24
DOCS_PER_BLOCK = 512
BLOCKS_PER_BUCKET = 2
HOT = 8192  # an anchor in more documents is split into its windows
PIECE = 1 << 18  # bytes of text hashed at a time
POSITIONS = 1 << 18  # positions of a suffix array, beyond one anchor's contexts
BITS = 24  # of a position in a piece; a single longer text is cut with overlap
LATE = np.iinfo(np.int64).max  # stands for a missing id

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- anchors of a block -----------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes (a multiple of 8) at every position that has so many."""
    n = len(data) - gram + 1
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    h = np.zeros(n, np.uint64)
    for i in range(gram // 8):
        h ^= x[8 * i : 8 * i + n] * ODD[i % 3]
        h *= ODD[3]
        h ^= h >> np.uint64(29)
    h *= ODD[0]
    return h ^ (h >> np.uint64(32))


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if size < width else keys


def anchors_of(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash, first and last window start of every run of valid windows with one anchor."""
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length or not valid.any():
        return nothing
    h = gram_hashes(data, gram)
    low = np.uint64((1 << BITS) - 1)
    keys = smallest((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    starts = np.flatnonzero(valid[: len(keys)])
    at = (keys[starts] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], starts[first], starts[last]


class Block:
    """The documents of one block in a fixed order, and their anchors sorted by hash."""

    def __init__(self, docs: pa.Table, length: int, gram: int = GRAM):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        rows = sorted((LATE if i is None else i, i is None, t or b"") for i, t in zip(ids, texts))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.missing = [r[1] for r in rows]
        self.texts, self.length = [r[2] for r in rows], length
        hashes, docs_of, starts, ends = [], [], [], []
        for group, base in self.pieces():
            lens = np.array([len(t) for _, _, t in group], np.int64)
            offsets = np.cumsum(lens) - lens
            data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
            edges = np.zeros(len(data) + 1, np.int32)
            fits = lens >= length
            np.add.at(edges, offsets[fits], 1)
            np.add.at(edges, (offsets + lens - length + 1)[fits], -1)
            h, a, z = anchors_of(data, np.cumsum(edges[:-1]) > 0, length, gram)
            which = np.searchsorted(offsets, a, side="right") - 1
            shift = np.array([s for _, s, _ in group], np.int64)[which] - offsets[which]
            hashes.append(h)
            docs_of.append(np.array([d for d, _, _ in group], np.int64)[which])
            starts.append(a + shift)
            ends.append(z + shift)
        if hashes:
            h, d, a, z = map(np.concatenate, (hashes, docs_of, starts, ends))
        else:
            h, d, a, z = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        order = np.argsort(h, kind="stable")  # documents and their windows are in order already
        self.h, self.doc, self.first, self.last = h[order], d[order], a[order], z[order]
        new = np.ones(len(self.h), bool)
        new[1:] = self.h[1:] != self.h[:-1]
        self.group = np.cumsum(new) - 1  # of each anchor among the distinct hashes
        self.heads = np.flatnonzero(new)

    def pieces(self) -> Iterator[tuple[list[tuple[int, int, bytes]], int]]:
        """Runs of (document, offset, text); a very long text comes in parts that overlap by all but one byte of a window."""
        held, size = [], 0
        step = 1 << 22
        for d, t in enumerate(self.texts):
            for i in range(0, max(1, len(t) - self.length + 1), step):
                part = t[i : i + step + self.length - 1] if len(t) > step else t
                if len(part) < self.length:
                    continue
                if held and size + len(part) > PIECE:
                    yield held, size
                    held, size = [], 0
                held.append((d, i, part))
                size += len(part)
        if held:
            yield held, size

    def doc_counts(self) -> np.ndarray:
        """In how many of the block's rows each distinct hash occurs."""
        new = np.ones(len(self.h), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.add.reduceat(new.astype(np.int64), self.heads) if len(self.heads) else np.zeros(0, np.int64)

    def contexts(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of the shared anchors.

        Returns their keys, smallest ids and bytes, sorted by key, and of each use the context, document and first
        window. ``states`` holds 0 (one document only), 1 (shared) or 2 (split into windows) per distinct hash.
        """
        state = states[self.group]
        numbers: dict[tuple[int, bytes], int] = {}
        use, docs, at = [], [], []
        for k in np.flatnonzero(state == 1):
            d, a = int(self.doc[k]), int(self.first[k])
            text = self.texts[d][a : int(self.last[k]) + self.length]
            use.append(numbers.setdefault((int(self.h[k]), text), len(numbers)))
            docs.append(d)
            at.append(a)
        for k in np.flatnonzero(state == 2):
            d = int(self.doc[k])
            t = self.texts[d]
            for a in range(int(self.first[k]), int(self.last[k]) + 1):
                text = t[a : a + self.length]
                use.append(numbers.setdefault((-1, text), len(numbers)))
                docs.append(d)
                at.append(a)
        use, docs, at = (np.array(x, np.int64) for x in (use, docs, at))
        texts = [text for _, text in numbers]
        keys = np.array([h if h >= 0 else window_key(text) for h, text in numbers], np.uint64)
        least = np.full(len(texts), LATE, np.int64)
        np.minimum.at(least, use, self.ids[docs])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys[order], least[order], [texts[i] for i in order], place[use], docs, at


def window_key(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """``bucket, start, end`` of sorted keys cut by their leading bits."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, int(edges[b]), int(edges[b + 1])


# --- common prefixes of contexts ----------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all suffixes (the empty ones too) in order; each row ends in a terminator of its own.

    ``symbols`` holds byte + 1, and 0 from a row's end on. Prefix doubling from the first seven symbols.
    """
    rows, width = symbols.shape
    key = np.zeros((rows, width), np.int64)
    for j in range(7):
        key[:, : width - j] |= symbols[:, j:].astype(np.int64) << (9 * (6 - j))
    used = np.arange(width)[None, :] <= lens[:, None]
    r, c = np.nonzero(used)
    rank = np.zeros((rows, width), np.int64)
    values, reach = key[used], 7
    while True:
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        dense = np.empty(len(order), np.int64)
        dense[order] = np.cumsum(new)
        if reach >= width or new.all():
            return r[order], c[order]
        rank[used] = dense
        after = np.zeros_like(rank)
        after[:, : width - reach] = rank[:, reach:]
        values = dense * (len(order) + 1) + after[used]
        reach *= 2


def classes(before: np.ndarray, ends: int, length: int) -> np.ndarray:
    """Number, in suffix order, of the class of suffixes that share ``length`` bytes.

    ``before`` is the transform: the symbol in front of each suffix, 0 in front of a whole row. The first ``ends``
    suffixes are the empty ones, each with its own terminator. Intervals start with the empty string and the
    terminators; extending those of length ``n`` to the left sets the boundaries whose common prefix is ``n``.
    """
    n = len(before)
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)  # where a suffix goes when its symbol is put in front
    known = np.zeros(n + 1, bool)
    known[: ends + 1] = True  # no two terminators are alike
    known[n] = True
    low, high = np.array([0]), np.array([n])
    for size in range(length):
        if size == 1:
            low, high = np.concatenate([np.arange(ends), low]), np.concatenate([np.arange(1, ends + 1), high])
        if not len(low):
            break
        spans = high - low
        which = np.repeat(np.arange(len(low)), spans)
        at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(low, spans)
        symbol = before[at]
        real = symbol > 0
        at, which, symbol = to[at[real]], which[real], symbol[real]
        order = np.argsort(at)
        at, which, symbol = at[order], which[order], symbol[order]
        new = np.ones(len(at), bool)
        new[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        begin, end = at[first], (at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else at)
        fresh = ~known[end]
        known[end[fresh]] = True
        low, high = begin[fresh], end[fresh]
    return np.cumsum(known[:n]) - 1


def least_ids(texts: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of every text, the smallest id of a text that holds the same window."""
    lens = np.array([len(t) for t in texts], np.int64)
    width = int(lens.max()) + 8
    symbols = np.zeros((len(texts), width), np.uint16)
    symbols[np.arange(width)[None, :] < lens[:, None]] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    rows, columns = suffix_order(symbols, lens)
    before = np.where(columns > 0, symbols[rows, columns - 1], 0)
    number = classes(before, len(texts), length)
    found = np.full(int(number[-1]) + 1, LATE, np.int64)
    np.minimum.at(found, number, ids[rows])
    table = np.empty((len(texts), width), np.int64)
    table[rows, columns] = found[number]
    return [table[i, : lens[i] - length + 1] for i in range(len(texts))]


def verdicts(keys: np.ndarray, texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, list]:
    """``least_ids`` of the distinct contexts of a bucket, and which of them each context is.

    Contexts of one key are compared with one another. Equal contexts are one. A key with one distinct context has
    nothing to compare: a single id stands for all its windows. The others are laid side by side in suffix arrays of
    bounded size and give ids and run lengths.
    """
    numbers: dict[tuple[int, bytes], int] = {}
    of = np.array([numbers.setdefault((k, t), len(numbers)) for k, t in zip(keys.tolist(), texts)], np.int64)
    least = np.full(len(numbers), LATE, np.int64)
    np.minimum.at(least, of, ids)
    groups: dict[int, list[int]] = {}
    for (k, _), i in numbers.items():
        groups.setdefault(k, []).append(i)
    listed = [t for _, t in numbers]
    out: list = [None] * len(numbers)
    held: list[list[int]] = []
    size = 0

    def settle() -> None:
        members = [i for g in held for i in g]
        if members:
            for i, found in zip(members, least_ids([listed[i] for i in members], least[members], length)):
                new = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                out[i] = (found[new].tolist(), np.diff(np.append(new, len(found))).tolist())

    for g in groups.values():
        if len(g) == 1:
            out[g[0]] = ((int(least[g[0]]),), (len(listed[g[0]]) - length + 1,))
            continue
        held.append(g)
        size += sum(len(listed[i]) + 1 for i in g)
        if size >= POSITIONS:
            settle()
            held, size = [], 0
    settle()
    return of, out


# --- the job ------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text",
                   docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal removed byte ranges (``start``, ``end``) and ``kept`` is what remains. A byte goes if it
    lies in a string of ``length`` bytes that also starts in a row with a smaller ``doc_id``; strings are judged on the
    input. Matches never cross documents. Null texts are empty. Rows without an id come after all others and take
    nothing from each other; nor do repeated rows of one id. ``length`` must be at least ``GRAM``, and ids whole numbers
    of any width: other types have no order that the transform could carry, and are refused.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    kind = docs.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}; number the documents with whole numbers first")
    n_blocks = docs.count() // docs_per_block + 1
    buckets = n_blocks // BLOCKS_PER_BUCKET + 8
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"),
    ).repartition(n_blocks, "block")  # one exchange of the texts, read three times

    def list_anchors(group: pa.Table) -> pa.Table:
        block = Block(group, length)
        hashes, counts = block.h[block.heads], np.minimum(block.doc_counts(), 65535).astype(np.uint16)
        out = [
            (b, group.column("block")[0].as_py(), hashes[i:j].astype(np.uint32).tobytes(), packed(counts[i:j]))
            for b, i, j in dealt(hashes, buckets)
        ]
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(
            (("bucket", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary())))})

    def find_shared(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in group.column("a").to_pylist()]
        counts = np.concatenate([unpacked(x, np.uint16) for x in group.column("b").to_pylist()]).astype(np.int64)
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        states = np.empty(len(order), np.uint8)
        states[order] = (sums > 1).astype(np.uint8) + (sums > HOT)
        cuts = np.split(states, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({
            "block": group.column("block"), "bucket": group.column("bucket"), "kind": pa.array([0] * len(parts), pa.int32()),
            "a": pa.array([packed(s) for s in cuts], pa.binary()), "b": pa.array([b""] * len(parts), pa.binary()),
        })

    def in_order(replies: pa.Table, which: int) -> list[dict]:
        return sorted((r for r in replies.to_pylist() if r["kind"] == which), key=lambda r: r["bucket"])

    def contexts_of(group: pa.Table, replies: pa.Table) -> tuple[Block, tuple]:
        block = Block(group, length)
        states = [unpacked(r["a"], np.uint8) for r in in_order(replies, 0)]
        return block, block.contexts(np.concatenate(states) if states else np.zeros(len(block.heads), np.uint8))

    def list_contexts(group: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if group.num_rows:
            _, (keys, least, texts, *_) = contexts_of(group, replies)
            for b, i, j in dealt(keys, buckets):
                lens = np.array([len(t) for t in texts[i:j]], np.uint16)
                body = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                out.append((b, group.column("block")[0].as_py(), packed(keys[i:j]), packed(least[i:j]), packed(lens), packed(body)))
            del texts
            give_back()
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(
            (("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("least", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())))})

    def judge(group: pa.Table) -> pa.Table:
        keys, ids, texts, sizes = [], [], [], []
        for i in range(group.num_rows):
            r = {n: group.column(n)[i].as_py() for n in ("keys", "least", "lens", "body")}
            keys.append(unpacked(r["keys"], np.uint64))
            ids.append(unpacked(r["least"], np.int64))
            ends = np.cumsum(unpacked(r["lens"], np.uint16).astype(np.int64))
            body = restored(r["body"])
            texts += [body[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
            sizes.append(len(ends))
        of, found = verdicts(np.concatenate(keys), texts, np.concatenate(ids), length)
        del keys, ids, texts
        values, runs, start = [], [], 0
        for n in sizes:
            own = [found[i] for i in of[start : start + n].tolist()]
            start += n
            values.append(packed(np.array([x for v, _ in own for x in v], np.int64)))
            runs.append(packed(np.array([x for _, w in own for x in w], np.uint32)))
        del found
        give_back()
        return pa.table({
            "block": group.column("block"), "bucket": group.column("bucket"), "kind": pa.array([1] * len(sizes), pa.int32()),
            "a": pa.array(values, pa.binary()), "b": pa.array(runs, pa.binary()),
        })

    def cut(group: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        if group.num_rows:
            block, (_, _, texts, use, docs_of, at) = contexts_of(group, replies)
            found = [np.repeat(unpacked(r["a"], np.int64), unpacked(r["b"], np.uint32)) for r in in_order(replies, 1)]
            least = np.concatenate(found) if found else np.zeros(0, np.int64)
            windows = np.array([len(t) - length + 1 for t in texts], np.int64)
            offsets = np.cumsum(windows) - windows
            wide = windows[use]
            step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            hit = least[np.repeat(offsets[use], wide) + step] < block.ids[np.repeat(docs_of, wide)]
            doc, start = np.repeat(docs_of, wide)[hit], (np.repeat(at, wide) + step)[hit]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            edges = np.searchsorted(doc, np.arange(len(block.texts) + 1))
            for d, t in enumerate(block.texts):
                s = start[edges[d] : edges[d + 1]]
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > s[:-1] + length  # a window that touches the one before prolongs its run
                first = np.flatnonzero(new)
                begins, ends = s[first], (s[np.append(first[1:], len(s)) - 1] + length if len(s) else s)
                keep = zip([0, *ends.tolist()], [*begins.tolist(), len(t)])
                out["doc_id"].append(None if block.missing[d] else int(block.ids[d]))
                out["n_bytes"].append(len(t))
                out["spans"].append([{"start": a, "end": z} for a, z in zip(begins.tolist(), ends.tolist())])
                out["kept"].append(b"".join(t[a:z] for a, z in keep))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": span, "kept": pa.binary()}
        return pa.table({n: pa.array(out[n], t) for n, t in types.items()})

    reply = "block int, bucket int, kind int, a binary, b binary"
    listed = rows.groupBy("block").applyInArrow(list_anchors, "bucket int, block int, a binary, b binary")
    shared = listed.groupBy("bucket").applyInArrow(find_shared, reply)
    by_block = rows.groupBy("block")
    met = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        list_contexts, "bucket int, block int, keys binary, least binary, lens binary, body binary"
    )
    judged = met.groupBy("bucket").applyInArrow(judge, reply)
    return by_block.cogroup(shared.unionByName(judged).groupBy("block")).applyInArrow(
        cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
