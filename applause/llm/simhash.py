"""Near duplicates by SimHash fingerprints, linked through deletion variants of their segments.

A 64-bit fingerprint is cut into ``distance // 2 + 1`` segments, so of two fingerprints that differ in at most
``distance`` bits one segment differs in at most one. Each distinct fingerprint is indexed under every segment as it is
and under every segment with one bit masked; equal keys are joined and the whole distance is verified. A pair meets at
one key of a segment only: at the plain key if the segments are equal, else at the key that masks the one bit in which
they differ (there, fingerprints with the bit clear meet those with the bit set).

Keys of very many fingerprints are keyed once more, in the same way, by the bits outside their segment, so no key is
left whose pairs grow with the square of a group of near copies. Copies share a fingerprint and never form pairs.

Spark sizes keys as if an explode made one row of each, so joins of keys carry a hint that keeps them off the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from applause.session import cut_lineage, release

from .packing import give_back, steps

SHINGLE, DISTANCE = 3, 3
HOT_PAIRS = 1 << 14  # keys whose two sides would make more pairs are keyed once more
CHUNK = 1 << 14


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words; of the whole sequence if there are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in runs), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit b is set if more than half of the hashes have it set; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp`` (a hash of the text; the 64 bits as a signed long), one row per row of ``docs``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [simhash(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), fps], ["doc_id", "mark", "fp"])
        give_back()

    return rows.mapInArrow(work, f"doc_id {kind}, mark bigint, fp bigint")


def pieces(bits: list[int], distance: int) -> list[list[int]]:
    """Bit numbers cut into so many runs that one differs in at most one bit."""
    n = distance // 2 + 1
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def variants(fp: Column, bits: list[list[int]]) -> Column:
    """Array of ``kind, side, value``: each run as it is (side null) and with each one bit masked (side: that bit)."""
    out, kind = [], 0
    for run in bits:
        whole = mask_of(run)
        out.append(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("side"), fp.bitwiseAND(F.lit(whole)).alias("value")))
        kind += 1
        for b in run:
            left = mask_of([x for x in run if x != b])
            side = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)).cast("int")
            out.append(F.struct(F.lit(kind).alias("kind"), side.alias("side"), fp.bitwiseAND(F.lit(left)).alias("value")))
            kind += 1
    return F.array(*out)


def apart(a: Column, b: Column, bits: list[int] | None = None) -> Column:
    both = a.bitwiseXOR(b)
    return F.bit_count(both if bits is None else both.bitwiseAND(F.lit(mask_of(bits))))


def first_run(a: Column, b: Column, bits: list[list[int]], kind: Column) -> Column:
    """No run before the key's own differs in at most one bit: of all keys that a pair shares, the first counts."""
    ok, kinds = F.lit(True), 0
    for i, run in enumerate(bits):
        if i:
            before = F.lit(True)
            for earlier in bits[:i]:
                before = before & (apart(a, b, earlier) > 1)
            ok = ok & ((kind < kinds) | (kind >= kinds + len(run) + 1) | before)
        kinds += len(run) + 1
    return ok


def met(rows: DataFrame, keys: list[str], side: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of the equality join of ``rows`` with itself."""
    low = rows.filter(f"{side} is null or {side} = 0").withColumnRenamed("fp", "a")
    high = rows.filter(f"{side} is null or {side} = 1").select(*keys, F.col("fp").alias("b"))
    return low, high


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: every pair of different fingerprints of ``nodes`` (distinct ``fp``) within ``distance`` bits, once."""
    runs = pieces(list(range(64)), distance)
    rows = nodes.select("fp", F.explode(variants(F.col("fp"), runs)).alias("v")).select("fp", "v.kind", "v.side", "v.value")
    keys = ["kind", "value"]
    lows = F.count_if(F.col("side").isNull() | (F.col("side") == 0))
    highs = F.count_if(F.col("side").isNull() | (F.col("side") == 1))
    hot = cut_lineage(
        rows.groupBy(*keys).agg(lows.alias("lows"), highs.alias("highs")).filter(F.col("lows") * F.col("highs") > HOT_PAIRS).select(*keys)
    )
    a, b = F.col("a"), F.col("b")
    near = (apart(a, b) <= distance) & first_run(a, b, runs, F.col("kind")) & (F.col("side").isNotNull() | (a < b))
    crowded = not hot.isEmpty()
    low, high = met(rows.join(hot, keys, "left_anti") if crowded else rows, keys, "side")
    found = low.join(high.hint("merge"), keys).filter(near).select("a", "b")
    if not crowded:
        return found
    # the bits outside a key's own run, cut in the same way
    rest = [pieces([b for b in range(64) if b not in run], distance) for run in runs]
    start = 0
    finer = None
    for run, others in zip(runs, rest):
        mine = rows.join(hot, keys, "left_semi").filter((F.col("kind") >= start) & (F.col("kind") <= start + len(run)))
        start += len(run) + 1
        mine = mine.select("fp", *keys, "side", F.explode(variants(F.col("fp"), others)).alias("w"))
        mine = mine.select("fp", *keys, "side", F.col("w.kind").alias("kind2"), F.col("w.value").alias("value2"), F.col("w.side").alias("side2"))
        both = keys + ["kind2", "value2"]
        # which of a pair is the low one is told by the first key's side, at plain keys by order
        once = F.col("low.side").isNull() & (F.col("low.fp") < F.col("high.fp")) | (F.col("low.side") < F.col("high.side"))
        other = F.col("low.side2").isNull() | (F.col("low.side2") != F.col("high.side2"))
        x, y = F.col("low.fp"), F.col("high.fp")
        close = (apart(x, y) <= distance) & first_run(x, y, runs, F.col("kind")) & first_run(x, y, others, F.col("kind2"))
        pairs = mine.alias("low").join(mine.alias("high").hint("merge"), both).filter(once & other & close)
        pairs = pairs.select(x.alias("a"), y.alias("b"))
        finer = pairs if finer is None else finer.unionByName(pairs)
    return found.unionByName(finer)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link; the root is the smallest node of its component.

    Large-star and small-star rounds. Each round is written to the shared folder; a node of very many links is only
    ever joined with one row, so its rows may be split.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        # large star: larger neighbours of every node go to the smallest of its neighbourhood
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, cut_lineage(large.filter("u <> v").distinct())
        release(last)
        # small star: the node and its smaller neighbours go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, cut_lineage(small.filter("u <> v").distinct())
        release(last)


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, mark, fp, fingerprint, component_id``; ``mark`` is a hash of the text.

    ``fingerprint`` has 16 lowercase hex digits. ``component_id`` is the smallest ``doc_id`` that can be reached over
    links of at most ``distance`` bits, the document itself included; null only where a component has no id at all.
    Null, empty and blank texts have fingerprint zero and link like any other.
    """
    rows = cut_lineage(fingerprints(docs, key, text, size))  # texts are read once
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # every fingerprint makes many keys, so they are dealt out in a number that adaptive execution leaves alone; by another
    # key than the groups above, whose few partitions would be taken over otherwise
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(links(nodes.select("fp").repartition(n, F.xxhash64("fp")), distance))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", "mark", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                         distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without those whose own component has a smaller id; all columns. Rows without an id stay.

    Rows that share an id are judged each by its own text.
    """
    gone = cluster(docs, key, text, size, distance).filter("doc_id <> component_id").select("doc_id", "mark").distinct().alias("gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("mark")).alias("rows")
    return rows.join(gone, F.expr("rows.id = gone.doc_id and rows.mark = gone.mark"), "left_anti").select("row.*")
