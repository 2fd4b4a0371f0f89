"""A factorisation machine that scores the quality of texts.

A text is a sparse vector: its lower-cased words, hashed into buckets and normalised to length one, structure statistics
(shares of letters, digits, signs, repeated words and lines, lengths) and numeric metadata. A number lies between
two knots, quantiles of the training rows, and shares a weight of one between them; a missing number has a place of its own.

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum equals half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2, so a text is scored in time linear in its
words. The machine is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructType

from .packing import give_back

BUCKETS = 1 << 14  # of hashed words
RANK = 8
KNOTS = 9
PER_LABEL = 2500  # labelled rows of each label that the machine is fitted on, about
BYTES_PER_STEP = 1 << 20
STATISTICS = (
    "log_words", "log_chars", "word_length", "upper", "digits", "signs", "white", "distinct", "repeated", "lines", "repeated_lines",
    "signed_words",
)
LOWER, UPPER, DIGIT, WHITE, SIGN = range(5)


def kinds_of_characters() -> np.ndarray:
    """Kind of each character of the basic plane; others count as letters without case."""
    table = np.zeros(1 << 16, np.int8)
    for code in range(1 << 16):
        c = chr(code)
        group = unicodedata.category(c)
        if c.isspace():
            table[code] = WHITE
        elif group in ("Lu", "Lt"):
            table[code] = UPPER
        elif group[0] == "N":
            table[code] = DIGIT
        elif group[0] not in "LM":
            table[code] = SIGN
    return table


class Features:
    """Words and statistics of texts. An instance may be kept for a task."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.kinds = buckets, kinds_of_characters()

    def __call__(self, texts: list[str], metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``edges, buckets, values`` of the word vectors, and a row of numbers (statistics, then metadata) for each text."""
        n = len(texts)
        split = [t.lower().split() for t in texts]
        lens = np.array([len(x) for x in split], np.int64)
        words = pa.array([w for x in split for w in x], pa.string()).dictionary_encode()
        of, codes = np.repeat(np.arange(n), lens), words.indices.to_numpy().astype(np.int64)
        names = words.dictionary.to_pylist()
        hashed = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.buckets for w in names], np.int64)
        size = max(len(names), 1)
        pairs, counts = np.unique(of * size + codes, return_counts=True)
        distinct = np.bincount(pairs // size, minlength=n)
        if len(names):
            cells, inverse = np.unique(pairs // size * self.buckets + hashed[pairs % size], return_inverse=True)
        else:
            cells, inverse = pairs, pairs
        values = np.log1p(np.bincount(inverse, weights=counts, minlength=len(cells)))
        rows = cells // self.buckets
        norm = np.sqrt(np.bincount(rows, weights=values * values, minlength=n))
        values = values / np.maximum(norm[rows], 1e-12)
        edges = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
        numbers = self.statistics(texts, lens, of, codes, distinct, names)
        return edges, (cells % self.buckets).astype(np.int32), values.astype(np.float32), np.concatenate([numbers, metadata], 1)

    def statistics(self, texts, lens, of, codes, distinct, names) -> np.ndarray:
        n = len(texts)
        chars = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.where(points < 1 << 16, self.kinds[np.minimum(points, (1 << 16) - 1)], LOWER)
        place = np.repeat(np.arange(n, dtype=np.int64) * 5, chars) + kinds
        shares = np.bincount(place, minlength=5 * n).reshape(n, 5) / np.maximum(chars, 1)[:, None]
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
        signed = np.array([not w.isalnum() for w in names], bool)
        lines = [t.split("\n") for t in texts]
        n_lines = np.array([len(x) for x in lines], np.float64)
        some = np.maximum(lens, 1)
        return np.stack([
            np.log1p(lens), np.log1p(chars), chars * (1 - shares[:, WHITE]) / some, shares[:, UPPER], shares[:, DIGIT],
            shares[:, SIGN], shares[:, WHITE], distinct / some, np.bincount(of[again], minlength=n) / some,
            np.log1p(n_lines), 1 - np.array([len(set(x)) for x in lines]) / n_lines,
            (np.bincount(of[signed[codes]], minlength=n) if len(codes) else np.zeros(n)) / some,
        ], 1)


@dataclass
class Machine:
    """A fitted machine; a few hundred kilobytes at any size of the corpus."""

    knots: np.ndarray  # (number, knot)
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # (feature, rank)
    buckets: int

    def places(self, edges: np.ndarray, buckets: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        return places(self.knots, self.buckets, edges, buckets, values, numbers)

    def margins(self, edges: np.ndarray, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        own, sums, squares = parts(self.weights, self.factors, edges, features, values)
        return self.bias + own + 0.5 * (sums * sums - squares).sum(1)


def places(knots: np.ndarray, buckets: int, edges, words, values, numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sparse row for each text: words, then two places for each number (one if it is missing or beyond the knots)."""
    n, width = len(numbers), knots.shape[1] + 1
    columns, shares = [], []
    for i, own in enumerate(knots):
        x, first = numbers[:, i], buckets + i * width
        missing = np.isnan(x)
        at = np.clip(np.searchsorted(own, x, "right") - 1, 0, len(own) - 2)
        gap = own[at + 1] - own[at]
        upper = np.where(gap > 0, np.clip((x - own[at]) / np.where(gap > 0, gap, 1), 0, 1), (x > own[at]).astype(float))
        columns += [np.where(missing, first + len(own), first + at), np.where(missing, first + len(own), first + at + 1)]
        shares += [np.where(missing, 1.0, 1 - upper), np.where(missing, 0.0, upper)]
    extra = len(columns)
    lens = np.diff(edges)
    out_edges = np.concatenate([[0], np.cumsum(lens + extra)])
    features, out = np.empty(out_edges[-1], np.int64), np.empty(out_edges[-1], np.float64)
    at = np.arange(len(words)) + np.repeat(np.arange(n) * extra, lens)
    features[at], out[at] = words, values
    tail = (out_edges[1:] - extra)[:, None] + np.arange(extra)
    features[tail], out[tail] = np.stack(columns, 1), np.stack(shares, 1) / np.sqrt(max(extra / 2, 1))
    return out_edges, features, out


def parts(weights, factors, edges, features, values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear sum, factor sums and sums of squares of each row; every row has at least one feature."""
    starts = edges[:-1]
    scaled = factors[features] * values[:, None]
    return (
        np.add.reduceat(weights[features] * values, starts), np.add.reduceat(scaled, starts, axis=0),
        np.add.reduceat(scaled * scaled, starts, axis=0),
    )


def fitted(rows: tuple[np.ndarray, ...], labels: np.ndarray, weight: np.ndarray, buckets: int = BUCKETS, rank: int = RANK,
           epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over batches; ``rows`` as ``Features`` gives them. The same rows give the same machine."""
    edges, words, values, numbers = rows
    share = np.linspace(0, 1, KNOTS)
    knots = np.stack([np.quantile(x[~np.isnan(x)], share) if (~np.isnan(x)).any() else np.zeros(KNOTS) for x in numbers.T])
    edges, features, values = places(knots, buckets, edges, words, values, numbers)
    size = buckets + len(knots) * (KNOTS + 1)
    rng = np.random.default_rng(seed)
    prior = np.clip(np.average(labels, weights=weight), 1e-3, 1 - 1e-3)
    machine = Machine(knots, float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.05, (size, rank)), buckets)
    weight = weight / weight.mean()
    steps, steps_of = np.full(size, 1e-6), np.full((size, rank), 1e-6)
    bias_step = 1e-6
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            lens = (edges[1:] - edges[:-1])[pick]
            ends = np.cumsum(lens)
            take = np.arange(ends[-1]) + np.repeat(edges[pick] - (ends - lens), lens)
            f, x, of = features[take], values[take], np.repeat(np.arange(len(pick)), lens)
            own, sums, squares = parts(machine.weights, machine.factors, np.concatenate([[0], ends]), f, x)
            margin = machine.bias + own + 0.5 * (sums * sums - squares).sum(1)
            error = weight[pick] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
            used, inverse = np.unique(f, return_inverse=True)
            slope = np.bincount(inverse, weights=error[of] * x) + decay * machine.weights[used] / len(pick)
            pull = error[of][:, None] * x[:, None] * (sums[of] - machine.factors[f] * x[:, None])
            slopes = np.stack([np.bincount(inverse, weights=pull[:, k]) for k in range(rank)], 1) + decay * machine.factors[used] / len(pick)
            steps[used] += slope**2
            steps_of[used] += slopes**2
            machine.weights[used] -= rate * slope / np.sqrt(steps[used])
            machine.factors[used] -= rate * slopes / np.sqrt(steps_of[used])
            total = error.sum()
            bias_step += total**2
            machine.bias -= rate * total / np.sqrt(bias_step)
    return machine


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the documents, by the checksum of the id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def given_numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Metadata of a batch; missing and endless numbers are not numbers."""
    rows = [[np.nan if x is None else x for x in m] for m in batch.column("meta").to_pylist()]
    numbers = np.array(rows, np.float64).reshape(batch.num_rows, -1)
    numbers[~np.isfinite(numbers)] = np.nan
    return numbers


def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of about a megabyte of text at a time; null is empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > BYTES_PER_STEP:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, key: str = "doc_id", text: str = "text",
                  label: str = "quality", metadata: Sequence[str] = ()) -> DataFrame:
    """``id, text, meta, label, weight``: about ``per_label`` rows of each label 0 and 1, by a hash of id and text.

    Labels that are null or another number, and rows without an id, are left out; an id with both labels counts with
    both. Of rows that share id, text and label one counts. ``weight`` is the number of rows that a chosen row stands for.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    mine = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.array(*[F.col(n).cast("double") for n in metadata]).cast("array<double>").alias("meta"),
    )
    short = mine.select("id", F.xxhash64("text").alias("text_hash")).join(known, "id").distinct()
    counts = {r["label"]: r["n"] for r in short.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    parts_of = 1 << 20
    limit = F.coalesce(*[F.when(F.col("label") == x, F.lit(-(-parts_of * per_label // n))) for x, n in counts.items()], F.lit(0))
    stands = F.coalesce(*[F.when(F.col("label") == x, F.lit(max(1.0, n / per_label))) for x, n in counts.items()], F.lit(0.0))
    chosen = short.filter(F.pmod(F.xxhash64("id", "text_hash", F.lit("sample")), F.lit(parts_of)) < limit)  # about 2 * per_label short rows
    whole = mine.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "text_hash"])
    return whole.dropDuplicates(["id", "text_hash", "label"]).select("id", "text", "meta", "label", stands.alias("weight"))


def fit(rows: DataFrame, buckets: int = BUCKETS, rank: int = RANK) -> Machine | None:
    """The machine of ``training_rows``; their sparse vectors are made on Spark and only these reach the driver.

    None without rows of both labels.
    """
    schema = (
        StructType().add("order", BinaryType()).add("label", IntegerType()).add("weight", DoubleType())
        .add("buckets", ArrayType(IntegerType())).add("values", ArrayType(FloatType())).add("numbers", ArrayType(DoubleType()))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch, texts in stepped(batches):
            edges, words, values, numbers = features(texts, given_numbers(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()),
                    batch.column("label"), batch.column("weight"), lists(edges, pa.array(words)), lists(edges, pa.array(values)),
                    pa.array(numbers.tolist(), pa.list_(pa.float64())),
                ],
                schema.names,
            )

    found = rows.select("text", "meta", "label", "weight").mapInArrow(work, schema).toArrow().combine_chunks()
    table = sorted(zip(*(found.column(c).to_pylist() for c in ("order", "label", "weight", "numbers", "buckets", "values"))), key=lambda r: (r[0], r[1], r[4]))
    if len({r[1] for r in table}) < 2:
        return None
    edges = np.concatenate([[0], np.cumsum([len(r[4]) for r in table])])
    sample = (
        edges, np.concatenate([np.array(r[4], np.int32) for r in table]), np.concatenate([np.array(r[5], np.float32) for r in table]),
        np.array([r[3] for r in table], np.float64),
    )
    return fitted(sample, np.array([r[1] for r in table], float), np.array([r[2] for r in table]), buckets, rank)


def lists(edges: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), flat)


def score(docs: DataFrame, machine: Machine | None, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """``doc_id, score``, one row per row of ``docs``: how likely label 1 is, from the text and the metadata alone.

    Null and empty texts are scored by their numbers; a missing or non-finite number has a place of its own. Without a
    machine every score is 0.5.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"),
        F.array(*[F.col(n).cast("double") for n in metadata]).cast("array<double>").alias("meta"),
    )
    schema = StructType([rows.schema["doc_id"]]).add("score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine) if machine else None)  # plain values, which any worker can read

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = Machine(**shared.value) if shared.value else None, None
        for batch, texts in stepped(batches):
            if own is None:
                found = np.full(batch.num_rows, 0.5)
            else:
                features = features or Features(own.buckets)
                margin = own.margins(*own.places(*features(texts, given_numbers(batch))))
                found = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])
        give_back()

    return rows.mapInArrow(work, schema)
