"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ``order`` bytes with the counts of the bytes that followed. A byte's
probability comes from the longest context known to any language; unseen bytes escape to the context that is one byte
shorter, whose probabilities are then shared out among the bytes not yet excluded, down to an even chance for all 256.
The statistics are frozen after training, so the code length of a text is exact and does not depend on the order in
which texts are scored. The language with the shortest code wins.

The model is fitted on a bounded sample: at most ``per_language`` labelled documents and about ``sample_bytes`` bytes of
each language, those with the smallest hash of their id. It is built once, on the driver, and travels as plain arrays;
no worker builds it. Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .packing import give_back, steps

ORDER = 3
PER_LANGUAGE = 400
SAMPLE_BYTES = 4 << 20  # of a language's texts that the model is fitted on
NODES_AT_ONCE = 512  # whose probabilities are worked out together, which bounds the memory of building
LEAST = 2  # a context below the first order is kept if it was seen so often in some language
SALTS = 64
PIECE = 1 << 18  # bytes scored at a time
UNKNOWN = "und"
PAD = b"\n"
LETTER = regex.compile(r"\p{L}")


class Model:
    """Context trees of all languages, kept as arrays.

    Bytes that no training text holds behave alike in every context, so they share one symbol. ``step[node, symbol]`` is
    the node of the context that is one (older) byte longer, -1 if there is none; ``cost[node, symbol]`` holds the code
    length in bits for each language.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        joined = {lang: self.padded(texts[lang]) for lang in self.languages}
        seen = np.zeros(256, bool)
        for data, _ in joined.values():
            seen[data] = True
        self.symbol = np.zeros(256, np.int16)  # symbol 0: never seen
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        self.width, rare = int(seen.sum()) + 1, 256 - int(seen.sum())
        coded = {lang: (self.symbol[data].astype(np.int64), real) for lang, (data, real) in joined.items()}
        n, size = len(self.languages), self.width
        base = np.full(size, 1 / 256)
        base[0] = rare / 256  # the whole class; one byte of it costs the log of its number more
        self.rare_bits = np.float32(np.log2(rare)) if rare else np.float32(0)
        bits = lambda probs: (-np.log2(probs)).astype(np.float32)
        parents = self.blended([self.followed(coded[x], None, 1) for x in self.languages], base[None, :, None].repeat(n, 2), np.zeros(1, np.int64))
        costs, steps = [bits(parents)], []
        nodes = {x: np.zeros(len(coded[x][0]), np.int64) for x in self.languages}  # of each position; -1: none
        first = 0
        for length in range(1, order + 1):
            level = len(parents)
            kept = np.zeros(level * size, bool)
            for x in self.languages:
                keys = self.longer(coded[x], nodes[x], length)
                kept |= np.bincount(keys[keys >= 0], minlength=level * size) >= (1 if length == 1 else LEAST)
            kept = np.flatnonzero(kept)
            child = np.full(level * size, -1, np.int64)
            child[kept] = np.arange(len(kept))
            for x in self.languages:
                keys = self.longer(coded[x], nodes[x], length)
                nodes[x] = np.where(keys >= 0, child[keys], -1)
            table = np.full((level, size), -1, np.int32)
            table.reshape(-1)[kept] = first + level + np.arange(len(kept))
            steps.append(table)
            parents = self.blended([self.followed(coded[x], nodes[x], len(kept)) for x in self.languages], parents, kept // size)
            costs.append(bits(parents))
            first += level
        steps.append(np.full((len(parents), size), -1, np.int32))
        self.step = np.concatenate(steps)
        self.cost = np.concatenate(costs)
        self.cost[:, 0, :] += self.rare_bits

    def state(self) -> dict:
        """Everything as plain values, which any worker can read."""
        return vars(self)

    @classmethod
    def of(cls, state: dict) -> Model:
        own = cls.__new__(cls)
        own.__dict__.update(state)
        return own

    def longer(self, coded: tuple[np.ndarray, np.ndarray], nodes: np.ndarray, length: int) -> np.ndarray:
        """Context of each position with one (older) byte more, -1 where the shorter one is not kept."""
        data, real = coded
        older = np.concatenate([np.zeros(length, np.int64), data[:-length]])
        return np.where((nodes >= 0) & real, nodes * self.width + older, -1)

    def padded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts, each after ``order`` padding bytes, and which bytes are text."""
        pad = PAD * self.order
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        real = np.ones(len(data), bool)
        at = np.cumsum([0] + [len(t) + len(pad) for t in texts])[:-1]
        for i in range(len(pad)):
            real[at + i] = False
        return data, real

    def followed(self, coded: tuple[np.ndarray, np.ndarray], nodes: np.ndarray | None, level: int) -> np.ndarray:
        """Counts of the symbols seen at each node."""
        data, real = coded
        here = real if nodes is None else real & (nodes >= 0)
        at = data[here] + (0 if nodes is None else nodes[here] * self.width)
        return np.bincount(at, minlength=level * self.width).reshape(level, self.width)

    def blended(self, counts: list[np.ndarray], shorter: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """``blend`` of the counts of each language and the rows of ``shorter`` that belong to them, some nodes at a time."""
        out = np.empty((len(parent), self.width, len(counts)))
        for i in range(0, len(parent), NODES_AT_ONCE):
            part = slice(i, i + NODES_AT_ONCE)
            out[part] = self.blend(np.stack([c[part] for c in counts], 2).astype(np.float64), shorter[parent[part]])
        return out

    @staticmethod
    def blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities (node, symbol, language): seen symbols by count, the rest by the shorter context.

        Escape probability: distinct symbols over occurrences plus distinct symbols. Symbols seen here are excluded from
        the shorter context, so every node's probabilities sum to one.
        """
        seen = counts > 0
        total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = np.where(seen, 0.0, shorter)
        rest = left.sum(1, keepdims=True)
        escape = np.where(rest > 0, np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0), 0.0)
        own = np.where(total > 0, counts / np.maximum(total, 1), 0.0)
        return own * (1 - escape) + left / np.maximum(rest, 1e-300) * escape

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (rows) in each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) < PIECE):
                size += len(texts[end])
                end += 1
            if size > 2 * PIECE:  # one very long text, in overlapping pieces
                out[start] = sum(
                    self.piece([texts[start][i : i + PIECE]], texts[start][max(0, i - self.order) : i])[0]
                    for i in range(0, len(texts[start]), PIECE)
                )
            else:
                out[start:end] = self.piece(texts[start:end])
            start = end
        return out

    def piece(self, texts: list[bytes], before: bytes = b"") -> np.ndarray:
        pad, order = (PAD * self.order + before)[-self.order :], self.order
        data = self.symbol[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)].astype(np.int32)
        node = np.zeros(len(data) - order, np.int32)
        alive = np.ones(len(node), bool)
        for length in range(1, order + 1):
            deeper = self.step[node, data[order - length : len(data) - length]]
            alive &= deeper >= 0
            np.copyto(node, deeper, where=alive)
        costs = self.cost[node, data[order:]]
        lens = np.array([len(t) for t in texts])
        starts = np.cumsum(lens + order) - lens - order  # in positions after the first padding
        sums = np.concatenate([np.zeros((1, costs.shape[1])), np.cumsum(costs, 0, dtype=np.float64)])
        return sums[starts + lens] - sums[starts]


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text",
                  label: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """At most ``per_language`` texts of each label, by the hash of the id; only these rows reach the driver.

    Texts are taken as long as those before them have less than ``sample_bytes`` bytes, each of them whole. Of rows that
    share id, label and text one counts; different texts of an id count each.
    """
    named = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    named = named.select(
        F.col(key).alias("_id"), F.col(label).alias("_label"), F.xxhash64(text).alias("_text"), F.col(text).alias("_whole")
    )
    ranked = named.select("_id", "_label", "_text", F.octet_length("_whole").alias("_size")).distinct().withColumn("_hash", F.xxhash64("_id"))
    order = ["_hash", "_id", "_text"]
    for part in (["_label", F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS))], ["_label"]):  # within parts of a label first, as labels are few
        first = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        ranked = ranked.withColumn("_nth", first).filter(F.col("_nth") <= per_language)
    before = F.sum("_size").over(Window.partitionBy("_label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < sample_bytes)
    chosen = ranked.select("_id", "_label", "_text")  # bounded by per_language and the number of labels
    whole = named.join(F.broadcast(chosen), ["_id", "_label", "_text"])
    texts: dict[str, list[bytes]] = {}
    for row in whole.groupBy("_id", "_label", "_text").agg(F.first("_whole").alias("_whole")).collect():
        texts.setdefault(row["_label"], []).append(row["_whole"].encode("utf-8", "surrogatepass"))
    return {lang: sorted(found) for lang, found in texts.items()}


def guesses(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    usable = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
    preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if usable:
        bits = model.bits([texts[i].encode("utf-8", "surrogatepass") for i in usable])
        best = bits.argmin(1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        for i, b, s in zip(usable, best, share):
            preds[i], scores[i] = model.languages[b], float(s)
    return preds, scores


def model_of(texts: dict[str, list[bytes]], order: int = ORDER) -> dict | None:
    """The state of the model of some training rows; None if there are none."""
    return Model(texts, order).state() if texts else None


def predict(docs: DataFrame, texts: dict[str, list[bytes]], order: int = ORDER, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced); only the text is looked at.

    ``score`` is the language's share of the probability that all languages give the text. A text that is null, empty
    or without a letter, or any text if nothing was learned, gets ``und`` and 0. Ties go to the first language by name.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model_of(texts, order))  # bounded by the training sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value) if shared.value else None
        for batch in steps(batches):
            preds, scores = guesses(model, batch.column(names.index(text)).to_pylist())
            columns = [*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])
        give_back()

    out = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(work, out)


def recognised(docs: DataFrame, texts: dict[str, list[bytes]], least: float = 0.5, order: int = ORDER, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text has a learned language with a score of at least ``least``."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model_of(texts, order))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value) if shared.value else None
        for batch in steps(batches):
            preds, scores = guesses(model, batch.column(at).to_pylist())
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(preds, scores)], pa.bool_()))
        give_back()

    return docs.mapInArrow(work, docs.schema)


def held_out(key: str = "doc_id") -> F.Column:
    """A third of the documents, by the checksum of the id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
