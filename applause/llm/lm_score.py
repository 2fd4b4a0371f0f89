"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word of a document is masked in turn and predicted from the words on both sides; the summed logarithms score the
document. The network (embeddings of the window, one hidden layer, a softmax over classes) is trained here in numpy: the
rounds share the positions of every document, so each is trained on once; each task trains on the documents it holds,
and the weights are averaged over the tasks, weighted by their positions, after every round.

The vocabulary follows the counted corpus: every word of at least a given relative frequency has a number, an embedding
and a probability of its own. The most frequent words are classes; the others share classes by rank, and a binary tree
of logistic decisions over the same hidden layer leads from the class to the word, so a word costs the logarithm of its
class's size. Rarer words are one class and are spelt by bytes, whose probabilities depend on the window as well; as
neighbours they are told apart by a hash. So any text has a probability, and all of it looks at both sides.

Word counts come from all documents. What reaches the driver is the vocabulary (at most one word by the least relative
frequency), 257 byte counts and the weights, 45 numbers a word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from applause.session import cut_lineage

from .packing import steps

PAD, OTHER = 0, 1
COUNTED = 400_000  # distinct words held by a task before they are passed on
WORDS_PER_TASK = 1 << 22  # of a training task at least, if there are more tasks than cores
CHUNK = 1 << 18  # weights that are averaged in one group


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its training."""

    inputs: int = 1024  # embeddings at least: numbered words, padding and the other words; ``fit`` adds what the corpus needs
    outputs: int = 256  # classes of the softmax: the most frequent words, padding, the other words and groups of words
    least: float = 1e-6  # relative frequency from which on a word has a number
    buckets: int = 4096  # embeddings that rarer words share as neighbours
    words: int | None = None  # numbered words; set by ``fit``
    side: int = 2  # words on either side
    width: int = 12  # of an embedding
    hidden: int = 32
    stride: int = 2  # one position in so many is trained on in a round
    rounds: int = 2  # as many as the stride, so that every position comes up once
    batch: int = 512
    rate: float = 0.05
    seed: int = 7


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space; none for null."""
    return (text or "").lower().split()


def in_bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all documents; counted inside each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in steps(batches):
            for t in batch.column("text").to_pylist():
                counts.update(words_of(t))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    part = docs.select(F.col(text).alias("text")).mapInArrow(work, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte, and a word's end (number 256), occurs in the given words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, np.int64)
        for batch in batches:
            coded = [in_bytes(w) for w in batch.column("word").to_pylist()]
            n = batch.column("n").to_numpy(zero_copy_only=False)
            weights = np.repeat(n, [len(c) for c in coded])
            total[:256] += np.bincount(np.frombuffer(b"".join(coded), np.uint8), weights, 256).astype(np.int64)
            total[256] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(total, pa.int64())], ["byte", "n"])

    out = np.zeros(257)
    for byte, n in words.mapInArrow(work, "byte int, n bigint").groupBy("byte").agg(F.sum("n")).collect():
        out[byte] = n
    return out


class Layout:
    """Class of every word number, and the decisions that lead from a class to a word.

    Without more words than classes each has its own. Otherwise half of the classes are groups of neighbouring ranks,
    larger for rarer words. A group of ``n`` words is a tree kept as a heap: decisions 1 to ``n - 1``, words from ``n``.
    """

    def __init__(self, s: Settings):
        known = s.outputs if s.words is None else s.words + 2
        self.classes = np.where(np.arange(s.inputs) < min(known, s.outputs), np.arange(s.inputs), OTHER).astype(np.int32)
        self.nodes, self.path, self.turn = 0, np.zeros((s.inputs, 0), np.int32), np.zeros((s.inputs, 0), np.int8)
        self.depth = np.zeros(s.inputs, np.int64)
        if known <= s.outputs:
            return
        single = s.outputs // 2
        edges = np.rint(np.linspace(np.sqrt(single), np.sqrt(known), s.outputs - single + 1) ** 2).astype(np.int64)
        ids = np.arange(single, known)
        group = np.searchsorted(edges, ids, "right") - 1
        self.classes[ids] = single + group
        self.nodes = known - single
        first, node = edges[group], np.diff(edges)[group] + ids - edges[group]
        depth = int(np.log2(node.max())) if len(node) else 0
        self.path, self.turn = np.zeros((s.inputs, depth), np.int32), np.zeros((s.inputs, depth), np.int8)
        for step in range(depth):
            on = node > 1
            self.turn[ids[on], step] = np.where(node[on] & 1, 1, -1)
            node = np.where(on, node >> 1, node)
            self.path[ids[on], step] = (first - single + node)[on]
        self.depth = (self.turn != 0).sum(1)


def places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of a batch, where each comes first, where they come again, and whose repeats those are."""
    keys = numbers.astype(np.int64) << 32
    keys |= np.arange(len(keys))
    keys.sort()  # faster than the order of the numbers
    at = keys & 0xFFFFFFFF
    keys >>= 32
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    owner = np.cumsum(new) - 1
    again, new = np.flatnonzero(~new), np.flatnonzero(new)
    return keys.take(new), at.take(new), at.take(again), owner.take(again)


def summed(grads: np.ndarray, first: np.ndarray, again: np.ndarray, whose: np.ndarray) -> np.ndarray:
    """Sums of the gradients of every distinct row; most rows occur once."""
    sums, width = grads.take(first, 0), grads.shape[1]
    if len(again):
        np.add.at(sums.reshape(-1), (whose[:, None] * width + np.arange(width)).reshape(-1), grads.take(again, 0).reshape(-1))
    return sums


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words, and where each word ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return np.frombuffer(b"".join(words), np.uint8), ends


class Network:
    """Weights and their use. All arrays are float32.

    ``arrays`` are the embeddings, the hidden layer and the softmax; ``more`` are the decisions inside the groups and
    what the hidden layer adds to the spelling. The biases of the softmax and of the decisions are kept beside their weights
    (``wide``, ``leaves``) and belong to a last column of ones in the hidden layer.
    """

    NAMES = ("embed", "inner", "inner_bias", "outer", "outer_bias")

    def __init__(self, settings: Settings, layout: Layout | None = None):
        s = self.settings = settings
        self.layout = layout or Layout(s)
        shapes = [(s.inputs, s.width), (2 * s.side * s.width, s.hidden), (s.hidden,), (s.hidden, s.outputs), (s.outputs,)]
        rng = np.random.default_rng(s.seed)
        arrays = [rng.normal(0, 1 / np.sqrt(x[0] if i else 4), x) if len(x) > 1 else np.zeros(x) for i, x in enumerate(shapes)]
        *inside, outer, outer_bias = [np.array(a, np.float32) for a in arrays]
        self.wide = np.concatenate([outer, outer_bias[None]])
        self.leaves = np.zeros((self.layout.nodes, s.hidden + 1), np.float32)
        self.arrays = [*inside, self.wide[:-1], self.wide[-1]]
        self.more = [self.leaves[:, :-1], self.leaves[:, -1], np.zeros((s.hidden, 257), np.float32)]

    @classmethod
    def from_flat(cls, settings: Settings, flat: np.ndarray) -> Network:
        net, at = cls(settings), 0
        for a in (*net.arrays, *net.more):
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in (*self.arrays, *self.more)])

    def windows(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids around the positions ``at`` of a document, without the position itself."""
        side = self.settings.side
        padded = np.concatenate([np.full(side, PAD, ids.dtype), ids, np.full(side, PAD, ids.dtype)])
        steps = [i for i in range(2 * side + 1) if i != side]
        return padded.take(at[:, None] + np.array(steps)[None, :])

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings of the windows, and the hidden layer with a last column of ones."""
        embed, inner, inner_bias, _, _ = self.arrays
        x = embed.take(windows, 0).reshape(len(windows), -1)
        z = x @ inner
        z += inner_bias
        z *= 2
        np.exp(np.minimum(z, 80, out=z), out=z)  # tanh by the exponential, which is faster
        z += 1
        np.divide(-2, z, out=z)
        h = np.ones((len(windows), self.settings.hidden + 1), np.float32)
        h[:, :-1] += z
        return x, h

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, h = self.hidden(windows)
        return x, h[:, :-1], h @ self.wide

    def moderate(self) -> bool:
        """Whether no window can give a logit whose exponential leaves float32: the hidden layer lies between -1 and 1."""
        return bool(np.abs(self.wide).sum(0).max() < 80)

    def log_probs(self, windows: np.ndarray, ids: np.ndarray, spelt: list[bytes], spelling: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each word given its window; ``spelt`` are the words without a number in turn."""
        out, done, layout, moderate = np.empty(len(ids), np.float32), 0, self.layout, self.moderate()
        for i in range(0, len(ids), 1024):
            own = ids[i : i + 1024]
            classes = layout.classes.take(own)
            _, h = self.hidden(windows[i : i + 1024])
            z = h @ self.wide
            if not moderate:
                z -= z.max(1, keepdims=True)
            part = z[np.arange(len(z)), classes]
            np.exp(z, out=z)
            part -= np.log(z @ np.ones(z.shape[1], np.float32))
            on = np.flatnonzero(layout.depth.take(own))
            if len(on):
                turn = layout.turn.take(own[on], 0)
                logit = np.einsum("ijk,ik->ij", self.leaves.take(layout.path.take(own[on], 0), 0), h[on])
                logit *= turn
                lost = np.log(1 + np.exp(-np.abs(logit)))
                lost -= np.minimum(logit, 0)
                part[on] -= np.einsum("ij,ij->i", lost, np.abs(turn).astype(np.float32))
            rare = np.flatnonzero(classes == OTHER)
            if len(rare):
                codes, ends = joined(spelt[done : done + len(rare)])
                done += len(rare)
                y = spelling.astype(np.float32) + h[rare, :-1] @ self.more[2]
                top = y.max(1)
                y -= (top + np.log(np.exp(y - top[:, None]).sum(1)))[:, None]
                rows = np.repeat(np.arange(len(rare)), np.diff(ends, prepend=0))
                part[rare] += y[:, 256] + np.bincount(rows, y[rows, codes], len(rare)).astype(np.float32)
            out[i : i + 1024] = part
        return out

    def memory(self) -> list[np.ndarray]:
        """Squared gradients so far, for ``train``."""
        embed, inner, inner_bias, _, _ = self.arrays
        return [np.full_like(a, 0.01) for a in (embed, inner, inner_bias, self.wide, self.leaves, self.more[2])]

    def step(self, a: np.ndarray, m: np.ndarray, grads: np.ndarray) -> None:
        """A step of Adagrad on weights with the squared gradients ``m``."""
        m += grads * grads
        size = np.sqrt(m)
        size += 1e-6
        np.divide(grads, size, out=size)
        size *= self.settings.rate
        a -= size

    def step_rows(self, a: np.ndarray, m: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
        own, seen = a.take(rows, 0), m.take(rows, 0)
        self.step(own, seen, grads)
        whole = np.dtype((np.void, a.itemsize * a.shape[1]))  # rows are put back in one piece
        for table, values in ((a, own), (m, seen)):
            table.view(whole)[rows, 0] = values.view(whole)[:, 0]

    def train(self, windows: np.ndarray, ids: np.ndarray, spelt: list[bytes], spelling: np.ndarray, memory: list[np.ndarray]) -> None:
        """Steps of Adagrad on one batch after the other; ``spelt`` are the words without a number in turn.

        What depends on the words alone is worked out for all batches at once. In a batch words with decisions come first
        and spelt ones last.
        """
        layout, edges = self.layout, np.append(np.arange(0, len(ids), self.settings.batch), len(ids))
        classes = layout.classes.take(ids)
        kind = np.where(classes == OTHER, 2, layout.depth.take(ids) == 0)
        letters = np.empty(len(ids), object)
        letters[kind == 2] = spelt
        order = np.argsort((kind + 3 * (np.arange(len(ids)) // self.settings.batch)).astype(np.min_scalar_type(3 * len(edges))), kind="stable")
        windows, ids, classes, kind, letters = windows[order], ids[order], classes[order], kind[order], letters[order]
        rare, codes, ends = self.edges_of(kind == 2, edges), *joined(letters[kind == 2].tolist())
        ends = np.append(0, ends)
        decided, deep = self.edges_of(kind == 0, edges), ids[kind == 0]
        path, turn = layout.path.take(deep, 0), layout.turn.take(deep, 0).astype(np.float32)
        cells = np.flatnonzero(turn)
        decisions = np.append(0, np.cumsum(layout.depth.take(deep)))[decided]
        spelling = spelling.astype(np.float32)
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            own, spell = slice(*decided[i : i + 2]), slice(*rare[i : i + 2])
            self.train_batch(
                windows[a:z], classes[a:z],
                path[own], turn[own], cells[slice(*decisions[i : i + 2])] - own.start * path.shape[1],
                codes[ends[spell.start] : ends[spell.stop]], np.diff(ends[spell.start : spell.stop + 1]), spelling, memory,
            )

    @staticmethod
    def edges_of(which: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(which))[edges]

    def train_batch(
        self, windows: np.ndarray, classes: np.ndarray, path: np.ndarray, turn: np.ndarray, cells: np.ndarray,
        codes: np.ndarray, lens: np.ndarray, spelling: np.ndarray, memory: list[np.ndarray],
    ) -> None:
        """``path`` and ``turn`` belong to the first positions, and ``cells`` are where they hold decisions; ``codes`` are the
        bytes of the last positions' words, whose lengths are ``lens``."""
        embed, inner, inner_bias, outer, _ = self.arrays
        of_embed, of_inner, of_bias, of_wide, of_leaves, of_spell = memory
        spell, n, moderate = self.more[2], len(classes), self.moderate()
        x, h = self.hidden(windows)
        z = h @ self.wide
        if not moderate:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        sums = z @ np.ones(z.shape[1], np.float32)
        z[np.arange(n), classes] -= sums
        share = (1 / (n * sums))[:, None]  # instead of dividing the wide array
        to_hidden = z @ outer.T
        to_hidden *= share
        dense = [(self.wide, of_wide, (h * share).T @ z)]
        if len(cells):
            own, leaves = h[: len(path)], self.leaves.take(path, 0)
            g = np.einsum("ijk,ik->ij", leaves, own)
            g *= turn
            np.exp(np.minimum(g, 60, out=g), out=g)
            g += 1
            np.divide(turn, g, out=g)
            g *= np.float32(-1 / n)
            to_hidden[: len(path)] += np.einsum("ij,ijk->ik", g, leaves)[:, :-1]
            grads = own.take(cells // path.shape[1], 0)
            grads *= g.reshape(-1).take(cells)[:, None]
            rows, *at = places(path.reshape(-1).take(cells))
            self.step_rows(self.leaves, of_leaves, rows, summed(grads, *at))
        if len(lens):
            own = h[n - len(lens) :, :-1]
            y = own @ spell
            y += spelling
            y -= y.max(1, keepdims=True)
            np.exp(y, out=y)
            y *= ((lens + 1) / (n * y.sum(1))).astype(np.float32)[:, None]
            np.subtract.at(y.reshape(-1), np.repeat(np.arange(len(lens)) * 257, lens) + codes, np.float32(1 / n))
            y[:, 256] -= np.float32(1 / n)
            to_hidden[n - len(lens) :] += y @ spell.T
            dense.append((spell, of_spell, own.T @ y))
        own = h[:, :-1]
        to_hidden *= 1 - own * own
        rows, *at = places(windows.reshape(-1))
        to_embed = summed((to_hidden @ inner.T).reshape(-1, embed.shape[1]), *at)
        dense += [(inner, of_inner, x.T @ to_hidden), (inner_bias, of_bias, to_hidden.sum(0))]
        for a, m, grads in dense:
            self.step(a, m, grads)
        self.step_rows(embed, of_embed, rows, to_embed)


@dataclass(frozen=True)
class Model:
    settings: Settings
    numbers: dict[str, int]  # of the words that are frequent enough
    spelling: np.ndarray  # logarithm of the probability of each byte and of a word's end, whatever the window
    weights: np.ndarray
    trained: int = 0  # positions in all rounds

    def coded(self, words: list[str]) -> np.ndarray:
        """Numbers of words; the others have one of the shared numbers, or ``OTHER`` if all words of the corpus are numbered."""
        get, first, buckets = self.numbers.get, (self.settings.words or 0) + 2, self.settings.buckets
        ids = np.fromiter(map(get, words, repeat(OTHER)), np.int32, len(words))
        if buckets:
            for i in np.flatnonzero(ids == OTHER):
                ids[i] = first + crc32(in_bytes(words[i])) % buckets
        return ids

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """Whether the words of these numbers are spelt."""
        return (ids == OTHER) | (ids >= (self.settings.words or 0) + 2)


def positions(start: int, length: int, settings: Settings) -> np.ndarray:
    """Positions of a text that a round trains on. With fewer rounds than the stride a short text gives one all the same."""
    if settings.rounds < settings.stride and length:
        start %= length
    return np.arange(start, length, settings.stride)


def train_round(docs: DataFrame, model: Model, number: int, key: str, text: str, tasks: int) -> Model:
    """The model after a round: every task trains from the same weights, then they are averaged."""
    settings, salts = model.settings, math.isqrt(tasks)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary and weights: sizes are settings

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        net = Network.from_flat(settings, model.weights)
        memory = net.memory()
        windows, targets, spelt, seen, held = [], [], [], 0, 0

        def step() -> None:
            w, t = np.concatenate(windows), np.concatenate(targets)
            rare, letters = model.spelt(t), np.empty(len(t), object)
            letters[rare] = spelt
            order = np.random.default_rng(settings.seed + seen).permutation(len(t))
            for i in range(0, len(t), 32 * settings.batch):  # a long text has many
                part = order[i : i + 32 * settings.batch]
                net.train(w[part], t[part], letters[part[rare[part]]].tolist(), model.spelling, memory)

        for batch in steps(batches):
            for start, t in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(t)
                ids = model.coded(words)
                at = positions(start, len(ids), settings)
                if len(at):
                    windows.append(net.windows(ids, at))
                    targets.append(ids[at])
                    spelt += [in_bytes(words[i]) for i in at[model.spelt(ids[at])]]
                    held += len(at)
                if held >= 32 * settings.batch:
                    step()
                    seen, held = seen + held, 0
                    windows.clear()
                    targets.clear()
                    spelt.clear()
        if held:
            step()
            seen += held
        if seen:
            flat, salt = net.flat(), TaskContext.get().partitionId() % salts
            for i in range(0, len(flat), CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // CHUNK], pa.int32()), pa.array([salt], pa.int32()), pa.array([float(seen)]),
                     pa.array([flat[i : i + CHUNK].tobytes()], pa.binary())],
                    ["chunk", "salt", "n", "weights"],
                )

    def average(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        mean = sum(np.frombuffer(x.as_py(), np.float32) * np.float32(k) for x, k in zip(group.column("weights"), n / n.sum()))
        return pa.table({
            "chunk": group.column("chunk")[:1], "salt": pa.array([0], pa.int32()), "n": pa.array([n.sum()]),
            "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
        })

    # positions shift by one from round to round, and from text to text
    stride = F.lit(settings.stride)
    start = F.pmod(F.pmod(F.xxhash64(key, text), stride) + F.lit(number), stride).cast("int")
    rows = docs.select(start.alias("start"), F.col(text).alias("text")).coalesce(tasks)  # each sends all weights
    schema = "chunk int, salt int, n double, weights binary"
    means = rows.mapInArrow(work, schema).groupBy("chunk", "salt").applyInArrow(average, schema)
    found = means.groupBy("chunk").applyInArrow(average, schema).collect()  # the weights once
    shared.unpersist()
    if not found:
        return model
    weights = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["chunk"])])
    return replace(model, weights=weights, trained=model.trained + round(found[0]["n"]))


def fit(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """The model of a table. An empty table gives the untrained network and even byte frequencies."""
    counts = cut_lineage(word_counts(docs, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total // WORDS_PER_TASK)
    least = max(1, settings.least * total)
    common = sorted((-r["n"], r["word"]) for r in counts.filter(F.col("n") >= least).collect())  # 1 / settings.least at most
    numbers = {word: i + 2 for i, (_, word) in enumerate(common)}
    rare = counts.filter(F.col("n") < least)
    buckets = 0 if rare.isEmpty() else settings.buckets
    settings = replace(settings, inputs=max(settings.inputs, len(numbers) + 2 + buckets), words=len(numbers), buckets=buckets)
    bytes_seen = byte_counts(rare) + 1
    spelling = np.log(bytes_seen / bytes_seen.sum())
    model = Model(settings, numbers, spelling, Network(settings).flat())
    for number in range(settings.rounds):
        model = train_round(docs, model, number, key, text, tasks)
    return model


def score_words(model: Model, net: Network, words: list[str]) -> float:
    """Summed logarithm (natural) of the probability of every word given the words around it."""
    ids = model.coded(words)
    total = 0.0
    for i in range(0, len(ids), 1 << 16):
        at = np.arange(i, min(len(ids), i + (1 << 16)))
        spelt = [in_bytes(words[k]) for k in at[model.spelt(ids[at])]]
        total += float(net.log_probs(net.windows(ids, at), ids[at], spelt, model.spelling).sum(dtype=np.float64))
    return total


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, log_likelihood, per_word``.

    A text without words, or null, has 0 words, likelihood 0 and a null ``per_word``. Equal texts score alike.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        net = Network.from_flat(model.settings, model.weights)
        for batch in steps(batches):
            sizes, sums = [], []
            for t in batch.column("text").to_pylist():
                words = words_of(t)
                sizes.append(len(words))
                sums.append(score_words(model, net, words) if words else 0.0)
            per = [s / n if n else None for s, n in zip(sums, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(per, pa.float64())],
                ["doc_id", "n_words", "log_likelihood", "per_word"],
            )

    return rows.mapInArrow(work, f"doc_id {kind}, n_words bigint, log_likelihood double, per_word double")
