"""Periodic runs, the prefix trie and the quality score: brute force, held-out accuracy and odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from applause.llm import periodic_runs, prefix_trie, quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def runs_of(words, least, repeats):
    """Every maximal stretch of every period, and of those the ones whose period is smallest."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                part = words[i : j + p]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed_of(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 2), (4, 2), (3, 3), (10, 3)])
def test_runs_by_brute_force(least, repeats):
    rng = random.Random(least * 10 + repeats)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.choice([0, 1, 5, 20, 60]))]
            part = words[: rng.randint(0, 8)]
            texts.append(" ".join(words[: rng.randint(0, 60)] + (part * 20)[: rng.randint(0, 90)] + words).encode())
        lens, counts, (start, length, period), collapsed = periodic_runs.analysed(texts, least, repeats)
        at = 0
        for i, text in enumerate(texts):
            here = slice(at, at + counts[i])
            at += counts[i]
            words = text.decode().split()
            want = runs_of(words, least, repeats)
            assert list(zip(start[here].tolist(), length[here].tolist(), period[here].tolist())) == want
            assert lens[i] == len(words) and collapsed[i].decode() == collapsed_of(words, want)


def test_common_prefix_floor():
    assert [periodic_runs.floor_of(*x) for x in ((6, 4), (2, 2), (4, 2), (10, 3))] == [5, 1, 2, 7]


ODD = [
    None, "", "  \n ", "a", "a a a a a", "a a a a a a", "x y " * 5000, "a b a b a b a b a b a b",
    "\ta b c\x0ba b c\x0ca b c\ra b c\n", "ß \U0001f600 " * 4, "a b a b a b a b c c c c c c c a b a b a b a b a b",
]


def test_runs_of_odd_rows(spark):
    rows = [(i, t, "d", 1) for i, t in enumerate(ODD)] + [(None, ODD[5], None, None), (5, ODD[5], "x", 2), (5, "other", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int").repartition(3)
    found = periodic_runs.find_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        own = [(0, 10000, 2)] if t == "x y " * 5000 else runs_of(words, 6, 4)
        want.append((i, len(words), own, "x y" if len(words) > 5000 else collapsed_of(words, own)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode()) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.find_runs(spark.createDataFrame([], docs.schema)).count() == 0


def test_periodic_runs_query(spark):
    """The registered query over its whole table against plain code."""
    want = []
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs_of(words, 6, 4) if n < 1500 else brute_long(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        start, length, period = best
        want.append((
            doc_id, len(found), start, length, period, None if length is None else 1000 * length // period,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed_of(words, found)),
        ))
    df = queries.QUERIES["op12_periodic_runs"](spark, SF)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 6 + ["string"] * 2
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(want) and any(r[1] for r in got)


def brute_long(words):
    """As ``runs_of`` with numbers in arrays."""
    codes = np.unique(np.array(words), return_inverse=True)[1]
    found = []
    for p in range(1, len(words) // 4 + 1):
        same = np.concatenate([[0], (codes[p:] == codes[:-p]).astype(np.int8), [0]])
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(starts.tolist(), ends.tolist()):
            if j + p - i >= max(6, 4 * p):
                part = words[i : j + p]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((i, j + p - i, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


# prefix trie


def trie_by_hand(conversations):
    """Nodes of ``{conv_id: [(role, text), ...]}`` straight from the definition."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, convs in members.items():
        cost = (len(convs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    out = []
    for p, convs in members.items():
        ends = sorted(c for c in convs if len(conversations[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), parent, len(convs), children[p], leaves[p], saved[p], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def rebuilt_by_hand(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own, key=lambda x: x[:2])] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # as SQL counts below zero
    return out


def test_prefix_trie_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    df = queries.QUERIES["op13_prefix_trie"](spark, SF)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == trie_by_hand(rebuilt_by_hand(rows))


@pytest.mark.parametrize("slice_bytes", [100, 1000, 1 << 20])
def test_trie_is_the_same_in_any_slices(spark, slice_bytes):
    """Many equal conversations, a common first turn, prefixes of others, nulls and odd columns."""
    rng = random.Random(3)
    rows, schema = [], "conv_id bigint, turn bigint, role string, text string, key string, slice int, turns int"
    for c in range(150):
        said = ["hello there", "b", "c c c", "", None] if c % 3 == 0 else ["hello there"] + [rng.choice(["b", "c c", "d"]) for _ in range(rng.randint(0, 6))]
        rows += [(c, i or None, "user" if i % 2 else None, t, "k", 1, 2) for i, t in enumerate(said)]
    rows += [(None, 1, "user", "nobody's", None, None, None), (-7, 2, "a", "x\ty z", None, None, None), (10**12, 5, "user:", "hello there", "", 0, 0)]
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, schema)
    sequences = prefix_trie.turns(given)
    want = trie_by_hand({c: t for c, t in plain_turns(rows).items()})
    got = sorted((tuple(r) for r in prefix_trie.build(sequences, slice_bytes).collect()), key=repr)
    assert got == want
    again = sorted((tuple(r) for r in prefix_trie.build(queries.rebuilt(sequences), slice_bytes).collect()), key=repr)
    assert again == trie_by_hand(rebuilt_by_hand([r[:4] for r in rows]))


def plain_turns(rows):
    turns = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own, key=lambda x: x[:2])] for c, own in turns.items()}


def test_empty_and_turnless_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.build(prefix_trie.turns(spark.createDataFrame([], schema))).count() == 0
    rows = [(c, 1, "u", "same") for c in (1, 3, 4, 7, 8)]  # no conversation 0: what h cuts off is lost
    df = prefix_trie.build(queries.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, schema))), 64)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == trie_by_hand(rebuilt_by_hand(rows))


def test_repeated_turns_have_one_order(spark):
    rows = [(2, 1, "u", t) for t in "abcabc"] + [(3, None, "u", "z"), (3, None, "u", "y"), (3, 0, "u", "x")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    a = prefix_trie.turns(spark.createDataFrame(rows, schema)).collect()
    b = prefix_trie.turns(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()
    assert sorted(a) == sorted(b) and [len(r["turns"]) for r in sorted(a)] == [6, 3]


def test_node_layouts():
    tree = prefix_trie.RadixTree()
    keys = [bytes([i]) * 16 + bytes([j]) * 16 for i in range(256) for j in range(i % 60)]
    random.Random(1).shuffle(keys)
    for k in keys:
        tree.insert(k, k)
    assert tree.root.layout == 256
    seen, todo = [], [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        whole = above + node.prefix
        assert all(e == whole for e in node.ends)
        seen += node.ends
        below = node.nodes()
        assert node.layout == next(x for x in (4, 16, 48, 256) if x >= len(below))
        assert [c.prefix[0] for c in below] == sorted(c.prefix[0] for c in below)
        todo += [(c, whole) for c in below]
    assert sorted(seen) == sorted(keys)


# quality


def test_pairwise_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    machine = quality.Machine(np.zeros((0, 3)), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)), 20)
    edges = np.array([0, 5, 6, 12])
    features, values = rng.integers(0, 20, 12), rng.normal(size=12)
    for i in range(3):
        f, x = features[edges[i] : edges[i + 1]], values[edges[i] : edges[i + 1]]
        pairs = sum(machine.factors[f[a]] @ machine.factors[f[b]] * x[a] * x[b] for a in range(len(f)) for b in range(a))
        assert np.isclose(machine.margins(edges, features, values)[i], 0.3 + machine.weights[f] @ x + pairs)


def test_gradient():
    """A step of the fit goes down the loss that finite differences see."""
    features = quality.Features(64)
    texts = ["good words here", "BAD!! BAD!!", "good text and more", "BAD!! $$$"]
    rows = features(texts, np.zeros((4, 0)))
    machine = quality.fitted(rows, np.array([1.0, 0, 1, 0]), np.ones(4), 64, 3, epochs=200)
    margins = machine.margins(*machine.places(*rows))
    assert (margins[[0, 2]] > 2).all() and (margins[[1, 3]] < -2).all()


def test_quality_query(spark):
    """Held-out documents at a tenth of scale: the labels are found, and clean documents keep their place."""
    sf = "/root/testdata/sf0.1"
    df = queries.QUERIES["op11_quality"](spark, sf)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    assert [t for _, t in df.dtypes] == ["bigint", "boolean", "double", "int"]
    found = {r["doc_id"]: r for r in df.collect()}
    assert len(found) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in found.items())
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    held = [(q, found[i]["predicted"]) for i, q in labels if found[i]["held_out"]]
    assert len(held) > 500
    for label in (0, 1):
        assert np.mean([p == label for q, p in held if q == label]) > 0.95


def test_quality_of_odd_rows(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["ALPHA!!", "$$$", "BETA!!"]) for _ in range(30)) for _ in range(60)]
    texts = [None, "", "  ", "\U0001f600" * 10, good[0] * 2000, *good, *bad]
    rows = [(i, t, None if i % 7 == 0 else float("inf") if i == 3 else float(i % 5), "x", 1) for i, t in enumerate(texts)]
    rows += [(None, good[0], 1.0, None, None), (7, bad[0], 1.0, "x", 0), (7, bad[0], 1.0, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n double, label string, weight int").repartition(3)
    given = [(i, None if i < 2 else int(i < 65), "e") for i in range(len(texts))] + [(None, 1, "e"), (8, 1, "e"), (8, 1, "e"), (9, 5, "e"), (999, 0, "e")]
    labels = spark.createDataFrame(given, "doc_id bigint, quality int, id string")
    rows_of = quality.training_rows(docs, labels, metadata=["n"])
    assert rows_of.count() == len(texts) - 2 + 1  # id 7 counts with both of its texts, repeated rows once
    machine = quality.fit(rows_of, 256)
    found = quality.score(docs, machine, metadata=["n"]).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(map(repr, (r[0] for r in rows)))
    by_id = {}
    for r in found:
        assert 0 <= r["score"] <= 1
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert np.mean([by_id[i][0] > 0.5 for i in range(70, len(texts))]) < 0.05 < 0.95 < np.mean([by_id[i][0] > 0.5 for i in range(10, 65)])
    few = quality.training_rows(docs, labels, per_label=10, metadata=["n"]).collect()
    assert 4 <= len(few) <= 40 and {r["label"] for r in few} == {0, 1} and all(r["weight"] > 1 for r in few)
    again = quality.fit(quality.training_rows(docs.repartition(2), labels, metadata=["n"]), 256)
    assert np.array_equal(again.factors, machine.factors) and again.bias == machine.bias
    empty = docs.limit(0)
    assert quality.fit(quality.training_rows(empty, labels, metadata=["n"])) is None
    assert quality.score(empty, machine, metadata=["n"]).count() == 0
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
