"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from applause.llm import bpe, decontaminate, exact_dedup, language_id, lm_score, queries, shards, simhash, substrings, token_counts, url_filter
from applause.session import cut_lineage

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "zwölf große Boxkämpfer jagen Viktor quer über den Deich " * 4000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, id_hash string, row string, score string, block int"


def rows():
    passage = "A passage that is long enough to be found again in another document, word for word."
    texts = [
        "the quick brown fox jumps over the lazy dog", "the quick  brown\tfox jumps over the lazy dog", None, "", "   ",
        passage, "Before it. " + passage + " After it.", LONG, LONG, "12 34 !!", "<|endoftext|> x <|startoftext|>",
        "Größe\u0301 \u00a0 ΣΑΣ  ne\r\nw\x85line \U0001f600\U0001f600 \u2028x", "a" * 5000, "a\x00b" + "\x00" * 70, "ab " * 40,
    ]
    out = [(i, t, "de" if t == LONG else "en") for i, t in enumerate(texts)]
    out += [(3, "", "en"), (0, texts[0], "en"), (None, texts[0], None), (None, passage, "en"), (99, None, None)]
    return [(i, t, lang, None if i == 4 else "s", None, "d", "h", "r", "x", 1) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [tuple(r) for r in df.collect()]


def order(found):
    return sorted(found, key=repr)


def plain(text):
    return " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", text or ""))


def test_exact_dedup(docs):
    given, want = rows(), []
    groups = {}
    for i, t, *_ in given:
        groups.setdefault(plain(t), []).append(i)
    for i, t, *_ in given:
        ids = groups[plain(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    for support in (0.5, 0.1, 0.001):
        assert order(got(exact_dedup.decide(docs, support=support))) == order(want)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({w[0] for w in want if w[3]})


def test_shards(docs, spark):
    first = shards.first_map(spark, 4, 64)
    found = shards.assign(docs, first, shards.grow(first, 4), slots=64).collect()
    sizes = order((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes
    for s in range(4):
        mine = [r["slot"] for r in found if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in found)
    ids = {}
    for r in found:
        assert ids.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])


def test_slot_maps(spark, docs, tmp_path):
    first = shards.first_map(spark, 5, 1000)
    path = str(tmp_path / "maps")
    shards.store_map(first, path)
    shards.store_map(shards.grow(shards.load_map(spark, path), 5), path)
    old = {r["slot"]: r["shard"] for r in shards.load_map(spark, path, 1).collect()}
    new = {r["slot"]: r["shard"] for r in shards.load_map(spark, path).collect()}
    assert all(new[s] in (old[s], 5) for s in old)
    counts = np.bincount(list(new.values()))
    assert len(counts) == 6 and counts.max() - counts.min() <= 6
    many = spark.range(20_000).selectExpr("id doc_id", "repeat('x', cast(id % 50 * (id % 7) as int)) text")
    sizes = shards.slot_sizes(many, slots=1000)
    even = shards.rebalance(first, sizes, 5)
    moved = {r["slot"]: r["shard"] for r in even.collect()}
    weight = {r["slot"]: r["bytes"] for r in sizes.collect()}
    full = [sum(weight.get(s, 0) for s in moved if moved[s] == k) for k in range(5)]
    assert sorted(moved) == list(range(1000)) and max(full) - min(full) <= 2 * max(weight.values())
    assert even.first()["version"] == 2


def test_sharding_applies_the_byte_aware_map(spark, tmp_path):
    many = spark.range(4000).selectExpr("id doc_id", "repeat('x', cast(if(id % 97 = 0, 3000, id % 50) as int)) text")
    many.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op5_sharding"](spark, str(tmp_path)).collect()
    assert len(found) == 4000
    slots, full = {}, [0] * 17
    for r in found:
        slots[r["virtual_slot"]] = slots.get(r["virtual_slot"], 0) + r["size"]
        full[r["balanced_shard"]] += r["size"]
    assert max(full) <= sum(full) / 17 + max(slots.values())
    grown = [sum(r["size"] for r in found if r["grown_shard"] == k) for k in range(17)]
    assert max(full) - min(full) < max(grown) - min(grown)


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "https://WWW.a.bad.org/x/y?z", "2024-03-01 00:00:00"), (2, "http://a.bad.org/x", "2024-01-31 23:59:59"),
         (3, None, "2024-03-01 00:00:00"), (4, "no host", "2024-03-01 00:00:00"), (5, "http://bad.org", None),
         (6, "http://u:p@bad.org:80/ok/z", "2025-01-01 00:00:00"), (6, "http://u:p@bad.org:80/ok/z", "2025-01-01 00:00:00"),
         (7, "http://notbad.org/x", "2024-03-01 00:00:00"), (None, "http://bad.org/q", "2024-02-01 00:00:00")],
        "page_id bigint, url string, t string",
    ).selectExpr("page_id", "url", "cast(t as timestamp_ntz) fetched_at", "'c' as pattern")
    entries = [("bad.org", "add", "2024-02-01"), ("bad.org", "add", "2024-02-10"), ("bad.org", "remove", "2024-04-01"),
               ("bad.org", "add", "2024-05-01"), ("bad.org/ok", "add", "2024-05-01"), (None, "add", "2024-01-01"),
               ("a.bad.org", "add", "2024-02-20"), ("a.bad.org", "remove", "2024-02-20"), ("x", "other", "2024-01-01")]
    listed = spark.createDataFrame(entries, "pattern string, action string, t string").selectExpr(
        "pattern", "action", "cast(t as timestamp_ntz) at")
    allow = listed.filter("pattern = 'bad.org/ok'")
    every = url_filter.evaluate(pages, listed, allow).collect()
    found = {r["page_id"]: r for r in every}
    assert len(every) == 9 and len(found) == 8
    assert {k for k, r in found.items() if not r["keep"]} == {1, None}
    assert found[1]["blocked_by"] == "bad.org" and found[1]["host"] == "a.bad.org"
    assert [r["n_blocking"] for r in every if r["page_id"] == 6] == [2, 2] and found[6]["allowed_by"] == "bad.org/ok" and found[6]["keep"]
    assert got(url_filter.evaluate(pages.limit(0), listed, allow)) == []
    assert all(r["keep"] for r in url_filter.evaluate(pages, listed.limit(0)).collect())


def test_url_filter_judges_each_capture(spark):
    """Captures that share an id, or have none, keep their own URL, time and decision."""
    rows = [(None, "http://bad.com/x", "2024-03-01"), (None, "http://ok.com/x", "2024-03-01"), (1, "http://bad.com/", "2023-12-31"),
            (1, "http://bad.com/", "2024-02-01"), (1, "http://bad.com/", None), (1, None, "2024-02-01"), (1, None, "2024-02-01")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, t string").selectExpr("page_id", "url", "cast(t as timestamp_ntz) fetched_at")
    listed = spark.sql("select 'bad.com' pattern, 'add' action, timestamp_ntz'2024-01-01 00:00:00' at")
    found = [(r["page_id"], r["host"], str(r["fetched_at"])[:10], r["keep"]) for r in url_filter.evaluate(pages, listed).collect()]
    assert order(found) == order([
        (None, "bad.com", "2024-03-01", False), (None, "ok.com", "2024-03-01", True), (1, "bad.com", "2023-12-31", True),
        (1, "bad.com", "2024-02-01", False), (1, "bad.com", "None", True), (1, None, "2024-02-01", True), (1, None, "2024-02-01", True),
    ])


@pytest.mark.parametrize("pattern", ["WWW.Ok.com", "ok.com/y/", "http://ok.com", " //ok.com/y ", "ok.com:80", "https://u@www.OK.com.//y?q#z"])
def test_url_filter_list_spelling(spark, pattern):
    pages = spark.sql("select 1 page_id, 'http://www.ok.com/y/z' url, timestamp_ntz'2024-03-01 00:00:00' fetched_at")
    listed = spark.createDataFrame([(pattern,), ("/only/a/path",), ("",)], "pattern string").selectExpr(
        "pattern", "'add' action", "timestamp_ntz'2024-01-01 00:00:00' at")
    row = url_filter.evaluate(pages, listed).first()
    assert not row["keep"] and row["blocked_by"] in ("ok.com", "ok.com/y") and row["n_blocking"] == 1


def test_url_filter_deep_patterns(spark):
    pages = spark.sql("select 1 page_id, 'http://h.org/a/b/c/d/e' url, timestamp_ntz'2024-03-01 00:00:00' fetched_at")
    listed = spark.sql("select 'h.org/a/b/c/d' pattern, 'add' action, timestamp_ntz'2024-01-01 00:00:00' at")
    row = url_filter.evaluate(pages, listed).first()
    assert row["blocked_by"] == "h.org/a/b/c/d" and not row["keep"]
    assert url_filter.evaluate(pages, listed, path_parts=4).first()["blocked_by"] == "h.org/a/b/c/d"
    with pytest.raises(Exception, match="deeper than path_parts=3"):
        url_filter.evaluate(pages, listed, path_parts=3).collect()


def brute_components(fps, distance):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_rows(docs):
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
        hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    given = [(i, t) for i, t, *_ in rows()]
    fps = [fingerprint(t) for _, t in given]
    root = brute_components(fps, 3)
    want = []
    for (i, _), f, r in zip(given, fps, root):
        ids = [x for (x, _), q in zip(given, root) if q == r and x is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    found = simhash.cluster(docs)
    assert order(got(found.select("doc_id", "fingerprint", "component_id"))) == order(want)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = {w[0] for w in want if w[0] is None or w[0] == w[2]}
    assert {r["doc_id"] for r in left.collect()} == ids


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are judged by their own text."""
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "wholly other words that nobody else has"), (None, "a b c d e"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert order(got(simhash.drop_near_duplicates(docs))) == order([rows[0], *rows[2:]])


@pytest.mark.parametrize("limit", [1 << 14, 1])
def test_simhash_links(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "HOT_PAIRS", limit)  # 1: every key with a pair is keyed once more
    rng = np.random.default_rng(1)
    near = [int(x) for x in rng.integers(0, 1 << 63, 20, np.uint64)]
    for base in near[:12]:
        for _ in range(6):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            near.append(x)
    near = sorted(set(near))
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    found = got(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 3))
    want = {frozenset((a, b)) for a, x in zip(signed, near) for b, y in zip(signed, near) if a < b and (x ^ y).bit_count() <= 3}
    assert len(found) == len(want) and {frozenset(f) for f in found} == want


@pytest.mark.parametrize("limit", [1 << 14, 1])
def test_simhash_keys_stay_off_the_driver(spark, monkeypatch, limit):
    """Exploded keys look small to Spark, whatever their number; no side of a join of keys may be broadcast."""
    monkeypatch.setattr(simhash, "HOT_PAIRS", limit)
    nodes = cut_lineage(spark.createDataFrame([(x,) for x in (1, 3, 1 << 40)], "fp bigint"))
    plan = simhash.links(nodes)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, x) for x in range(201, 230)]
    found = dict(got(simhash.components(spark.createDataFrame(chain, "a bigint, b bigint"))))
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[95] == found[90] == 90
    assert all(found[i] == 200 for i in range(200, 230))


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows()]
    assert order((i, list(ids), bytes(b)) for i, ids, b in got(found)) == order(want)
    both = bpe.encode_and_decode(docs, RANKS, PATTERN)
    assert order((i, list(ids), bytes(b)) for i, ids, b in got(both)) == order(want)


def test_bpe_words():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Tokenizer(RANKS, PATTERN)
    rng = np.random.default_rng(3)
    letters = list("aabcdeest  \n'19é中\u00a0\U0001f600.-_")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)] + ["a" * 1000, " " * 300, "é" * 400]
    assert [np.frombuffer(x, np.int32).tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    words = [w.encode() for w in ("thththeer", "aaaaaaa", "tokenization", "x" * 90)]
    words += [bytes(rng.choice(list(b"abcde"), n)) for n in (120, 128, 129, 300, 1000)] + [b"a" * n for n in range(126, 140)]
    assert [coder.contract_heap(w) for w in words] == coder.contract(words)
    assert [coder.contract_batch([w], longer=True)[0] for w in words] == coder.contract(words)


@pytest.mark.parametrize("n, length", [(20_000, 40), (10_000, 60), (5_000, 100), (20, 1000), (1, 60_000)])
def test_bpe_of_many_long_words(n, length):
    """Texts whose steps together would not fit into the memory of a query."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = np.random.default_rng(n).choice(list("abcdefghijklmnopqrstuvwxyz"), (n, length))
    text = " ".join(map("".join, letters))
    coder = bpe.Tokenizer(RANKS, PATTERN)
    ids = coder.encoded(pa.array([text, None, "", text[:100]]))
    assert ids[0].as_py() == library.encode_ordinary(text)
    assert coder.decode(ids) == [text.encode(), b"", b"", text[:100].encode()]


def test_bpe_where_a_contraction_makes_an_earlier_pair(tmp_path):
    """Ranks in any order: after one contraction the pair beside it may come first."""
    rng = np.random.default_rng(9)
    for n in range(20):
        tokens = sorted({bytes(rng.choice(list(b"abc"), rng.integers(2, 5))) for _ in range(40)})
        tokens = [bytes([i]) for i in range(256)] + [tokens[i] for i in rng.permutation(len(tokens))]
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        coder = bpe.Tokenizer(str(path), PATTERN)
        words = [bytes(rng.choice(list(b"abc"), rng.integers(1, 60))) for _ in range(60)]
        heap = [coder.contract_heap(w) for w in words]
        assert heap == coder.contract_batch(words) == coder.contract_batch(words, longer=True)


def test_one_tokenizer_for_a_worker():
    assert bpe.tokenizer(RANKS, PATTERN) is bpe.tokenizer(RANKS, PATTERN)


def test_token_counts(docs):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert order(got(token_counts.count_tokens(docs, WORDS))) == order(want)
    assert order(got(token_counts.count_tokens(docs, WORDS, buckets=1))) == order(want)


def test_token_count_cuts():
    library, source = Tokenizer.from_file(WORDS), token_counts.PreTokens(WORDS)
    rng = np.random.default_rng(5)
    letters = list("aAbé'st 1中\u0301\u00a0\u2002ΣßİǅK\n.-\x85") + ["<|endoftext|>", "<|startoftext|>"]
    for _ in range(500):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        n = sum(source.pieces([w for own in source.of_cuts(source.cuts(text)) for w in own]))
        assert n == len(library.encode(text, add_special_tokens=False).ids), text


def brute_removal(texts, length):
    first, out = {}, []
    for i, t in texts:
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            first[w] = min(first.get(w, i), i)
    for i, t in texts:
        gone = [False] * len(t)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < i:
                gone[a : a + length] = [True] * length
        spans, kept = [], bytearray()
        for a, g in enumerate(gone):
            if not g:
                kept.append(t[a])
            elif a and gone[a - 1]:
                spans[-1][1] = a + 1
            else:
                spans.append([a, a + 1])
        out.append((None if i == substrings.LATE else i, len(t), spans, bytes(kept)))
    return out


def compare_removal(df, texts, length, **options):
    found = [(r["doc_id"], r["n_bytes"], [list(s) for s in r["spans"]], bytes(r["kept"])) for r in
             substrings.remove_repeats(df, length, **options).collect()]
    assert order(found) == order(brute_removal(texts, length))


def test_suffix_dedup(docs):
    texts = [(substrings.LATE if i is None else i, (t or "").encode()) for i, t, *_ in rows()]
    compare_removal(docs, texts, 50)


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup_random(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)  # 1: every shared anchor is split into its windows
    rng = np.random.default_rng(11)
    shared = ["".join(rng.choice(list("ab c"), 90)) for _ in range(4)] + ["ab" * 60, "x" * 80]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts.append(str(rng.choice(shared))[rng.integers(0, 30) : rng.integers(45, 120)])
            parts.append("".join(rng.choice(list("abcdefgh"), rng.integers(0, 20))))
        texts.append((i // 2 * 2 if i % 7 == 0 else i, "".join(parts)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    compare_removal(df, [(i, t.encode()) for i, t in texts], 32, docs_per_block=7)


def test_interval_classes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        texts = [bytes(rng.integers(0, 3, rng.integers(6, 20)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        ids = rng.integers(0, 9, len(texts))
        found = substrings.least_ids(texts, ids, 6)
        for t, f in zip(texts, found):
            for a in range(len(t) - 5):
                assert f[a] == min(i for i, u in zip(ids, texts) if t[a : a + 6] in u)


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark, docs):
    item = "What is the capital of the smallest country whose name begins with the letter L, and when was it founded there?"
    edited = item.replace("smallest", "smalest").replace("begins with", "begin with the")
    far = item[: len(item) // 2] + " something else entirely different from this"
    items = spark.createDataFrame([(1, item), (2, None), (3, "!!"), (4, item), (5, "zz"), (None, "not in there at all")], "item_id bigint, text string")
    more = [(50, "Intro. " + item.upper() + " Outro."), (51, "x " + edited), (52, far), (53, item + " " + item), (53, item), (54, LONG + item)]
    given = spark.createDataFrame(more, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    clean, texts = decontaminate.normalised, more + [(i, t) for i, t, *_ in rows()]
    want = []
    for i, t in texts:
        for k, x in ((1, item), (4, item), (5, "zz")):
            t2 = clean(t or "")[-3000:] if t and len(t) > 10_000 else clean(t or "")
            d = edit_distance_in(clean(x), t2)
            if t is not None and d <= decontaminate.budget(clean(x)):
                want.append((i, k, d))
    found = decontaminate.find(given, items)
    assert order((r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()) == order(want)
    assert (51, 1, 6) in want and {w[0] for w in want} == {50, 51, 53, 54}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count()


def test_decontamination_of_repeated_and_missing_ids(spark):
    item = "a passage of the benchmark that no document should hold"
    rows = [(7, "x " + item), (7, "clean"), (None, item), (None, "clean too"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert order(got(decontaminate.drop_contaminated(docs, items))) == order([rows[1], *rows[3:]])


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "string", "decimal(9,0)", "double", "date"])
def test_decontamination_with_any_id_type(spark, kind):
    item = "a passage of the benchmark that no document should hold"
    value = "date'2024-01-01'" if kind == "date" else f"cast(3 as {kind})"
    docs = spark.sql(f"select {value} doc_id, 'x {item} y' text")
    items = spark.sql(f"select {value} item_id, '{item}' text")
    found = decontaminate.find(docs, items)
    row = found.first()
    assert found.schema["item_id"].dataType.simpleString() == kind and row["item_id"] == row["doc_id"] and row["edits"] == 0


def test_short_items_stand_alone(spark):
    items = [(1, "he"), (2, "zz top"), (3, "é")]
    matcher = decontaminate.Matcher(items)
    hits = lambda t: [(h[0], t_of(t)[h[2] : h[3]]) for h in matcher.hits(t)]
    t_of = decontaminate.normalised
    assert hits("the puzzle: there, zz topping, éa") == []
    assert hits("so he said; ZZ  top!") == [(1, "he"), (2, "zz top")] and hits("é") == [(3, "é")] and hits("he he") == [(1, "he")]


def test_an_item_without_its_longest_word():
    item = "why would an unusually known committee meet in the small town by the lake at night, and for what good"
    for gone in ("unusually ", "committee ", "town "):
        assert decontaminate.Matcher([(1, item)]).hits("Intro " + item.replace(gone, "") + " and so on")
    assert not decontaminate.Matcher([(1, item)]).hits("why would an old man meet by the lake at night, he said, and for what reason in the town")
    assert decontaminate.budget("x" * 31) == 1 and decontaminate.budget("") == 0


def test_suffix_dedup_id_types(spark):
    base = spark.range(3).selectExpr("id", "repeat('abc ', 30) text")
    for kind in ("tinyint", "smallint", "int"):
        found = substrings.remove_repeats(base.selectExpr(f"cast(id as {kind}) doc_id", "text"))
        assert found.schema["doc_id"].dataType.simpleString() == kind
        assert sorted((r["doc_id"], len(r["kept"])) for r in found.collect()) == [(0, 120), (1, 0), (2, 0)]
    with pytest.raises(TypeError, match="doc_id is string"):
        substrings.remove_repeats(base.selectExpr("cast(id as string) doc_id", "text"))


def test_myers_and_pieces():
    rng = np.random.default_rng(4)
    for _ in range(300):
        item = "".join(rng.choice(list("abc "), rng.integers(1, 80)))
        text = "".join(rng.choice(list("abc "), rng.integers(0, 60)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontaminate.nearest(masks, len(item), text)[0] == edit_distance_in(item, text)
    base = "".join(rng.choice(list("abcdefgh "), 200))
    matcher = decontaminate.Matcher([(1, base)])
    clean = decontaminate.normalised(base)
    for _ in range(100):
        changed = list(clean)
        for _ in range(rng.integers(0, 16)):
            at = int(rng.integers(0, len(changed)))
            changed[at : at + int(rng.integers(0, 2))] = str(rng.choice(list("xyz")))
        text = "p" + "".join(changed) + "q"
        d = edit_distance_in(clean, text)
        hits = matcher.hits(text)
        assert (d <= decontaminate.budget(clean)) == bool(hits) and (not hits or hits[0][1] == d)


def test_language(spark, docs):
    english = ["the cat sat on the mat and then it went away", "this is a question of the time that we have left"]
    german = ["die Katze saß auf der Matte und ging dann weg", "das ist eine Frage der Zeit die uns noch bleibt"]
    train = spark.createDataFrame(
        [(i, t, "en") for i, t in enumerate(english)] + [(9 + i, t, "de") for i, t in enumerate(german)] + [(5, "nichts", None), (6, None, "de"), (None, "x", "en")],
        "doc_id bigint, text string, lang string",
    )
    texts = language_id.training_rows(train)
    assert sorted(texts) == ["de", "en"] and len(texts["de"]) == 2 and len(language_id.training_rows(train, 1)["en"]) == 1
    found = language_id.predict(docs, texts)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in found.collect():
        t = r["text"]
        if not t or not language_id.LETTER.search(t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en") and 0.5 <= r["score"] <= 1
        if t == LONG:
            assert r["lang_pred"] == "de" and r["score"] > 0.99
    kept = language_id.recognised(docs, texts)
    assert kept.columns == docs.columns and kept.filter("text = '12 34 !!'").count() == 0
    assert {r[0] for r in language_id.predict(docs, {}).select("lang_pred").collect()} == {"und"}


def test_language_sample_of_repeated_ids(spark):
    given = [(1, f"text {i}", "en") for i in range(50)] + [(1, "text 0", "en")] * 50 + [(2, "zwei", "de")] * 9 + [(1, "eins", "de")]
    train = spark.createDataFrame(given, "doc_id bigint, text string, lang string").repartition(3)
    texts = language_id.training_rows(train, 5)
    assert len(texts["en"]) == len(set(texts["en"])) == 5 and texts["de"] == [b"eins", b"zwei"]


def test_language_sample_of_long_texts(spark):
    given = [(i, f"{i} " + "long " * 300, "en") for i in range(30)] + [(50, "x " * 9000, "de"), (51, "kurz", "de")]
    train = spark.createDataFrame(given, "doc_id bigint, text string, lang string").repartition(3)
    texts = language_id.training_rows(train, sample_bytes=4000)
    assert len(texts["en"]) == 3 and sum(map(len, texts["en"])) < 4000 + 1600 and 1 <= len(texts["de"]) <= 2
    assert language_id.training_rows(train) == {lang: sorted(t.encode() for _, t, x in given if x == lang) for lang in ("de", "en")}


def test_no_worker_builds_the_language_model(spark, monkeypatch):
    """Workers get arrays: with no way to build a model left, they predict all the same."""
    texts = {"en": [b"the cat sat on the mat"], "de": [b"die Katze lag auf dem Teppich"]}
    state = language_id.model_of(texts)
    assert all(isinstance(v, (int, list, np.ndarray, np.generic)) for v in state.values())
    built = language_id.Model(texts)
    monkeypatch.setattr(language_id, "model_of", lambda *_: state)
    monkeypatch.setattr(language_id.Model, "__init__", None)
    docs = spark.createDataFrame([(1, "the mat"), (2, "die Katze")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, texts).collect()} == {1: "en", 2: "de"}
    assert language_id.recognised(docs, texts).count() == 2
    assert np.array_equal(language_id.Model.of(state).cost, built.cost)


def test_language_model_is_exact():
    texts = {"a": [b"abracadabra", b"abba"], "b": [b"banana bandana", b""]}
    model = language_id.Model(texts, 3)
    assert np.allclose(np.exp2(-model.cost[:, 1:, :].astype(float)).sum(1) + np.exp2(-model.cost[:, 0, :].astype(float)) * (256 - model.width + 1), 1, atol=1e-4)

    def brute(lang, text):
        """Code length by counting in the training texts, context by context."""
        counts, known = {}, {}
        for name, group in texts.items():
            for t in group:
                t = b"\n\n\n" + t
                for i in range(3, len(t)):
                    for k in range(4):
                        c = t[i - k : i]
                        known.setdefault(c, {}).setdefault(name, 0)
                        known[c][name] += 1
                        if name == lang:
                            counts.setdefault(c, {}).setdefault(t[i], 0)
                            counts[c][t[i]] += 1

        def used(c):
            """A context is in the tree with all its shorter ones."""
            return all(max(known.get(c[len(c) - k :], {"": 0}).values()) >= (1 if k < 2 else language_id.LEAST) for k in range(1, len(c) + 1))

        @functools.cache
        def prob(c, sym):
            here = counts.get(c, {})
            lower = (lambda s: 1 / 256) if not c else (lambda s: prob(c[1:], s))
            total, kinds = sum(here.values()), len(here)
            rest = sum(lower(s) for s in range(256) if s not in here)
            esc = (kinds / (total + kinds) if total else 1.0) if rest > 0 else 0.0
            return here[sym] / total * (1 - esc) if sym in here else lower(sym) / rest * esc

        t, bits = b"\n\n\n" + text, 0.0
        for i in range(3, len(t)):
            c = t[i - 3 : i]
            while c and not used(c):
                c = c[1:]
            bits -= np.log2(prob(c, t[i]))
        return bits

    for text in (b"abra", b"banabra!", b"zz"):
        assert np.allclose(model.bits([text])[0], [brute("a", text), brute("b", text)], rtol=1e-4), text
    long = [b"abracadabra banana" * 9]
    whole = model.bits(long)
    language_id.PIECE, kept = 16, language_id.PIECE
    try:
        assert np.allclose(model.bits(long), whole, rtol=1e-6)
    finally:
        language_id.PIECE = kept


def test_lm_score(spark, docs):
    rng = np.random.default_rng(8)
    chain = [f"w{i}" for i in range(30)]
    lines = [" ".join(chain[(s + i) % 30] for i in range(40)) for s in rng.integers(0, 30, 600)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string").repartition(2)
    settings = lm_score.Settings(inputs=64, outputs=40, stride=2, rounds=3, batch=64)
    model = lm_score.fit(train, settings)
    good, bad = lines[0], " ".join(rng.permutation(lines[0].split()))
    net = lm_score.Network.from_flat(settings, model.weights)
    assert lm_score.score_words(model, net, good.split()) > lm_score.score_words(model, net, bad.split()) + 10
    assert lm_score.score_words(model, net, good.split()) / 40 > -np.log(30) + 0.5  # better than the words' frequencies
    words = "w3 w4 unseen w6".split()
    ids, total = model.coded(words), 0.0
    embed, inner, inner_bias, outer, outer_bias = (a.astype(float) for a in net.arrays)
    for i, w in enumerate(words):
        near = [ids[j] if 0 <= j < 4 else lm_score.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
        z = np.tanh(np.concatenate([embed[k] for k in near]) @ inner + inner_bias) @ outer + outer_bias
        total += z[min(ids[i], 39) if ids[i] < 40 else 1] - np.log(np.exp(z).sum())
        if ids[i] == lm_score.OTHER:
            total += sum(model.spelling[b] for b in w.encode()) + model.spelling[256]
    assert np.isclose(lm_score.score_words(model, net, words), total, rtol=1e-4)
    found = lm_score.score(docs, model).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["per_word"] is None) == (r["n_words"] == 0) and np.isfinite(r["log_likelihood"])


def test_lm_vocabulary_follows_the_corpus(spark):
    """Under the registered settings: a probability of its own for every frequent word, and spelling that looks at the window."""
    rng = np.random.default_rng(9)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(400)]
    lines += ["left left rare" + "zq"[i % 2] * 3 + str(i) + " right right" for i in range(300)]
    train = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(2)
    model = lm_score.fit(train)
    counted = {w for t in lines for w in t.split()}
    assert set(model.numbers) == counted and len(counted) > 3000  # every word is frequent in so few
    net = lm_score.Network.from_flat(model.settings, model.weights)
    window = net.windows(model.coded(lines[0].split()), np.array([5]))
    every = np.array([lm_score.PAD, lm_score.OTHER, *range(2, len(counted) + 2)])
    logs = net.log_probs(np.repeat(window, len(every), 0), every, [b"x"], np.where(np.arange(257) == 120, 0.0, -200.0))
    logs[1] -= np.float32(-200.0)  # the word "x" is spelt by one letter and the end
    assert np.isclose(np.exp(logs.astype(float)).sum(), 1, atol=1e-3) and len(set(logs[-500:].tolist())) > 100
    words = lines[1].split()
    leaf, leaf_bias, _ = net.more
    embed, inner, inner_bias, outer, outer_bias = (a.astype(float) for a in net.arrays)
    ids, total = model.coded(words), 0.0
    for i in range(len(words)):
        h = np.tanh(embed[net.windows(ids, np.array([i]))[0]].reshape(-1) @ inner + inner_bias)
        z = h @ outer + outer_bias
        total += z[net.layout.classes[ids[i]]] - np.log(np.exp(z).sum())
        for node, turn in zip(net.layout.path[ids[i]], net.layout.turn[ids[i]]):
            total -= np.log1p(np.exp(-turn * (h @ leaf[node] + leaf_bias[node]))) if turn else 0
    assert np.isclose(lm_score.score_words(model, net, words), total, rtol=1e-4)
    bound = lm_score.fit(train, lm_score.Settings(least=0.005, stride=1, rounds=3))
    net = lm_score.Network.from_flat(bound.settings, bound.weights)
    assert set(bound.numbers) == {"left", "right"} and len({int(x) for x in bound.coded(["w1", "w2", "w3"])}) == 3
    near, far = (net.windows(bound.coded(t.split()), np.array([2])) for t in ("left left w1 right right", "w5 w6 w1 w7 w8"))
    ids = bound.coded(["w1"])
    h = [net.forward(w)[1] @ net.more[2] for w in (near, far)]
    assert np.abs(h[0] - h[1]).max() > 0.1
    gains = [net.log_probs(w, ids, [b"rarezzz"], bound.spelling) - net.log_probs(w, ids, [b"w1234"], bound.spelling) for w in (near, far)]
    assert gains[0] > gains[1]


def test_lm_trains_on_every_position(spark, docs):
    """Under the registered settings, short texts and rows without an id included."""
    settings = lm_score.Settings()
    for length in range(40):
        found = np.concatenate([lm_score.positions(n % settings.stride, length, settings) for n in range(5, 5 + settings.rounds)])
        assert sorted(found.tolist()) == list(range(length))
    sparse = lm_score.Settings(stride=16, rounds=2)
    assert all(len(lm_score.positions(start, length, sparse)) for start in range(16) for length in range(1, 20))
    assert lm_score.fit(docs).trained == sum(len(lm_score.words_of(t)) for _, t, *_ in rows())


def test_lm_steps_are_plain_adagrad():
    """Several batches in one call, the last one short: words with decisions, classes, spelt words and repeated rows."""
    settings = lm_score.Settings(inputs=100, outputs=16, words=80, buckets=18, width=3, hidden=5, batch=32)
    net, rng = lm_score.Network(settings), np.random.default_rng(3)
    assert net.layout.nodes > 0
    for a in (*net.arrays, *net.more):
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    ids = rng.choice(100, 75, p=np.arange(100, 0, -1) / 5050)
    ids[ids == lm_score.PAD] = 2
    rare = (ids == lm_score.OTHER) | (ids >= 82)
    spelt = [b"x" * int(k) + b"yz" for k in rng.integers(0, 3, rare.sum())]
    windows, spelling = rng.integers(0, 100, (75, 4)), rng.normal(-3, 1, 257)
    plain = [a.astype(float) for a in (*net.arrays, *net.more)]
    memory = [np.full_like(a, 0.01) for a in plain]
    letters = dict(zip(np.flatnonzero(rare), spelt))
    for start in range(0, 75, 32):
        embed, inner, inner_bias, outer, outer_bias, leaf, leaf_bias, spell = plain
        grads, n = [np.zeros_like(a) for a in plain], len(ids[start : start + 32])
        for i in range(start, start + n):
            x = embed[windows[i]].reshape(-1)
            h = np.tanh(x @ inner + inner_bias)
            d = np.exp(h @ outer + outer_bias)
            d /= d.sum()
            d[net.layout.classes[ids[i]]] -= 1
            to_hidden = outer @ d
            grads[3] += np.outer(h, d)
            grads[4] += d
            for node, turn in zip(net.layout.path[ids[i]], net.layout.turn[ids[i]].astype(float)):
                g = -turn / (1 + np.exp(turn * (h @ leaf[node] + leaf_bias[node])))
                to_hidden = to_hidden + g * leaf[node]
                grads[5][node] += g * h
                grads[6][node] += g
            if i in letters:
                seen = np.bincount(np.frombuffer(letters[i], np.uint8), minlength=257) + (np.arange(257) == 256)
                d = np.exp(spelling + h @ spell)
                d = d / d.sum() * seen.sum() - seen
                to_hidden = to_hidden + spell @ d
                grads[7] += np.outer(h, d)
            back = to_hidden * (1 - h * h)
            grads[1] += np.outer(x, back)
            grads[2] += back
            np.add.at(grads[0], windows[i], (inner @ back).reshape(4, -1))
        for a, m, g in zip(plain, memory, grads):
            m += (g / n) ** 2
            a -= settings.rate * g / n / (np.sqrt(m) + 1e-6)
    net.train(windows, ids, spelt, spelling, net.memory())
    for a, b in zip((*net.arrays, *net.more), plain):
        assert np.allclose(a, b, atol=2e-5)
    again = lm_score.Network.from_flat(settings, net.flat())
    assert all(np.array_equal(a, b) for a, b in zip((*net.arrays, *net.more), (*again.arrays, *again.more)))
    near = windows[:40]
    found = net.log_probs(near, ids[:40], spelt[: rare[:40].sum()], spelling)
    net.wide *= 60  # logits whose exponentials would leave float32
    assert net.moderate() is False and np.isfinite(net.log_probs(near, ids[:40], spelt[: rare[:40].sum()], spelling)).all()
    net.train(windows, ids, spelt, spelling, net.memory())
    assert np.isfinite(net.flat()).all() and np.isfinite(found).all()


def test_empty_tables(nothing, spark):
    none = nothing
    benchmark = none.selectExpr("doc_id item_id", "text")
    for df in (
        exact_dedup.decide(none), exact_dedup.drop_duplicates(none), shards.assign(none, shards.first_map(spark, 2, 8), slots=8),
        simhash.cluster(none), simhash.drop_near_duplicates(none), bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS, PATTERN),
        token_counts.count_tokens(none, WORDS), substrings.remove_repeats(none), decontaminate.find(none, benchmark),
        decontaminate.drop_contaminated(none, benchmark), language_id.predict(none, language_id.training_rows(none)),
        language_id.recognised(none, {}), lm_score.score(none, lm_score.fit(none, lm_score.Settings(rounds=1))),
    ):
        assert df.collect() == []


def test_pipeline(spark, docs, tmp_path):
    """Every stage against a plain form of it, on few rows."""
    folder = tmp_path / "sf"
    docs.write.parquet(str(folder / "documents.parquet"))
    rows_of = docs.filter("doc_id = 5").selectExpr("doc_id item_id", "text")
    rows_of.write.parquet(str(folder / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(folder))
    passage = rows()[5][1]
    for r in out.collect():
        assert passage not in r["text"] and language_id.LETTER.search(r["text"]) and r["n_tokens"] == len(r["ids"])
    given = {i: t for i, t, *_ in reversed(rows()) if i is not None}
    ids = [r["doc_id"] for r in out.collect()]
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}.items() <= given.items()
    assert sorted(i for i in ids if i is not None) == [0, 7, 10, 11, 12, 13, 14]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(folder))
        assert frame.columns == docs.columns
