"""Exact, substring, near and embedding dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import embeddings, exact_dedup, shared, simhash, substring_dedup, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, texts, bits):
    groups = defaultdict(list)
    for i, t in texts:
        groups["".join(SPLIT.findall(t or ""))].append((-len(t or ""), i))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, bits).collect()}
    assert len(got) == len(texts)
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert got[i].asDict() == {"doc_id": i, "keep_id": keep, "group_size": len(members), "kept": i == keep, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()}


def test_exact_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "zz")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 1, True)], key=repr)


def test_exact_null_ids_under_colliding_hashes(spark):
    texts = ["ab", "zz", "qq x", "a b", "zz", "m", "n", "o"]
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, "zz")], "doc_id long, text string")
    for bits in (64, 1):
        got = Counter((r["text_sha256"], r["group_size"], r["keep_id"]) for r in exact_dedup.exact_dedup(df, bits).collect())
        sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("ab", "zz", "qqx", "m", "n", "o")}
        assert got == {(sha["ab"], 2, None): 2, (sha["zz"], 3, 7): 3} | {(sha[t], 1, None): 1 for t in ("qqx", "m", "n", "o")}


def test_chunks_make_up_the_text(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t or "",) for _, t in texts], "text string").withColumn("chunks", exact_dedup.chunks_of(F.col("text")))
    assert all(b"".join(r["chunks"]) == r["text"].encode() for r in df.collect())


SCRIPTS = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "arabic": 0x627, "hebrew": 0x5D0, "devanagari": 0x915, "kana": 0x3042, "han": 0x4E00, "hangul": 0xAC00, "gothic": 0x10330}


@pytest.mark.parametrize("script", SCRIPTS)
def test_chunks_follow_the_content_in_every_script(spark, script):
    """After an edit at the front the chunks behind it are the same, and few are as long as they may be."""
    from pyspark.sql import functions as F

    rng, first = np.random.default_rng(3), SCRIPTS[script]
    n = {"han": 3000, "hangul": 3000, "kana": 80}.get(script, 26)
    text = "".join(chr(first + int(k)) for k in rng.integers(0, n, 40_000))
    df = spark.createDataFrame([(text,), (chr(first) + text[2:],)], "text string").select(exact_dedup.chunks_of(F.col("text")).alias("c"))
    a, b = (r["c"] for r in df.collect())
    assert a[0] != b[0] and len(set(a) & set(b)) > 0.8 * len(a) > 20
    assert sum(len(c) == exact_dedup.MAX_CHUNK for c in a) <= 0.05 * len(a)


def test_exact_of_a_very_long_text(spark):
    long = "".join(f"w{i} " for i in range(400_000))
    rows = [(1, long), (2, long.replace(" ", "\n ")), (3, long[:-3]), (4, "x" * 1_000_000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, recipe string, n int")).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def brute_substring(rows, w):
    found = [(i, SPLIT.findall(t or "")) for i, t in rows]
    first = {}
    for i, x in found:
        for k in range(len(x) - w + 1):
            first[tuple(x[k : k + w])] = min(first.get(tuple(x[k : k + w]), i), i)
    out = {}
    for i, x in found:
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if first[tuple(x[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        kept = " ".join(y for y, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), kept)
    return out


def check_substring(got, rows, window):
    want, found = brute_substring(rows, window), {i: SPLIT.findall(t or "") for i, t in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_text"], r["kept_sha256"]) == (n, gone, kept, hashlib.sha256(kept.encode()).hexdigest())
        covered = set()
        for span in filter(None, r["spans"].split(",")):
            start, size, source, word = span.split(":")
            start, size, own = int(start), int(size), found[r["doc_id"]]
            assert size >= window and int(source) < r["doc_id"]
            if word:
                assert own[start : start + size] == found[int(source)][int(word) : int(word) + size]
            covered |= set(range(start, start + size))
        assert len(covered) == gone


@pytest.mark.parametrize(("window", "gram", "size", "bits"), [(13, 5, 1 << 24, 64), (13, 5, 20_000, 64), (6, 3, 20_000, 64), (13, 5, 1 << 24, 6), (6, 3, 20_000, 6)])
def test_substring(docs, texts, window, gram, size, bits):
    check_substring(substring_dedup.substring_dedup(docs, window, gram, size, bits).collect(), texts, window)


@pytest.mark.parametrize("size", [1 << 24, 60])
def test_windows_of_colliding_words_are_told_apart(spark, size):
    data, offsets = words.text_bytes(pa.array(["jntxbqdv!@!@@!!! xamfaxgb8lMymS~%"]))
    s, e, _ = words.find_words(data, offsets)
    assert len(set(words.hash_spans(data, s, e).tolist())) == 1
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"jntxbqdv!@!@@!!! {tail}"), (2, f"xamfaxgb8lMymS~% {tail}"), (3, f"xamfaxgb8lMymS~% {tail} more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = substring_dedup.substring_dedup(df, block_bytes=size).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 13}
    check_substring(got, rows, 13)


def test_factors_go_on_as_far_as_their_source(spark):
    first, second = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(["x", *first[5:30], *second[10:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in substring_dedup.substring_dedup(df, block_bytes=100).collect()}
    assert got == {1: "", 2: "", 3: "1:25:1:5,26:30:2:10"}


def test_substring_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(20)))
    rows = [(None, text), (5, text), (5, text), (5, f"{text} x"), (None, None), (None, f"y {text}"), (7, "")]
    for size in (1 << 24, 10):
        got = substring_dedup.substring_dedup(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, id int"), block_bytes=size).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == Counter([(None, 20, 20), (5, 20, 0), (5, 20, 0), (5, 21, 0), (None, 0, 0), (None, 21, 20), (7, 0, 0)])


def test_substring_of_a_very_long_text(spark):
    own = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(own[100_000:100_050])), (2, " ".join(own))]
    check_substring(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1000).collect(), rows, 13)


def test_word_hashes_depend_on_bytes_only():
    data, offsets = words.text_bytes(pa.array(["ab cd", None, "xx ab  cdcdcdcdcdcd cdcdcdcdcdcd", "ab"]))
    s, e, n = words.find_words(data, offsets)
    h = words.hash_spans(data, s, e).tolist()
    assert n.tolist() == [2, 0, 4, 1]
    assert h[0] == h[3] == h[6] and h[4] == h[5] and len(set(h)) == 4


def plain_fingerprint(text):
    x = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not x:
        return 0
    g = [" ".join(x[k : k + 3]) for k in range(max(len(x) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(y.encode(), 42) for y in g]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(g))


def components(values, near):
    label = list(range(len(values)))

    def find(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if near(values[a], values[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("max_group", [4096, 2])
def test_simhash(docs, texts, max_group):
    prints = [plain_fingerprint(t) for _, t in texts]
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r["doc_id"]: r for r in simhash.simhash_dedup(docs, max_group=max_group).collect()}
    for i, _ in texts:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", roots[i])


def test_gray_index_links_like_all_pairs():
    rng = np.random.default_rng(1)
    made = {int(x) for x in rng.integers(0, 2**63, 20)}
    for x in list(made):
        for _ in range(30):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            made.add(y)
    fp = np.array(sorted(made), np.uint64)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    labels = simhash.link(np.zeros(len(fp), int), fp, step=64).tolist()
    want = components(fp.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(set(zip(labels, want, strict=True))) == len(set(labels)) == len(set(want))


def test_crowded_groups_are_dealt_until_they_are_small(spark):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    made = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (60, 2))} | {int(x) << 40 for x in range(200)})
    rows = [(x - 2**64 if x >= 2**63 else x,) for x in made]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long"), max_group=20).collect()
    place = {x: k for k, (x,) in enumerate(rows)}
    pairs = {(place[r["a"]], place[r["b"]]) for r in links}
    got = components(list(range(len(made))), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == components(made, lambda a, b: (a ^ b).bit_count() <= 3)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_hot_keys(spark, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)], "a long, k string")
    facts = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    got = {r["a"]: r["v"] for r in shared.join_hot(rows, facts, ["k"], "a", how).collect()}
    want = {i: 1 if i % 3 else 2 if i == 3 else None for i in range(900)}
    assert got == {i: v for i, v in want.items() if v or how == "left"}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("tile", [1024, 5])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    rows = []
    for k in range(400):
        v = base[k % 60] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 2), "x"))
    odd = [(1000, None, 1, "x"), (1001, [0.0] * 24, 1, "x"), (1002, [float("nan")] * 24, 1, "x"), (1003, [None] * 24, 1, "x"), (1004, [float("inf")] * 24, 1, "x"), (1005, rows[0][1], None, "x"), (1006, [], 0, "x"), (1007, [1.0, 2.0], 0, "x"), (1008, [1e200, 1e200], 0, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, id string").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.embedding_dedup(df, tile=tile).collect()}
    assert len(got) == len(rows) + len(odd)
    for k in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert got[k][1:] == (0, k, True)
    assert got[1007]["n_links"] == got[1008]["n_links"] == 1 - (np.dot([1, 2], [1, 1]) / np.sqrt(10) < 0.93)
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (np.einsum("ij,kj->ik", x, x) >= 0.93) & (label[:, None] == label)
    roots = components(list(range(400)), lambda a, b: near[a, b])
    assert {k: got[k][1:] for k in range(400)} == {k: (near[k].sum() - 1, roots[k], roots[k] == k) for k in range(400)}
    assert near.sum() > 1000


def test_embeddings_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(4)
    v, w = (rng.normal(size=16).tolist() for _ in range(2))
    rows = [(1, v, 0), (1, v, 0), (1, w, 0), (None, v, 0), (None, w, 0), (2, v, 0), (3, v, 1), (4, w, 0)]
    got = Counter(tuple(r) for r in embeddings.embedding_dedup(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, tbl int, side int")).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (None, 0, None, True), (None, 0, None, True), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 1, False)])


def test_recall_at_the_threshold_itself():
    rng = np.random.default_rng(0)
    for d in (16, 64, 128):
        a, b = rng.normal(size=(2, 1000, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        x, y = embeddings.cross_polytope(a), embeddings.cross_polytope(0.93 * a + np.sqrt(1 - 0.93**2) * b)
        met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
        assert met.mean() >= 0.97


def test_nothing_in_nothing_out(spark, none):
    for run in (exact_dedup.exact_dedup, substring_dedup.substring_dedup, simhash.simhash_dedup):
        assert run(none).count() == 0
    assert embeddings.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
