"""The pipeline's stages, each against what its operator says."""

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import SPLIT, components, plain_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


KEY = "a key of the tests"


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[0] == counts[1] >= counts[2] >= counts[3] == counts[4]
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == {r[0] for r in spark.read.parquet(str(tmp_path / "pii")).select("doc_id").collect()}


def test_language_stage_drops_undecided(spark, data):
    docs = spark.createDataFrame([(1, "ein kleiner Text", "de", "s", 1), (2, "12 34", "de", "s", 1), (3, None, "de", "s", 1), (5, "noch einer", "de", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_stage(spark, docs, data)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, norm string"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_and_no_rows(spark, data, stage):
    rows = [(1, "one text of some words", None, None, None), (1, "one text of some words", "en", "s", 1), (None, "quite another text here, by far", "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)
    got = stage(spark, docs, data)
    ids = {r["doc_id"] for r in got.collect()}
    assert {1, None} <= ids <= {1, None, 4, 5}
    assert stage(spark, docs.limit(0), data).count() == 0


def plain_pipeline(rows):
    """Texts by doc_id that reach packing, by brute force."""
    from quern.llm import pii

    docs = {i: t for i, t in rows if t and any(unicodedata.category(c)[0] == "L" for c in t)}
    best = {}
    for i, t in docs.items():
        norm = "".join(SPLIT.findall(t))
        best[norm] = min(best.get(norm, (0, i)), (-len(t), i))
    ids = sorted(i for _, i in best.values())
    prints = [plain_fingerprint(docs[i]) for i in ids]
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    key = pii.secret(KEY)
    return {i: pii.replace(docs[i], key)[0] for k, i in enumerate(ids) if roots[k] == k}


@pytest.fixture
def key(spark):
    from quern.llm import pii

    spark.conf.set(pii.KEY_SETTING, KEY)
    yield KEY
    spark.conf.unset(pii.KEY_SETTING)


def test_run_equals_brute_force(spark, data, key):
    from quern.llm import bpe

    library = bpe.vocabulary("byte_bpe_50k.json").library
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in plain_pipeline(documents).items()}
    assert 0 < len(want) < len(documents)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for parts, total in [(p, len(want[i])) for i, p in pieces.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total else at <= 1024


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_stage, corpus_pipeline.near_stage])
def test_one_row_of_each_group_stays_whatever_its_id(spark, data, stage):
    a, b, c = "a text of some words that comes again and again", "nobody knows which river runs behind that old mill", "seven green bottles stand upon an empty wooden shelf"
    rows = [(1, a), (1, a), (1, b), (None, b), (None, b), (None, c), (None, c), (2, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 9, "x") for i, t in rows], SCHEMA).repartition(3)
    got = stage(spark, docs, data).collect()
    assert sorted((r["text"], r["doc_id"]) for r in got) == [(a, 1), (b, 1), (c, None)]


def test_language_stage_keeps_texts_where_nothing_could_be_learnt(spark, data):
    texts = ["ein kleiner Text", "12 34", None, "", "noch einer"]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_stage(spark, docs, data)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4]
