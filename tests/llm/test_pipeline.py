"""The pipeline's stages, each against brute force on what the one before kept."""

import re

import pytest
from conftest import DATA
from test_operators import components_by_brute_force, corpus, prose, removed_by_brute_force

import corpus_pipeline
from halyard.llm import secrets, suffixes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _h long, kept string, n_words string"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, lang, s, len(t or ""), 7, "mine", "own") for i, t, lang, s, _ in corpus()]
    rows += [(100 + i, prose(400 + i, 90) + (" token=abcdefgh12345" if i % 5 == 0 else ""), "en", "s", 1, 7, "mine", "own") for i in range(60)]
    rows += [(200 + i, " ".join("#" * 3 + w for w in prose(500 + i, 80).split()), "en", "s", 1, 7, "mine", "own") for i in range(4)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def as_rows(df):
    return sorted(df.collect(), key=repr)


def test_stages_by_brute_force(spark, documents, tmp_path):
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = as_rows(docs)
        out = stage(spark, docs, DATA)
        assert out.schema.names == documents.schema.names
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = as_rows(docs)
        assert {(r["_h"], r["kept"], r["n_words"]) for r in after} == {(7, "mine", "own")}
        if name == "quality_rules":
            assert set(after) <= set(before)
            ids = {r.doc_id for r in after}
            assert {100 + i for i in range(60)} <= ids and not ids & {200, 201, 202, 203, 9, 10, 11, 12}
        elif name == "near_duplicate_join":
            rows = [(r.doc_id, r.text) for r in before]
            groups = {}
            for r, (_, n, c) in zip(before, components_by_brute_force(rows, 5, 80, 100), strict=True):
                groups.setdefault(("null", r.text) if c is None else c, []).append(r)
            assert len(after) == len(groups) and set(after) <= set(before)
            assert {r.doc_id for r in after if r.doc_id is not None} == {c for c in groups if not isinstance(c, tuple)}
        elif name == "suffix_deduplication":
            assert [r.doc_id for r in after] == [r.doc_id for r in before]
            keyed = {r.text: h for r, h in zip(before, [x.h for x in spark.createDataFrame([(r.text,) for r in before], "t string").selectExpr("xxhash64(t) AS h").collect()], strict=True)}
            masks = removed_by_brute_force(sorted(((suffixes.LAST if r.doc_id is None else r.doc_id, keyed[r.text]), r.text) for r in before))
            for b, a in zip(sorted(before, key=lambda r: repr((r.doc_id, r.n_chars))), sorted(after, key=lambda r: repr((r.doc_id, r.n_chars))), strict=True):
                gone = masks[(suffixes.LAST if b.doc_id is None else b.doc_id, keyed[b.text])]
                left = bytes(x for x, g in zip(b.text.encode(), gone, strict=True) if not g)
                assert a.text == left.decode("utf-8", "ignore")
        else:
            assert any("[secret]" in r.text for r in after)
            for b, a in zip(before, after, strict=True):
                assert not secrets.scan(a.text.encode()) and (a.text == b.text or "[secret]" in a.text)
                assert len(re.findall("token=", b.text)) == a.text.count("[secret]")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_tables(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.where("false"), DATA).count() == 0


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
