"""The pipeline's stages, each on its own input."""

import hashlib

import corpus_pipeline
from small import MEDIUM
from test_llm_operators import spans_by_hand, whole_encoding

from tidemark.llm import decontam, pii, toxicity
from tidemark.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, MEDIUM, "documents")
    columns, before = docs.columns, docs.count()
    wins = {w for r in table(spark, MEDIUM, "benchmark").collect() for w in decontam.windows_of(decontam.words_of(r["text"]), 10)}
    wins = [w.decode().split() for w in wins]
    for name, stage in corpus_pipeline.STAGES:
        inside = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, MEDIUM).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        out = {r["doc_id"]: r for r in rows}
        assert len(out) == len(rows) and set(out) <= set(inside)
        if name != "byte_bpe":
            assert docs.columns == columns and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in table(spark, MEDIUM, "labels").collect()}
            gone = set(inside) - set(out)
            assert sum(labels.get(i) == 1 for i in gone) > 30 and sum(labels.get(i) == 0 for i in gone) <= 2
        if name == "near_duplicates":
            kept = [r["text"] for r in rows]
            assert len(set(kept)) == len(kept) and {r["text"] for r in rows} <= set(inside.values())
            assert 0.8 * len(inside) < len(kept) < len(set(inside.values())) + 1
        if name == "decontamination":
            some = [r["text"] for r in rows if r["text"] != inside[r["doc_id"]]]
            assert some and all(spans_by_hand(t, wins)[1] == 0 for t in some)
        if name == "personal_data":
            assert all(not pii.find(r["text"]) for r in rows)
        if name == "byte_bpe":
            enc = whole_encoding()
            assert len(out) == len(inside)
            for i, r in out.items():
                assert r["n_tokens"] == len(enc.encode_ordinary(inside[i]))
                assert r["decoded_sha256"] == hashlib.sha256(inside[i].encode()).hexdigest()
    assert 0.6 * before < docs.count() < before


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0), (None, "a null id", "x", "y", 9)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, shape)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame([tuple(r) for r in out.collect()], out.schema)
        assert docs.count() == (3 if rows else 0)
    assert toxicity.fit(spark.createDataFrame([], shape), spark.read.parquet(f"{tmp_path}/labels.parquet")) is None


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(1, "mail me@example.org, a b c d e f", 32, *"abcdefg", 7), (1, None, None, *"hijklmn", 8), (None, "some words", 10, *"opqrstu", 9), (2, "nine ten eleven twelve", 22, *"vwxyzab", 10)]
    extra = ["as_text", "_As_Text", "new", "made", "gone", "toxic", "print"]
    shape = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in extra) + ", key int"
    docs = spark.createDataFrame(rows, shape)
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {r[-1]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = out.collect()
        assert kept and all(tuple(r)[3:] == tuple(given[r[-1]])[3:] for r in kept)
        if name == "decontamination":
            assert [r["text"] for r in kept if r["doc_id"] == 2] == ["eleven twelve"]
        if name == "personal_data":
            assert [r["text"] for r in kept if r["text"] and "[EMAIL]" in r["text"]]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
