"""The pipeline on a small table: each stage's decisions take effect, and clean documents stay."""

from __future__ import annotations

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join("".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(n))
    one, item = text(80), text(15)
    rows = [(i, text(60), "en", "s", 1) for i in range(30)]
    rows += [(100, one, "en", "s", 1), (101, one + " more", "en", "s", 1), (102, f"{text(20)} {item} {text(20)}", "en", "s", 1), (103, f"{text(20)} me@mail.org {text(20)}", "en", "s", 1)]
    rows += [(104, None, "en", "s", 1), (105, "123 !", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in at.collect()}
        gone = {"language_id": {104, 105}, "near_duplicates": {104, 105, 101}}.get(name, {104, 105, 101, 102})
        assert ids == {r[0] for r in rows} - gone, name
    got = {r["doc_id"]: r for r in at.collect()}
    assert "[EMAIL]" in got[103]["text"] and got[103]["n_chars"] == len(got[103]["text"]) and got[100]["text"] == one
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), str(tmp_path)).collect()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, ids that are missing or repeat, a long text and columns with names used inside."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(n))
    known = [(i, text(40), "en", None, None, "x", i) for i in range(20)]
    again = (50, text(30), "en", "s", 1, None, 1)
    rows = [*known, again, again, (None, text(30), None, None, None, None, None), (50, text(25), "en", "s", 1, "y", 2), (51, text(20_000), "en", "s", 1, "z", 3), (52, None, None, None, None, None, None), (53, "", "en", "s", 0, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, _row long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"language_id": 25, "near_duplicates": 26, "decontamination": 27, "personal_data": 27}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == want[name], name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("start = 0").count() == len(rows)
