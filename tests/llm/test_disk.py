"""What the stages that change or drop texts shuffle and leave behind: no texts but one copy."""

from __future__ import annotations

import os

import numpy as np
import pytest

from paperloom.llm import common, op3_contextual_pii, op5_ngram_join


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """Where tables go; nothing is small enough for Spark to broadcast it by itself."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield tmp_path / "paperloom"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def left(folder) -> set[str]:
    return {t.rsplit("-", 2)[0] for s in os.listdir(folder) for t in os.listdir(folder / s)}


def shuffles(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    return "SortMergeJoin" in plan or "Exchange hashpartitioning" in plan


def texts(n: int, words: int) -> list[str]:
    rng = np.random.default_rng(7)
    return [" ".join("".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(words)) for _ in range(n)]


def test_copies_are_dropped_without_a_shuffle_of_texts(spark, folder):
    one, *rest = texts(12, 60)
    rows = [(1, one), (2, one), (3, one + " more"), (None, one), *((10 + i, t) for i, t in enumerate(rest)), (40, None), (41, None)]
    kept = op5_ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert not shuffles(kept)
    assert left(folder) == {"rows", "gone"}
    assert sorted(kept.collect()) == sorted([rows[0], *rows[4:]])


def test_what_contexts_add_comes_to_the_texts_without_a_shuffle(spark, folder):
    rows = [(i, f"please call our desk number +1 415 555 01{i:02d} today my friend") for i in range(20)]
    rows += [(50, "please call our desk number 415 555 0199 today my friend"), (51, None), (52, "nothing here")]
    done = op3_contextual_pii.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not shuffles(done)
    assert left(folder) == {"scan", "added"}
    got = dict(done.collect())
    assert set(got) == {i for i, _ in rows} and got[51] is None and got[52] == "nothing here"
    assert {got[i] for i, _ in rows[:21]} == {"please call our desk number [PHONE] today my friend"}


def test_a_table_over_the_bound_is_not_broadcast(spark, folder, monkeypatch):
    """The bound decides how rows meet, not which stay."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    one, *rest = texts(6, 60)
    rows = [(1, one), (2, one), *((10 + i, t) for i, t in enumerate(rest))]
    kept = op5_ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted(kept.collect()) == sorted([rows[0], *rows[2:]])


def test_clear_deletes_replaced_tables_too(spark, folder):
    scratch = common.Scratch(spark, "test")
    for _ in range(2):
        scratch.keep(spark.range(3), "t")
    assert left(folder) == {"t"}
    scratch.clear()
    assert not scratch.paths and scratch.keep(spark.range(2), "t").count() == 2
    assert sum(len(os.listdir(folder / s)) for s in os.listdir(folder)) == 1
