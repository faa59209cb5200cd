"""Queries on tables that a finding was about."""

from __future__ import annotations

from paperloom.plans import catalogue


def test_address_of_a_resume_with_a_number_of_five_digits(spark, tmp_path):
    spark.createDataFrame([(7,), (9999,), (10000,), (99999,), (100000,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = catalogue.QUERIES["addresses"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(k, "Dayton, OH 45402", 12, 29) for k in (7, 9999, 10000, 99999, 100000)]


def test_hybrid_fields_of_a_resume_with_a_number_of_five_digits(spark, tmp_path):
    spark.createDataFrame([(9999,), (10000,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = catalogue.QUERIES["hybrid_resumes"](spark, str(tmp_path)).select("doc_id", "address", "persons").collect()
    assert sorted(tuple(r) for r in found) == [(k, "Dayton, OH 45402", "Maria Keller;Licensed Project Planner") for k in (9999, 10000)]


def test_marked_search_equals_the_fold(spark):
    from pyspark.sql import functions as F

    from paperloom.functions.text import FEW, MARK, _fold_all, find_all

    many = "é1 " * (2 * FEW + 3)
    texts = [None, "", "none", "1", "12", "ä 1x22 ", f"a{MARK}1{MARK}2", many[: 3 * FEW], many[: 3 * FEW + 3], many]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    for group in (0, 1):
        got = rows.select(find_all(F.col("text"), r"(\d)x?", group).alias("a"), _fold_all(F.col("text"), r"(\d)x?", group).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
        assert got[0]["a"] is None and len(got[-1]["a"]) == 2 * FEW + 3


def test_parties_read_companies_only(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import entities

    text = "Maria Keller\nBrightleaf Tools LLC\nDover, DE 19901\nMar 9, 2018 $5"
    row = spark.createDataFrame([(text,)], "text string").select(entities.rules(F.col("text"), ("ORG",)).alias("some"), entities.rules(F.col("text")).alias("every")).first()
    assert [e["text"] for e in row["some"]] == ["Brightleaf Tools LLC"]
    assert row["some"] == [e for e in row["every"] if e["label"] == "ORG"] and len(row["every"]) == 5


def test_resumes_of_a_small_file_are_made_by_several_tasks(spark, tmp_path):
    from paperloom.plans import render

    spark.range(100).select("id").withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = render.resumes(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == list(range(100))


def test_words_that_start_a_match(spark):
    from pyspark.sql import functions as F

    from paperloom.functions.text import from_word, in_lower_case

    texts = ["", "none", "Tax 1", "a VAT, a tax", "b\ntaxé", "a ſum"]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(from_word(F.col("t"), in_lower_case(F.col("t")), "tax", "vat").alias("x")).collect()]
    assert got == [None, None, "Tax 1", " VAT, a tax", "b\ntaxé", "a ſum"]


def test_labels_and_first_values_of_an_invoice(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import fields, invoice

    text = "bill me\nInv no\nTen 7, Bill 8\nx@y.org, z@y.org 302-253-0000 302-253-0001\nA, DE 19901-1234 19902\n12345\nB 19903\nſubtotal: 4.00\nqty\nBolt 5.00 5.00\nNut 2 1.00 2.00\nTax due\nCog 1.00 1.00"
    t = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(
        fields.addresses(t).alias("every"), fields.addresses(t, 2).alias("some"), fields.emails(t)[0].alias("email"), fields.first_email(t).alias("first_email"), fields.phone_numbers(t)[0].alias("phone"),
        fields.first_phone(t).alias("first_phone"), fields.invoice_numbers(t).alias("numbers"), fields.invoice_numbers(t, 1).alias("number"), invoice.extract(t).alias("x"),
    ).first()
    assert [(f["value"], *f["position"]) for f in row["every"]] == [("A, DE 19901-1234 19902", 71, 94)] * 2 + [("B 19903", 100, 108)]
    assert row["some"][:2] == row["every"][:2] and row["first_email"] == row["email"] and row["first_phone"] == row["phone"]
    assert [f["value"] for f in row["numbers"]] == ["8"] and row["number"] == row["numbers"][:1]
    assert [(i["description"]["value"], i["quantity"]["value"]) for i in row["x"]["line_items"]] == [("Bolt", "1"), ("Nut", "2")]
    assert row["x"]["totals"]["subtotal"]["num_value"] == 4.0


def test_an_invoice_is_searched_once_for_each_label(spark):
    """What nullif() is given is copied within a lambda: each pattern stood in the plan twice and was run twice."""
    from pyspark.sql import functions as F

    from paperloom.operators import invoice

    plan = spark.createDataFrame([("x",)], "t string").select(invoice.payment_terms(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(p) == 1 for p in invoice.TERMS)
