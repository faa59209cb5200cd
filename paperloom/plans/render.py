"""Sample documents rendered from the relational tables, so that what is extracted can be compared with its columns.

Amounts are written from DECIMAL(18,2), every row has a quantity, and item names hold no word of a table's head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, lines, subtotal): the order's lines in order of their numbers."""
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_suppkey")
    )
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "qty", "amount")
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("amount").cast(MONEY).alias("subtotal"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast(MONEY).alias("price"))
    return found.join(_lines(spark, sf_dir), found["o_orderkey"] == F.col("l_orderkey")).drop("l_orderkey")


def _day(days: int = 0):
    return F.date_format(F.date_add("day", days), "yyyy-MM-dd")


def invoices(spark: SparkSession, sf_dir: str, labels: bool = True, off: bool = False) -> DataFrame:
    """(doc_id, text). labels: with labelled totals. off: the subtotal of odd orders is wrong by 5."""
    rows = F.transform("lines", lambda x: F.concat(F.lit("Bracket-"), x["l_partkey"], F.lit(" "), x["qty"], F.lit(" "), x["amount"], F.lit(" "), x["amount"]))
    subtotal = (F.col("subtotal") + F.when(F.lit(off) & (F.col("o_orderkey") % 2 == 1), 5).otherwise(0)).cast(MONEY)
    head = [
        F.lit("Brightleaf Tools LLC\n48 Quarry Lane\nDover, DE 19901\nbilling@brightleaf.example.org\n(302) 253-0000\n"), F.lit("Bill To:"),
        F.concat(F.lit("Client C"), "o_custkey"), F.lit("9 Orchard Court\nSalem, OR 97301\n"), F.concat(F.lit("Invoice No: BL-"), "o_orderkey"),
        F.concat(F.lit("Issued: "), _day()), F.concat(F.lit("Payable by: "), _day(30)), F.concat(F.lit("Purchase Order: C-"), "o_custkey"),
        F.lit("\nItem Qty Rate Amount"), F.array_join(rows, "\n"),
    ]
    sums = [F.concat(F.lit("\nSubtotal: $"), subtotal), F.lit("Sales Tax: $12.00"), F.concat(F.lit("Amount Due: $"), (subtotal + 12).cast(MONEY)), F.lit("\nTerms: Net 45 days\n")]
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *head, *(sums if labels else [])).alias("text"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text)."""
    rows = F.transform("lines", lambda x: F.concat(F.lit("Gasket-"), x["l_partkey"], F.lit("   "), x["amount"]))
    parts = [
        F.concat(F.lit("Lakeside Market K"), "o_custkey"), F.lit("31 Mill Street\nAurora, IL 60505\n(630) 253-0001\n"), F.concat(F.lit("Sold on "), _day(), F.lit(" at 09:45")),
        F.concat(F.lit("Receipt: "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")), F.concat(F.lit("Terminal: "), F.col("o_orderkey") % 9 + 1),
        F.lit(""), F.array_join(rows, "\n"), F.concat(F.lit("\nSubtotal   "), "subtotal"), F.lit("Sales Tax   1.50"), F.concat(F.lit("Total   "), (F.col("subtotal") + 1.5).cast(MONEY)),
        F.lit("\nPaid by MasterCard"), F.concat(F.lit("Acct: xxxx"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")),
        F.concat(F.lit("Approval: Q"), "o_custkey"), F.concat(F.lit("\nMember ID: "), F.lpad(F.col("o_custkey").cast("string"), 9, "0")),
        F.concat(F.lit("Points: "), F.col("o_custkey") % 1000), F.lit("\nYour cashier says thank you\n"),
    ]
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *parts).alias("text"))


def resumes(spark: SparkSession, sf_dir: str, mark: str = "") -> DataFrame:
    """(doc_id, text). mark: what stands before the number of the certificate; a letter keeps a number of five digits from
    being a ZIP code, which would make its line an address. The keys, which a small file may hold all in one piece, are dealt
    out before anything is made of them."""
    skill = F.element_at(F.array(*[F.lit(s) for s in ("Docker", "Kubernetes", "AWS", "Node.js", "C++")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    parts = [
        F.lit("Maria Keller\nDayton, OH 45402"), F.concat(F.lit("applicant"), "c_custkey", F.lit("@post.example.org | (937) 253-0000")),
        F.concat(F.lit("https://www.linkedin.com/in/m https://github.com/m https://m"), "c_custkey", F.lit(".example.org/me")),
        F.lit("\nExperience\nAnalyst at Harborview Logistics Corp.\nMar 9, 2018\n\nEducation\nMaster of Science in Engineering"),
        F.concat(F.lit("Harbor College, "), F.lit("class of "), (F.col("c_custkey") % 20 + 2000).cast("string")), F.concat(F.lit("\nSkills\nRust, "), skill, F.lit(", SQL, Rust")),
        F.concat(F.lit(f"\nCertifications\nCertified Crane Operator {mark}"), "c_custkey"), F.lit("Licensed Project Planner"),
    ]
    keys = _table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    return keys.select(F.col("c_custkey").alias("doc_id"), F.concat_ws("\n", *parts).alias("text"))


def mangled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): prices with misread digits, currency words and European separators."""
    price = F.col("o_totalprice").cast(MONEY)
    plain = F.format_number(price, 2)
    kind = F.col("o_orderkey") % 4
    european = F.translate(plain, ".,", ",.")
    raw = F.when(kind == 0, F.concat(F.lit("USD "), F.translate(price.cast("string"), "058", "OSB"))).when(kind == 1, F.concat(F.lit("$"), plain)).when(kind == 2, european)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.otherwise(F.translate(price.cast("string"), "12", "lZ")).alias("raw"))


def mangled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): dates in several forms."""
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(kind == 2, F.concat(F.lit("Due: "), F.date_format(day, "MMM d, yyyy")))
        .otherwise(F.date_format(day, "d MMMM yyyy"))
    )
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
