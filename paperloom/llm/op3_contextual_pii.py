"""Personal data: fixed patterns as seeds, and identifiers that the seeds' contexts discover.

Every text is searched for e-mail addresses, IP addresses, card and phone numbers. These seeds, every other token with
at least four digits or an @, and every run of digit groups with spaces in it whose digits could be an identifier, are
mentions; tokens inside such a run are mentions of their own only if they have the form of a kind themselves. The words around a mention are its contexts: the two before it, the two behind
it, or one on each side. Contexts and mention values form a bipartite graph, on which scores are spread for
``ROUNDS`` rounds: a context's score for a kind is the mean score of its mentions (with one more that counts 0), and
the score of a value that is no seed is the best score of its contexts. In each round a context takes part if it has at
least ``SUPPORT`` different trusted values of the kind: seeds, and values whose score reached ``CONFIDENT`` in the rounds
before, so values that one context discovers can make another one a pattern. In the end a context with a score of at least
``CONFIDENT`` is a pattern, and the mentions it surrounds whose form suits its kind are added.

All of it is DataFrame and SQL functions. Texts are read and searched once. Finding shuffles mentions only; ``redact`` keeps
the texts with what was found in them and joins the discovered spans by row number, which no key can make uneven. Edges are
summed before they are joined, so a context or value that holds a large share of all mentions is one row by task at first.
The patterns need time linear in the text: their repetitions are possessive and start at the start of a run.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_all
from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a pattern has nothing to find.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
MENTION = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){4}|[^\s@]*+@)\S++"
#: Digit groups joined by up to three spaces, dots, dashes and brackets, on one line; a full stop with a space behind it joins nothing.
RUN = r"(?<![\p{L}0-9])[+(]{0,2}+[0-9]++(?!\p{L})(?:(?![().-]*+\.\x20)[\x20().-]{1,3}+[0-9]++(?!\p{L}))++"
RUN_GUARD = r"[0-9][().-]{0,2}\x20[\x20().-]{0,2}[0-9]"
#: Values of more characters are keyed by their hash.
LONGEST_KEY = 200
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 5
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """All matches, left to right, with their code-point offsets."""
    found = find_all(text, pattern)
    return F.transform(found, lambda m: F.struct(m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"), m["hit"].alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits of number (a string of digits) pass the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) + 1 - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern passes the kind's check."""
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(spans_of(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    return F.when(text.rlike(GUARDS[kind]), found).otherwise(F.array().cast(_SPAN))


def suits(kind: Column, value: Column) -> Column:
    """Whether a discovered value has the form of its kind."""
    n = F.length(digits(value))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike(r"^\W*[0-9a-fA-F]+([.:][0-9a-fA-F]*){2,}\W*$"))
        .when(kind == "card", (n >= 10) & (n <= 24) & value.rlike(r"^[0-9\W]+$"))
        .otherwise((n >= 7) & (n <= 17) & value.rlike(r"^[0-9\W]+$"))
    )


def fits_any(value: Column) -> Column:
    """Whether a value has the form of some kind."""
    return functools.reduce(lambda a, b: a | b, [suits(F.lit(k), value) for k in KINDS])


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of docs: (uid, row, email, ip, card, phone, mentions), arrays of spans; mentions are the identifier-like
    tokens and runs of digit groups that no seed overlaps, with 80 characters of text before and behind each one, and the seeds likewise.
    row has the columns of docs, without the text unless it is kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*([F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"] or [F.lit(True).alias("none")])).alias("row")
    found = docs.select(F.monotonically_increasing_id().alias("uid"), row, text.alias("text"))
    found = found.select("uid", "row", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    seeds = F.concat(*[_all_of_kind(F.col(k), F.lit(k)) for k in KINDS])
    found = found.withColumn("seeds", seeds)
    none = F.array().cast(_SPAN)
    free = lambda spans, of: F.filter(spans, lambda s: ~F.exists(of, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    runs = F.filter(spans_of(F.col("text"), RUN), lambda s: s["value"].contains(" ") & fits_any(s["value"]))
    found = found.withColumn("runs", free(F.when(F.col("text").rlike(RUN_GUARD), runs).otherwise(none), "seeds"))
    other = F.when(F.col("text").rlike(r"[0-9@]"), spans_of(F.col("text"), MENTION)).otherwise(none)
    found = found.withColumn("other", free(other, "seeds"))
    tokens = F.filter("other", lambda s: ~F.exists("runs", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) | fits_any(s["value"]))
    every = F.concat("seeds", _all_of_kind(F.concat("runs", tokens), F.lit(None).cast("string")))
    around = F.transform(
        every,
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lower(s["value"]).alias("value"),
            F.lower(F.substring(F.col("text"), F.greatest(s["start"].cast("int") - 79, F.lit(1)), F.least(s["start"].cast("int"), F.lit(80)))).alias("before"),
            F.lower(F.substring(F.col("text"), s["end"].cast("int") + 1, F.lit(80))).alias("behind"),
        ),
    )
    return found.select("uid", "row", *[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS], around.alias("mentions"))


def _all_of_kind(spans: Column, kind: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _ordered(spans: Column, order: int) -> Column:
    kind = F.lit(KINDS[order]).alias("kind")
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), kind))


def contexts(scanned: DataFrame) -> DataFrame:
    """(uid, start, end, kind, value, fits, context): up to three contexts of each mention. A context needs its words within
    the 80 characters beside the mention. value is a key of the whole value, fits has the kinds whose form the whole has."""
    m = scanned.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    word = r"[\p{L}#:_'-]+"
    before = F.regexp_extract("before", rf"({word})\W+({word})\W*$", 0)
    behind = F.regexp_extract("behind", rf"^\W*({word})\W+({word})", 0)
    left1 = F.regexp_extract("before", rf"({word})\W*$", 1)
    right1 = F.regexp_extract("behind", rf"^\W*({word})", 1)
    squeeze = lambda c: F.regexp_replace(c, r"\W+", " ")
    forms = F.array(
        F.when(before != "", F.concat(F.lit("before:"), F.trim(squeeze(before)))),
        F.when(behind != "", F.concat(F.lit("behind:"), F.trim(squeeze(behind)))),
        F.when((left1 != "") & (right1 != ""), F.concat(F.lit("around:"), left1, F.lit(" _ "), right1)),
    )
    key = F.when(F.length("value") > LONGEST_KEY, F.concat(F.lit("sha256:"), F.sha2("value", 256))).otherwise(F.col("value"))
    fits = F.array_compact(F.array(*[F.when(suits(F.lit(k), F.col("value")), k) for k in KINDS]))
    shaped = m.select("uid", "start", "end", "kind", key.alias("value"), fits.alias("fits"), F.array_compact(forms).alias("forms"))
    return shaped.select("uid", "start", "end", "kind", "value", "fits", F.explode("forms").alias("context"))


def patterns(mentions: DataFrame, scratch: Scratch, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(context, kind, score): the contexts that the graph of contexts and values finds trustworthy for a kind."""
    edges = scratch.keep(mentions.groupBy("context", "value").agg(F.count("*").alias("n"), F.max("kind").alias("seed"), F.max("fits").alias("fits")), "edges")
    able = F.col("seed").isNotNull() | (F.size("fits") > 0)
    # a context with fewer values that could ever be trusted than support asks for is no pattern in any round: the graph is cut to the others
    totals = scratch.keep(edges.groupBy("context").agg(F.sum("n").alias("total"), F.count_if(able).alias("able")).where(F.col("able") >= support).drop("able"), "totals")
    graph = scratch.keep(edges.where(able).join(totals, "context", "left_semi"), "graph")
    fixed = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    scores = fixed
    best = None
    for _ in range(rounds):
        trusted = F.count_if(F.col("score") >= confident)
        sums = graph.join(scores, "value").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("s"), trusted.alias("trusted"))
        backed = sums.where(F.col("trusted") >= support)
        best = scratch.keep(backed.join(totals, "context").select("context", "kind", (F.col("s") / (F.col("total") + 1)).alias("score")), "patterns")
        spread = graph.where("seed is null").join(best, "context").where("array_contains(fits, kind)")
        found = spread.groupBy("value", "kind").agg(F.max("score").alias("score"))
        scores = scratch.keep(fixed.unionByName(found.join(fixed, ["value", "kind"], "left_anti")), "scores")
    return best.where(F.col("score") >= confident)


def find_pii(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(row, spans, base) for every row of docs (text string): row holds its other columns as a struct (and the text, if it is
    kept), base and spans are arrays of (start, order, end, kind) sorted by start, then kind; spans has the discovered ones too.

    A null text counts as empty and has no spans. Rows that repeat are searched alike. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "op3")
    scanned = scratch.keep(scan(docs, keep_text), "scan")
    mentions = contexts(scanned)
    inner = Scratch(docs.sparkSession, "op3-graph")
    trusted = patterns(mentions, inner)
    found = mentions.where("kind is null").drop("kind").join(trusted, "context").where("array_contains(fits, kind)")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    best = found.groupBy("uid", "start", "end").agg(F.max(F.struct("score", (-order).alias("order"), "kind")).alias("b"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("b.kind")).cast("int") - 1
    added = best.groupBy("uid").agg(F.collect_list(F.struct("start", order.alias("order"), "end", F.col("b.kind").alias("kind"))).alias("added"))
    added = scratch.keep(added, "added")
    inner.clear()
    shape = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
    base = F.concat(*[_ordered(F.col(k), i) for i, k in enumerate(KINDS)])
    joined = scanned.join(scratch.small("added", added), "uid", "left")
    return joined.select(
        "row", F.array_sort(base).cast(shape).alias("base"), F.array_sort(F.concat(base.cast(shape), F.coalesce(F.col("added").cast(shape), F.array().cast(shape)))).alias("spans"), *KINDS
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced by the first one's."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    return F.aggregate(spans, start, step, end)


def redact(docs: DataFrame) -> DataFrame:
    """docs (text, other columns) with every span of personal data replaced in its text. A null text stays null, and all other
    columns stay as they are, whatever their names; repeated rows are redacted alike; an empty table gives no rows."""
    found = find_pii(docs, keep_text=True)
    text = F.col("row.text").cast("string")
    changed = F.when(F.size("spans") > 0, redacted(text, F.col("spans"))).otherwise(text)
    return found.select(*[(changed if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_contextual_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
