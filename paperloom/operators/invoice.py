"""Invoices: header, parties, line items, totals and payment terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import to_number
from ..functions.text import first_match, from_word, in_lower_case, let, lines, re_, strip, unless_empty
from ..schema import FIELD, EngineOptions, field, first
from . import entities as ner
from .fields import addresses, amounts, dates, first_email, first_phone, invoice_numbers

# Labels, words and row form that define the results.
PO_NUMBER = r"\b(?:P\.O\.|Purchase Order|PO Number|PO)\b\s*[:#]?\s*([A-Z0-9-]+)"
TABLE_HEAD = r"(?:description|item|qty|quantity|rate|unit price|amount|total)"
TABLE_END = r"^(?:subtotal|total|tax|amount due)"
ROW = r"^(.+?)\s+(\d+)?\s*[\$]?\s*([0-9,]+\.\d{2})\s*[\$]?\s*([0-9,]+\.\d{2})$"
LABELS = {
    "subtotal": r"(?:subtotal|sub text|net amount|sub-total)",
    "tax": r"(?:tax|vat|gst)",
    "total_amount": r"\b(?:total|amount due|grand total)\b",
    "discount": r"(?:discount)",
    "shipping": r"(?:shipping|freight)",
}
#: What the matches of a pattern start with: a text is searched from the first of these on.
PO_WORDS = ("p.o.", "purchase order", "po")
LABEL_WORDS = {
    "subtotal": ("subtotal", "sub text", "net amount", "sub-total"),
    "tax": ("tax", "vat", "gst"),
    "total_amount": ("total", "amount due", "grand total"),
    "discount": ("discount",),
    "shipping": ("shipping", "freight"),
}
LABELLED = r".*?[:\s]+[\$]?([0-9,]+\.\d{2})"
TERMS = (r"(net\s*\d+)", r"(due\s*in\s*\d+\s*days)", r"(payment\s*terms\s*[:]?\s*[\w\s]+)")
TERM_WORDS = ("net", "due", "payment")

ITEM = f"struct<description:{FIELD},quantity:{FIELD},unit_price:{FIELD},total_amount:{FIELD}>"


def header(text: Column, options: EngineOptions) -> Column:
    """Number, purchase order, and the first two dates as invoice and due date."""
    po = let(in_lower_case(text), lambda low: first_match(from_word(text, low, *PO_WORDS), re_(PO_NUMBER, ignore_case=True)))
    return let(
        dates(text, options),
        lambda found: F.struct(
            first(invoice_numbers(text, 1)).alias("invoice_number"),
            F.get(found, F.lit(0)).alias("invoice_date"),
            F.get(found, F.lit(1)).alias("due_date"),
            let(po, lambda p: F.when(p.isNotNull(), field(p, "po_number", 0.9, "regex"))).alias("po_number"),
        ),
    )


def parties(text: Column, options: EngineOptions) -> Column:
    """struct(vendor, customer); both without any value if there is no recogniser."""
    found = ner.recognise(text, options, ("ORG",))
    none = F.lit(None).cast(FIELD)
    if found is None:
        vendor = F.struct(*[none.alias(k) for k in ("name", "address", "email", "phone")])
        return F.struct(vendor.alias("vendor"), F.struct(none.alias("name"), none.alias("address")).alias("customer"))

    def both(x: Column) -> Column:
        names, places = x["names"], x["places"]
        vendor = F.struct(
            first(names["vendor"]).alias("name"), F.get(places, F.lit(0)).alias("address"), first_email(text).alias("email"), first_phone(text).alias("phone")
        )
        customer = F.struct(first(names["customer"]).alias("name"), F.get(places, F.lit(1)).alias("address"))
        return F.struct(vendor.alias("vendor"), customer.alias("customer"))

    return let(F.struct(ner.company_names(text, found).alias("names"), addresses(text, 2).alias("places")), both)


def line_items(text: Column) -> Column:
    """Rows of the item table: from the first line with a head word to the first that starts with a total's label.
    Lines with a head word are skipped throughout, wherever it stands in a word."""
    end, row = re_(TABLE_END, ignore_case=True), re_(ROW)
    is_head = lambda line: line.rlike(re_(TABLE_HEAD, ignore_case=True))
    # a head word lies within a line, so the first one of the text is in the first line with one
    below = F.regexp_extract(text, re_(rf"{TABLE_HEAD}[^\n]*\n([\s\S]*)", ignore_case=True), 1)

    def rows(body: Column) -> Column:
        stop = F.array_position(F.transform(body, lambda line: line.rlike(end) & ~is_head(line)), True)
        inside = let(stop, lambda n: F.slice(body, F.lit(1), F.when(n > 0, n.cast("int") - 1).otherwise(F.size(body))))
        return F.filter(inside, lambda line: line.rlike(row) & ~is_head(line))

    found = let(F.transform(lines(below), strip), rows)
    part = lambda line, group: F.regexp_extract(line, row, group)

    def item(line: Column) -> Column:
        quantity = F.coalesce(unless_empty(part(line, 2)), F.lit("1"))
        values = {"description": (strip(part(line, 1)), "string"), "quantity": (quantity, "number"), "unit_price": (part(line, 3), "currency"), "total_amount": (part(line, 4), "currency")}
        return F.struct(*[field(v, kind, 0.8, "regex_row").alias(k) for k, (v, kind) in values.items()]).cast(ITEM)

    return F.transform(found, item)


def labelled_amount(text: Column, key: str, low: Column) -> Column:
    """The first number behind a label, or null. low: in_lower_case(text)."""
    number = to_number(first_match(from_word(text, low, *LABEL_WORDS[key]), re_(LABELS[key] + LABELLED, ignore_case=True)))
    return let(number, lambda n: F.when(n.isNotNull(), field(n.cast("string"), "currency", 0.95, "regex_label", number=n)))


def largest_amount(text: Column) -> Column:
    """The largest amount of a text, the first of equals."""
    ranked = F.transform(amounts(text), lambda a, i: F.struct(a["num_value"].alias("v"), (-i).alias("i"), a.alias("a")))
    return F.array_max(ranked)["a"]


def item_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(to_number(F.replace(x["total_amount"]["value"], F.lit("$"), F.lit(""))), F.lit(0.0)))


def item_errors(items: Column, subtotal: Column) -> Column:
    """An error if the rows' sum is off a subtotal, that is neither missing nor 0, by more than 1."""

    def check(x: Column) -> Column:
        total, stated = x["total"], x["stated"]
        message = F.concat(F.lit("Line items total ("), total.cast("string"), F.lit(") does not match extracted subtotal ("), stated.cast("string"), F.lit(")"))
        wrong = stated.isNotNull() & (stated != 0) & (F.abs(total - stated) > 1.0)
        return F.when(wrong, F.array(message)).otherwise(F.array().cast("array<string>"))

    return let(F.struct(item_sum(items).alias("total"), subtotal.alias("stated")), check)


def totals(text: Column, items: Column) -> Column:
    def parts(low: Column) -> Column:
        found = {key: labelled_amount(text, key, low) for key in LABELS}
        found["total_amount"] = F.coalesce(found["total_amount"], largest_amount(text))
        return F.struct(*[v.alias(k) for k, v in found.items()])

    return let(let(in_lower_case(text), parts), lambda x: F.struct(*[x[k].alias(k) for k in LABELS], item_errors(items, x["subtotal"]["num_value"]).alias("validation_errors")))


def payment_terms(text: Column) -> Column:
    first_term = lambda low: F.coalesce(*[first_match(from_word(text, low, w), re_(p, ignore_case=True)) for w, p in zip(TERM_WORDS, TERMS)])
    return let(let(in_lower_case(text), first_term), lambda t: F.struct(F.when(t.isNotNull(), field(t, "string", 0.9, "regex")).alias("term_description")))


def extract(text: Column, options: EngineOptions = EngineOptions()) -> Column:
    """Everything of an invoice as one struct; null for a null or empty text."""
    with_sums = let(line_items(text), lambda items: F.struct(items.alias("items"), totals(text, items).alias("sums")))

    def whole(x: Column) -> Column:
        return F.struct(
            header(text, options).alias("header"), x["parties"]["vendor"].alias("vendor"), x["parties"]["customer"].alias("customer"), x["rows"]["items"].alias("line_items"),
            x["rows"]["sums"].alias("totals"), payment_terms(text).alias("payment_terms"), F.lit("invoice").alias("document_type"),
            x["rows"]["sums"]["validation_errors"].alias("validation_errors"),
        )

    parts = F.struct(with_sums.alias("rows"), parties(text, options).alias("parties"))
    return F.when(F.coalesce(text, F.lit("")) != "", let(parts, whole))
