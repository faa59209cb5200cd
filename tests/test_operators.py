"""Each operator on the documents and values that define its behaviour."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions.amounts import correct_amount, valid_amount
from paperloom.functions.dates import correct_date, parse_date
from paperloom.functions.phones import correct_phone, valid_phone
from paperloom.operators import correct, entities, export, fields, merge, store, validate
from paperloom.operators.classify import classify
from paperloom.plans.pipeline import process, process_files
from paperloom.schema import CORRECTIONS, DOCUMENTS, EXTRACTIONS, FIELD, EngineOptions
from paperloom.sources import files, images

INVOICE = """Fernhill Joinery Ltd.
6 Sawmill Road, Unit 2
Bend, OR 97701
accounts@fernhill.example.org
(541) 253-7788

Bill To:
Petra Nowak
Suite C, 210 Cedar Way
Eugene, OR 97401

Invoice No: FJ-0042
Issued 04/18/2024, payable by 05/18/2024
Purchase Order: K7731

Item Qty Rate Amount
Oak shelf 3 80.50 241.50
Hinges 12 2.25 27.00
Delivery $31.50 31.50

Subtotal: $300.00
VAT: $24.00
Amount Due: $324.00
Due in 30 days
"""
RECEIPT = """Harbour Books
17 Quay Street
Camden, ME 04843
(207) 236-4455
Sold 2024-02-29 at 5:12 pm
Receipt No. #: R20931
Terminal: T9

Atlas of tides   18.75
Pencil set        4.10 T

Subtotal   22.85
Tax        1.26
Total     24.11

Paid with American Express
Acct: XXXX7702
Approval Code: 55KQ
Member ID: 4400-1199
Points 36

Your cashier thanks you, thank you for the visit
"""
RESUME = """Lena Fischer
Tucson, AZ 85701
lena@fischer.example.org, (520) 253-9081
https://github.com/lena https://fischer.example.org/cv https://www.linkedin.com/in/lena

Skills
Rust, Terraform, SQL, Rust

Employment
Lead Architect with Red Mesa Engineering Group
Jun 3, 2016

Education
Diploma in Engineering Technology
Sonora Institute
awarded 2012

Awards
Welding medal of the county
"""


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def values(spark, column, text):
    return [f["value"] for f in value(spark, column, text)]


@pytest.mark.parametrize(
    ("text", "kind", "least"),
    [
        ("Invoice # 1\nBill To: A\nSubtotal 5", "Invoice", 0.5),
        ("Experience, education and skills", "Resume", 0.6),
        ("Transaction 1\nTotal Amount 5\nThank you", "Receipt", 0.3),
        ("Passport, date of birth, sex, expiry date", "ID Document", 0.9),
        ("", "Unknown", 0.0),
        (None, "Unknown", 0.0),
        ("nothing of note", "Unknown", 0.0),
        ("Tel 5, Acme Co. Ltd.", "Business Card", 1.0),
    ],
)
def test_classify(spark, text, kind, least):
    found = value(spark, classify, text)
    assert found["document_type"] == kind and found["confidence"] >= least


def test_classify_details(spark):
    assert value(spark, classify, "écv")["document_type"] == "Unknown"  # a letter before: no word boundary
    assert "co." in value(spark, classify, "Acme Co. x")["matched_rules"]
    long = "experience education skills " + "x" * 1000
    assert value(spark, classify, long)["confidence"] == 1.0
    tie = value(spark, classify, "invoice resume " + "y" * 300)
    assert tie["document_type"] == "Invoice" and tie["confidence"] == 0.25


def test_generic_fields(spark):
    assert values(spark, fields.emails, "😀 a help@lumen.example.org, sales@example.com") == ["help@lumen.example.org", "sales@example.com"]
    first = value(spark, fields.emails, "😀 a help@lumen.example.org")[0]
    assert (first["position"]["start"], first["position"]["end"]) == (4, 26)
    assert values(spark, fields.dates, "2023-10-25, 15/11/2023, Dec 1, 2023, 99/99/2023") == ["2023-10-25", "2023-11-15", "2023-12-01"]
    found = value(spark, fields.amounts, "Total $1,250.00 and 50.00, 2,023 and 1500.00")
    assert [(f["num_value"], f["confidence"]) for f in found] == [(1250.0, 0.9), (50.0, 0.9), (2023.0, 0.4), (500.0, 0.9)]
    assert values(spark, fields.invoice_numbers, "Invoice No: INV-2023-001, BILL TO: x") == ["INV-2023-001"]
    assert values(spark, fields.urls, "see https://www.lumen.example.org/x") == ["https://www.lumen.example.org"]
    assert values(spark, fields.phone_numbers, "call +1 (650) 253-0000 ext 5 now") == ["+1 (650) 253-0000 ext 5"]
    assert values(spark, fields.addresses, "a\n1 Main St, IL 62704\n12345") == ["1 Main St, IL 62704"]
    assert values(spark, fields.skills, "Python, JavaScript, python, C++, Python, Machine Learning") == ["Python", "JavaScript", "C++", "Machine Learning"]
    assert values(spark, fields.job_titles, "Senior Software Engineer at Acme") == ["Software Engineer"]
    for f in (fields.emails, fields.dates, fields.amounts, fields.skills):
        assert not value(spark, f, "") and not value(spark, f, None)


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("2023-01-01", "2023-01-01"), ("Jan 5, 2023", "2023-01-05"), ("01/05/2023", "2023-01-05"), ("5th January 2023", "2023-01-05"),
        ("Due: Jan 5, 2023", "2023-01-05"), ("Not a date", None), ("", None), (None, None), ("31/12/24", "2024-12-31"), ("1/2/80", "1980-01-02"), ("30/02/2023", None),
    ],
)
def test_correct_date(spark, raw, day):
    assert value(spark, lambda c: correct_date(c, 2025), raw) == day


def test_parse_date(spark):
    for raw, day in [("13-01-2023", "2023-01-13"), ("45/10/20", "2045-10-20"), ("2023-25-10", None), ("Sept 5, 2023", "2023-09-05"), ("Janvier 5, 2023", None)]:
        assert value(spark, lambda c: parse_date(c, 2025), raw) == day


@pytest.mark.parametrize(
    ("raw", "number"),
    [
        ("1,234.56", 1234.56), ("$1,234.56", 1234.56), ("$ 1 234.56", 1234.56), ("1.234,56", 1234.56), ("100,50", 100.5), ("USD 50.00", 50.0),
        ("Free", None), ("1OO.OO", 100.0), ("$l0.00", 10.0), ("", None), (None, None), ("100,000", 100000.0), ("1,234,50", None), ("-5.00", -5.0),
    ],
)
def test_correct_amount(spark, raw, number):
    assert value(spark, correct_amount, raw) == number


def test_phones(spark):
    for raw in ("650-253-0000", "(650) 253-0000", "+1 650 253 0000"):
        assert value(spark, correct_phone, raw) == "+16502530000"
    for raw in ("555-123-4567", "12345", "", None):
        assert value(spark, correct_phone, raw) is None and value(spark, valid_phone, raw) is False


def test_validity(spark):
    check = lambda f, x: value(spark, f, x)
    assert [check(validate.validate_email, x) for x in ("test@example.org", "invalid-email", "user@example.com", None)] == [True, False, False, False]
    assert [check(validate.validate_date, x) for x in ("2023-01-01", "2023-1-1", "1800-01-01", "3000-01-01", "invalid", "2023-02-30", None)] == [True, True, False, False, False, False, False]
    assert [check(valid_amount, x) for x in ("100.5", "100.50", "-5", "x", None)] == [True, True, False, False, False]
    totals = lambda **k: value(spark, lambda c: validate.validate_totals(lambda key: F.lit(k.get(key))), "")
    assert totals(subtotal="100", tax="10", shipping="5", discount="0", total_amount="$115")["valid"]
    assert totals(subtotal="100", tax="10", total_amount="150")["errors"] == ["Total mismatch: Calculated 110.00 != Extracted 150.00"]
    days = value(spark, lambda c: validate.validate_dates(lambda k: F.lit({"invoice_date": "2023-02-01", "due_date": "2023-01-01"}[k])), "")
    assert days["errors"] == ["Due Date 2023-01-01 is before Invoice Date 2023-02-01"]
    assert value(spark, lambda c: validate.validate_resume_dates(), "")["valid"]


def run(spark, text, options=EngineOptions(), **more):
    return process(spark.createDataFrame([(1, text)], "doc_id long, text string"), options, **more).first()


def test_invoice(spark):
    row = run(spark, INVOICE)
    got = {k: v["value"] for k, v in row["fields"].items()}
    assert row["classification"]["document_type"] == "Invoice" and row["validation"]["document_valid"]
    assert got["header.invoice_number"] == "FJ-0042" and got["header.po_number"] == "K7731"
    assert (got["header.invoice_date"], got["header.due_date"]) == ("2024-04-18", "2024-05-18")
    assert got["line_items.0.description"] == "Oak shelf" and got["line_items.0.quantity"] == "3" and got["line_items.1.total_amount"] == "27.0"
    assert row["fields"]["line_items.1.total_amount"]["original_value"] == "27.00" and got["line_items.2.quantity"] == "1" and "line_items.3.quantity" not in got
    assert [row["fields"][f"totals.{k}"]["num_value"] for k in ("subtotal", "tax", "total_amount")] == [300.0, 24.0, 324.0]
    assert got["payment_terms.term_description"] == "Due in 30 days" and got["vendor.name"] == "Fernhill Joinery Ltd." and got["customer.address"] == "Eugene, OR 97401"


def test_receipt_and_resume(spark):
    got = {k: v["value"] for k, v in run(spark, RECEIPT)["fields"].items()}
    assert got["merchant.name"] == "Harbour Books" and got["merchant.phone"] == "+12072364455" and got["transaction.date"] == "2024-02-29"
    assert got["transaction.terminal_id"] == "T9" and got["transaction.time"] == "5:12 pm"
    assert (got["items.0.description"], got["items.1.total_price"]) == ("Atlas of tides", "4.1") and "items.2.quantity" not in got
    assert (got["payment.method"], got["payment.card_last_4"], got["payment.auth_code"]) == ("American Express", "7702", "55KQ")
    assert (got["loyalty.member_id"], got["loyalty.points_balance"], got["total_amount"]) == ("4400-1199", "36", "24.11")
    got = {k: v["value"] for k, v in run(spark, RESUME)["fields"].items()}
    assert got["contact_info.name"] == "Lena Fischer" and got["contact_info.email"] == "lena@fischer.example.org"
    assert (got["contact_info.github"], got["contact_info.linkedin"], got["contact_info.other_links.0"]) == ("https://github.com", "https://www.linkedin.com", "https://fischer.example.org")
    assert got["education.0.degree"] == "Diploma in Engineering Technology" and got["education.0.institution"] == "Sonora Institute"
    assert got["experience.0.title"] == "Architect" and got["experience.0.company"] == "Red Mesa Engineering Group"
    assert [got[f"skills.{i}"] for i in range(3)] == ["Rust", "Terraform", "SQL"] and "skills.3" not in got
    assert "Welding medal of the county" in got.values()


def test_compat_and_errors(spark):
    row = run(spark, INVOICE, EngineOptions(compat=True))
    assert "header.invoice_number" not in row["fields"] and any(k.startswith("email.") for k in row["fields"])
    assert run(spark, None)["status"] == "error" and run(spark, "")["status"] == "success"
    assert run(spark, INVOICE, EngineOptions(ner="none"))["fields"].get("vendor.name") is None


def test_entities_with_a_model(spark):
    def model(text):
        return F.array(F.struct(F.lit("ORG").alias("label"), F.lit("Acme").alias("text"), F.lit(9).alias("start"), F.lit(13).alias("end")))

    got = value(spark, lambda c: entities.company_names(c, entities.recognise(c, EngineOptions(ner=model))), "bill to: Acme Corp")
    assert [f["value"] for f in got["customer"]] == ["Acme"] and got["customer"][0]["confidence"] == 0.85 and not got["vendor"]


def test_recogniser_that_fails_to_load(spark):
    def broken():
        raise OSError("no such model")

    assert entities.load(broken) == "none"

    def make():
        def read(text):
            if "boom" in text:
                raise ValueError("boom")
            return [("PERSON", text[:4], 0, 4)]

        return read

    df = spark.createDataFrame([("Anna was here",), ("boom",), (None,)], "text string")
    got = df.select(entities.recognise(F.col("text"), EngineOptions(ner=entities.load(make))).alias("e")).collect()
    assert [[e["text"] for e in r["e"]] for r in got] == [["Anna"], [], []]


def test_hooks(spark):
    """A classifier and an extractor of one's own, and the functions for SQL."""
    from paperloom.plans import pipeline

    label = lambda text: F.struct(F.lit("Menu").alias("document_type"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("matched_rules"))
    pipeline.register("menu", lambda text, options: F.create_map(F.lit("dish"), fields.field(F.upper(text), "string", 0.9)).cast("map<string," + FIELD + ">"))
    try:
        row = run(spark, "soup", EngineOptions(classifier=label))
    finally:
        del pipeline.EXTRACTORS["menu"]
    assert row["classification"]["document_type"] == "Menu" and row["fields"]["dish"]["value"] == "SOUP"
    pipeline.register_functions(spark)
    assert spark.sql("SELECT read_date('on 5 of May 2023') AS d").first()["d"] == "2023-05-05"


def test_large_amounts_and_health(spark):
    got = spark.createDataFrame([("5",), ("2000000000",), ("x",), (None,)], "v string").select(validate.warn_amount(F.col("v")).alias("w"), validate.validate_amount(F.col("v")).alias("ok")).collect()
    assert [r["w"] is not None for r in got] == [False, True, False, False] and [r["ok"] for r in got] == [True, True, False, False]
    assert store.health(spark).first()["status"] == "healthy"


def test_many_matches_of_one_text(spark):
    """More matches than a block holds keep their places."""
    found = value(spark, fields.emails, "é a@bc.de " * 1300)
    assert len(found) == 1300 and all((f["position"]["start"], f["position"]["end"]) == (10 * i + 2, 10 * i + 9) for i, f in enumerate(found))


def test_merge(spark):
    at = lambda a, b: {"start": a, "end": b}
    field = lambda v, c, p=None: {"value": v, "confidence": c, "position": p}
    one = merge.merged([field("Google", 0.9, at(0, 6))], [field("Google Inc", 0.8, at(0, 10))])
    assert len(one) == 1 and one[0]["value"] == "Google" and one[0]["confidence"] == 0.87
    assert len(merge.merged([field("Apple", 0.9)], [field("Microsoft", 0.8)])) == 2
    assert len(merge.merged([field("abc", 0.9, at(0, 3))], [field("xyz", 0.8, at(1, 2))])) == 2  # only the spans overlap
    assert merge.merged([], []) == []
    df = spark.createDataFrame([([("Apple", 0.9, None)], [("apple", 0.5, None)])], "a array<struct<value:string,confidence:double,position:struct<start:int,end:int>>>, b array<struct<value:string,confidence:double,position:struct<start:int,end:int>>>")
    assert merge.merge_columns(df, "a", "b", "m").first()["m"][0]["confidence"] == 0.78


def test_corrections(spark):
    df = spark.createDataFrame([("1OO.OO", "amount"), ("Jan 5, 2023", "date"), ("$l0.00", "currency"), ("x", "date"), (None, "date")], "v string, k string")
    got = [r["s"] for r in df.select(correct.suggestions(F.col("v"), F.col("k")).alias("s")).collect()]
    assert got == [["100.0"], ["2023-01-05"], ["10.0"], [], []]


def test_store(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tables = store.Store(spark, str(tmp_path / "db")).init()
    documents = store.insert_documents(tables.read("documents"), spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf")], "id string, filename string"), now)
    fields_ = F.create_map(F.lit("total"), F.array(store.item(F.lit("100.00"), F.lit(0.9))), F.lit("note"), F.array(store.bare(F.lit("x"))))
    results = spark.createDataFrame([("a",), ("zz",)], "id string").select("id", F.lit("Invoice").alias("document_type"), F.lit(0.5).alias("confidence"), F.lit("t").alias("text_content"), fields_.alias("fields"))
    documents, extractions = store.complete(documents, tables.read("extractions"), results, now)
    documents = store.mark_failed(documents, spark.createDataFrame([("b", "broken")], "id string, error string"))
    start = tables.version()
    tables.replace(start, documents=documents, extractions=extractions)
    with pytest.raises(store.Conflict):
        tables.replace(start, documents=documents)
    documents, extractions = tables.read("documents"), tables.read("extractions")
    assert {r["id"]: r["status"] for r in documents.collect()} == {"a": "completed", "b": "failed"}
    assert extractions.count() == 2 and store.find_extractions(extractions, "a", "total").first()["value"] == "100.00"
    updates = spark.createDataFrame([("a", "total", "500.00"), ("a", "new", "1")], "document_id string, field_key string, new_value string")
    after, log = store.correct(extractions, tables.read("corrections"), updates, now)
    row = store.find_extractions(after, "a", "total").collect()
    assert len(row) == 1 and (row[0]["value"], row[0]["source"], row[0]["confidence"]) == ("500.00", "manual_correction", 1.0)
    assert {(r["field_key"], r["previous_value"], r["new_value"]) for r in log.collect()} == {("total", "100.00", "500.00"), ("new", None, "1")}
    assert export.to_table(documents, after).first().asDict() == {"document_id": "a", "total": "500.00", "note": "x", "new": "1"}
    assert '"total":[{"value":"500.00"' in export.to_json(documents, after).first()["json"]
    with pytest.raises(ValueError):
        export.export(documents, after, str(tmp_path / "x"), "xml")
    assert store.results(documents, after).where("document_id = 'b'").first()["extracted_fields"] == {}
    ready, missing = export.requested(documents, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert [r["id"] for r in ready.collect()] == ["a"] and {(r["id"], r["code"]) for r in missing.collect()} == {("b", 404), ("c", 404)}
    left, (rest,) = store.delete_documents(documents, [after], spark.createDataFrame([("a",)], "id string"))
    assert left.count() == 1 and rest.count() == 0
    rows = spark.createDataFrame([("a", 0, "k", "1"), ("a", 1, "k", "2"), ("a", 2, "", "3")], "id string, ord int, Field string, Value string")
    assert store.updates_map(rows).first()["updates"] == {"k": "2"}
    assert [r["id"] for r in store.recent(documents, 1).collect()] == ["a"]
    assert spark.createDataFrame([], DOCUMENTS).count() + spark.createDataFrame([], EXTRACTIONS).count() + spark.createDataFrame([], CORRECTIONS).count() == 0


def test_store_appends(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "db")).init()
    tables.init()
    docs = lambda *rows: spark.createDataFrame([(i, f"{i}.txt", status) for i, status in rows], "id string, filename string, status string").select("*", *[F.lit(None).cast(t).alias(n) for n, t in [c.split() for c in DOCUMENTS.split(", ")][3:]])
    rows = lambda *xs: spark.createDataFrame([(f"{d}{k}{o}", d, k, o, v, 1.0, "s", None) for d, k, o, v in xs], EXTRACTIONS)
    assert tables.append("one", documents=docs(("a", "processing"), ("b", "processing")), extractions=rows(("a", "k", 0, "1"), ("a", "k", 1, "2"), ("a", "m", 0, "3")))
    assert not tables.append("one", documents=docs(("z", "processing")))  # work that is repeated counts once
    assert tables.append(documents=docs(("a", "completed")), extractions=rows(("a", "k", 0, "9")))
    state = lambda: ({(r["id"], r["status"]) for r in tables.read("documents").collect()}, {(r["field_key"], r["ord"], r["value"]) for r in tables.read("extractions").collect()})
    want = ({("a", "completed"), ("b", "processing")}, {("k", 0, "9"), ("m", 0, "3")})
    assert state() == want and tables.read("documents", 1).count() == 2 and tables.read("corrections").count() == 0
    tables.compact()
    tables.vacuum(keep=1)
    assert state() == want and len(list((tmp_path / "db" / "documents").iterdir())) == 1
    assert not tables.append("one", documents=docs(("z", "processing")))


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"plain")
    found = files.scan(spark, str(tmp_path))
    good, bad = files.admit(found)
    assert [r["content_type"] for r in good.collect()] == ["application/pdf"]
    assert [(r["code"], r["content_type"]) for r in bad.collect()] == [(400, "text/plain")]
    assert files.staged(good, "/landing").first()["staged_path"].endswith(".pdf")
    for _ in range(2):  # staged again, the file is the same
        landed = files.stage(good, str(tmp_path / "landing")).collect()
    assert [p.read_bytes() for p in (tmp_path / "landing").iterdir()] == [b"%PDF-1.7 x"] and landed[0]["staged_path"] == str(next((tmp_path / "landing").iterdir()))
    text = files.scan_text(spark, str(tmp_path / "b.txt")).first()["text"]
    assert text == "plain"
    t = dt.datetime(2024, 1, 1)
    requests = spark.createDataFrame([(i, 1, t + dt.timedelta(seconds=i)) for i in range(61)], "event_id long, user_id long, ts timestamp")
    assert files.rate_limited(requests).where("admitted").count() == 11


def test_images(spark):
    rows = spark.createDataFrame([((["Hello", " ", "World"], [99, 50, -1], [10, 0, 0], [1, 1, 1], [2, 2, 2], [3, 3, 3]),)], f"r {images.OCR_ROWS}")
    got = rows.select(images.words(F.col("r")).alias("w")).first()["w"]
    assert len(got) == 1 and got[0]["confidence"] == 0.99 and got[0]["bbox"]["x"] == 10
    size = spark.range(1).select(images.resized(F.lit(200), F.lit(100)).alias("s"), images.skew(F.lit(-80.0)).alias("t"), images.skew(F.lit(0.3)).alias("u")).first()
    assert size["s"]["width"] == 2000 and size["t"] == -10.0 and size["u"] == 0.0
    raw = spark.createDataFrame([("x.png", b"1"), ("y.png", b"")], "path string, content binary")

    def engine(image):
        if not image:
            raise ValueError("empty")
        return {"text": "Invoice No: 12\nbill to", "rows": {"text": ["Invoice"], "conf": [90], "left": [1], "top": [1], "width": [1], "height": [1]}}

    done = {r["doc_id"]: r for r in process_files(raw, engine=engine, prepare=lambda i: i, pages=lambda c, p: [c]).collect()}
    assert done["x.png"]["status"] == "success" and done["x.png"]["classification"]["document_type"] == "Invoice"
    assert done["y.png"]["status"] == "error" and "empty" in done["y.png"]["error"]


def test_image_steps_in_order(spark, monkeypatch):
    """The order of the image steps, with numbers in place of pixels: a stand-in notes what is called on what."""
    import sys
    import types

    import numpy as np

    seen = []

    def note(name, out=None):
        def call(image, *args, **kwargs):
            seen.append(name)
            return image if out is None else out(image, *args)

        return call

    cv2 = types.SimpleNamespace(
        COLOR_BGR2GRAY=1, COLOR_BGR2LAB=2, COLOR_LAB2BGR=3, COLOR_RGB2BGR=4, INTER_AREA=5, INTER_CUBIC=6, BORDER_REPLICATE=7, IMREAD_COLOR=8,
        resize=note("resize", lambda image, size: np.resize(image, (size[1], size[0], 3))), cvtColor=note("color", lambda image, code: image[..., 0] if code == 1 else image.copy()),
        minAreaRect=lambda points: ((0, 0), (1, 1), -80.0), getRotationMatrix2D=lambda centre, turn, scale: seen.append(("turn", turn)), warpAffine=lambda image, *a, **k: note("rotate")(image),
        fastNlMeansDenoisingColored=note("denoise"), createCLAHE=lambda **k: types.SimpleNamespace(apply=note("contrast")),
        imdecode=lambda data, mode: None if not len(data) else np.ones((4, 8, 3), dtype=np.uint8), imread=lambda path: None,
    )
    monkeypatch.setitem(sys.modules, "cv2", cv2)
    image = images.load_image(b"123")
    assert image.shape == (4, 8, 3) and images.load_image(image) is image
    out = images.enhance(images.resize(image))
    assert out.shape == (1000, 2000, 3) and seen == ["resize", "color", ("turn", -10.0), "rotate", "denoise", "color", "contrast", "color"]
    seen.clear()
    images.enhance(image, deskew=False, contrast=False)
    assert seen == ["denoise"]
    for bad in (b"", "missing.png", 5):
        with pytest.raises(ValueError):
            images.load_image(bad)


def test_streaming(spark, tmp_path):
    from paperloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(INVOICE)
    tables = store.Store(spark, str(tmp_path / "db")).init()
    for _ in range(2):  # the second run finds nothing new
        ingest.run(ingest.text_stream(spark, str(tmp_path / "in")), tables, str(tmp_path / "cp")).awaitTermination(300)
    assert [r["status"] for r in tables.read("documents").collect()] == ["completed"]
    assert tables.read("extractions").where("field_key = 'header.invoice_number'").first()["value"] == "FJ-0042"
    t = dt.datetime(2024, 1, 1)
    requests = spark.createDataFrame([(1, t), (1, t)], "user_id long, ts timestamp")
    assert ingest.request_counts(requests).first()["requests"] == 2
