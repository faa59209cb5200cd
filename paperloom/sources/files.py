"""Reading and admitting files: binary scans, content types by magic bytes, the size limit, and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
ALLOWED = ("application/pdf", "image/jpeg", "image/png", "image/tiff")
# How files of a type begin, in hexadecimal.
MAGIC = {
    "application/pdf": ("25504446",),
    "image/jpeg": ("FFD8FF",),
    "image/png": ("89504E470D0A1A0A",),
    "image/tiff": ("49492A00", "4D4D002A"),
    "image/gif": ("47494638",),
    "application/zip": ("504B0304",),
    "application/gzip": ("1F8B08",),
    "application/x-executable": ("7F454C46", "4D5A90"),
}
#: Patterns of file names for uploads by hand (no TIFF there) and for the service.
UPLOAD_GLOB, SERVICE_GLOB = "*.{pdf,jpg,png,jpeg}", "*.{pdf,jpg,jpeg,png,tif,tiff}"


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files under path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def sniff(content: Column, declared: Column | None = None) -> Column:
    """The content type by the first bytes; text/plain if they are all printable; else the declared type, if any."""
    head = F.hex(F.substring(content, 1, 16))
    known = F.coalesce(*[F.when(F.greatest(*[head.startswith(m) for m in marks], F.lit(False)), kind) for kind, marks in MAGIC.items()])
    first = F.hex(F.substring(content, 1, 2048))
    plain = F.when(first.rlike("^(?:0[9AaDd]|[2-6][0-9A-Fa-f]|7[0-9A-Ea-e])+$"), "text/plain")
    return F.coalesce(known, plain, declared if declared is not None else F.lit(None).cast("string"), F.lit("application/octet-stream"))


def admit(uploads: DataFrame, declared: str | None = None, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): rejected rows have a code (400 for the type, 413 for the size) and a detail. uploads needs
    content, and uses length if it has it."""
    size = F.col("length") if "length" in uploads.columns else F.length("content").cast("long")
    typed = uploads.withColumn("content_type", sniff(F.col("content"), F.col(declared) if declared else None)).withColumn("_size", size)
    code = F.when(~F.col("content_type").isin(*ALLOWED), 400).when(F.col("_size") > max_bytes, 413)
    detail = F.when(code == 400, F.concat(F.lit("Invalid file type: "), F.col("content_type"))).when(code == 413, F.lit("File too large"))
    typed = typed.withColumn("code", code).withColumn("detail", detail).drop("_size")
    return typed.where("code is null").drop("code", "detail"), typed.where("code is not null")


def staged(uploads: DataFrame, folder: str, random_ids: bool = False) -> DataFrame:
    """uploads with an id and a path in the landing folder that keeps the extension. Ids come from the path and are the
    same on every run, unless random ones are asked for."""
    name = F.coalesce(F.col("filename") if "filename" in uploads.columns else F.col("path"), F.lit(""))
    found = uploads.withColumn("id", F.uuid() if random_ids else F.sha2(name, 256))
    extension = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    return found.withColumn("staged_path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("id"), extension))


def stage(uploads: DataFrame, folder: str, random_ids: bool = False) -> DataFrame:
    """Write the content of each upload to its place in the landing folder; gives staged() without the content. Files are written
    by the tasks that hold them, under another name first, so a task that runs again leaves whole files. folder is a path
    or URL that pyarrow's file systems know and that all executors share."""
    columns = [c for c in staged(uploads, folder, random_ids).columns if c != "content"]

    def write(batches):
        import uuid

        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        for rows in batches:
            for path, content in zip(rows.column("staged_path").to_pylist(), rows.column("content").to_pylist(), strict=True):
                place = f"{base.rstrip('/')}/{path.rsplit('/', 1)[1]}"
                part = f"{place}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as out:
                    out.write(content or b"")
                fs.move(part, place)
            yield rows.select(columns)

    shaped = staged(uploads, folder, random_ids)
    return shaped.mapInArrow(write, shaped.select(*columns).schema)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def rate_limited(requests: DataFrame, client: str = "user_id", ts: str = "ts", per_minute: int = 10) -> DataFrame:
    """requests with ``admitted``: the first per_minute of a client in each calendar minute. Clients are dealt out by
    client and minute, so a busy client is spread over its minutes."""
    from pyspark.sql import Window

    order = [F.col(ts), *[F.col(c) for c in requests.columns if c not in (ts, client)][:1]]
    place = F.row_number().over(Window.partitionBy(client, F.date_trunc("minute", ts)).orderBy(*order))
    return requests.withColumn("admitted", place <= per_minute)
