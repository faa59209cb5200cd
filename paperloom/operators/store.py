"""The three tables (documents, extractions, corrections) as DataFrame transformations.

Every operation takes the present tables and returns the new ones; ``Store`` keeps them as folders that a log of commits names,
so rows can be appended and all tables switch at once.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CORRECTIONS, DOCUMENTS, EXTRACTIONS

#: A result to be stored: a list of items for each key. An item without a value is stored as empty.
RESULT = "map<string,array<struct<value:string,confidence:double,source:string,position:struct<start:int,end:int>>>>"


def insert_documents(documents: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """documents with the rows of new (id, filename) as ``processing``."""
    rows = new.select("id", "filename", F.lit("processing").alias("status"), (now if now is not None else F.current_timestamp()).alias("upload_timestamp"))
    return documents.unionByName(rows, allowMissingColumns=True)


def get_document(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.where(F.col("id") == doc_id).limit(1)


def find_extractions(extractions: DataFrame, doc_id: str, field_key: str) -> DataFrame:
    return extractions.where((F.col("document_id") == doc_id) & (F.col("field_key") == field_key))


def item(value: Column, confidence: Column | None = None, source: Column | None = None, position: Column | None = None) -> Column:
    """An item of a result, with the defaults of a field that lacks parts."""
    return F.struct(
        F.coalesce(value.cast("string"), F.lit("")).alias("value"),
        F.coalesce(confidence if confidence is not None else F.lit(None).cast("double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(source if source is not None else F.lit(None).cast("string"), F.lit("hybrid")).alias("source"),
        (position if position is not None else F.lit(None)).cast("struct<start:int,end:int>").alias("position"),
    )


def bare(value: Column) -> Column:
    """An item made of a plain value: confidence 1 and an unknown source."""
    return item(value, F.lit(1.0), F.lit("unknown"))


def flatten(results: DataFrame) -> DataFrame:
    """Extraction rows of results (id, fields RESULT): one row an item, in order."""
    by_key = results.select(F.col("id").alias("document_id"), F.explode("fields").alias("field_key", "items"))
    rows = by_key.select("document_id", "field_key", F.posexplode("items").alias("ord", "x"))
    return rows.select(
        F.sha2(F.concat_ws("|", "document_id", "field_key", "ord"), 256).alias("id"), "document_id", "field_key", "ord",
        F.coalesce("x.value", F.lit("")).alias("value"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("x.source", F.lit("hybrid")).alias("source"), F.to_json("x.position").alias("position_json"),
    )


def complete(documents: DataFrame, extractions: DataFrame, results: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Store results (id, document_type, confidence, text_content, fields). Results of unknown documents are dropped."""
    known = results.join(documents.select("id"), "id", "left_semi")
    new = known.select("id", F.lit(True).alias("_hit"), F.col("document_type").alias("_type"), F.col("confidence").alias("_conf"), F.col("text_content").alias("_text"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    when = now if now is not None else F.current_timestamp()
    changed = documents.join(new, "id", "left").select(
        "id", "filename", F.when(hit, "completed").otherwise(F.col("status")).alias("status"), "upload_timestamp",
        F.when(hit, when).otherwise(F.col("processed_timestamp")).alias("processed_timestamp"),
        F.when(hit, F.col("_type")).otherwise(F.col("document_type")).alias("document_type"),
        F.when(hit, F.col("_text")).otherwise(F.col("text_content")).alias("text_content"),
        F.when(hit, F.col("_conf")).otherwise(F.col("confidence")).alias("confidence"), "error",
    )
    return changed, extractions.unionByName(flatten(known))


def mark_failed(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """documents with the rows of errors (id, error) as ``failed``."""
    new = errors.select("id", F.col("error").alias("_error"), F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    joined = documents.join(new, "id", "left")
    joined = joined.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).withColumn("error", F.when(hit, F.col("_error")).otherwise(F.col("error")))
    return joined.select(*documents.columns)


def grouped(extractions: DataFrame) -> DataFrame:
    """(document_id, fields): map of key to its (value, confidence) items in order."""
    items = extractions.groupBy("document_id", "field_key").agg(F.array_sort(F.collect_list(F.struct("ord", "value", "confidence"))).alias("xs"))
    items = items.withColumn("xs", F.transform("xs", lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"))))
    return items.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", "xs")), _by_key)).alias("fields"))


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["field_key"] < b["field_key"], -1).when(a["field_key"] > b["field_key"], 1).otherwise(0)


def with_fields(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each document with its extractions; an empty map if it has none."""
    joined = documents.join(grouped(extractions), documents["id"] == F.col("document_id"), "left").drop("document_id")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<struct<value:string,confidence:double>>>"))
    return joined.withColumn("fields", F.coalesce("fields", empty))


def results(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """What a client gets for each document."""
    both = with_fields(documents, extractions)
    return both.select(F.col("id").alias("document_id"), "filename", "status", "upload_timestamp", "processed_timestamp", "document_type", "confidence", F.col("fields").alias("extracted_fields"), "error")


def recent(documents: DataFrame, limit: int = 10) -> DataFrame:
    """The latest uploads, ties by id."""
    return documents.select("id", "filename", "status", "upload_timestamp").orderBy(F.desc("upload_timestamp"), "id").limit(limit)


def correct(extractions: DataFrame, corrections: DataFrame, updates: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace all items of a key by one new value and log the change. updates: (document_id, field_key, new_value); of
    several for one key the greatest ``ord`` wins, if there is such a column, else the greatest value."""
    order = [F.desc(c) for c in ("ord", "new_value") if c in updates.columns]
    last = Window.partitionBy("document_id", "field_key").orderBy(*order)
    new = updates.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("document_id", "field_key", "new_value")
    before = extractions.groupBy("document_id", "field_key").agg(F.min_by("value", "ord").alias("previous_value"))
    logged = new.join(before, ["document_id", "field_key"], "left").select(
        F.sha2(F.concat_ws("|", "document_id", "field_key", "new_value"), 256).alias("id"), "document_id", "field_key", "previous_value", "new_value",
        (now if now is not None else F.current_timestamp()).alias("timestamp"),
    )
    rows = new.select(
        F.sha2(F.concat_ws("|", "document_id", "field_key", F.lit("manual")), 256).alias("id"), "document_id", "field_key", F.lit(0).alias("ord"),
        F.col("new_value").alias("value"), F.lit(1.0).alias("confidence"), F.lit("manual_correction").alias("source"), F.lit(None).cast("string").alias("position_json"),
    )
    return extractions.join(new, ["document_id", "field_key"], "left_anti").unionByName(rows), corrections.unionByName(logged)


def delete_documents(documents: DataFrame, children: list[DataFrame], gone: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All tables without the documents of gone (id) and what belongs to them."""
    ids = gone.select(F.col("id").alias("_gone"))
    return documents.join(ids, documents["id"] == ids["_gone"], "left_anti"), [c.join(ids, c["document_id"] == ids["_gone"], "left_anti") for c in children]


def found_or_404(documents: DataFrame, asked: DataFrame, status: str | None = None, detail: str = "Document not found") -> tuple[DataFrame, DataFrame]:
    """(documents asked for, rejects) of asked (id): rejects (id, code, detail) are ids without a document, or without one in
    the given status."""
    ids = asked.select("id").distinct()
    ready = documents.where(F.col("status") == status) if status else documents
    missing = ids.join(ready.select("id"), "id", "left_anti").select("id", F.lit(404).alias("code"), F.lit(detail).alias("detail"))
    return ready.join(ids, "id", "left_semi"), missing


def submit(documents: DataFrame, extractions: DataFrame, corrections: DataFrame, updates: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """correct() for the updates (document_id, field_key, new_value) of known documents, and rejects for the others."""
    _, missing = found_or_404(documents, updates.select(F.col("document_id").alias("id")))
    known = updates.join(missing.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    after, log = correct(extractions, corrections, known, now)
    return after, log, missing


def health(spark: SparkSession) -> DataFrame:
    """One row (status, timestamp), as a sign of life of the session."""
    return spark.range(1).select(F.lit("healthy").alias("status"), F.current_timestamp().alias("timestamp"))


def status_view(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each upload (id, filename): its status and type; ``processing`` and - while there is none."""
    d = documents.select("id", F.col("status").alias("_s"), F.col("document_type").alias("_t"))
    return uploads.join(d, "id", "left").select("filename", F.coalesce("_s", F.lit("processing")).alias("status"), F.coalesce("_t", F.lit("-")).alias("type"), "id")


def field_table(results: DataFrame) -> DataFrame:
    """(id, Field, Value, Confidence), one row an item, of results (id, fields)."""
    return flatten(results).select(F.col("document_id").alias("id"), F.col("field_key").alias("Field"), F.col("value").alias("Value"), F.col("confidence").alias("Confidence"))


def updates_map(rows: DataFrame) -> DataFrame:
    """(id, updates): map of the edited rows (id, ord, Field, Value) with a name; the last of a name wins."""
    last = rows.where(F.coalesce("Field", F.lit("")) != "").groupBy("id", "Field").agg(F.max_by("Value", "ord").alias("Value"))
    return last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("Field", "Value"))).alias("updates"))


class Conflict(RuntimeError):
    """Another writer was faster; the change has to be made again on the new state."""


class Store:
    """The tables as Parquet folders under one path, and a log of commits that says which folders count.

    ``append`` adds rows; a row of ``documents`` replaces the older row of its id, a group of ``extractions`` the older group of its
    document and key. ``replace`` puts new contents in place of the old. Either writes its folders first and then one
    commit, a file whose number must be new: all tables switch at once, readers never see half a change, and of two
    writers that started from the same state one gets a ``Conflict``, or, if both append, simply comes second. A commit can
    carry the key of its work, so that work which is repeated after a failure counts once. ``compact`` merges what was
    appended, ``vacuum`` deletes folders that no commit of the last ones mentions.
    """

    TABLES = {"documents": DOCUMENTS, "extractions": EXTRACTIONS, "corrections": CORRECTIONS}
    KEYS = {"documents": ["id"], "extractions": ["document_id", "field_key"], "corrections": ["id"]}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def init(self) -> Store:
        """Create the store if it does not exist."""
        fs, log = self._fs("log")
        fs.mkdirs(log)
        if self.version() < 0:
            try:
                self._commit(0, {"folders": {name: [] for name in self.TABLES}, "done": []})
            except Conflict:
                pass
        return self

    def version(self) -> int:
        """The number of the last commit, -1 before the first."""
        fs, log = self._fs("log")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def state(self, version: int | None = None) -> dict:
        """What a commit says: the folders of each table, as (folder, number of its commit), and the keys of done work."""
        fs, file = self._fs(f"log/{self.version() if version is None else version:012d}")
        stream = fs.open(file)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, number: int, state: dict) -> None:
        fs, file = self._fs(f"log/{number:012d}")
        _, draft = self._fs(f"log/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(state).encode())
        out.close()
        if fs.exists(file) or not fs.rename(draft, file):
            fs.delete(draft, False)
            raise Conflict(f"commit {number} exists")

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.select(*[c.split()[0] for c in self.TABLES[name].split(", ")]).write.parquet(f"{self.path}/{folder}")
        return folder

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table's present rows, or those of an older commit."""
        folders = self.state(version)["folders"][name]
        if not folders:
            return self.spark.createDataFrame([], self.TABLES[name])
        parts = [self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{f}").withColumn("_commit", F.lit(n)) for f, n in folders]
        rows = functools.reduce(DataFrame.unionByName, parts)
        if len(parts) > 1 and name != "corrections":  # what was appended later stands for what it repeats
            last = Window.partitionBy(*self.KEYS[name])
            rows = rows.withColumn("_last", F.max("_commit").over(last)).where(F.col("_commit") == F.col("_last")).drop("_last")
        return rows.drop("_commit")

    def append(self, key: str | None = None, **tables: DataFrame) -> bool:
        """Add rows to tables in one commit; False if work of this key was committed before."""
        if key is not None and key in self.state()["done"]:
            return False
        folders = {name: self._write(name, df) for name, df in tables.items()}
        while True:
            number = self.version()
            state = self.state(number)
            if key is not None and key in state["done"]:
                return False
            for name, folder in folders.items():
                state["folders"][name].append([folder, number + 1])
            if key is not None:
                state["done"] = [*state["done"], key][-1000:]
            try:
                self._commit(number + 1, state)
                return True
            except Conflict:
                continue

    def replace(self, since: int | None = None, **tables: DataFrame) -> None:
        """Put new contents in place of the old, in one commit. since: the commit that they were made from; a Conflict if
        there is a later one."""
        number = self.version()
        if since is not None and number != since:
            raise Conflict(f"commit {since} is not the last one")
        state = self.state(number)
        for name, df in tables.items():
            state["folders"][name] = [[self._write(name, df), number + 1]]
        self._commit(number + 1, state)

    def compact(self, *names: str) -> None:
        """Merge the folders of tables to one each."""
        number = self.version()
        self.replace(number, **{name: self.read(name, number) for name in names or self.TABLES})

    def vacuum(self, keep: int = 10) -> None:
        """Delete the folders that none of the last commits mentions, and older commits. To be run while no one writes."""
        fs, log = self._fs("log")
        last = self.version()
        kept = [n for n in range(max(0, last - keep + 1), last + 1)]
        named = {f for n in kept for fs_ in self.state(n)["folders"].values() for f, _ in fs_}
        for status in fs.listStatus(log):
            if status.getPath().getName().isdigit() and int(status.getPath().getName()) not in kept:
                fs.delete(status.getPath(), False)
        for name in self.TABLES:
            _, folder = self._fs(name)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{name}/{status.getPath().getName()}" not in named:
                    fs.delete(status.getPath(), True)
