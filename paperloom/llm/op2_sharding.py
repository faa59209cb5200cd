"""Placement of keys on shards by a lookup table that permutations fill.

Every shard ranks the slots of a table of prime size by its own permutation: slot i is (offset + i * skip) mod size,
with offset and skip taken from hashes of the shard's name. The shards take turns, each claiming the first slot of its
order that is still free, until the table is full; so the shards' shares differ by one slot at most, and a shard that
leaves or joins moves few keys besides its own. The table depends on the names only; it has ``SLOTS`` rows and
is broadcast. A key's slot is its hash modulo the size. Placing rows is a map-side broadcast join: no shuffle, and no
key is moved to another, whatever its share of the rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 10_007
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode(), usedforsecurity=False).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot. Shards take part in the order of their names, so the order of
    the list does not matter; numbers are places in the list. Names must differ, and slots must be a prime of at
    least as many as there are shards."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or not is_prime(slots):
        raise ValueError("shards must be distinct and not more than slots, a prime")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = {i: _hash(shards[i], "offset") % slots for i in turns}
    skip = {i: _hash(shards[i], "skip") % (slots - 1) + 1 for i in turns}
    step = dict.fromkeys(turns, 0)
    owner = [-1] * slots
    free = slots
    while free:
        for i in turns:
            while owner[slot := (offset[i] + step[i] * skip[i]) % slots] >= 0:
                step[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    """The slot of a key: the first 48 bits of the MD5 of its text, modulo the size; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") % slots


def _table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(_slot, _shard): SLOTS rows, made by SQL functions from one literal."""
    numbers = F.transform(F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ","), lambda x: x.cast("int"))
    return spark.range(1).select(F.posexplode(numbers).alias("_slot", "_shard")).withColumn("_slot", F.col("_slot").cast("long"))


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(row, slot, shard) for every row of df: the row as a struct, so no name can clash, its slot and its shard's number.

    A null key is placed like the empty text; equal keys share a shard; an empty table gives no rows.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot_of(F.col(f"`{key}`"), slots).alias("_slot"))
    placed = rows.join(F.broadcast(_table(df.sparkSession, shards, slots)), "_slot")
    return placed.select("row", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def moved(df: DataFrame, key: str, before: list[str], after: list[str], slots: int = SLOTS) -> DataFrame:
    """(row, from_shard, to_shard) for the rows whose shard's name changes when the list of shards does."""
    old, new = (F.broadcast(_table(df.sparkSession, s, slots)) for s in (before, after))
    names = [F.array(*map(F.lit, s)) for s in (before, after)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot_of(F.col(f"`{key}`"), slots).alias("_slot"))
    both = rows.join(old.withColumnRenamed("_shard", "_a"), "_slot").join(new.withColumnRenamed("_shard", "_b"), "_slot")
    both = both.select("row", F.get(names[0], F.col("_a")).alias("from_shard"), F.get(names[1], F.col("_b")).alias("to_shard"))
    return both.where("from_shard <> to_shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return place(docs, "doc_id").select("row.doc_id", "row.n_chars", "slot", "shard")


def oracle() -> str:
    numbers = ",".join(map(str, lookup_table(SHARDS)))
    return f"""
WITH p AS (
  SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {SLOTS} AS slot
  FROM documents
), t AS (SELECT string_split('{numbers}', ',') AS owner)
SELECT doc_id, n_chars, slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM p, t
"""
