"""Benchmark decontamination by suffix arrays of the training text.

Each portion of about a megabyte of documents is one shard. Its words become integers (0 for a word that no benchmark item
has). A match with the benchmark can go on only from word to word while the pair of words occurs in an item, so the text
is cut into runs of such pairs; the shard's suffix array holds every word position of a run in the order of what follows
up to the run's end, made by prefix doubling. Memory is linear in the shard and in the benchmark, whatever the length of
an item: suffixes are places in one array of word numbers.

Every suffix of every item that has a whole window is then looked up by binary search: the range of the array that shares its
window has every occurrence of that window. Where the words before it differ (a match that is not the continuation of a longer one),
the words shared beyond the window are counted, which gives the longest verbatim match; matches shorter than a window are not
looked for.

Documents never leave their partition: there is no shuffle, and memory is one shard and one block of the benchmark.
The benchmark is read in blocks of at most ``BLOCK_WORDS`` words, or one longer item, each broadcast on its own; the results of
one block are carried to the pass of the next, so the size of the benchmark is not limited.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions, release, table

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Lower-cases A-Z and blanks every other ASCII byte that belongs to no word.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_item", T.LongType()),
        T.StructField("longest_start", T.LongType()),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


def ranks(ids: np.ndarray, goes_on: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of the places ``starts`` its rank among the suffixes there, equal suffixes having equal ranks. A suffix goes
    on to the next place while ``goes_on``; every place that a suffix reaches is in starts. Prefix doubling."""
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(~goes_on)
    length = ends[np.searchsorted(ends, starts)] - starts + 1
    _, rank = np.unique(ids[starts], return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step, longest = 1, int(length.max())
    while step < longest and int(rank.max()) < len(starts):
        ahead = np.zeros(len(starts), dtype=np.int64)
        more = np.flatnonzero(length > step)
        ahead[more] = rank[np.searchsorted(starts, starts[more] + step)]
        _, rank = np.unique(rank * (len(starts) + 1) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
    return rank


class Block:
    """A bounded part of the benchmark: its vocabulary, all its words as numbers in one array (0 behind each item), and its
    windows, each with the items and places that have it. An item without id has no number."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        numbers = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws] for _, ws in items]
        self.ids = np.array([n for ns in numbers for n in (*ns, 0)], dtype=np.int32)
        first = np.cumsum([0, *(len(ns) + 1 for ns in numbers)])
        pair = self.ids[:-1].astype(np.int64) << 32 | self.ids[1:]
        self.pairs = np.unique(pair[(self.ids[:-1] > 0) & (self.ids[1:] > 0)])
        self.singles = np.unique(np.array([ns[0] for ns in numbers if len(ns) == 1], dtype=np.int64))
        data = self.ids.astype(">u4").tobytes()
        #: window -> [(item, place in ids)]
        self.windows: dict[bytes, list[tuple[int | None, int]]] = {}
        for (item, _), ns, at in zip(items, numbers, first.tolist(), strict=False):
            size = min(window, len(ns))
            for place in range(at, at + len(ns) - size + 1):
                self.windows.setdefault(data[4 * place : 4 * (place + size)], []).append((item, place))

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, ws, repeat(0)), dtype=np.int32, count=len(ws))


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


class Shard:
    """The suffix array of a few documents against one block."""

    def __init__(self, docs: list[np.ndarray], block: Block):
        self.sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # a 0 stands behind each document
        self.ids = np.zeros(int(self.first[-1]) + 1, dtype=np.int32)
        for at, d in zip(self.first, docs, strict=False):
            self.ids[at : at + len(d)] = d
        goes_on = np.append(_member(self.ids[:-1].astype(np.int64) << 32 | self.ids[1:], block.pairs), False) & (self.ids > 0)
        begins = goes_on | _member(self.ids.astype(np.int64), block.singles) & (self.ids > 0)
        reached = begins.copy()
        reached[1:] |= goes_on[:-1]
        starts = np.flatnonzero(reached)
        rank = ranks(self.ids, goes_on, starts)
        keep = begins[starts]
        self.positions = starts[keep][np.argsort(rank[keep], kind="stable")]
        ends = np.flatnonzero(~goes_on)
        stop = np.minimum(ends[np.searchsorted(ends, self.positions)] + 1, self.positions + block.window)
        data = self.ids.astype(">u4").tobytes()
        self.heads = [data[4 * a : 4 * b] for a, b in zip(self.positions.tolist(), stop.tolist(), strict=True)]

    def occurrences(self, window: bytes) -> np.ndarray:
        """The positions whose suffixes begin with a window."""
        low = bisect_left(self.heads, window)
        high = bisect_left(self.heads, window + b"\xff\xff\xff\xff", lo=low)
        return self.positions[low:high]


def common(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Words that a from i on and b from j on share; a 0 ends both."""
    n, step = 0, 16
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        m = min(len(x), len(y))
        if not m:
            return n
        wrong = np.flatnonzero((x[:m] != y[:m]) | (x[:m] == 0))
        if len(wrong):
            return n + int(wrong[0])
        n, step = n + m, 2 * step


def _scan(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    block = block.value
    for rows in portions(batches, 1):
        shard = Shard([block.numbers(words(t.as_py())) for t in rows.column(1)], block)
        before = rows.column(2).to_pylist()
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        best: dict[int, tuple[int, bool, int, int]] = {}
        for window, owners in block.windows.items():
            found = shard.occurrences(window)
            if not len(found):
                continue
            known = {item for item, _ in owners if item is not None}
            of = np.searchsorted(shard.first, found, side="right") - 1
            for position, k in zip(found.tolist(), of.tolist(), strict=True):
                start = position - int(shard.first[k])
                spans.setdefault(k, []).append((start, start + len(window) // 4))
                items.setdefault(k, set()).update(known)
                left = int(shard.ids[position - 1]) if start else 0
                for item, place in owners:
                    if left and place and left == block.ids[place - 1]:
                        continue  # goes on from a longer match
                    shared = common(shard.ids, position, block.ids, place)
                    best[k] = max(best.get(k, (0, False, 0, 0)), (shared, item is not None, -(item or 0), -start))
        out = []
        for k, n_words in enumerate(shard.sizes.tolist()):
            old = before[k] or {"spans": [], "items": [], "longest": 0, "longest_item": None, "longest_start": None}
            merged: list[list[int]] = []
            for a, b in sorted([*spans.get(k, ()), *((s["start"], s["end"]) for s in old["spans"])]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            shared, named, item, start = best.get(k, (0, False, 0, 0))
            newer = shared > old["longest"]
            out.append(
                {
                    "n_words": n_words,
                    "spans": [{"start": a, "end": b} for a, b in merged],
                    "items": sorted(items.get(k, set()) | set(old["items"])),
                    "longest": shared if newer else old["longest"],
                    "longest_item": (-item if named else None) if newer else old["longest_item"],
                    "longest_start": -start if newer else old["longest_start"],
                }
            )
        found = pa.array(out, type=rows.schema.field(2).type)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), found], names=["row", "words_of", "found"])
    release()


def blocks(bench: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark, streamed to the driver in bounded blocks; items without words take no part."""
    part, n = [], 0
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    for r in rows.where("text is not null").toLocalIterator():
        ws = words(bytes(r["text"]))
        if not ws:
            continue
        if part and n + len(ws) > block_words:
            yield Block(part, window)
            part, n = [], 0
        part.append((r["item_id"], ws))
        n += len(ws)
    yield Block(part, window)


def find_contamination(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None
) -> DataFrame:
    """(row, found) for every row of docs (text string): row is the input row, or its columns ``keep``, as a struct,
    so no column name can clash; found has n_words, merged word spans, item ids, and the longest match with its item and place.

    bench needs item_id and text. A null or empty text has no words. Rows of one item_id are one item for the
    count of items; an item without id gives spans, but is not among the items. An item of fewer than ``window`` words is a
    single window. Ties for the longest match go to the smallest item_id, then the first place. Repeated rows are searched
    alike. Empty tables give no rows, or no spans.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    at = docs.select(row, F.col("text").cast("string").cast("binary").alias("words_of"), F.lit(None).cast(_FOUND).alias("found"))
    spark = docs.sparkSession
    for block in blocks(bench, window, block_words):
        sent = spark.sparkContext.broadcast(block)
        at = at.mapInArrow(lambda it, b=sent: _scan(it, b), at.schema)
    return at.select("row", "found")


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    return find_contamination(docs, bench, window).where(F.size("found.spans") == 0).select("row.*")


def sha256_of_ids(items: F.Column) -> F.Column:
    """Lower-case hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        sha256_of_ids(F.col("found.items")).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
        F.col("found.longest").alias("longest_match"),
        F.col("found.longest_item").alias("longest_item"),
        F.col("found.longest_start").alias("longest_start"),
    )
