"""Token ids of documents, packed into fixed-width matrices by best-fit-decreasing.

A document longer than the window fills whole rows first, without loss; what is left of all documents of a block is
placed in order of falling length, each part in the row with the least room that still holds it. A segment tree over
the room left (one leaf for each amount, holding how many open rows have it) finds that row in log(window) steps.

A partition is worked off in blocks of at most ``BLOCK_TOKENS`` tokens, so memory is bounded whatever its size, and there
is no shuffle. Each row of the result is one row of the id matrix, as little-endian unsigned 16-bit ids, with its
segments' cumulative lengths, the places where positions start again, and each segment's document and place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, release, table
from .tokens import END_ID, encoder

WINDOW = 2048
BLOCK_TOKENS = 16_000_000
PAD_ID = 0


class CapacityTree:
    """A multiset of capacities 0..n-1 with a search for the smallest one that is large enough."""

    def __init__(self, n: int):
        self.leaves = 1 << (n - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, size: int) -> int:
        """The smallest stored capacity >= size, or -1."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:  # climb until a right sibling has something, then go down on its left
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length) that hold every token of documents of these lengths once."""
    rows: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for doc, length in enumerate(lengths):
        whole = length - length % window
        rows += [[(doc, start, window)] for start in range(0, whole, window)]
        if length > whole:
            rest.append((doc, whole, length - whole))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = CapacityTree(window + 1)
    open_rows: dict[int, list[list[tuple[int, int, int]]]] = {}
    for piece in rest:
        room = tree.at_least(piece[2])
        if room < 0:
            row: list[tuple[int, int, int]] = []
            rows.append(row)
            room = window
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        row.append(piece)
        room -= piece[2]
        if room:
            open_rows.setdefault(room, []).append(row)
            tree.add(room, 1)
    return rows


def position_ids(cu_seqlens: list[int], window: int = WINDOW) -> np.ndarray:
    """Positions in a row, starting again at 0 with each segment; padding counts on from 0 as a segment of its own."""
    out = np.arange(window)
    for start, end in zip(cu_seqlens, [*cu_seqlens[1:], window], strict=True):
        out[start:end] -= start
    return out


SCHEMA = (
    "sequence_id long, n_tokens long, n_segments long, ids_crc32 long, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>, input_ids binary"
)


def _pack(batches: Iterator[pa.RecordBatch], window: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    sequence = (ctx.partitionId() if ctx else 0) << 32
    code = encoder()
    end = np.array([END_ID], dtype="<u4").tobytes()
    docs: list[tuple[int | None, np.ndarray]] = []
    held = 0

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal sequence, held
        rows = best_fit_decreasing([len(ids) for _, ids in docs], window)
        for at in range(0, len(rows), 2000):
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            for row in rows[at : at + 2000]:
                ids = np.concatenate([docs[d][1][s : s + n] for d, s, n in row])
                full = np.full(window, PAD_ID, dtype="<u2")
                full[: len(ids)] = ids
                cu = np.cumsum([0, *(n for _, _, n in row)]).tolist()
                values = (sequence, len(ids), len(row), zlib.crc32(ids.tobytes()), cu, cu[:-1], [docs[d][0] for d, _, _ in row], [s for _, s, _ in row], full.tobytes())
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                sequence += 1
            types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
        docs.clear()
        held = 0

    for rows in portions(batches, 1):
        for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            ids = np.frombuffer(code.ids(text.as_py()) + end, dtype="<u4").astype("<u2")
            if docs and held + len(ids) > block_tokens:
                yield from give()
            docs.append((doc_id, ids))
            held += len(ids)
    if docs:
        yield from give()
    release()


def token_matrices(docs: DataFrame, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of the packed id matrices of docs (doc_id long, text string), each document closed by one end id.

    A null or empty text is its end id alone. Null and repeated doc_ids are packed like any other row; other columns
    are ignored; an empty table gives no rows. One document longer than a block is a block of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, window, block_tokens), SCHEMA)


def write_matrices(docs: DataFrame, path: str, window: int = WINDOW) -> None:
    """Write the matrices under path, as a table of which every row is a matrix row."""
    token_matrices(docs, window).write.parquet(path)


def op4_token_matrices(spark, sf_dir: str) -> DataFrame:
    return token_matrices(table(spark, sf_dir, "documents"))
