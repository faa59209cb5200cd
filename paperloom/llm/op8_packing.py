"""Sum-of-squares online packing of token sequences into fixed windows.

Documents arrive in the order of their partition. A document longer than the window first fills whole windows;
what is left is placed into the fill level h for which the sum of squared level counts grows least: moving a
window from level h to h+s changes that sum by 2 * (count[h+s] - count[h]) + 2; levels 0 and full do not count.
The counts of the partly filled windows are the level array. When the partition ends, the windows still open are
merged: the least filled are dissolved, their pieces cut and moved into the gaps of the fullest, so at most one
stays open, and that one is cut along the binary digits of its fill, as a sequence whose length is a power of
two needs no padding.

A partition is packed on its own, without a shuffle; the state is the level array and the open windows with the ids of
their pieces, which is at most the ids of one input partition (spark.sql.files.maxPartitionBytes of text). No number of open
windows changes the rule. sequence_id is the partition's number times 2**32 plus a running number, so a recomputed partition
gives the same rows.
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
Piece = tuple[int, int, int]  # document's running number, start, length


class SumOfSquares:
    """The online packer. add() takes a document; closed windows, lists of pieces, come out of it and of finish()."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def add(self, doc: int, length: int) -> Iterator[list[Piece]]:
        start = 0
        while length - start >= self.window:
            yield [(doc, start, self.window)]
            start += self.window
        size = length - start
        if not size:
            return
        n = self.levels
        usable = n[: self.window - size + 1] > 0
        usable[0] = True
        growth = 2 * n[size:] - 2 * n[: self.window - size + 1] + 2
        growth[0] = 2 * n[size] + 1  # a new window
        growth[-1] = 1 - 2 * n[self.window - size]  # a full window is no longer counted
        growth[~usable] = np.iinfo(np.int64).max
        best = len(growth) - 1 - int(np.argmin(growth[::-1]))  # ties go to the fullest level
        if best:
            pieces = self.open[best].pop()
            n[best] -= 1
        else:
            pieces = []
        pieces.append((doc, start, size))
        if best + size == self.window:
            yield pieces
            return
        self.open.setdefault(best + size, []).append(pieces)
        n[best + size] += 1

    def finish(self) -> Iterator[list[Piece]]:
        """Merge the open windows by cutting the least filled into the gaps of the fullest."""
        left = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.open = {}
        self.levels[:] = 0
        low = len(left) - 1
        spare: list[Piece] = []
        for i, (fill, pieces) in enumerate(left):
            if i > low:
                break
            while fill < self.window:
                if not spare:
                    if low <= i:
                        break
                    spare = left[low][1][::-1]
                    low -= 1
                doc, start, size = spare.pop()
                cut = min(size, self.window - fill)
                pieces.append((doc, start, cut))
                fill += cut
                if cut < size:
                    spare.append((doc, start + cut, size - cut))
            if fill == self.window:
                yield pieces
            else:
                yield from self.binary(pieces)
        while spare:  # the gaps are gone before the pieces of the last dissolved window
            yield from self.binary(spare[::-1])
            spare = []

    def binary(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Windows of falling powers of two that hold these pieces without padding."""
        pieces = pieces[::-1]
        fill = sum(p[2] for p in pieces)
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill -= room
            out = []
            while room:
                doc, start, size = pieces.pop()
                cut = min(size, room)
                out.append((doc, start, cut))
                room -= cut
                if cut < size:
                    pieces.append((doc, start + cut, size - cut))
            yield out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    first = (ctx.partitionId() if ctx else 0) << 32
    code, packer, sequence = encoder(), SumOfSquares(window), 0
    waiting: dict[int, tuple] = {}  # running number -> doc_id, tokens in all, first kept, kept ids, tokens not yet given out
    end = np.array([END_ID], dtype="<u4").tobytes()
    out: list[tuple] = []

    def give(pieces: list[Piece]) -> None:
        nonlocal sequence
        at = 0
        for number, start, size in pieces:
            doc_id, total, base, ids, rest = waiting[number]
            part = ids[4 * (start - base) : 4 * (start - base + size)]
            out.append((doc_id, start, size, zlib.crc32(part), total, first + sequence, at))
            at += size
            if rest == size:
                del waiting[number]
            else:
                waiting[number] = (doc_id, total, base, ids, rest - size)
        sequence += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        out.clear()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    number = 0
    for rows in portions(batches, 1):
        for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            ids = code.ids(text.as_py()) + end
            total = len(ids) // 4
            waiting[number] = (doc_id, total, 0, ids, total)
            for pieces in packer.add(number, total):
                give(pieces)
            if total > window and number in waiting:  # only the unplaced tail stays in memory
                base = total - waiting[number][4]
                waiting[number] = (doc_id, total, base, ids[4 * base :], total - base)
            number += 1
        yield batch()
    for pieces in packer.finish():
        give(pieces)
    yield batch()
    release()


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document (doc_id long, text string): where it starts in the document's ids, its
    length and checksum, and its sequence and offset there.

    Every document ends with one end id; a null or empty text has that id only. Null and repeated doc_ids are
    packed like any other row. An empty table gives no rows. Other columns of docs are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, window), SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
