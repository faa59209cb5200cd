"""Nearest neighbours by additive quantisation.

A vector is stored as a sum of one codeword of each of ``BOOKS`` codebooks, all of full dimension. The codebooks are
fitted one after the other, by k-means on the residuals of a bounded sample of about ``TRAIN_VECTORS`` vectors. Encoding
is a beam search that carries the ``BEAM`` best partial sums from book to book. The squared norm of the sum is stored with
the codes, so a distance needs no decoding. A query's inner products with all codewords fill a lookup table, summed up for
pairs of books; a stored vector's score is the sum of ``BOOKS`` / 2 entries. Each part's ``RERANK`` best are then scored
exactly on the original vectors, in double precision.

Every vector is indexed. Of vectors that are equal, only the k + 1 rows of smallest vec_id can be among any query's
k nearest, so no more of them are kept, by a window limit that acts before the shuffle. The index is dealt out in parts of
about ``PART_ROWS`` vectors, and a copy of each query goes to each part; a task holds one part, and the queries stream past
it. Neither index nor queries ever go to the driver, and no broadcast grows with them. All queries meet all vectors, so the
work grows with the product of their numbers; the vectors of a part that are scored exactly do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, release, table

BOOKS, WORDS, BEAM = 32, 32, 4
TRAIN_VECTORS = 4096
RERANK = 256
PART_ROWS = 16_384
QUERY_ROWS = 256
K = 20


class Quantiser:
    """Codebooks of shape books x words x dimension, an even number of books; ``scale`` brings components to at most 1."""

    def __init__(self, books: np.ndarray, scale: float = 1.0):
        self.books, self.scale = books.astype(np.float32), scale

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 11, scale: float = 1.0) -> Quantiser:
        rng = np.random.default_rng(seed)
        rest, out = (x / scale).astype(np.float32), []
        words = min(words, len(x))
        for _ in range(books):
            centres = rest[rng.choice(len(rest), words, replace=False)]
            for _ in range(rounds):
                own = np.argmin((centres**2).sum(axis=1) - 2 * rest @ centres.T, axis=1)
                order = np.argsort(own, kind="stable")
                used, first = np.unique(own[order], return_index=True)
                sums = np.add.reduceat(rest[order], first, axis=0)
                centres = centres.copy()
                centres[used] = sums / np.diff(np.append(first, len(own)))[:, None]
            own = np.argmin((centres**2).sum(axis=1) - 2 * rest @ centres.T, axis=1)
            rest = rest - centres[own]
            out.append(centres)
        return cls(np.stack(out), scale)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes n x books, squared norms of their sums), by a beam search over the books."""
        n, x = len(x), (x / self.scale).astype(np.float32)
        rest = x[:, None, :]
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        at = np.arange(n)[:, None]
        for words in self.books:
            squares = (words**2).sum(axis=1)
            error = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ words.T + squares
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            path, word = best // len(words), best % len(words)
            rest = rest[at, path] - words[word]
            codes = np.concatenate([codes[at, path], word[:, :, None].astype(np.uint8)], axis=2)
        last = np.argmin((rest**2).sum(axis=2), axis=1)
        row = np.arange(n)
        return codes[row, last], ((x - rest[row, last]) ** 2).sum(axis=1)

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """The entries of the lookup table that a vector's score sums: n x books / 2."""
        return codes[:, 0::2].astype(np.intp) * self.books.shape[1] + codes[:, 1::2]

    def table(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of the queries with the sums of two codewords: queries x books / 2 x words ** 2."""
        one = np.einsum("qd,bwd->qbw", (queries / self.scale).astype(np.float32), self.books, optimize=True)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), len(self.books) // 2, -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows with a vec_id whose vector is neither null nor zero, has finite components only,
    and has the commonest length (of lengths equally common, the largest)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _encode(batches: Iterator[pa.RecordBatch], quantiser) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if not rows.num_rows:
            continue
        x = _matrix(rows.column(1))
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            codes, norms = quantiser.value.encode(part)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).slice(at, 1024), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array([v.tobytes() for v in part], pa.binary())],
                ["vec_id", "codes", "norm", "v"],
            )


def build_index(vectors: DataFrame, scratch: Scratch, k: int = K) -> tuple[DataFrame, Quantiser | None]:
    """(vec_id, codes, norm, v) for every usable vector that can be among k nearest, written to the shared folder."""
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = usable(vectors).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    rows = scratch.keep(rows, "vectors")
    n, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return rows.select("vec_id", F.lit(None).cast("binary").alias("codes"), F.lit(0).cast("float").alias("norm"), F.lit(None).cast("binary").alias("v")), None
    chance = F.pmod(F.xxhash64("vec_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < TRAIN_VECTORS / n).select("v").limit(2 * TRAIN_VECTORS).toPandas()
    if len(sample) < 2:
        sample = rows.select("v").limit(2).toPandas()
    quantiser = Quantiser.fit(np.stack(sample["v"].to_numpy()), scale=float(largest))
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)
    index = rows.repartition(max(1, -(-n // PART_ROWS))).mapInArrow(lambda it: _encode(it, sent), "vec_id long, codes binary, norm float, v binary")
    return scratch.keep(index, "index"), quantiser


def _floats(values: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


class Part:
    """A part of the index, and the search of queries in it."""

    def __init__(self, rows: list[pa.RecordBatch], quantiser: Quantiser):
        whole = pa.Table.from_batches(rows).combine_chunks()
        self.quantiser = quantiser
        self.ids = whole.column("vec_id").to_numpy()
        self.pairs = np.ascontiguousarray(quantiser.pairs(_floats(whole.column("codes").to_pylist(), np.uint8)).T)
        self.norms = whole.column("norm").to_numpy()
        self.v = _floats(whole.column("v").to_pylist(), np.float64)

    def search(self, own: np.ndarray, query: np.ndarray, k: int, rerank: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score) of the k nearest of each query among the rerank best of the quantised scores."""
        table = self.quantiser.table(query)
        score = np.zeros((len(own), len(self.ids)), dtype=np.float32)
        for m, pair in enumerate(self.pairs):
            score += table[:, m].take(pair, axis=1)
        if metric == "l2":
            score = 2 * score - self.norms
        r = min(rerank, len(self.ids))
        near = np.argpartition(-score, r - 1, axis=1)[:, :r] if r < len(self.ids) else np.tile(np.arange(r), (len(own), 1))
        with np.errstate(over="ignore", invalid="ignore"):
            x = self.v[near]
            exact = (x @ query[:, :, None])[:, :, 0] if metric == "ip" else -((x - query[:, None]) ** 2).sum(axis=2)
        found = self.ids[near]
        self_ = found == own[:, None]
        key = np.where(np.isnan(exact), -np.inf, exact)
        order = np.lexsort((found, -key, self_), axis=1)[:, :k]
        line = np.arange(len(own))[:, None]
        at, j = np.nonzero(~self_[line, order])
        return at, found[line, order][at, j], exact[line, order][at, j]


def _search(batches: Iterator[pa.RecordBatch], quantiser, k: int, rerank: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, the part's vectors before the queries."""
    number, held, part = None, [], None
    for rows in batches:
        parts, asked = rows.column("part").to_numpy(), rows.column("asked").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
            if a == b:
                continue
            if parts[a] != number:
                number, held, part = parts[a], [], None
            if not asked[a]:
                held.append(rows.slice(a, b - a))
                continue
            if part is None and held:
                part, held = Part(held, quantiser.value), []
            for at in range(a, b if part is not None else a, QUERY_ROWS):
                some = rows.slice(at, min(QUERY_ROWS, b - at))
                own = some.column("vec_id").to_numpy()
                place, found, score = part.search(own, _floats(some.column("v").to_pylist(), np.float64), k, rerank, metric)
                yield pa.RecordBatch.from_arrays([pa.array(own[place]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])
    part = None
    release()


def search(vectors: DataFrame, is_query: F.Column, k: int = K, rerank: int = RERANK, metric: str = "ip") -> DataFrame:
    """Each query's k nearest rows of vectors (vec_id, embedding): query_id, rank, vec_id, score; nearest first, ties to
    the smaller vec_id. metric: ``ip`` for the largest inner product, ``l2`` for the smallest distance (the score
    is the negative squared distance).

    Vectors that are null, zero or of an odd length, or hold null or non-finite components, take no part; nor do rows
    without vec_id. A query is never its own candidate: rows with its vec_id are left out. Of different vectors of one
    vec_id the smallest (component by component) asks, and each of them is a candidate. A score that overflows is infinite, one that
    is no number comes last. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "op1")
    index, quantiser = build_index(vectors, scratch, k)
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    if quantiser is not None:
        sent = vectors.sparkSession.sparkContext.broadcast(quantiser)
        n_parts = max(1, -(-index.count() // PART_ROWS))
        part = F.pmod(F.xxhash64("vec_id", F.col("v")), F.lit(n_parts)).cast("int")
        parts = index.select(part.alias("part"), F.lit(False).alias("asked"), "vec_id", "codes", "norm", "v")
        asked = usable(vectors).where(is_query).groupBy("vec_id").agg(F.min("v").alias("x"))
        asked = asked.mapInArrow(_packed, "vec_id long, v binary")
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(True).alias("asked"), "vec_id", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"), "v")
        both = parts.unionByName(asked).repartition(n_parts, "part").sortWithinPartitions("part", "asked")
        found = both.mapInArrow(lambda it: _search(it, sent, k, rerank, metric), "query_id long, vec_id long, score double")
    nan_last = F.isnan("score")
    order = Window.partitionBy("query_id").orderBy(nan_last, F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        v = [x.tobytes() for x in _matrix(rows.column(1))] if rows.num_rows else []
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(v, pa.binary())], ["vec_id", "v"])


def op1_additive_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
