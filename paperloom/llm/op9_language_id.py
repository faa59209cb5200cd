"""Language identification by multilingual mixtures.

Every word of a document is taken to come from one of the languages, with the likelihood of its letter trigrams in
that language. Expectation-maximisation gives the document's proportions of languages. The languages are then
ranked by proportion, the mixture is fitted anew to the first 1, 2, ... of them, and the set with the best
likelihood less a penalty of half the logarithm of the word count for each further language is kept.

Trigram counts are gathered by a distributed sum from a bounded sample of labelled rows: of each language about
``TRAIN_ROWS`` rows of smallest hash (all if there are fewer), with their whole texts. Prediction reads each whole
text once, without a shuffle, a portion of at most a megabyte or one longer text at a time: memory is bounded by the words of a
portion times the number of languages.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, release, table

BUCKETS = 1 << 16
TRAIN_ROWS = 3000
ROUNDS = 10
PIECE = 500_000
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for anything else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all letter trigrams, where each word's begin, where each word begins in text)."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    padded = np.concatenate([np.zeros(2, dtype=np.uint32), codes, np.zeros(1, dtype=np.uint32)])
    here, one, two = padded[2:], padded[1:-1], padded[:-2]
    at = np.flatnonzero((here > 0) | (one > 0))  # every letter, and the end of every word
    a, b, c = here[at], one[at], np.where(one[at] > 0, two[at], 0)
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(b == 0)
    return (h >> np.uint32(16)).astype(np.int64), starts, at[starts]


def pieces(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The texts, joined or cut to pieces of about PIECE characters: (piece, where its texts begin, their numbers)."""
    parts: list[str] = []
    starts: list[int] = []
    owners: list[int] = []
    size = 0

    def flush():
        nonlocal parts, starts, owners, size
        out = ("\n".join(parts), np.array(starts), np.array(owners))
        parts, starts, owners, size = [], [], [], 0
        return out

    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > PIECE:
                space = text.rfind(" ", at, at + PIECE)
                end = space if space > at else at + PIECE
            if parts and size + end - at > PIECE:
                yield flush()
            parts.append(text[at:end])
            starts.append(size)
            owners.append(i)
            size += end - at + 1
            at = end
    if parts:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for rows in portions(batches, 1):
        langs = rows.column(0).to_pylist()
        texts = rows.column(1).to_pylist()
        for lang in set(langs):
            n = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for piece, _, _ in pieces([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                n += np.bincount(trigrams(piece)[0], minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    """Log-likelihood of every trigram bucket in every learned language."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.5):
        self.langs = sorted(counts)
        table = np.array([counts[x] for x in self.langs], dtype=np.float64).reshape(len(self.langs), BUCKETS) + smoothing
        self.log = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(likelihoods of the words by language, the largest of a word being 1; where the words begin)."""
        buckets, starts, at = trigrams(text)
        if not len(starts):
            return np.empty((0, len(self.langs)), dtype=np.float32), at
        scores = np.add.reduceat(self.log[buckets], starts, axis=0)
        return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)), at

    def proportions(self, like: np.ndarray, first: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation for all documents at once. first: where each one's words begin; mask: languages
        it may use. Gives the proportions and the log-likelihoods."""
        sizes = np.diff(np.append(first, len(like)))
        of = np.repeat(np.arange(len(first)), sizes)
        pi = (mask / mask.sum(axis=1, keepdims=True)).astype(np.float32)
        for _ in range(rounds):
            part = like * pi[of]
            part /= part.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(part, first, axis=0) / sizes[:, None].astype(np.float32)
            pi *= mask
        total = np.einsum("ij,ij->i", like, pi[of]).astype(np.float64)
        return pi, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        """(language, its proportion, the set of languages, their proportions) for each text."""
        none = (UNDETERMINED, 0.0, [], [])
        out = [none] * len(texts)
        if not self.langs:
            return out
        like, owner = [], []
        for piece, starts, owners in pieces(texts):
            l, at = self.words(piece)
            like.append(l)
            owner.append(owners[np.searchsorted(starts, at, side="right") - 1])
        if not like or not sum(map(len, like)):
            return out
        like, owner = np.concatenate(like), np.concatenate(owner)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        who, sizes = owner[first], np.diff(np.append(first, len(owner)))
        pi, _ = self.proportions(like, first, np.ones((len(first), len(self.langs)), dtype=np.float32))
        rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
        best, score = self.proportions(like, first, (rank < 1).astype(np.float32), 1)
        for k in range(2, len(self.langs) + 1):
            # the likeliest language of each word has 1, so no log-likelihood exceeds 0 and the penalty bounds what k languages can reach
            open_ = np.flatnonzero(score < -0.5 * (k - 1) * np.log(sizes + 1))
            if not len(open_):
                break
            n, keep = sizes[open_], np.zeros(len(sizes), dtype=bool)
            keep[open_] = True
            some = like[np.repeat(keep, sizes)]
            fit, fitted = self.proportions(some, np.cumsum(n) - n, (rank[open_] < k).astype(np.float32), ROUNDS // 2)
            fitted -= 0.5 * (k - 1) * np.log(n + 1)
            better = fitted > score[open_]
            best[open_[better]], score[open_[better]] = fit[better], fitted[better]
        for row, i in zip(best, who, strict=True):
            order = [int(x) for x in np.argsort(-row, kind="stable") if row[x] > 0]
            share = row / row.sum()
            out[i] = (self.langs[order[0]], min(1.0, float(share[order[0]])), [self.langs[x] for x in order], [float(share[x]) for x in order])
        return out


def held_out(doc_id: F.Column) -> F.Column:
    """True for the rows that training must not see; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and lang of the rows of docs that are not held out and have both. Only counts reach the driver:
    at most BUCKETS for each language."""
    known = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(chance < part[F.col("lang")]).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = sample.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {lang: np.zeros(BUCKETS) for lang in sizes}
    for r in found.toLocalIterator():
        counts[r["lang"]][r["bucket"]] = r["n"]
    return Model({k: v for k, v in counts.items() if v.any()})


_TYPE = "lang string, score double, langs array<string>, shares array<double>"


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for some in portions(batches, 1):
        out = [dict(zip(("lang", "score", "langs", "shares"), x, strict=True)) for x in model.value.predict(some.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, type=some.schema.field(2).type)], ["row", "found"])
    release()


def identify(docs: DataFrame, keep: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, found): each row of docs (doc_id, text, lang), or its columns ``keep``, as a struct, with the language,
    its share, and the set of languages with their shares.

    A null text, or one without a letter, is ``und`` with score 0 and an empty set; so is every text if nothing was
    learned. Equal shares go to the language that sorts first. Rows with a null lang are not learned from.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    shaped = docs.select(kept, F.col("text").cast("string").alias("text"), F.lit(None).cast(f"struct<{_TYPE.replace(' ', ':').replace(',:', ', ')}>").alias("found"))
    out = shaped.select("row", "found").schema
    return shaped.mapInArrow(lambda it: _predict(it, sent), out)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.langs").alias("langs"),
        F.col("found.shares").alias("shares"),
    )
