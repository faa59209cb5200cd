"""Exact Jaccard join of word n-gram sets by a token-group matrix.

A token is the 64-bit hash of a shingle. All tokens are put into one order: first by the (logarithmic) count of their
bucket in a sketch of ``2**SKETCH_BITS`` counters over the whole corpus, so that common tokens come last, then by hash.
The prefix of a set of size s is its first s - ceil(t * s) + l(s) tokens with l(s) = 1 + floor((1 - t) * s / 8); two sets at the
threshold t share the lesser of their two l(s) tokens of their prefixes at least, whatever the order. The sketch decides only how
often sets that are not similar meet.

1. Texts with equal sets are collapsed to their smallest doc_id by a map-side minimum, so exact copies never meet again.
   Tokens that stand in one set's prefix only are dropped, and with them all sets that can have no partner; that takes one
   shuffle of the prefixes. Tokens whose counter says that they may be hot are dealt out for it, and kept.
2. Similar sets are dealt into groups: a set's home are the two commonest tokens of its prefix. A home is searched in units of
   bounded size, the heads of its units' clusters once more, for up to ``LEVELS`` levels. Inside a unit a small dense
   token-group matrix bounds the overlap of a set with each token group, and only groups that can qualify are opened.
   Clusters of linked sets, and sets without a link, are the groups of the next step.
3. The token-group matrix of the corpus holds, for each token and group, the union of the members' prefixes: a row
   (token, group) with the range of the sizes of its members and the largest number of tokens that any of them has from
   that token on. Two sets at the threshold share a first token, from which on both have at least t / (1 + t) times the
   sum of their sizes; the matrix bounds that for every two groups that share a token. For those that reach it, the smaller
   group asks the larger: the number of tokens that the matrix has for both bounds the overlap of any two members, since what
   they share outside their prefixes is at most the longer rest. Only groups that reach this bound, too, are opened: the sets
   of the asking groups are compared, exactly, with the members, in units of bounded size.

Steps 1 and 3 together find every link between different groups, so the components are exact, up to collisions of
64-bit hashes. Nothing of the corpus goes to the driver but the sketch, one byte a counter.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, connected_components, partitions_for, portions, release, spread_join, table

SKETCH_BITS = 22
CHUNK_BITS = 14
#: Bounds of a unit: sets, shingles, and cells of its matrix.
UNIT_DOCS = 512
UNIT_SHINGLES = 2_000_000
UNIT_CELLS = 64_000_000
LEVELS = 3
#: Members by which a cluster of one unit meets those of other units.
KEPT = 8
TOKEN_GROUP = 16
#: Parts that the sets of a token that may be hot are dealt out to.
SALTS = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_ODD = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A 64-bit number for each byte."""
    return np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, made as far as a text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(max(n, 1 << 16), _ODD, dtype=np.uint64)
            back = np.full(len(base), pow(_ODD, -1, 2**64), dtype=np.uint64)
            base[0] = back[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(back)
        return self.up[:n], self.down


@functools.lru_cache(maxsize=1)
def _powers() -> _Powers:
    return _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts, number of the first word of each text, and the number of words). A word's
    hash is a polynomial in its bytes, read off the running sum over all bytes."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(joined.translate(_LOWER), dtype=np.uint8)
    up, down = _powers().to(len(data))
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last byte is blank, so every word ends
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_letters()[data] * up)])
    hashes = _mix((total[end] - total[start]) * down[start])
    places = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return hashes, np.searchsorted(start, places)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens that two sets have in common."""
    both = np.sort(np.concatenate([x, y]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = _shared(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of its whole word sequence if it has fewer words."""
    words, first = word_hashes(texts)

    def rolled(h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            out = _mix(out + h[i : len(h) - size + 1 + i])
        return out

    whole = rolled(words, n) if len(words) >= n else None
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(_distinct(whole[a : b - n + 1]))
        else:
            out.append(rolled(words[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64))
    return out


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    return shingle_sets([text], n)[0]


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    shift = np.uint64(64 - SKETCH_BITS)
    for rows in portions(batches, 1):
        sets = [s for s in shingle_sets(rows.column(1).to_pylist(), n) if len(s)]
        if sets:
            counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=len(counts)).astype(np.uint32)
    parts = counts.reshape(-1, 1 << CHUNK_BITS)
    used = [i for i, part in enumerate(parts) if part.any()]
    packed = [zlib.compress(parts[i].tobytes(), 1) for i in used]
    release()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for rows in batches:
        for chunk, packed in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            n = total.setdefault(chunk, np.zeros(1 << CHUNK_BITS, dtype=np.int64))
            n += np.frombuffer(zlib.decompress(packed), dtype=np.uint32)
    logs = [np.frexp(n.astype(np.float64))[1].astype(np.uint8).tobytes() for n in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(logs, pa.binary())], ["chunk", "counts"])


def token_classes(rows: DataFrame, n: int) -> np.ndarray:
    """The logarithm of each sketch counter, over every text of rows (id, text binary); 2**SKETCH_BITS bytes."""
    parts = rows.mapInArrow(lambda it: _count(it, n), "chunk long, counts binary").repartition("chunk")
    out = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), dtype=np.uint8)
    for r in parts.mapInArrow(_classes, "chunk long, counts binary").collect():  # one row a chunk
        out[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.reshape(-1)


def hot_class(classes: np.ndarray) -> int:
    """The class from which on a counter may hold a HOT_KEYS-th of all tokens; at most about HOT_KEYS counters reach it."""
    sizes = np.ldexp(1.0, np.arange(64))
    total = float((np.bincount(classes, minlength=64)[:64] * sizes).sum()) / 2
    return int(np.log2(max(64.0, total / HOT_KEYS))) + 1


def prefix(shingles: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set in the order of all tokens."""
    size = len(shingles)
    keep = min(size, size + 1 + -percent * size // 100 + (100 - percent) * size // 800) if size else 0
    key = classes[shingles >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | shingles >> np.uint64(8)
    return shingles[np.argsort(key, kind="stable")[:keep]]


def _profile(batches: Iterator[pa.RecordBatch], n: int, percent: int, classes) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_key", "prefix", "cold"]
    hot = hot_class(classes.value)
    for rows in portions(batches, 1):
        sets = shingle_sets(rows.column(1).to_pylist(), n)
        keys = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets]
        first = [prefix(s, classes.value, percent) for s in sets]
        cold = [int(np.count_nonzero(classes.value[t >> np.uint64(64 - SKETCH_BITS)] < hot)) for t in first]  # the hot ones come last
        first = [t.view(np.int64) for t in first]
        ends = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
        flat = pa.array(np.concatenate(first) if first else np.empty(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, flat), pa.array(cold, pa.int32())], names)
    release()


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def links_of(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) with 100 * intersection >= percent * union, enough of them to connect every linked pair of sets. Its
    matrix takes at most a byte for each token and set."""
    if len(sets) <= 3:  # too few for a matrix to pay
        return [(i, j) for i in range(len(sets)) for j in range(i) if _linked(sets[i], sets[j], percent)]
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    local = np.split(flat, np.cumsum([len(s) for s in sets])[:-1])
    parts, found = UnionFind(len(sets)), []
    matrix = np.zeros((8, len(tokens)), dtype=bool)  # token group x token
    members: list[list[int]] = []
    smallest: list[int] = []
    home: dict[int, int] = {}
    mark = np.zeros(len(tokens), dtype=bool)
    for q in order:
        size = len(local[q])
        bound = matrix[: len(members), local[q]].sum(axis=1, dtype=np.int64)
        # the overlap of a pair at the threshold is at least percent / (100 + percent) of the sum of its sizes
        need = (percent * (size + np.array(smallest, dtype=np.int64)) + 99 + percent) // (100 + percent)
        mark[local[q]] = True
        first = None
        for g in np.argsort(-bound, kind="stable"):
            if bound[g] < need[g]:
                continue
            for m in members[g]:
                if parts.find(m) == parts.find(q) or 100 * len(local[m]) < percent * size:
                    continue
                both = int(np.count_nonzero(mark[local[m]]))
                if 100 * both >= percent * (size + len(local[m]) - both):
                    parts.join(q, m)
                    found.append((q, m))
                    first = m if first is None else first
        mark[local[q]] = False
        g = home.get(first, -1)
        if g < 0 or len(members[g]) >= TOKEN_GROUP:
            g = len(members)
            members.append([])
            smallest.append(size)
            if g == len(matrix):
                matrix = np.concatenate([matrix, np.zeros_like(matrix)])
        members[g].append(q)
        home[q] = g
        matrix[g, local[q]] = True
    return found


def _heads(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, rep, text) come sorted by unit, a bounded set of documents. Gives (a, b, kept): each set's link to the smallest
    of its cluster in the unit; kept are that and KEPT - 1 others of a cluster."""
    unit, held = None, []

    def solve() -> pa.RecordBatch:
        seen = list(dict.fromkeys(held))
        pairs = links_of(shingle_sets([t for _, t in seen], n), percent) if len(seen) > 1 else []
        parts = UnionFind(len(seen))
        for i, j in pairs:
            parts.join(i, j)
        low: dict[int, int] = {}
        for i, (rep, _) in enumerate(seen):
            root = parts.find(i)
            low[root] = min(rep, low.get(root, rep))
        ends = sorted({(rep, low[parts.find(i)]) for i, (rep, _) in enumerate(seen) if rep != low[parts.find(i)]}, key=lambda e: (e[0] * _ODD) % 2**64)
        count: dict[int, int] = {}
        kept = []
        for _, b in ends:
            count[b] = count.get(b, 0) + 1
            kept.append(count[b] < KEPT)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends], pa.int64()), pa.array([b for _, b in ends], pa.int64()), pa.array(kept, pa.bool_())], ["a", "b", "kept"])

    for rows in portions(batches, 2):
        for u, rep, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if u != unit and held:
                yield solve()
                held.clear()
            unit = u
            held.append((rep, text))
    if held:
        yield solve()
    held.clear()
    release()


def _open(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, asks, grp, rep, text) come sorted by unit, the opened group's members before the sets that ask. Gives (a, b):
    a set that asks and a member it is linked with, once for each asking group and unit."""
    unit, members, flat, starts, sizes, done = None, [], None, None, None, set()
    names = ["a", "b"]
    for rows in portions(batches, 4):
        found = []
        sets = shingle_sets(rows.column(4).to_pylist(), n)
        for u, asks, grp, rep, tokens in zip(*(rows.column(i).to_pylist() for i in range(4)), sets, strict=True):
            if u != unit:
                unit, members, flat, done = u, [], None, set()
            if not asks:
                if len(tokens):
                    members.append((rep, tokens))
                continue
            if not members or not len(tokens) or grp in done:
                continue
            if flat is None:
                flat = np.concatenate([t for _, t in members])
                sizes = np.array([len(t) for _, t in members])
                starts = np.cumsum(sizes) - sizes
            at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
            both = np.add.reduceat(tokens[at] == flat, starts, dtype=np.int64)
            good = np.flatnonzero(100 * both >= percent * (len(tokens) + sizes - both))
            if len(good):
                found.append((rep, members[int(good[0])][0]))
                done.add(grp)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names)
    members.clear()
    flat = None
    release()


def _can_link(percent: int, size_a, size_b, rest_a, rest_b) -> Column:
    """Whether sets of these sizes (for groups: whose members' sizes reach from the first to the second) can be at the
    threshold if their first common token has rest_a and rest_b tokens from it on."""
    (low_a, high_a), (low_b, high_b) = size_a, size_b
    sizes = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return sizes & ((100 + percent) * F.least(rest_a, rest_b) >= percent * (low_a + low_b))


def _first_links(work: DataFrame, rows: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Links that tie the sets of a home together as far as they are found alike. work: (w, rep, n, r, c), c being the
    token's number of sets."""
    # a list here is a part of one set's prefix
    tops = F.slice(F.sort_array(F.collect_list(F.struct("c", F.xxhash64("w").alias("h"), "w")), asc=False), 1, 2)["w"]
    state = scratch.keep(work.groupBy("rep").agg(F.xxhash64(F.sort_array(tops)).alias("home"), F.max("n").alias("n")), "state")
    links = None
    for level in range(LEVELS):
        totals = state.groupBy("home").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
        blocks = F.greatest(F.col("docs") / UNIT_DOCS, F.col("shingles") / UNIT_SHINGLES, F.sqrt(F.col("docs") * F.col("shingles") / UNIT_CELLS))
        totals = scratch.keep(totals.select("home", "docs", F.ceil(blocks).cast("long").alias("blocks")), f"homes-{level}")
        placed = spread_join(state, totals, "home", "docs", state.count())
        block = F.pmod(F.xxhash64("rep", F.lit(level)), "blocks")
        placed = scratch.keep(placed.select("rep", "home", "n", "blocks", F.xxhash64("home", block, F.lit(level)).alias("unit")), f"placed-{level}")
        texts = scratch.keep(rows.withColumnRenamed("doc_id", "rep").join(scratch.small(f"placed-{level}", placed.select("rep", "unit")), "rep").select("unit", "rep", "text"), f"texts-{level}")
        parts = partitions_for(texts.sparkSession, scratch.size(f"texts-{level}"), 8 << 20)
        dealt = texts.repartition(parts, "unit").sortWithinPartitions("unit")
        found = scratch.keep(dealt.mapInArrow(lambda it: _heads(it, n, percent), "a long, b long, kept boolean"), f"heads-{level}")
        scratch.free(f"texts-{level}")
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        more = placed.where("blocks > 1")
        if more.isEmpty():
            break
        state = scratch.keep(more.join(found.where("not kept").select(F.col("a").alias("rep")).distinct(), "rep", "left_anti").select("rep", "home", "n"), "state")
    return links


def _other_links(work: DataFrame, links: DataFrame, rows: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Links that, with those given, connect all sets that are linked. The groups are the components of the links given."""
    spark = rows.sparkSession
    groups = scratch.keep(connected_components(links, scratch, "op5-groups").withColumnsRenamed({"node": "rep", "root": "grp"}), "groups")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"), F.count("*").alias("w"))
    groups = scratch.keep(spread_join(groups, sizes, "grp", "w", groups.count()), "sized")
    placed = work.join(groups, "rep", "left").select("w", F.coalesce("grp", "rep").alias("grp"), "rep", "n", "r", F.coalesce("members", F.lit(1)).alias("members"))
    work = scratch.keep(placed, "work")
    matrix = work.groupBy("w", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("r").alias("rest"), F.max("members").alias("members"))
    matrix = scratch.keep(matrix, "matrix")
    shared = scratch.keep(matrix.groupBy("w").agg(F.count("*").alias("groups")).where("groups > 1"), "shared")
    cells = scratch.keep(spread_join(matrix, shared, "w", "groups", matrix.count()), "cells")
    # first bound: what two groups can have from a shared token on
    a, b = cells.alias("a"), cells.alias("b")
    able = _can_link(percent, (F.col("a.low"), F.col("a.high")), (F.col("b.low"), F.col("b.high")), F.col("a.rest"), F.col("b.rest"))
    smaller = F.struct("a.members", "a.grp") < F.struct("b.members", "b.grp")
    met = a.join(b, (F.col("a.w") == F.col("b.w")) & smaller & able).select(F.col("a.grp").alias("q"), F.col("b.grp").alias("g")).distinct()
    met = scratch.keep(met, "met")
    # second bound: c shared tokens, and at most the longer rest of the two sets outside their prefixes
    asked = met.join(cells.select("w", F.col("grp").alias("q"), F.col("low").alias("low_q"), F.col("high").alias("high_q")), "q")
    asked = asked.join(cells.select("w", F.col("grp").alias("g"), "low", "high"), ["w", "g"]).groupBy("q", "g")
    counts = asked.agg(F.count("*").alias("c"), F.least(F.min("low_q"), F.min("low")).alias("low"), F.greatest(F.max("high_q"), F.max("high")).alias("high"))
    t, q = percent / 100, (100 - percent) / 800
    least = t / (1 + t) * F.col("low") - (t * t / (1 + t) - q) * F.col("high")
    opened = scratch.keep(counts.where(F.col("c") + 1 >= least - 1e-6).select("q", "g"), "opened")
    # the sets that ask come to the units of the opened group
    members = scratch.keep(work.select("grp", "rep", "n").distinct(), "members")
    asking = scratch.keep(opened.join(members.withColumnRenamed("grp", "q"), "q").select("g", "q", "rep", "n"), "asking")
    room = F.greatest(F.count("*") / UNIT_DOCS, F.sum("n") / UNIT_SHINGLES)
    blocks = asking.groupBy("g").agg(F.ceil(room).cast("long").alias("q_blocks"), F.count("*").alias("n_asking"))
    own = members.withColumnRenamed("grp", "g")
    own = spread_join(own, blocks.join(own.groupBy("g").agg(F.count("*").alias("w")), "g"), "g", "w", own.count())
    own = scratch.keep(own.select("g", "rep", "n", "q_blocks", "n_asking"), "own")
    m_blocks = own.groupBy("g").agg(F.ceil(room).cast("long").alias("m_blocks"), F.max("q_blocks").alias("q_blocks"), F.max("n_asking").alias("n_asking"), F.count("*").alias("n_own"))
    m_blocks = scratch.keep(m_blocks, "blocks")
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    one = lambda blocks, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), blocks)
    held = spread_join(own.select("g", "rep"), m_blocks, "g", "n_own", own.count())
    held = held.select("g", F.lit(False).alias("asks"), F.col("g").alias("grp"), "rep", one("m_blocks", "member").alias("m"), every("q_blocks").alias("k"))
    come = spread_join(asking.select("g", "q", "rep"), m_blocks, "g", "n_asking", asking.count())
    come = come.select("g", F.lit(True).alias("asks"), F.col("q").alias("grp"), "rep", every("m_blocks").alias("m"), one("q_blocks", "asks").alias("k"))
    units = scratch.keep(held.unionByName(come).select(F.xxhash64("g", "m", "k").alias("unit"), "asks", "grp", "rep"), "units")
    texts = rows.withColumnRenamed("doc_id", "rep").join(scratch.small("units", units), "rep").select("unit", "asks", "grp", "rep", "text")
    texts = scratch.keep(texts, "unit-texts")
    dealt = texts.repartition(partitions_for(spark, scratch.size("unit-texts"), 8 << 20), "unit").sortWithinPartitions("unit", "asks")
    found = scratch.keep(dealt.mapInArrow(lambda it: _open(it, n, percent), "a long, b long"), "links")
    scratch.free("groups", "sized", "work", "matrix", "shared", "cells", "met", "opened", "members", "asking", "own", "blocks", "units", "unit-texts")
    return found


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text string). percent is from 1 to 100.

    component_id is the smallest doc_id that links reach. A null or blank text has an empty set and its own doc_id.
    Rows that repeat a doc_id are versions of one document: their links are pooled, and each row is returned. A row
    whose doc_id is null links with nothing and has a null component_id. Other columns of docs are ignored. An empty
    table gives no rows. Texts of any length are read whole. The result reads tables in scratch, which a caller that gives its
    own may clear once it has written the result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "op5")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    classes = spark.sparkContext.broadcast(token_classes(rows, n))
    shape = "doc_id long, n_shingles long, set_key binary, prefix array<long>, cold int"
    whole = scratch.keep(rows.mapInArrow(lambda it: _profile(it, n, percent, classes), shape), "prefixes")
    able = F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()
    same = whole.where(able).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.min_by(F.struct("prefix", "cold"), "doc_id").alias("x"))
    first = scratch.keep(same, "first")
    # the prefixes take most of the room: what is read later is kept without them
    profile = scratch.keep(whole.drop("prefix", "cold"), "profile")
    scratch.free("prefixes")
    usable = profile.where(able)
    # tokens of one prefix only meet nothing; the rows of a token that may be hot are dealt out and stay
    work = first.select("rep", "n", "x.cold", F.posexplode("x.prefix").alias("p", "w"))
    salt = F.when(F.col("p") >= F.col("cold"), F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    work = work.select("w", salt.alias("salt"), "rep", "n", (F.col("n") - F.col("p")).alias("r"))
    work = work.withColumn("c", F.count("*").over(Window.partitionBy("w", "salt"))).where("c > 1 or salt > 0")
    work = scratch.keep(work.select("w", "rep", "n", "r", F.when(F.col("salt") > 0, F.lit(1 << 60)).otherwise(F.col("c")).alias("c")), "play")
    reps = scratch.keep(first.select("set_key", "rep", "copies"), "reps")
    scratch.free("first")
    links = _first_links(work, rows, scratch, n, percent)
    links = links.union(_other_links(work, links, rows, scratch, n, percent))
    scratch.free("play", "state")
    # documents of one doc_id are one node; equal sets are tied to their smallest doc_id
    twice = profile.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).where("k > 1")
    if not twice.isEmpty():  # a doc_id with several sets ties their classes
        copies = usable.join(reps.select("set_key", "rep"), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
        full = connected_components(links.union(copies), scratch, "op5-repeated")
        return profile.join(full.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
        )
    merged = connected_components(links, scratch, "op5-result").withColumnRenamed("node", "rep")
    classes_of = reps.select("set_key", "rep", "copies").join(merged, "rep", "left").select("set_key", "copies", F.coalesce("root", "rep").alias("root"))
    classes_of = scratch.keep(classes_of, "classes")
    known = spread_join(usable.select("doc_id", "n_shingles", "set_key"), classes_of, "set_key", "copies", profile.count())
    rest = profile.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.select("doc_id", "n_shingles", F.col("root").alias("component_id")).unionByName(rest)


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs (doc_id, text) of each group of rows that links reach, with all its columns: the one of smallest
    doc_id (null last), then the first one.

    Links are between rows, so rows that repeat a doc_id, or have none, go only if their texts are equal or linked. A null
    or blank text links with nothing and stays. Columns of any name are kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "op5-rows")
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    inner = Scratch(docs.sparkSession, "op5")
    groups = ngram_components(numbered.select(F.col(row).alias("doc_id"), "text"), n, percent, inner).select(F.col("doc_id").alias("r"), F.col("component_id").alias("g"))
    groups = scratch.keep(groups.where(F.col("g").isNotNull()), "groups")
    inner.clear()
    sizes = groups.groupBy("g").agg(F.count("*").alias("w")).where("w > 1")
    members = spread_join(groups, sizes, "g", "w", groups.count())
    members = scratch.keep(members.join(numbered.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("id")), "r"), "members")
    first = members.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("m")).select(F.col("m.r").alias("r"))
    gone = scratch.keep(members.select("r").join(first, "r", "left_anti").withColumnRenamed("r", row), "gone")
    scratch.free("groups", "members")
    return numbered.join(scratch.small("gone", gone), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)
