"""The methods inside the corpus operators against plain versions of them, and what they must hold against: sizes beyond a
unit, hot keys, long texts, ids that are missing or repeat."""

from __future__ import annotations

import html
import itertools
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import LOWER, docs, near_copies, plain_components, words  # noqa: F401

from paperloom.llm import common, op1_additive_ann, op4_token_matrices, op5_ngram_join
from paperloom.llm import op6_html_extraction, op7_decontamination, op8_packing, op9_language_id, op10_warc

# shared parts


def test_components(spark):
    hub = [(5000, 1000 + i) for i in range(300)] + [(6000, 5000)]  # more edges than a node may bring to a join
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (50, 50), (None, 1)] + hub
    found = common.connected_components(spark.createDataFrame(pairs, "a long, b long"), common.Scratch(spark, "test"), "test")
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100, 50: 50, **dict.fromkeys([5000, 6000, *range(1000, 1300)], 1000)}


def test_spread_join(spark):
    big = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 50)] + [(99, 0)], "k long, v long")
    small = spark.createDataFrame([(0, "a", 500), *((k, "b", 1) for k in range(1, 50)), (77, "c", 0)], "k long, x string, w long")
    got = common.spread_join(big, small, "k", "w", 550)
    assert got.columns == ["k", "v", "x"] and sorted(map(tuple, got.collect())) == sorted([(0, i, "a") for i in range(500)] + [(k, k, "b") for k in range(1, 50)])


def test_partitions_follow_what_was_measured(spark):
    """A frame without statistics must not become a million partitions, and its tables can be deleted."""
    scratch = common.Scratch(spark, "test")
    scratch.keep(spark.createDataFrame([(1, "a")], "doc_id long, text string").mapInArrow(lambda it: it, "doc_id long, text string"), "t")
    assert common.partitions_for(spark, scratch.size("t"), 1 << 20) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch.paths["t"].removeprefix("file://")
    assert os.path.isdir(path)
    scratch.free("t")
    assert not os.path.exists(path)


def test_session_is_left_alone(spark, docs):  # noqa: F811
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    op8_packing.pack_documents(docs).count()
    op9_language_id.identify(docs).count()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


# op1


def test_ann_recall_beyond_the_reranked(spark):
    """20,000 vectors, of which far fewer are scored exactly: recall at 20, and exact scores, against brute force."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64)) + 0.5 * rng.normal(size=(20, 64))[rng.integers(0, 20, 20_000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    assert op1_additive_ann.RERANK * 2 < len(x) / 20
    got = op1_additive_ann.search(df, F.col("vec_id") % 100 == 0).toPandas()
    x = x.astype(float)
    hit = 0
    for q, rows in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        assert len(rows) == 20 and np.allclose(rows["score"], score[rows["vec_id"]])
        hit += len(set(rows["vec_id"]) & set(np.argsort(-score)[:20]))
    assert got["query_id"].nunique() == 200 and hit / 4000 >= 0.9


def test_ann_repeated_ids_and_huge_values(spark):
    rows = [(0, [3.0, 1.0]), (0, [2.0, 5.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1e200, 1e200]), (20, [-1e200, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op1_additive_ann.search(df, F.col("vec_id") % 20 == 0, k=4).collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert [v for v, _ in of(0)] == [20, 3, 1, 2]  # the smaller vector of id 0 asks; ties go to the smaller id
    assert np.allclose([x for _, x in of(0)], [5e300, 7e200, 2.0, 2.0])
    assert [v for v, _ in of(20)] == [3, 0, 0, 1] and of(20)[0][1] == float("inf")


# op4


def test_token_matrices_written(spark, docs, tmp_path):  # noqa: F811
    op4_token_matrices.write_matrices(docs, f"file://{tmp_path}/ids", window=128)
    one = lambda df: sorted((r["sequence_id"], bytes(r["input_ids"]), tuple(r["cu_seqlens"]), tuple(r["position_resets"])) for r in df.collect())
    back = one(spark.read.parquet(f"file://{tmp_path}/ids"))
    assert back == one(op4_token_matrices.token_matrices(docs, window=128)) and all(len(x[1]) == 256 for x in back)


def plain_best_fit_decreasing(lengths, window):
    """The fills of the rows, by looking at every open row for every part."""
    fills: list[int] = []
    for n in sorted((n % window for n in lengths if n % window), reverse=True):
        fits = [i for i, f in enumerate(fills) if f + n <= window]
        if fits:
            fills[max(fits, key=lambda i: fills[i])] += n
        else:
            fills.append(n)
    return sorted(fills + [window] * sum(n // window for n in lengths))


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_against_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(n) for n in rng.integers(0, 200, 150)] + [64, 128, 63, 1]
    rows = op4_token_matrices.best_fit_decreasing(lengths, 64)
    assert sorted(sum(n for _, _, n in row) for row in rows) == plain_best_fit_decreasing(lengths, 64)
    pieces = sorted(p for row in rows for p in row)
    for doc, length in enumerate(lengths):
        own = [(s, n) for d, s, n in pieces if d == doc]
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == length


# op5


def test_ngram_join_finds_all_links_without_the_first_step(spark, monkeypatch):
    """The matrix over all groups alone finds every link, whatever the order of the tokens."""
    none = lambda work, rows, scratch, n, percent: rows.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(op5_ngram_join, "_first_links", none)
    monkeypatch.setattr(op5_ngram_join, "token_classes", lambda rows, n: np.zeros(1 << op5_ngram_join.SKETCH_BITS, dtype=np.uint8))
    rows = [*near_copies(40, 5), (1, "a b c d"), (2, "a b c d e"), (3, "A b c d")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 75).collect()}
    assert got == plain_components(rows, 2, 75)


def test_shingles_against_plain_ones():
    rng = np.random.default_rng(11)
    alphabet = [*"abAB \n\t.é日", "  ", "\x1c", " "]
    texts = ["", None, " ", "a", "ab ba", "A\x0bb", *("".join(rng.choice(alphabet, int(k))) for k in rng.integers(0, 60, 300))]
    for n in (1, 3):
        sets = op5_ngram_join.shingle_sets([t if t is None else t.encode() for t in texts], n)
        seen: dict = {}
        for t, s in zip(texts, sets, strict=True):
            ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
            k = min(n, len(ws))
            plain = frozenset(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)) if ws else frozenset()
            assert len(plain) == len(s) and seen.setdefault(s.tobytes(), plain) == plain
        assert len(set(seen.values())) == len(seen)


def test_keep_one_of_each_keeps_different_rows_of_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "quite another text of one id"), (1, "a b c d e f g"), (None, "no id has this text"), (None, "no id has this text"), (None, "nor this one here"), (2, None), (2, None)]
    kept = op5_ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    want = [(1, "a b c d e f g"), (1, "quite another text of one id"), (0, "no id has this text"), (0, "nor this one here"), (2, ""), (2, "")]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(want)


# op6


def test_html_blocks_of_any_depth():
    """Unclosed elements, at whatever depth, neither hide what follows nor hand it their flags."""
    texts = lambda page: [b.text for b in op6_html_extraction.blocks(page)]
    flags = lambda page: [b.flags for b in op6_html_extraction.blocks(page)]
    deep = "<div class=menu>" + "<b><i>" * 400 + "x</div><p>after</p>"
    assert texts(deep) == ["x", "after"] and flags(deep)[1] == op6_html_extraction._TAG_BIT["p"]
    nested = "<div class=ad>" + "<div>" * 3000 + "x" + "</div>" * 3001 + "<p>after"
    assert texts(nested) == ["x", "after"] and flags(nested)[1] == op6_html_extraction._TAG_BIT["p"]
    for name in ("svg", "object", "iframe", "template", "noscript"):
        assert "after" in texts(f"<{name}><p>after</p>") and texts(f"<{name}>gone</{name}><p>after</p>") == ["after"]
    assert texts("<p>one<p>two<li>three<b>bold<li>four") == ["one", "two", "threebold", "four"]
    assert texts('<p title="a>b">one</p><p title="open>two</p>3 < 4 <5>') == ["one", "two", "3 < 4 <5>"]
    assert texts("<a <a " * 20_000 + "x") == [] and texts("<" * 50_000 + "<p>y")[-1] == "y"
    assert texts('<p title="' + "<a " * 20_000 + ">z</p>")[-1] == "z"


def path_score(own, steps, labels):
    return sum(own[i, c] for i, c in enumerate(labels)) + sum(steps[a, b] for a, b in itertools.pairwise(labels))


def test_html_decoding_against_all_labellings():
    rng = np.random.default_rng(13)
    for n in (1, 2, 5, 8):
        x = rng.integers(0, 2, (n, op6_html_extraction.N_FEATURES)).astype(float)
        chain = op6_html_extraction.Chain(rng.normal(size=(op6_html_extraction.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: path_score(x @ chain.weights, chain.steps, y))  # noqa: B023
        assert chain.decode(x).tolist() == list(best)


def test_html_training_follows_the_likelihood():
    """The first step of training has the signs of the gradient of the log-likelihood over all labellings."""
    rng = np.random.default_rng(14)
    k = op6_html_extraction.N_FEATURES
    pages = [(rng.integers(0, 2, (n, k)).astype(float), rng.integers(0, 2, n)) for n in (1, 3, 4)]

    def likelihood(w, s):
        total = 0.0
        for x, y in pages:
            total += path_score(x @ w, s, y) - np.log(sum(np.exp(path_score(x @ w, s, z)) for z in itertools.product((0, 1), repeat=len(y))))
        return total / len(pages)

    first = op6_html_extraction.train(pages, rounds=1, rate=1.0, penalty=0.0)
    none, still = np.zeros((k, 2)), np.zeros((2, 2))
    for i, j in ((0, 0), (3, 1), (20, 0), (60, 1)):
        w = none.copy()
        w[i, j] = 1e-4
        slope = (likelihood(w, still) - likelihood(-w, still)) / 2e-4
        assert abs(slope) < 1e-3 or np.sign(slope) == np.sign(first.weights[i, j])
    for i, j in itertools.product((0, 1), repeat=2):
        s = still.copy()
        s[i, j] = 1e-4
        slope = (likelihood(none, s) - likelihood(none, -s)) / 2e-4
        assert abs(slope) < 1e-3 or np.sign(slope) == np.sign(first.steps[i, j])
    better = op6_html_extraction.train(pages, rounds=30, penalty=0.0)
    assert likelihood(better.weights, better.steps) > likelihood(none, still)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no tables")
def test_html_extraction_of_the_pages_of_the_tables():
    """Pages whose labels are known: their article element holds a heading and paragraphs, and nothing else."""
    import pyarrow.parquet as pq

    chain, right, n = op6_html_extraction.trained(), 0, 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        own = re.search(r"<article>(.*?)</article>", page or "", re.S)
        if own is None:
            continue
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", own[1].replace("<br>", " ")))
        want = "\n".join(" ".join(html.unescape(t).split()) for t in parts if t.strip())
        right += op6_html_extraction.main_text(page, chain) == want
        n += 1
    assert n > 200 and right / n > 0.99


# op7


def test_decontamination_of_long_items_and_items_without_id(spark):
    rng = np.random.default_rng(16)
    long = words(rng, 20_000, 3000).split()
    items = [(1, " ".join(long)), (None, "q1 q2 q3 q4 q5"), (2, "same " * 3000), (None, "lonely")]
    texts = [" ".join(long[5000:9000]), "x " + " ".join(long[:12]) + " y", "a q1 q2 q3 q4 b", "same " * 50, "so lonely here", " ".join(long)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["row"]["doc_id"]: r["found"] for r in op7_decontamination.find_contamination(df, bench, window=4).collect()}
    hit = {k: sum(s["end"] - s["start"] for s in f["spans"]) for k, f in got.items()}
    assert hit == {0: 4000, 1: 12, 2: 4, 3: 50, 4: 1, 5: 20_000}
    assert [got[k]["items"] for k in range(6)] == [[1], [1], [], [2], [], [1]]
    assert [got[k]["longest"] for k in range(6)] == [4000, 12, 4, 50, 1, 20_000] and got[2]["longest_item"] is None and got[1]["longest_start"] == 1
    block = op7_decontamination.Block([(1, [w.encode() for w in long])], 10)
    assert block.ids.nbytes + sum(map(len, block.windows)) < 60 * len(long)  # linear in the item


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(17)
    for n, size in ((1, 1), (50, 2), (300, 3), (300, 1)):
        ids = rng.integers(0, size + 1, n).astype(np.int32)
        goes_on = np.append(ids[:-1] * ids[1:] > 0, False) & (rng.random(n) < 0.9)
        goes_on[-1] = False
        starts = np.flatnonzero(ids > 0)
        stop = np.flatnonzero(~goes_on)
        plain = [tuple(ids[i : stop[np.searchsorted(stop, i)] + 1].tolist()) for i in starts.tolist()]
        rank = op7_decontamination.ranks(ids, goes_on, starts)
        assert [plain[i] for i in np.argsort(rank, kind="stable")] == sorted(plain)
        assert all((plain[i] == plain[j]) == (rank[i] == rank[j]) for i in range(0, len(plain), 7) for j in range(0, len(plain), 5))


# op9


def plain_mixture(like, langs, rounds):
    """Expectation-maximisation for one document, word by word."""
    pi = {x: 1 / len(langs) for x in langs}
    for _ in range(rounds):
        sums = dict.fromkeys(langs, 0.0)
        for word in like:
            total = sum(pi[x] * word[x] for x in langs)
            for x in langs:
                sums[x] += pi[x] * word[x] / total
        pi = {x: v / len(like) for x, v in sums.items()}
    return pi, sum(np.log(sum(pi[x] * word[x] for x in langs)) for word in like)


def test_language_mixtures_against_the_plain_ones():
    rng = np.random.default_rng(18)
    model = op9_language_id.Model({x: rng.integers(0, 50, op9_language_id.BUCKETS) for x in ("aa", "bb", "cc", "dd")})
    like, _ = model.words(" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)))
    rows = [{i: float(v) for i, v in enumerate(word)} for word in like]
    for langs in ([0, 1, 2, 3], [1, 3]):
        mask = np.zeros((1, 4), dtype=np.float32)
        mask[0, langs] = 1
        pi, score = model.proportions(like, np.array([0]), mask, 6)
        want, value = plain_mixture(rows, langs, 6)
        assert all(abs(pi[0, x] - want.get(x, 0)) < 1e-4 for x in range(4)) and abs(score[0] - value) < 1e-2


def test_language_id_of_repeated_rows(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("baba dodo kiki baba", "xx"), ("schling string schlstr", "yy")] * 30)]
    df = spark.createDataFrame([*rows, *rows, (900, "Baba 7 dodo", None), (900, "Baba 7 dodo", None)], "doc_id long, text string, lang string")
    got = op9_language_id.identify(df).select("row.doc_id", "found.lang", "found.score").collect()
    assert len(got) == 122 and len({tuple(r) for r in got}) == 61 and {r["lang"] for r in got if r["doc_id"] == 900} == {"xx"}


# op10


def test_warc_copies_of_a_thousand_bytes_and_a_common_page(spark, tmp_path):
    """1000 bytes are enough for a revisit, 999 are not; a page that most rows have is joined where its rows are."""
    rows = [(1, "x" * 1000), (2, "x" * 1000), (3, "y" * 999), (4, "y" * 999), (5, "é" * 500), (6, "é" * 500), *((100 + i, "common " * 200) for i in range(120))]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string")
    op10_warc.write_warc(df, f"file://{tmp_path}/w")
    got = {int(r["record_id"].rsplit(":", 1)[1]): (r["kind"], r["refers_to"]) for r in op10_warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    alone, again = ("response", None), lambda i: ("revisit", f"urn:page:{i}")
    want = {1: again(2), 2: alone, 3: alone, 4: alone, 5: again(6), 6: alone, **{100 + i: again(219) for i in range(119)}, 219: alone}
    assert got == want
