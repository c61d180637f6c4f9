"""Cases that lie at the edge: very long texts and sets, crafted pages, repeated ids and rows, empty tables, hubs."""

import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorwright.llm import decontamination, edit_counts, html_blocks, ngram_join, packing, preferences, recurrent_lm, toxicity
from floorwright.llm import sentencepiece as sp_mod
from floorwright.llm.common import bounded
from floorwright.llm.components import components


def test_a_document_of_several_rows_holds_what_its_rows_hold(spark):
    item = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, "a b c d e f g h", 1), (1, "e f g h i j k l", 2), (2, item, 3), (3, "a b c d e f g h", 4), (1, None, 5), (None, item, 6)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(map(tuple, decontamination.containment(docs, items).collect())) == [(1, 9, 8, 8), (2, 9, 8, 8)]


def test_overlaps_of_very_large_sets_are_exact(spark):
    """Sets of 671,091 and 894,788 shingles, one within the other: exactly 75 %; one shingle less is below it."""
    large, small = 894_788, 671_091
    words = [f"{k:x}" for k in range(large + 4)]
    docs = [(1, " ".join(words)), (2, " ".join(words[: small + 4])), (3, " ".join(words[: small + 3]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, rounds=0).collect()}
    assert got == {1: (large, 1), 2: (small, 1), 3: (small - 1, 1)}  # 3 links with 2
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df.where("doc_id <> 2"), rounds=0).collect()}
    assert got == {1: 1, 3: 3}


def test_sparse_and_filled_chunks_count_alike():
    r = np.random.default_rng(0)
    for density in (0.001, 0.05, 0.6):
        x, y = r.random((40, ngram_join.CHUNK)) < density, r.random((30, ngram_join.CHUNK)) < density
        column = np.concatenate([np.nonzero(x)[1], np.nonzero(y)[1]])
        row = np.concatenate([np.nonzero(x)[0], np.nonzero(y)[0]])
        left = np.arange(len(column)) < x.sum()
        order = np.argsort(column, kind="stable")
        got = ngram_join._overlaps(column[order], row[order], left[order], 40, 30)
        assert (got.reshape(40, 30) == x.astype(int) @ y.T.astype(int)).all()


@pytest.mark.parametrize("page", ["<li><ul>" + 40_000 * "<span>" + 40_000 * "<li></li>", 60_000 * "<p><b>", 60_000 * "<td>" + 60_000 * "</b>", 50_000 * "<dd><div>"])
def test_crafted_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_blocks.blocks(page)
    assert time.process_time() - began < 20


def test_starts_close_what_they_closed_before():
    said = lambda page: [(b.text, b.path) for b in html_blocks.blocks(page)]
    assert said("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == [("a", ("ul", "li")), ("b", ("ul", "li")), ("c", ("ul", "li", "ul", "li")), ("d", ("ul", "li"))]
    assert said("<p>a<div>b</div><p>c<p>d") == [("a", ("p",)), ("b", ("div",)), ("c", ("p",)), ("d", ("p",))]
    assert said("<table><tr><td>a<td>b<tr><th>c</table>") == [("a", ("table", "tr", "td")), ("b", ("table", "tr", "td")), ("c", ("table", "tr", "tr", "th"))]


def test_language_model_reads_a_very_long_text_beside_short_ones():
    config = recurrent_lm.LanguageModelConfig()
    texts = [b"w%d " % (k % 50) * 20 for k in range(400)]
    hashes, heads, _ = recurrent_lm._tokens(texts, config)
    h, n = np.unique(hashes, return_counts=True)
    zeros = np.zeros(config.heads)
    vocab = recurrent_lm.Vocabulary(h, np.arange(len(h), dtype=np.int32), np.zeros(len(h)), np.log10((n + 1) / (n.sum() + len(h) + 1)), zeros, np.log10(n.sum() + len(h) + 1), n.astype(float), zeros + 1, int(n.sum()))
    weights = recurrent_lm.Network(vocab, config).weights
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = recurrent_lm.score_texts([b"w1 w2 w3 w4 w5 " * 200_000, *texts], vocab, config, weights)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes
    alone = recurrent_lm.score_texts(texts, vocab, config, weights)
    assert found["n_tokens"][0] == 1_000_001 and np.allclose(found["score"][1:], alone["score"], rtol=1e-4)


def test_samples_are_bounded_by_rows(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("page_id"), F.concat(F.lit("x"), F.col("id") % 70).alias("html"))
    rows = rows.unionByName(rows)
    key = F.xxhash64("page_id", "html")
    assert bounded(rows, key, 50).count() == 50 and bounded(rows, key, 50).distinct().count() == 50
    assert bounded(rows, key, 10_000).count() == rows.distinct().count() and bounded(rows.limit(0), key, 5).count() == 0


def test_components_of_a_hub(spark):
    edges = spark.range(20_000).select(F.lit(7).cast("long").alias("a"), (F.col("id") + 100).alias("b")).unionByName(spark.createDataFrame([(50, 101), (50, 51), (3, 4), (5, 5), (None, 1)], "a long, b long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert len(got) == 20_005 and set(got.values()) == {7, 3} and got[50] == got[51] == 7 and got[4] == 3


def test_packing_of_odd_tables(spark, tmp_path):
    config = packing.PackingConfig(length=32)
    none = spark.createDataFrame([], "doc_id long, text string, ids binary")
    assert packing.pack(none, config).count() == 0
    rows = [(1, "one two three " * 30, b"x"), (1, "one two three " * 30, b"x"), (None, "four five", b"y"), (2, None, None), (3, "", None)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids binary").repartition(1), config)
    packing.write_packed(packed, str(tmp_path / "packed"))
    again = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert sum(r.n_tokens for r in again) == sum(r.n_tokens for r in packed.collect())
    docs = [d for r in again for d in r.doc_ids]
    assert set(docs) == {1, None} and all(r.cu_seqlens[-1] == r.n_tokens for r in again)
    assert sum(r.n_tokens for r in again) > 0.9 * 32 * (len(again) - 1)  # all but the last row are nearly full


def test_queries_of_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score double, piece_ids string")
    assert sp_mod.digests(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 0
    again = spark.createDataFrame([(1, "a b", 0.5, "x"), (1, "a b", 0.5, "x"), (None, None, None, None)], docs.schema)
    assert sorted(r.score for r in toxicity.classify(again, labels).collect()) == [0.0, 0.0, 0.0]
    long = spark.createDataFrame([(1, "é" * 160_000, None, None), (2, "▁", None, None)], docs.schema)
    assert {r.doc_id: r.round_trip for r in sp_mod.digests(long).collect()} == {1: True, 2: True}


def test_preferences_of_long_conversations_and_clashing_columns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}", "x", 1) for t in range(3000)]
    rows += [(0, t, ("user", "assistant")[t % 2], f"other {t}", "x", 1) for t in range(4)] + rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, prompt string, side int")
    got = {r.pair_id: r for r in preferences.format_pairs(preferences.swapped_pairs(df)).collect()}
    assert set(got) == {0, 1} and got[1].prompt_turns == 2999 and "turn 2999" in got[1].chosen and "other 3" in got[1].rejected
    (start, end) = got[1].chosen_spans[0]
    assert got[1].chosen[start:end].startswith("turn 2999")


def test_token_counts_of_odd_tables(spark):
    kind = "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens string"
    rows = [(1, "some words here", None, "x"), (1, "some words here", None, "x"), (2, None, [None, (None, None, None)], None), (3, "abc", [(0, 99, None), (5, 1, "new text")], None), (None, "", [], None)]
    df = spark.createDataFrame(rows, kind)
    got = sorted(map(repr, (tuple(r)[:3] for r in edit_counts.count_tokens(df).collect())))
    plain = {t: edit_counts.count_tokens(spark.createDataFrame([(0, t, None, None)], kind)).first().n_tokens for t in ("some words here", "abc", "new text")}
    assert got == sorted(map(repr, [(1, plain["some words here"], plain["some words here"])] * 2 + [(2, 0, 0), (3, plain["abc"], plain["new text"]), (None, 0, 0)]))
    assert edit_counts.count_tokens(df.limit(0)).count() == 0
