"""Each stage of the corpus pipeline, and all of them, against plain versions."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_llm import ODD, linked, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, toxic_score int"
BAD = ["scumlord", "idiotic", "pathetic", "worthless", "moronic"]


def make():
    """Rows, labels and items: clean texts, toxic ones, copies and near copies, leaks, repeated rows, nulls."""
    r = random.Random(11)
    vocab = ["".join(r.choice(["the", "an", "er", "on", "th", "re", "ing", "ed"]) for _ in range(3)) + str(r.randrange(10)) for _ in range(900)]
    texts = [[r.choice(vocab) for _ in range(r.randrange(20, 90))] for _ in range(260)]
    toxic = list(range(0, 260, 7))
    for i in toxic:
        for _ in range(8):
            texts[i].insert(r.randrange(len(texts[i])), r.choice(BAD))
    items = [" ".join(r.choice(vocab) for _ in range(12)) for _ in range(5)]
    for k, i in enumerate((1, 2, 3, 4, 5)):
        texts[i][5:5] = items[k].upper().split()
    for i in range(20, 40):  # near copies of one text
        texts[i] = list(texts[19])
        texts[i][r.randrange(len(texts[i]))] = f"x{i}"
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(50, "another text under an id that is there already"), rows[51], (None, rows[52][1]), (None, "a text without any id at all")]
    full = [(i, t, "en", f"s{k % 3}", k, "clash", 1) for k, (i, t) in enumerate(rows)]
    return full, [(i, int(i in set(toxic))) for i in range(260)], list(enumerate(items))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = make()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_copies(rows):
    """Of each group the row of the least doc_id; of rows with the same doc_id and text the least."""
    once = {}
    for row in rows:
        k = row[:2]
        once[k] = min(once.get(k, row), row, key=lambda x: x[2:])
    own = list(once.values())
    group = [c for _, c in linked([x[1] for x in own])]
    best = {}
    for i, c in enumerate(group):
        best.setdefault(c, []).append(own[i])
    return [min(v, key=lambda x: (x[0] is None, x[0] or 0)) for v in best.values()]


def holds(text, items):
    return any(len(shingles(text) & shingles(t)) * 100 >= 75 * len(shingles(t)) for _, t in items)


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)


def test_near_duplicates_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = cp.near_duplicates(spark, docs, tables)
    assert out.columns == docs.columns
    same(out, plain_copies(make()[0]))


def test_decontamination_stage(spark, tables):
    rows, _, items = make()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    same(cp.decontamination(spark, docs, tables), [x for x in rows if not holds(x[1], items)])


def test_toxicity_stage(spark, tables):
    rows, labels, _ = make()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [tuple(x) for x in cp.toxicity(spark, docs, tables).collect()]
    assert set(out) <= set(rows)
    clean = [x for x in rows if not any(b in (x[1] or "") for b in BAD)]
    assert len([x for x in clean if x in set(out)]) >= 0.97 * len(clean)
    bad = [x for x in rows if any(b in (x[1] or "") for b in BAD)]
    assert len([x for x in bad if x not in set(out)]) >= 0.8 * len(bad)


def test_encoding_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    for x in cp.encoding(spark, docs, tables).collect():
        assert list(x.piece_ids) == sp.encode(x.text or "") and x.n_pieces == len(x.piece_ids)


def test_stages_on_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_run_chains_the_stages(spark, tables):
    _, _, items = make()
    kept = [tuple(x) for x in cp.toxicity(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).collect()]
    want = sorted((x for x in plain_copies(kept) if not holds(x[1], items)), key=repr)
    got = cp.run(spark, tables)
    assert got.columns[-2:] == ["piece_ids", "n_pieces"]
    same(got.drop("piece_ids", "n_pieces"), want)
    assert got.where(F.col("n_pieces") == 0).count() == sum(not (x[1] or "").strip() and not x[1] for x in want)
