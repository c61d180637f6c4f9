"""The operators do the whole job: no text, label or page is left out where the input is large or uneven."""

from dataclasses import replace

import numpy as np

from floorwright.llm import decontamination, html_blocks, nn_descent, recurrent_lm
from floorwright.llm import sentencepiece as sp_mod


def test_language_model_fits_on_all_texts_at_any_size(spark):
    rows = [(k if k % 5 else None, " ".join(f"t{k}x{j}" for j in range(6))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    config = recurrent_lm.LanguageModelConfig(hot=256, held=300)
    vocab = recurrent_lm.vocabulary(recurrent_lm.word_counts(docs, config), config)
    before = recurrent_lm.Network(vocab, config).weights["emb"]
    for tokens in (vocab.tokens, 64_000_000):  # as if the same texts were a small and a large corpus
        after = recurrent_lm.fit(docs, replace(vocab, tokens=tokens), config)["emb"]
        read = recurrent_lm._ids(*recurrent_lm._tokens([t.encode() for _, t in rows], config)[:2], vocab)[0]
        assert (abs(after - before)[read].max(1) > 1e-6).all()


def _small_and_hot():
    """A hot label with a dense cloud, and 200 labels of two pairs each at a cosine of about 0.935."""
    r = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, cloud = unit(r.standard_normal((400, 32))), unit(r.standard_normal(32) + 0.02 * r.standard_normal((300, 32)))
    side = r.standard_normal((400, 32))
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.935 * a + np.sqrt(1 - 0.935**2) * side, cloud, unit(r.standard_normal((6000, 32)))])
    return x, [1 + k % 200 for k in range(800)] + [0] * 6300


def test_nn_descent_small_labels_beside_a_hot_one(spark):
    x, labels = _small_and_hot()
    df = spark.createDataFrame([(k, v.tolist(), lab) for k, (v, lab) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: g.n_links for g in nn_descent.near_duplicates(df, nn_descent.DescentConfig(leaf=4)).collect()}
    assert sum(got[k] == 0 for k in range(800)) == 0


def test_nn_descent_compares_all_where_the_audit_fails(spark, monkeypatch):
    x, labels = _small_and_hot()
    x, labels = x[:1200], labels[:1200]
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: 0.0)
    df = spark.createDataFrame([(k, v.tolist(), lab) for k, (v, lab) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: (g.n_links, g.component_id) for g in nn_descent.near_duplicates(df, nn_descent.DescentConfig(attempts=1, rounds=0, neighbours=1, leaf=1, whole=64)).collect()}
    lab = np.array(labels)
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    first = np.arange(len(x))
    for _ in range(50):
        first = np.where(hit, first[None, :], len(x)).min(1)
    assert got == {k: (int(n), int(c)) for k, (n, c) in enumerate(zip(hit.sum(1) - 1, first, strict=True))}


def test_html_blocks_keep_what_is_shown():
    said = lambda page: [b.text for b in html_blocks.blocks(page)]
    for attr in ('class="overflow-hidden"', 'class="hidden-xs"', 'id="hidden-valley"', 'aria-label="Hidden gems"'):
        assert said(f"<body><div {attr}><p>the article</p></div>") == ["the article"]
    assert said('<div hidden><p>gone</p></div><div style="display:none">gone</div><p>shown') == ["shown"]
    assert said("<html><head><meta charset=utf-8><title>T</title><body><p>text</p></body></html>") == ["text"]
    assert said("<html><head><title>T</title><h1>text</h1>more") == ["text", "more"]


def test_forward_states_are_shared_by_prefixes():
    own = sp_mod.Pieces.load()
    words = sorted({sp_mod.MARK + w for w in ("interesting", "interested", "internal", "in", "übergang", "über", "xyz☃z")})
    held = {w: list(states) for w, states in own.forward(words)}
    a, b = held[sp_mod.MARK + "interested"], held[sp_mod.MARK + "interesting"]
    assert all(x is y for x, y in zip(a[: len("interest") + 2], b, strict=False))
    for w, states in held.items():
        assert len(states) == len(w) + 1
        for end, (score, piece, before) in enumerate(states[1:], 1):
            assert w[:end].endswith(piece) and before is states[end - len(piece)]
            assert score == before[0] + own.ranks.get(piece, own.least)


def test_decontamination_by_shuffle_equals_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate((3, 6, 20, 90))], "item_id long, text string")
    texts = [" ".join([*[f"x{d}y{k}" for k in range(d)], *[f"i{d % 4}w{k}" for k in range((3, 6, 20, 90)[d % 4])]]) for d in range(24)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)] + [(1, "another text"), (7, None)], "doc_id long, text string")
    want = sorted(map(tuple, decontamination.containment(docs, items).collect()))
    assert {(d, i) for d, i, *_ in want} == {(d, d % 4) for d in range(24) if d % 4 or d == 0}
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, decontamination.containment(docs, items).collect())) == want


def test_language_model_scores_equal_a_plain_forward_pass(spark):
    rows = [(k, " ".join(f"t{(k * j) % 11}" for j in range(3 + k % 40))) for k in range(60)] + [(100, "t1 t2 " * 400), (101, None), (None, "t3 new"), (102, "t3 new"), (102, "t3 new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    config = recurrent_lm.LanguageModelConfig(hot=8, per_class=4, held=10, heads=4, width=6)
    out = {r.doc_id: r for r in recurrent_lm.score_documents(docs, config).collect()}
    train = docs.where(~recurrent_lm.held_out(config))
    counts = recurrent_lm.word_counts(train, config)
    vocab = recurrent_lm.vocabulary(counts, config)
    w = recurrent_lm.fit(train, vocab, config)
    known = {r.h: r.n for r in counts.collect()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v - np.log(np.exp(v - v.max()).sum()) - v.max()
    net, n = recurrent_lm.Network(vocab, config, w), config.width
    for doc, text in rows:
        hashes, heads, _ = recurrent_lm._tokens([(text or "").encode()], config)
        ids = recurrent_lm._ids(hashes, heads, vocab)[0]
        h, before, total = np.zeros(n), int(recurrent_lm._ids(np.array([recurrent_lm.END]), np.zeros(1, np.int64), vocab)[0][0]), 0.0
        for i, x, head in zip(ids, hashes, heads, strict=True):
            pre, hw = w["emb"][before] @ w["wx"] + w["b"], h @ w["wh"]
            z, r = sig(pre[:n] + hw[:n]), sig(pre[n : 2 * n] + hw[n : 2 * n])
            h = (1 - z) * np.tanh(pre[2 * n :] + r * hw[2 * n :]) + z * h
            c = int(net.class_of(np.array([i]))[0])
            total += soft(h @ w["cw"] + w["cb"])[c] / np.log(10)
            if i < net.hot:
                total += soft(h @ w["ww"][c] + w["wb"][c])[i - c * config.per_class] / np.log(10)
            else:
                total += np.log10(known.get(int(np.uint64(x).view(np.int64)), 0) + 1) - vocab.head_total[head]
            before = int(i)
        assert abs(out[doc].score - total) < 1e-3 * max(1, abs(total)) / 10
    empty = recurrent_lm.score_documents(docs.limit(0), config)
    assert empty.count() == 0
