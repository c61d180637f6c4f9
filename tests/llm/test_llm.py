"""Operators of the llm subpackage against plain versions, and their behaviour on odd rows."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from floorwright.llm import bpe, decontamination, edit_counts, html_blocks, html_extraction, ngram_join, nn_descent, packing, preferences, recurrent_lm, sentencepiece as sp_mod, text, toxicity
from floorwright.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ODD = [None, "", " \t\n", "one", "Two WORDS", "one two three four five", "ONE two  three\tfour five", "é ü ß " * 3, "x" * 5000]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus(seed=0, n=120):
    """Texts with copies, near copies, shared passages and odd rows."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    make = lambda k: [r.choice(vocab) for _ in range(k)]
    passage = make(60)
    out = [make(r.choice([3, 8, 40, 120, 400])) for _ in range(n)]
    for _ in range(n // 2):
        own = list(r.choice(out))
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            own[r.randrange(len(own))] = r.choice(vocab)
        out.append(own)
    base = make(150)
    for _ in range(40):  # a chain of near copies
        base = list(base)
        base[r.randrange(150)] = r.choice(vocab)
        out.append(base)
    out += [make(30) + passage + make(20) for _ in range(30)]
    return [" ".join(x) for x in out] + ODD


def frame(spark, texts, **more):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shared string, h int")


def linked(texts, percent=75):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def test_word_hashes_equal_words():
    texts = corpus(3, 20)
    raw = [(t or "").encode() for t in texts]
    h, at = text.word_hashes(raw)
    flat = [w for t in texts for w in words(t)]
    assert len(h) == len(flat)
    assert len({(int(a), b) for a, b in zip(h, flat, strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]


@pytest.mark.parametrize("rounds", [4, 1, 0])
def test_ngram_join_against_all_pairs(spark, rounds):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts), rounds=rounds).collect()}
    assert got == dict(enumerate(linked(texts)))


def test_ngram_join_with_one_large_group(spark):
    r = random.Random(5)
    base, more = [f"b{k}" for k in range(80)], corpus(6, 20)
    near = []
    for _ in range(300):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            own[r.randrange(80)] = f"x{r.randrange(10**6)}"
        near.append(" ".join(own))
    texts = near + more
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == dict(enumerate(linked(texts)))


def test_ngram_join_odd_tables(spark):
    df = frame(spark, ["a b c d e f"] * 3)
    empty = ngram_join.ngram_components(df.limit(0))
    assert empty.count() == 0
    repeated = df.unionByName(df).unionByName(spark.createDataFrame([(None, "a b c d e f", "", 0)], df.schema))
    rows = [(r.doc_id, r.component_id) for r in ngram_join.ngram_components(repeated).collect()]
    assert sorted(rows, key=str) == sorted([(i, 0) for i in (0, 1, 2)] * 2 + [(None, None)], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}
    assert got == want


def test_decontamination_against_all_pairs(spark):
    r = random.Random(1)
    items = [" ".join(f"t{r.randrange(300)}" for _ in range(k)) for k in (3, 5, 15, 30, 59)] + ["", None]
    docs = corpus(2, 40)
    for it in items[:5]:
        w = it.split()
        docs += ["pre " * 30 + it.upper() + " post", " ".join(w[: max(1, len(w) * 9 // 10)]), " ".join(w[: len(w) // 2]), it]
    ids = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(2, items[2], "x")], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id, x.overlap, x.item_shingles) for x in decontamination.containment(frame(spark, docs), ids).collect()}
    want = set()
    for i, it in enumerate(items):
        own = shingles(it)
        for d, t in enumerate(docs):
            both = len(own & shingles(t))
            if own and 100 * both >= 75 * len(own):
                want.add((d, i, both, len(own)))
    assert got == want
    assert decontamination.containment(frame(spark, docs).limit(0), ids).count() == 0
    assert decontamination.containment(frame(spark, docs), ids.limit(0)).count() == 0


def test_pieces_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=sp_mod.DEFAULT_MODEL)
    own = sp_mod.Pieces.load()
    r = random.Random(4)
    texts = [t or "" for t in corpus(5, 10)] + ["  a  b ", "ﬁ Ａ x​é 🙂🙂 日本語", " " * 40 + "x", "aaaa" * 9, "▁ab", "Hello, world! it's 1,234.5\n\n\tfine"]
    texts += ["".join(r.choice("abcdeéß ., 12\n") for _ in range(r.randrange(40))) for _ in range(200)]
    assert own.encode(texts) == lib.encode(texts)
    assert [own.decode(x) for x in own.encode(texts)] == [t.replace(sp_mod.MARK, " ") for t in texts]


def test_encode_documents_rows(spark):
    out = sp_mod.digests(frame(spark, ODD)).orderBy("doc_id").collect()
    assert all(r.round_trip for r in out)
    assert [r.n_pieces for r in out][:2] == [0, 0]


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(0)
    vocab = ["".join(r.choice(["the", "an", "er", "on", "th", "re", "ing", "ed"]) for _ in range(r.randrange(1, 5))) for _ in range(600)]
    bad = ["scumlord", "idiotic", "pathetic", "worthless", "moronic"]
    rows, labels = [], []
    for i in range(1500):
        own = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(1 + len(own) // 40):
                own.insert(r.randrange(len(own)), r.choice(bad))
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(toxic)))
    rows += [(5000 + i, t, "s") for i, t in enumerate(ODD)] + [(None, "pathetic idiotic", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.classify(docs, lab).collect()}
    assert len(out) == len(rows)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i, _ in labels)
    right = sum(out[i].predicted == int(i % 7 == 0) for i in held) / len(held)
    assert right > 0.97
    none = toxicity.classify(docs, lab.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0


def test_html_blocks_and_labeller():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a><li>About</ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Big &amp; bold</h1><p><b>First<br>line<p>Second   para</p></article><div style="display: none">gone</div><footer>&copy; me</footer>'
    got = [b.text for b in html_blocks.blocks(page)]
    assert got == ["Home", "About", "Buy", "Big & bold", "First line", "Second para", "© me"]
    assert html_blocks.blocks("") == []
    assert [b.text for b in html_blocks.blocks("a < b <p>x &lt; y")] == ["a < b", "x < y"]
    r = random.Random(0)
    say = lambda k: " ".join(r.choice(["and", "the", "of", "word", "on", "text"]) for _ in range(k))
    make = lambda: f"<html><body><nav><a href='/'>{say(2)}</a></nav><div class='ad'>{say(6)}</div><article><h1>{say(5)}</h1><p>{say(40)}</p><p>{say(30)}</p></article><footer>{say(4)}</footer></body></html>"
    model = html_extraction.fit([make() for _ in range(120)], html_extraction.LabellerConfig(epochs=8))
    own = [html_blocks.blocks(make()) for _ in range(20)] + [[]]
    for page_blocks, p in zip(own, html_extraction.label(model, own), strict=True):
        assert [bool(x >= 0.5) for x in p] == [html_extraction.teacher(b) == 1 for b in page_blocks]


def test_lstm_gradients():
    config = html_extraction.LabellerConfig(buckets=16, width=3, hidden=4)
    w = {k: v.astype(np.float64) for k, v in html_extraction._initial(config).items()}
    r = np.random.default_rng(0)
    x, mask = r.standard_normal((5, 3, 12)).astype(np.float32), np.ones((5, 3), bool)
    mask[3:, 1] = False
    up = r.standard_normal((5, 3, 4))
    keep = []
    html_extraction._lstm(x, mask, w["fx"], w["fh"], w["fc"], keep)
    _, gx, gh, gc = html_extraction._lstm_back(x, up, keep, w["fx"], w["fh"])
    for name, g in (("fx", gx), ("fh", gh), ("fc", gc)):
        for at in [tuple(r.integers(n) for n in g.shape) for _ in range(4)]:
            f = []
            for d in (1e-3, -1e-3):
                v = w[name].copy()
                v[at] += d
                f.append((html_extraction._lstm(x, mask, *[v if k == name else w[k] for k in ("fx", "fh", "fc")]) * up).sum())
            assert g[at] == pytest.approx((f[0] - f[1]) / 2e-3, rel=2e-2, abs=2e-3)


def test_language_model(spark):
    r = random.Random(0)
    tongues = [[f"{p}{k}" for k in range(150)] for p in ("aa", "bb", "cc")]
    texts = []
    for i in range(900):
        own = tongues[i % 3]
        texts.append(" ".join(own[min(149, int(r.expovariate(1 / 25)))] for _ in range(r.randrange(5, 120))))
    texts += ODD
    config = recurrent_lm.LanguageModelConfig(hot=256, held=300)
    out = {x.doc_id: x for x in recurrent_lm.score_documents(frame(spark, texts), config).collect()}
    tokens = [[*words(t), b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for i, own in enumerate(tokens) if not held[i] for w in own)
    n, v = c.total(), len(c)
    for i, own in enumerate(tokens):
        assert out[i].held_out == held[i]
        assert out[i].n_tokens == len(own)
        assert out[i].n_known == sum(c[w] > 0 for w in own)
        assert out[i].train_tokens == n
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
    long = [i for i in range(900) if held[i]]
    assert sum(out[i].score for i in long) > sum(out[i].base_score for i in long)


def test_language_model_sums_to_one():
    texts = [b"a b c d a b", b"a c e f g", b"b b a h"]
    config = recurrent_lm.LanguageModelConfig(hot=4, per_class=2, heads=3, held=6)
    h, heads, _ = recurrent_lm._tokens(texts, config)
    u, first, n = np.unique(h, return_index=True, return_counts=True)
    order = np.lexsort((u, -n))
    hot = set(order[:4].tolist())
    net_states = np.random.default_rng(0).standard_normal((1, config.width)).astype(np.float32)
    head_n, head_v = np.zeros(3), np.zeros(3)
    for k in range(len(u)):
        if k not in hot:
            head_n[heads[first[k]]] += n[k]
            head_v[heads[first[k]]] += 1
    vocab = recurrent_lm.Vocabulary(u, np.zeros(len(u), np.int32), np.zeros(len(u)), np.zeros(len(u)), np.log10(head_n + head_v + 1), 1.0, n[order[:4]].astype(float), head_n + 1, int(n.sum()))
    net = recurrent_lm.Network(vocab, config)
    total = sum(math.exp(net.log_probs(net_states, np.array([k]))[0]) for k in range(4))
    for k in range(3):
        p = math.exp(net.log_probs(net_states, np.array([4 + k]))[0])
        shares = [(n[j] + 1) / 10 ** vocab.head_total[k] for j in range(len(u)) if j not in hot and heads[first[j]] == k] + [1 / 10 ** vocab.head_total[k]]
        assert sum(shares) == pytest.approx(1)
        total += p
    assert total == pytest.approx(1, abs=1e-5)


def test_packing_is_lossless(spark):
    texts = corpus(7, 20)
    config = packing.PackingConfig(length=64)
    rows = packing.pack(frame(spark, texts), config).collect()
    b, pieces = bpe.bpe(), {}
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        ids, at = np.frombuffer(r.ids, b.dtype), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == 64
        assert (ids[r.n_tokens :] == config.pad_id).all()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            lo, hi = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            pieces[d, s] = ids[lo:hi].tolist()
            assert at[lo:hi].tolist() == list(range(hi - lo))
    for d, t in enumerate(texts):
        whole = [x for k in sorted(k for k in pieces if k[0] == d) for x in pieces[k]]
        assert whole == ([*b.encoding.encode_ordinary(t), config.end_id] if t else [])


def test_best_fit_against_search():
    r = random.Random(2)
    sizes = [r.randrange(1, 65) for _ in range(500)]
    rows, room = [], []
    for i in sorted(range(500), key=lambda k: -sizes[k]):
        fit = [x for x in room if x >= sizes[i]]
        if fit:
            k = max(j for j, x in enumerate(room) if x == min(fit))
            rows[k].append(i)
            room[k] -= sizes[i]
        else:
            rows.append([i])
            room.append(64 - sizes[i])
    mine = packing.best_fit(sizes, 64)
    assert sorted(i for x in mine for i in x) == list(range(500))
    assert len(mine) == len(rows)
    assert packing.best_fit([], 64) == []


def test_edit_counts_against_encoding_anew(spark):
    b, r = bpe.bpe(), random.Random(3)
    for _ in range(400):
        t = r.choice([x or "" for x in corpus(8, 5)])[: r.choice([0, 1, 7, 60, 3000])]
        tree = edit_counts.TokenTree(t, b)
        for _ in range(4):
            i = r.randint(0, len(t))
            j = min(len(t), i + r.choice([0, 1, 5, 200]))
            new = r.choice(["", " ", "  x", "'ll", "\n\n", "é " * 3, "many words " * r.randrange(1, 60)])
            tree.edit(i, j, new)
            t = t[:i] + new + t[j:]
            assert tree.text() == t
            assert tree.total == len(b.encoding.encode_ordinary(t))
    out = edit_counts.count_tokens(edit_counts.sample_edits(frame(spark, ODD))).orderBy("doc_id").collect()
    for row, t in zip(out, ODD, strict=True):
        assert row.n_tokens == len(b.encoding.encode_ordinary(t or ""))


def test_nn_descent_against_all_pairs(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((300, 16))
    near = base[:60] + 0.05 * r.standard_normal((60, 16))
    cloud = r.standard_normal(16) + 0.02 * r.standard_normal((90, 16))
    x = np.concatenate([base, near, cloud, np.repeat(base[:1] * 2, 30, 0)])
    rows = [(i, v.tolist(), int(i % 2 == 0 or i >= 360), 9) for i, v in enumerate(x)]
    odd = [(1000, None, 1, 9), (1001, [0.0] * 16, 1, 9), (1002, [float("nan")] * 16, 1, 9), (1003, [], 1, 9), (1004, x[0].tolist(), None, 9), (None, x[0].tolist(), 1, 9), (1005, [None] * 16, 1, 9), (1006, [1.0, 2.0], 1, 9), (1007, [2.0, 4.0], 1, 9)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, vertex int")
    got = {g.vec_id: g for g in nn_descent.near_duplicates(df, nn_descent.DescentConfig(tile=32)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([q[2] for q in rows])
    hit = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= hit.sum(1)).all()
    assert n.sum() >= 0.98 * hit.sum()
    for i in (1000, 1001, 1002, 1003, 1004, None, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[1007].component_id == 1006
    assert not got[1007].kept
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_preferences(spark):
    pairs = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "chosen", 2, "user", "ok"), (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "a"), (3, "chosen", 0, "assistant", "b")]
    out = {r.pair_id: r for r in preferences.format_pairs(spark.createDataFrame(pairs, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert out[1].prompt == "<|user|>\nhi<|end|>\n"
    assert out[1].chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nok<|end|>\n"
    assert [out[1].chosen[a:b] for a, b in out[1].chosen_spans] == ["yes<|end|>\n"]
    assert [out[1].rejected[a:b] for a, b in out[1].rejected_spans] == ["no<|end|>\n"]
    assert (out[2].prompt_turns, out[2].chosen, out[2].rejected) == (1, "", "")
    assert (out[3].prompt, out[3].rejected) == ("", "")
    odd = spark.createDataFrame([(0, 0, None, None), (0, 0, "assistant", "x"), (None, 1, "user", "y"), (1, None, "user", "z")], "conv_id long, turn long, role string, text string")
    only = preferences.format_pairs(preferences.swapped_pairs(odd)).collect()
    assert [(x.pair_id, x.prompt_turns, x.chosen, x.rejected) for x in only] == [(0, 1, "", "")]
    said = [(4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 2, "user", "thanks"), (5, 0, "assistant", "b"), (8, 0, "assistant", "alone"), (9, 0, "user", "no answer")]
    got = {x.pair_id: x for x in preferences.format_pairs(preferences.swapped_pairs(spark.createDataFrame(said, odd.schema))).collect()}
    assert set(got) == {4, 5, 8, 9}
    assert got[4].chosen == "<|assistant|>\na<|end|>\n<|user|>\nthanks<|end|>\n" and got[4].rejected == got[4].chosen.replace("\na<", "\nb<")
    assert got[8].rejected == "<|assistant|>\n<|end|>\n" and (got[9].chosen, got[9].prompt_turns) == ("", 1)
    assert json.dumps(preferences.turns(odd).count()) == "1"
