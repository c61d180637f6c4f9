import numpy as np

from floorwright.llm import recurrent_lm


def test_held_words_are_found_by_first_bits():
    r = np.random.default_rng(1)
    close = (np.uint64(7) << np.uint64(50)) + np.arange(40, dtype=np.uint64)  # all with the same first bits
    held = np.unique(np.concatenate([r.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), close, np.array([0, 2**64 - 1], np.uint64), [recurrent_lm.END]]))
    none = np.zeros(0)
    vocab = recurrent_lm.Vocabulary(held, np.arange(len(held), dtype=np.int32), none, none, none, 0.0, np.ones(5), none, 9)
    asked = np.concatenate([held[::-1], held + np.uint64(1), r.integers(0, 1 << 63, 500).astype(np.uint64)])
    place = {int(h): k for k, h in enumerate(held)}
    ids, at = recurrent_lm._ids(asked, np.full(len(asked), 3), vocab)
    assert at.tolist() == [place.get(int(h), -1) for h in asked]
    assert ids.tolist() == [place.get(int(h), 5 + 3) for h in asked]
    assert (recurrent_lm._order(held % np.uint64(9), 9) == np.argsort(held % np.uint64(9), kind="stable")).all()


def test_probabilities_with_and_without_a_bound_of_the_logits():
    config = recurrent_lm.LanguageModelConfig(per_class=4, heads=3, width=6)
    none = np.zeros(0)
    vocab = recurrent_lm.Vocabulary(none, none, none, none, none, 0.0, np.arange(10, 0, -1.0), np.array([3.0, 1.0, 2.0]), 60)
    r = np.random.default_rng(2)
    states = np.tanh(r.standard_normal((50, 6))).astype(np.float32)
    ids = r.integers(0, 13, 50)
    for by, bounded in ((1, True), (300, False)):
        net = recurrent_lm.Network(vocab, config)
        w = net.weights
        w["cw"], w["ww"] = w["cw"] * by, w["ww"] * by
        assert (recurrent_lm._shifted(w["cw"], w["cb"]) is not None) == bounded
        assert (recurrent_lm._shifted(w["ww"], w["wb"]) is not None) == bounded
        log = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
        want = []
        for s, i in zip(states.astype(float), ids.tolist(), strict=True):
            k = i // 4 if i < 10 else 3 + i - 10
            want.append(log(s @ w["cw"] + w["cb"])[k] + (log(s @ w["ww"][k] + w["wb"][k])[i - 4 * k] if i < 10 else 0))
        assert np.allclose(net.log_probs(states, ids), want, rtol=1e-4, atol=1e-4)
