import random

import sentencepiece

from floorwright.llm import sentencepiece as sp_mod


def test_neighbours_are_checked_without_joining_both():
    own = sp_mod.Pieces.load()
    r, pieces = random.Random(2), list(own.ranks)
    letters = ["a", "aa", "aaa", "e", "ss", "☃", sp_mod.MARK, sp_mod.MARK * 2]
    pairs = [(r.choice(pieces), r.choice(pieces)) for _ in range(3000)] + [(r.choice(pieces), r.choice(letters)) for _ in range(1000)]
    pairs += [(a, b) for a in letters for b in letters] + [(p[: len(p) // 2], p[len(p) // 2 :]) for p in pieces[500:3000] if len(p) > 1]
    want = [own.joined(a + b) == [a, b] for a, b in pairs]
    assert [own.uncrossed(a, b) for a, b in pairs] == want
    assert True in want and False in want


def test_words_of_the_generation_before_are_not_walked_again(monkeypatch):
    monkeypatch.setattr(sp_mod, "_REMEMBERED", 3)
    lib, own, walked = sentencepiece.SentencePieceProcessor(model_file=sp_mod.DEFAULT_MODEL), sp_mod.Pieces.load(), []
    forward = own.forward
    monkeypatch.setattr(own, "forward", lambda words: (walked.extend(words), forward(words))[1])
    texts = ["one two three four", "five one", "six seven eight one", "two one ☃", "two ünd six"]
    for t in texts:
        assert own.encode([t]) == lib.encode([t])
    assert walked.count(sp_mod.MARK + "one") == 1
    assert walked.count(sp_mod.MARK + "two") == 2  # not used for two generations
    assert len(own.words) + len(own.older) < 12
