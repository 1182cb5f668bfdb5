"""Texts are cut at blanks before the encoder's matches are sought, and stretches met before are not encoded again."""

import random

import public_tokenizers

from tessera.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_matches_of_stretches_are_those_of_the_text():
    own = bpe.Codec(bpe.vocabulary(PATH), PATTERN)
    rng = random.Random(4)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "\0", "'s", "'ll", "'", "a", "Été", "7", "²", "!", ".\n", "日本"]
    texts = ["", " ", "  ", "a ", " a", "a  b", "a \n b", "\n a\n\n  b"] + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(20000)]
    for text in texts:
        cut = own.stretches(text)
        assert "".join(cut) == text
        assert [w for x in cut for w in own.find(x)] == own.find(text), repr(text)
    assert len(own.stretches("one two, three")) == 3


def test_words_met_again_are_not_encoded_again(monkeypatch):
    """What does not fit goes, but not the words that the texts at hand have."""
    own, seen, replay = bpe.Codec(bpe.vocabulary(PATH), PATTERN), [], bpe.replay
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    monkeypatch.setattr(bpe, "replay", lambda words, *rest: seen.append(words) or replay(words, *rest))
    texts = lambda k: [" ".join([f"usualwordzq{i % 10}x" for i in range(20)] + [f"newwordzq{k}y{i}" for i in range(12)])]
    first = [list(own.encode(texts(k))) for k in range(4)]
    assert not any(b"usualwordzq" in w for words in seen[1:] for w in words)
    assert [list(bpe.Codec(bpe.vocabulary(PATH), PATTERN).encode(texts(k))) for k in range(4)] == first
    assert len(own.known) < 120
