"""The word cache of op1: a long tail of words is encoded once."""

import itertools

import public_tokenizers
from topicflow.llm.packing import WordEncoder


def test_a_long_tail_of_words_is_encoded_once(monkeypatch):
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklm", repeat=5), 240_000)]
    texts = [" ".join(words[k : k + 60_000]) for k in range(0, len(words), 60_000)]
    encode = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    first, asked, real = [encode([t]) for t in texts], [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda some: asked.extend(some) or real(some))
    assert [encode([t]) for t in texts] == first and not asked
