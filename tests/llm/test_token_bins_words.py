"""op1's encoder: each distinct word of a batch is looked up once, and the ids are the library's."""

import random
import struct

from tiersift.llm import queries, token_bins


def test_words_are_looked_up_once():
    coder = token_bins.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    rng, end = random.Random(2), struct.pack("<I", 2)
    words = ["a", "Été", "don't", "x\ny", "1234", "日本語", "...", "a\u00a0b", "tab\tin", "😀"]
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(40)]
    texts += ["", " ", "  ", " a", "a ", "a  b", " a b", "a \n b", "a\n", "\n", "\na b", "a", "\u3000a", *coder.special[:1], *(f"a {s} b" for s in coder.special[:1])]
    asked, find = [], coder.cache.find
    coder.cache.find = lambda units: asked.extend(map(list, units)) or find(units)
    got = [x.tolist() for x in coder.encode(texts, end)]
    assert got == [[*coder.model.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert coder.encode([], end) == []
    assert all(len(u) == len(set(u)) for u in asked if len(u) > 10)
