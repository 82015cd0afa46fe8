"""op2's codec and the pipeline's last stage: what a worker holds is bounded by bytes, and the ids stay the library's."""

import hashlib
import random
import tracemalloc

from tiersift.llm import queries, token_codec

PATH = queries.vocabulary("byte_bpe_50k.json")


def traced(run):
    """(bytes that stay, most bytes) of a call."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        run()
        now, most = tracemalloc.get_traced_memory()
        return now - before, most - before
    finally:
        tracemalloc.stop()


def test_known_units_take_few_bytes():
    codec, rng = token_codec.Codec(PATH), random.Random(3)
    codec.encode(["warm up"])
    words = [f"w{rng.randrange(10**7)}" for _ in range(40_000)]
    kept, _ = traced(lambda: [codec.encode([" ".join(words[at : at + 4000])]) and None for at in range(0, len(words), 4000)])
    assert kept < 80 * len(words)


def test_long_texts_are_cut_into_units_piece_by_piece():
    codec = token_codec.Codec(PATH)
    text = " ".join(random.Random(4).choices(["some", "words", "that", "recur", "now", "x.y"], k=800_000))
    _, most = traced(lambda: codec.encode([text]))
    assert most < 10 * len(text)


def test_pieces_and_forgetting_change_no_ids(monkeypatch):
    from tokenizers import Tokenizer

    model, rng = Tokenizer.from_file(PATH), random.Random(5)
    special = list(token_codec.Codec(PATH).special)
    parts = ["a", "é'", "'s", "don't", " ", "  ", "\n", "\t", " ", "　", "日本", "1", "23", "...", "😀", "\x1c", "\x85", *special]
    texts = ["", *special, *("".join(rng.choices(parts, k=60)) for _ in range(100))]
    for piece, merged, digested, held in ((1, 1, 1, 2000), (7, 30, 3, 50_000), (1 << 20, 1 << 18, 1 << 16, 0)):
        for name, value in (("PIECE", piece), ("MERGED", merged), ("DIGESTED", digested)):
            monkeypatch.setattr(token_codec, name, value)
        codec = token_codec.Codec(PATH)
        codec.known.held = held
        for _ in range(2):
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                want = model.encode(text, add_special_tokens=False).ids
                back = model.decode(want, skip_special_tokens=False)
                assert ids.tolist() == want
                assert codec.digests(ids) == (hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert sum(x.nbytes for part in codec.known.parts for x in part) <= held
