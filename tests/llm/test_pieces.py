"""Words that go straight to the model get the ids of the whole tokenizer."""

import random

import numpy as np

from privlink.llm import queries, token_files


def test_pieces_have_the_ids_of_the_text():
    path = queries.vocabulary("byte_bpe_50k.json")
    draw = random.Random(11)
    letters = ["abcdetion", "ABcdé", "ñóüßœſ", "日本", "µªʰ", "012", "'", "_", ".,;:!?", "\n", "\n", " ", " ", " ", "\t", "#%", "…", " ", "×÷"]
    words = ["".join(draw.choice(draw.choice(letters)) for _ in range(draw.randrange(1, 9))) for _ in range(3000)]
    some = ["one", "two.", "Drei,", "é.\nÉa", "x\nThe", "end.\n\nNew", "it's", "a.b", "word..", "naïve!\nWow?", "\nlead", "tail\n", "a\nb\nc", ""]
    texts = [" ".join(draw.choices(words + 100 * some, k=draw.randrange(0, 60))) for _ in range(400)]
    encoder = token_files.Encoder(path)
    assert encoder.model is not None
    want = [np.array(encoder.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.batch(texts) == want and encoder.batch(texts[::-1]) == want[::-1]
    seen = []
    lib = encoder.lib
    encoder = token_files.Encoder(path)
    encoder._learn = lambda pieces: seen.append(pieces)
    encoder.learn(["plain", "marked,", "two.\nLines", "naïve"])
    assert not seen and all(encoder.known[w] == np.array(lib.encode(" " + w, add_special_tokens=False).ids, "<u4").tobytes() for w in ("plain", "marked,", "two.\nLines", "naïve"))
