import random
import re

import numpy as np
import pyarrow as pa

from runlens.llm import counts, words


def test_words_equal_the_pattern():
    rng = random.Random(3)
    texts = ["", None, "a", " a b ", "x\ny\tz  é ü", "q" * 3000]
    texts += ["".join(rng.choice("ab \n é\x0b") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    data, offsets = words.buffers(pa.array(texts).slice(0))
    w = words.split_words(data, offsets)
    seen = {}
    for i, t in enumerate(texts):
        at = range(w.first[i], w.first[i + 1])
        got = [bytes(data[w.start[k] : w.end[k]]).decode() for k in at]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for x, k in zip(got, at):
            assert seen.setdefault(x, w.hashes[k]) == w.hashes[k]
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_their_offsets():
    column = pa.array(["one two", None, "three", "four five six"]).slice(2)
    w = words.split_words(*words.buffers(column))
    assert np.diff(w.first).tolist() == [1, 3]


def test_equal_windows_have_equal_grams():
    rng = random.Random(5)
    text = " ".join(rng.choice("abc") for _ in range(400))
    own = text.split()
    w = words.split_words(*words.buffers(pa.array([text])))
    starts, at, value = words.window_grams(w.hashes, w.first, 6, 2)
    assert starts.tolist() == list(range(395))
    first = {}
    for s, g in zip(starts.tolist(), at.tolist()):
        key = tuple(own[s : s + 6])
        assert first.setdefault(key, g - s) == g - s and 0 <= g - s <= 4


def test_sketch_never_underestimates(spark):
    rows = spark.createDataFrame([(f"w{i % 700} x{i % 3} w{i % 700}",) for i in range(2000)], "text string").repartition(3)

    def hashes(batch):
        return words.split_words(*words.buffers(batch.column(0))).hashes

    cells = counts.cells_for(1, 1 << 20)
    packed = counts.sketch(rows, hashes, 2, cells, counts.repeated_bits)
    some = pa.array([f"w{i} x{i % 3}" for i in range(700)])
    assert counts.maybe_repeated(packed, words.split_words(*words.buffers(some)).hashes, cells).all()
    new = pa.array([f"new{i}" for i in range(2000)])
    assert counts.maybe_repeated(packed, words.split_words(*words.buffers(new)).hashes, cells).mean() < 0.01
