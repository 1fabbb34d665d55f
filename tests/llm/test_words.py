import random
import re

import numpy as np
import pyarrow as pa

from fieldspark.llm import words as W


def test_words_are_those_of_the_patterns(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab AB\n\té.1-\x0b\x85") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", " ", "é", "x" * 300]
    column = pa.array([None, *texts, None])[1:-1]
    for size in (W.SEGMENT, 50):
        monkeypatch.setattr(W, "SEGMENT", size)
        for breaks, pattern, lower in ((W.BLANKS, r"[^\x20\x09-\x0D]+", False), (W.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
            data, offsets = W.buffers(column)
            h, first = W.words(data, offsets, breaks, lower)
            want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t) for t in texts]
            assert np.diff(first).tolist() == [len(w) for w in want]
            seen = {}
            for w, x in zip([x for own in want for x in own], h.tolist()):
                assert seen.setdefault(w, x) == x
            assert len(set(seen.values())) == len(seen)


def test_windows_stay_in_their_texts():
    first = np.array([0, 3, 3, 7, 8])
    assert W.firsts(first, 2).tolist() == [True, True, False, True, True, True, False]
    h = np.arange(8, dtype=np.uint64)
    assert len(np.unique(W.rolling(h, 2, 1))) == 7 and len(W.rolling(h, 9, 1)) == 0


def test_null_and_empty_columns():
    for column in (pa.array([], pa.string()), pa.array([None, None], pa.string()), pa.array(["", None, "a"])):
        data, offsets = W.buffers(column)
        h, first = W.words(data, offsets)
        assert len(first) == len(column) + 1 and len(h) == first[-1]
