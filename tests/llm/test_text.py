import re

import numpy as np
import pyarrow as pa
import pytest

from mastwire.llm import text

TEXTS = ["", None, " a", "b ", "a b", "A\tb\n\nC  d", "é É straße", "x" * 5000 + " y", "one two three four five one two three four",
         "The the THE", "a\x1cb c", "end."]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("chunk", [4, 64, 10**6])
def test_words_and_shingles_equal_plain_python(chunk, monkeypatch):
    monkeypatch.setattr(text, "STRETCH", 1000)
    names, sets = {}, {}
    rows = 0
    for part in text.texts(pa.array(["zz", *TEXTS]).slice(1), chunk):
        found = text.words(part)
        hashes, bounds = text.shingles(found, 4)
        for i in range(len(part.starts)):
            want = split(TEXTS[part.first + i])
            mine = found.hashes[found.bounds[i] : found.bounds[i + 1]]
            assert len(mine) == len(want)
            for w, h in zip(want, mine, strict=True):
                assert names.setdefault(w, h) == h
            wanted = {tuple(want[j : j + 4]) for j in range(max(len(want) - 3, min(len(want), 1)))}
            got = set(hashes[bounds[i] : bounds[i + 1]].tolist())
            assert len(got) == len(wanted)
            sets[part.first + i] = (wanted, got)
            rows += 1
    assert rows == len(TEXTS) and len(set(names.values())) == len(names)
    for a, b in sets.values():
        for c, d in sets.values():
            assert len(a & c) == len(b & d)


def test_kept_bytes_only():
    kept = np.zeros(256, dtype=bool)
    kept[97:123] = kept[65:91] = True
    a, b = (text.words(next(text.texts(pa.array([t]))), kept).hashes for t in ("(One, two) !!", "one two"))
    assert a[0] == b[0] and a[1] == b[1] and len(a) == 3 and a[2] == 0
