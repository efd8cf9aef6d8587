import zlib

import numpy as np
import pyarrow as pa
import pytest

from mastwire.llm import packing


def exact_ids(text):
    return packing._tokenizer(packing.TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["", None, "  ", "Hello  world\tit's\n\nfine", "a b c", "été ́x", "x\x1cy\x1dz", "don't we'll 1234 !!??",
       "naïve ÉTÉ straße 漢字 🙂🙂", "<|endoftext|> tail", "w" * 3000, "a b " * 5000, "tab\x0bvt\x0cff",
       "It's, he'll. 'summer' x'.y …, a…b. é.É, ×. a×,b 're's. (the) 's 'sun a'", "ﬁne ＡＢ İstanbul ǅ ñ̃. e\u0301, ab\u0301."]


def test_ids_equal_the_tokenizer():
    got = list(packing.token_ids(pa.array(ODD), packing.Vocabulary(packing.TOKENIZER, limit=5)))
    for text, ids in zip(ODD, got, strict=True):
        assert ids.tolist() == exact_ids(text)
    sliced = packing.token_ids(pa.array(["skip me", *ODD]).slice(1), packing.vocabulary(packing.TOKENIZER))
    assert [x.tolist() for x in sliced] == [x.tolist() for x in got]


def test_fullest_bin_against_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 30), 5, False), rng.integers(1, 4, 5), strict=True)}
        items = [k for k, v in counts.items() for _ in range(v)]
        first, rest = max(items), sorted(items)[:-1]
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        best = first + max(s for s in sums if s + first <= 40)
        bin_ = packing.fullest(counts, 40)
        assert sum(bin_) == best and all(bin_.count(k) <= counts.get(k, 0) for k in bin_)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_is_whole_and_gapless(spark, capacity):
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, capacity).toPandas()
    want = [len(exact_ids(t)) for _, t, _ in rows]
    assert got["length"].sum() == sum(want)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == np.concatenate(([0], bin_["length"].cumsum()[:-1])).tolist()
        assert bin_["length"].sum() <= capacity
    one = exact_ids(ODD[3])
    mine = got[(got.doc_id == 3)].sort_values("piece")
    assert mine["start"].tolist() == list(range(0, len(one), capacity))
    assert mine["ids_crc32"].tolist() == [
        zlib.crc32(np.array(one[s : s + capacity], dtype="<u4").tobytes()) for s in mine["start"]]
    assert got["sequence_id"].nunique() <= -(-sum(want) // capacity) + 1


def test_pack_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_real_texts(spark):
    from mastwire.llm.store import table

    rows = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for text, ids in zip(rows, packing.token_ids(pa.array(rows), packing.vocabulary(packing.TOKENIZER)), strict=True):
        assert ids.tolist() == exact_ids(text)


def test_capitals_are_lowered_by_the_tokenizer():
    rows = ["ΟΔΟΣ", "Η ΟΔΟΣ ΤΗΣ πόλης, ΟΔΟΣ. ABC ΣΑΣ"]
    for text, ids in zip(rows, packing.token_ids(pa.array(rows), packing.Vocabulary(packing.TOKENIZER)), strict=True):
        assert ids.tolist() == exact_ids(text)
