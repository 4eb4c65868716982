import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.packing import encoding, harmonic_fill, pack_documents, reciprocal_class


def check_fill(sizes, capacity):
    bin_of, place, offset = harmonic_fill(np.array(sizes, np.int64), capacity)
    bins = {}
    for i, b in enumerate(bin_of.tolist()):
        bins.setdefault(b, []).append(i)
    assert sorted(bins) == list(range(len(bins)))
    for members in bins.values():
        members.sort(key=lambda i: place[i])
        assert [place[i] for i in members] == list(range(len(members)))
        at = 0
        for i in members:
            assert offset[i] == at
            at += sizes[i]
        assert at <= capacity
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_every_size_is_placed_and_fits(sizes):
    bins = check_fill(sizes, 50)
    # at most one container is no more than half full
    assert sum(2 * sum(sizes[i] for i in m) <= 50 for m in bins.values()) <= 1


def test_classes_have_their_fixed_count():
    assert [reciprocal_class(s, 60) for s in (60, 31, 30, 21, 20, 16, 15, 1)] == [1, 1, 2, 2, 3, 3, 4, 60]
    bins = check_fill([21] * 10, 60)
    assert all(len(m) == 2 for m in bins.values())


def test_little_space_is_left():
    sizes = np.random.default_rng(0).integers(1, 4097, 5000).tolist()
    bins = check_fill(sizes, 4096)
    assert sum(sizes) / (len(bins) * 4096) > 0.97


def test_documents(spark):
    texts = ["a b c", None, "", "word " * 3000, "x", "x", "<|endoftext|>", "é" * 5000]
    rows = [(i, t, "p") for i, t in enumerate(texts)] + [(3, "word " * 3000, "p"), (None, "no id", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    got = [r.asDict() for r in pack_documents(df, "doc_id", "text", capacity=64, workers=3).collect()]
    e = encoding("byte_bpe_50k.tiktoken")
    for i, t in enumerate(texts):
        n = len(e.encode_ordinary(t or ""))
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        copies = 2 if i == 3 else 1
        assert sum(r["n_tokens"] for r in own) == n * copies
        if n <= 64:
            assert len(own) == copies and own[0]["token_start"] == 0
        if n == 0:
            assert own[0]["container_id"] is None and own[0]["place"] is None
        assert {r["token_start"] for r in own} == {k * 64 for k in range(max(1, -(-n // 64)))}
        assert all(r["n_tokens"] == 64 for r in own if r["token_start"] + 64 <= n)
    bins = {}
    for r in got:
        if r["container_id"] is not None:
            bins.setdefault(r["container_id"], []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["place"])
        assert [r["place"] for r in members] == list(range(len(members)))
        assert [r["token_offset"] for r in members] == np.cumsum([0, *(r["n_tokens"] for r in members[:-1])]).tolist()
        assert sum(r["n_tokens"] for r in members) <= 64
    assert sum(r["doc_id"] is None for r in got) == 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
