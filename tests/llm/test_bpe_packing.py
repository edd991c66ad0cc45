import base64
import os
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import bpe, packing

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hallo Welt, it's 12:30!", "aaaaaaa" * 50, "ab" * 300, "\r\n\t  x", "東京タワー 🙂🙏🏽", "<|endoftext|>", "Straße äöü é", "x" * 20_000, "ไทย हिन्दी عربى"]


def test_equals_public_library(public):
    got = bpe.vocabulary(PATH).encode_batch([*TEXTS, None])
    assert [x.tolist() for x in got] == [public.encode_ordinary(t) for t in TEXTS] + [[]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_random_texts(public, texts):
    got = bpe.vocabulary(PATH).encode_batch(texts)
    assert [x.tolist() for x in got] == [public.encode_ordinary(t) for t in texts]


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hallo Welt", "x"), (2, None, "x"), (3, "", "x"), (4, "Hallo Welt", "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] != []
    assert bpe.encode_texts(df.limit(0)).count() == 0
    assert rows(bpe.token_counts(df.filter("doc_id = 2"))) == [(2, 0)]


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([rng.randint(1, 900), 2048, rng.randint(2049, 9000)]) if i % 7 == 0 else rng.randint(1, 600), "z") for i in range(6000)]
    sizes += [(10_000, 0, "z"), (10_001, None, "z")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int, container string").repartition(6)
    out = packing.pack(df, 2048, 32).collect()
    left = {i: n for i, n, _ in sizes if n}
    load, pieces = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r["piece_no"])
    assert set(pieces) == set(left)
    for r in out:
        n, k = left[r["doc_id"]], r["piece_no"]
        size = min(2048, n - k * 2048)
        load[r["container"]] = load.get(r["container"], 0) + size
    assert all(sorted(p) == list(range((left[i] + 2047) // 2048)) for i, p in pieces.items())
    assert max(load.values()) <= 2048
    assert sum(load.values()) / (2048 * len(load)) > 0.97
    assert packing.pack(df.limit(0)).count() == 0


def test_leftovers_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "LAST", 8)
    df = spark.createDataFrame([(i, 700 + i % 5) for i in range(60)], "doc_id long, n_tokens int").repartition(20)
    out = packing.pack(df, 2048, 4).collect()
    load = {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + 700 + r["doc_id"] % 5
    assert len(out) == 60 and max(load.values()) <= 2048
