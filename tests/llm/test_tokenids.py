import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.llm import tokenids

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokenids.default_vocabulary()


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "é", "中", "。", "1", "٣", "!", "　", "’", "😀", "ⅷ", "\x1c", "​", "ſ", "<|endoftext|>", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=8))
def test_equals_the_public_tokenizer(texts):
    tool = tokenids.encoder(PATH)
    ids, sizes = tool.encode(texts)
    at = 0
    for t, n in zip(texts, sizes):
        assert ids[at : at + n].tolist() == _reference().encode_ordinary(t)
        at += n


_made = []


def _reference():
    if not _made:
        with open(PATH, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _made[0]


def test_operator_and_round_trip(spark, reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(300)] + [None, "", " ", "长" * 300_000, "a" * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (0, texts[0], 1)], "doc_id bigint, text string, ids int")
    got = tokenids.token_ids(df).collect()
    retained = {r.doc_id: r.offsets for r in tokenids.token_ids(df, offsets=True).collect()}
    assert len(got) == len(texts) + 2
    for r in got:
        t = "x" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(t)
        text, offsets = tokenids.decode(r.ids)
        assert text == t and len(offsets) == len(r.ids)
        assert retained[r.doc_id] == offsets
    assert tokenids.token_ids(df.where("false")).count() == 0


def test_composition_is_associative():
    _, compose, _ = tokenids.monoid()
    n = len(compose)
    assert all(compose[compose[a, b], c] == compose[a, compose[b, c]] for a in range(n) for b in range(n) for c in range(n))
