import random

import pytest

from inkmill.llm import pieces

RANDOM = random.Random(5)


def prose(n, marks="。，；！？\n”"):
    return "".join(RANDOM.choice("甲乙丙丁戊己庚辛" * 3 + marks) for _ in range(n))


@pytest.mark.parametrize("text", [prose(n) for n in (1001, 1050, 1949, 1950, 1951, 5000, 20011)] + ["甲" * 9740, "x" * 1001, "\n" * 3000, "😀" * 2500, "ab " * 900, "é" * 1200])
def test_pieces_fit_overlap_and_join(text):
    got = pieces.cuts(text)
    parts = [text[a:b] for a, b in got]
    assert all(0 < len(p) <= 1000 for p in parts) and len(parts) > 1
    assert parts[0] + "".join(p[50:] for p in parts[1:]) == text
    assert all(a[-50:] == b[:50] for a, b in zip(parts, parts[1:]))


def test_pieces_end_where_prose_allows():
    text = ("甲" * 37 + "。") * 100
    ends = [text[b - 1] for _, b in pieces.cuts(text)]
    assert set(ends) == {"。"}


def test_the_strongest_boundary_nearby_wins():
    text = "甲" * 90 + "。" + "甲" * 9 + "，" + "甲" * 20 + "\n" + "甲" * 200
    assert pieces.snap(text, 100, 30) == 122 and pieces.snap(text, 100, 15) == 91 and pieces.snap(text, 103, 5) == 101 and pieces.snap(text, 200, 20) == 200
    assert pieces.snap("甲。" * 50, 51, 20) == 50


def test_other_limits():
    for limit, overlap in ((10, 0), (10, 4), (100, 30)):
        text = prose(777)
        parts = [text[a:b] for a, b in pieces.cuts(text, limit, overlap)]
        assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == text and max(map(len, parts)) <= limit


def test_operator_on_dirty_rows(spark):
    long = prose(2500)
    rows = spark.createDataFrame([("a", long, 1), ("a", long, 2), ("b", None, 3), (None, long, 4), ("c", "", 5), ("d", "甲" * 1000, 6), ("e", "甲" * 1001, 7)], "id string, text string, piece_no int")
    got = pieces.split_oversized(rows).collect()
    assert sorted({r.id for r in got}, key=str) == [None, "a", "e"] or {r.id for r in got} == {None, "a", "e"}
    assert len([r for r in got if r.id == "a"]) == 3 and len([r for r in got if r.id == "e"]) == 2
    assert {r.id for r in pieces.oversized_keys(rows).collect()} == {None, "a", "e"}
    whole = pieces.split_oversized(rows, oversized_only=False).collect()
    assert [r.pieces for r in whole if r.id == "d"] == [1]
    assert pieces.split_oversized(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(rows, limit=50, overlap=30)
