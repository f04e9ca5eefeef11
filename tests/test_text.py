"""Text columns against small Python models."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from inkmill.functions import rules, text
from inkmill.functions.hanfold import fold_key, letters, to_simplified

RANDOM = random.Random(7)
ALPHABET = ["甲", "乙", "。", "！", "？", "…", "\n", "\r\n", "　", " ", "”", "“", "\"", "'", "a", "Z", "1", "😀", "\x1c", " ", "；"]


def noise(n=200, longest=40):
    return ["".join(RANDOM.choice(ALPHABET) for _ in range(RANDOM.randint(0, longest))) for _ in range(n)]


def apply(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("t")).alias("r")).collect())]


def test_strip_is_unicode(spark):
    values = [*noise(), None, "", "　\x1c甲 \n"]
    assert apply(spark, values, text.strip) == [None if v is None else v.strip() for v in values]


def test_normalize_lines(spark):
    values = noise()
    assert apply(spark, values, text.normalize_lines) == ["\n".join(x.strip() for x in v.splitlines() if x.strip()) for v in values]


def test_hard_wrap_merge(spark):
    def model(t):
        out = ""
        for x in (y.strip() for y in t.split("\n")):
            if x:
                out += x + ("\n" if x.endswith("。") else "")
        return out[:-1] if out.endswith("\n") else out

    values = noise()
    assert apply(spark, values, text.hard_wrap_merge) == [model(v) for v in values]


def test_summaries(spark):
    def lead(t):
        t = t.strip()
        for d in "。！？":
            at = t.find(d) + 1
            if 20 < at <= 100:
                return t[:at][:50]
        return t[:30]

    values = [v * 3 for v in noise(100, 50)]
    assert apply(spark, values, lambda c: text.lead_summary(c, "", "")) == [lead(v) for v in values]

    def two(t):
        kept = [s.strip() for d in "。！？" for s in t.split(d)]
        kept = [s for s in kept if len(s) > 10][:2]
        return ("。".join(kept) if kept else t[:50]) + "。"

    assert apply(spark, values, lambda c: text.two_piece_summary(c, before="")) == [two(v) for v in values]
    assert apply(spark, values, text.every_third) == ["。".join(re.split("[。！？]", v)[::3])[:300] for v in values]


def test_templates_leave_braces_in_text(spark):
    got = apply(spark, ["甲{style}乙"], lambda c: text.fill_template(F.lit("以{style}写：{text}"), c, style=F.lit("旧体")))
    assert got == ["以旧体写：甲{style}乙"]


def test_prefixes(spark):
    assert apply(spark, ["请改：正文", "前请改：正文", "无"], lambda c: text.drop_prefix(c, "请改：")) == ["正文", "：正文", "无"]
    assert apply(spark, ["乙：正文", "无"], lambda c: text.drop_prefixes(c, ["甲：", "乙："])) == ["正文", "无"]


def test_html_unescape(spark):
    values = ["&lt;甲&gt;", "&#20013;&#x4e2d;", "&nbsp;&hellip;", "无", None, "&copy 2 &#10;", ""]
    assert apply(spark, values, text.html_unescape) == [None if v is None else html.unescape(v) for v in values]


def test_quotes_alternate(spark):
    assert apply(spark, ['他说"好"又说"走"', 'a"b'], lambda c: text.curl_quotes(c, '"', "“", "”")) == ["他说“好”又说“走”", "a“b"]


def test_script(spark):
    assert apply(spark, ["記憶與龍", None], lambda c: to_simplified(spark, c)) == ["记忆与龙", None]
    assert apply(spark, ["Ａｂ 記-1憶！"], letters) == ["ab記憶"]
    assert apply(spark, ["沈記", "沉记"], lambda c: fold_key(spark, c))[0] == apply(spark, ["沉记"], lambda c: fold_key(spark, c))[0]


@pytest.mark.parametrize("line,ad", [("ｗｗｗ．某．ｃｏｍ", True), ("小-说 天.堂", True), ("1234", True), ("123", False), ("平常一句。", False), ("更 新 最 快", True), ("", False), ("他是大学生", True)])
def test_ad_lines(spark, line, ad):
    assert apply(spark, [line], rules.AdRules().is_ad) == [ad]


def test_ad_rules_can_be_exchanged(spark):
    assert apply(spark, ["手打", "大学生"], rules.AdRules(terms=["某站"], sequences=["某某"]).is_ad) == [False, False]


def test_marks(spark):
    assert apply(spark, ["第十章 夜渡\n正文。\n\n\n\n却说那人。"], lambda c: rules.drop_marks(c, rules.MARKS_AUTHOR)) == ["正文。\n\n那人。"]
    assert apply(spark, ["作者：某\n第三回 归\n正文 https://a.b/c 止\r\n"], rules.drop_meta) == ["正文 止"]
    assert apply(spark, [""], rules.style_sample) == [""]


def test_sound_text(spark):
    good = "夜" * 120
    assert apply(spark, [good, good[:90], good + "第三章", "a" * 200, ""], rules.is_sound) == [True, False, False, False, False]


def test_names(spark):
    rows = spark.createDataFrame([("x/书名_作者_站.txt",), ("书.txt",), ("a_b.c_d",)], "n string")
    book, author = text.book_info(F.col("n"))
    assert [tuple(r) for r in rows.select(book, author).collect()] == [("书名", "作者"), ("书", "unknown"), ("a", "b")]
