"""Line and text rules as tables: terms, patterns and keyword sequences, and the predicates made of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import WS, lines, strip

#: Full-width letters and digits, and what they stand for.
FULL = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
HALF = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Signs that advertisers scatter among letters.
NOISE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}.,;:：，。；~～\-—_=、$@`\"']+"
#: Terms of site furniture, in the order in which they are removed.
FURNITURE = ["首页", "字母", "下一页", "上一页", "网站", "加入书架", "投推荐票", "回目录", "txt下载", "TXT下载", "本小章还未完", "请点击下一页继续阅读后面精彩内容", "请点击继续阅读后面精彩内容"]
FURNITURE_MORE = [*FURNITURE[:10], "下载", *FURNITURE[10:]]
#: Terms of navigation and boilerplate lines.
NAVIGATION = ["序言", "前言", "后记", "自序", "序", "下一页", "上一页", "下一章", "上一章", "返回目录", "回到首页", "返回总目录", "返回", "本章完", "未完待续", "待续", "下回分解", "欲知后事", "且听下回分解", "第一卷", "第二卷", "第三卷", "第四卷"]
#: Chapter headers, chapter marks, and marks of a text that is no running prose.
HEADER = r"^第[0-9零一二三四五六七八九十百千]+[回章]|^第\p{Nd}+[回章]"
MARKS_COMMON = [
    (r"第[一二三四五六七八九十百千零0-9]+章[^。\n]{0,30}" + WS + "*"),
    (r"第[一二三四五六七八九十百千零0-9]+回[^。\n]{0,30}" + WS + "*"),
    (r"(?m)^第[0-9]+章" + WS + r"+[^\n]+\n"),
    (r"第[0-9]+回" + WS + r"+[^\n]+\n"),
    r"【第[^】]+】",
    r"（第[^）]+）",
]
MARKS_AUTHOR = [*MARKS_COMMON, r"话说[当且]?[时日]", r"却说", r"且说", r"再说", r"书接上回", r"欲知后事如何"]
MARKS_GENERIC = [*MARKS_COMMON, r"书接上回", r"欲知后事如何"]
UNSOUND = [
    r"第[一二三四五六七八九十百千0-9]+[章回节卷]", r"目" + WS + "*录", r"(前|后)?言", r"作者[:：]", r"https?://[^\x09-\x0d\x1c-\x20\x85\p{Z}]+", r"(八二|82|8\.2)小说网", r"(简|繁)体.*阅读",
    r"无弹窗", r"下一章|上一章|返回目录", r"且听下回分解", r"欲知.*如何|欲知后事", r"手机端.*阅读", r"&[\p{L}\p{N}_]+;",
]
META = [r"(?m)作者[:：][^\n]*?$", r"(?m)^[\x09-\x0d\x1c-\x20\x85\p{Z}]*第[一二三四五六七八九十百千0-9]+[章回节][^\n]*?$", r"(?i)https?://[^\x09-\x0d\x1c-\x20\x85\p{Z}]+"]
#: Letters that make an advertisement when they follow one another.
AD_SEQUENCES = ["小说txt", "小说天堂", "txt小说", "更新最快", "手打", "顶点小说", "笔趣阁", "飘天文学", "大学生小说网"]
AD_TERMS = ["小说网", "大学生"]


def java(pattern: str) -> str:
    """A pattern for Java's engine: line anchors at line feeds only."""
    return pattern.replace("(?m)", "(?md)")


@dataclass(frozen=True)
class AdRules:
    """Rules of advertisement lines; each can be exchanged, since some hit ordinary prose."""

    terms: list = field(default_factory=lambda: list(AD_TERMS))
    sequences: list = field(default_factory=lambda: list(AD_SEQUENCES))
    least_digits: int = 4

    @property
    def sequence_pattern(self) -> str:
        return "|".join(".*".join(re.escape(c) for c in s) for s in self.sequences)

    def is_ad(self, line: Column) -> Column:
        """Whether any rule holds; null for null."""
        plain = F.regexp_replace(F.translate(line, FULL, HALF), NOISE, "")
        low = F.lower(plain)
        term = "|".join(map(re.escape, self.terms))
        digits = strip(line).rlike(r"^\p{Nd}{%d,}\z" % self.least_digits)
        return (F.contains(low, F.lit("www")) & F.contains(low, F.lit("com"))) | line.rlike(term) | plain.rlike(term) | digits | low.rlike("(?s)" + self.sequence_pattern)


def drop_ad_lines(text: Column, rules: AdRules | None = None) -> Column:
    """``text`` without its advertisement lines."""
    rules = rules or AdRules()
    return F.array_join(F.filter(lines(text), lambda x: ~rules.is_ad(x)), "\n")


def is_header(line: Column) -> Column:
    return strip(line).rlike(HEADER)


def is_navigation(line: Column) -> Column:
    return strip(line).rlike("|".join(NAVIGATION))


def drop_opening(line: Column) -> Column:
    """Stripped, without a storyteller's opening."""
    return F.regexp_replace(strip(line), rf"^[话却且再]说{WS}*", "")


def drop_marks(text: Column, marks: list[str], blank: str = r"\n\n+") -> Column:
    """Chapter marks taken out one after another, runs of blank lines shortened, stripped."""
    for p in marks:
        text = F.regexp_replace(text, java(p), "")
    return strip(F.regexp_replace(text, blank, "\n\n"))


def drop_meta(text: Column) -> Column:
    """Author lines, chapter lines and addresses taken out, white space collapsed to single spaces."""
    text = F.replace(text, F.lit("\r"), F.lit("\n"))
    for p in META:
        text = F.regexp_replace(text, java(p), "")
    return strip(F.regexp_replace(text, WS + "+", " "))


def style_sample(text: Column, prefix: str = "### 语料\n### 正文\n") -> Column:
    """The cleaned text under a fixed heading; the empty string for an empty one."""
    body = drop_meta(text)
    return F.when(body != "", F.concat(F.lit(prefix), body)).otherwise("")


def is_sound(text: Column, least: int = 100, share: float = 0.7, letters: str = r"[\x{4e00}-\x{9fff}]") -> Column:
    """Long enough when stripped, free of ``UNSOUND`` patterns, and mostly of ``letters``."""
    bad = "(?id)" + "|".join(f"(?:{p})" for p in UNSOUND)
    return (F.length(strip(text)) >= least) & ~text.rlike(bad) & (F.regexp_count(text, F.lit(letters)) >= share * F.length(text))


def first_match(text: Column, table: dict[str, str]) -> Column:
    """The name of the first pattern of ``table`` that is found in the lower-case text; null if none is."""
    out = None
    for name, p in table.items():
        out = F.when(F.lower(text).rlike(p), name) if out is None else out.when(F.lower(text).rlike(p), name)
    return out
