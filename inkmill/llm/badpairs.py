"""Defective prompt and response pairs: empty, refused, copied, in another language, or broken off.

A copy is a response that a zstandard dictionary made of its own prompt compresses to a fraction of its size. Refusals
are found by a dictionary of what is declined and how, in what the answerer says and not a character; languages by scripts
and per-language dictionaries; and breaking off by a terminal-context model: how often each run of closing signs ends a
response, counted over all responses. What was asked for (an echo, a summary) is read from the request's wording.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.hanfold import fold_pairs, to_simplified
from inkmill.llm.crosssplit import ANSWER, DISTANCE, USER, edit_distance, turn
from inkmill.llm.encoding import LANGUAGES
from inkmill.plans.lineage import cut
from inkmill.sources.tables import spread

#: A response is a copy if its prompt explains all but this share of its size, at about the prompt's length.
COPY_SIZE, COPY_LENGTH = 0.5, (0.8, 1.35)
#: A run of signs ends sentences if it ends responses at this share of the places where it stands, as a full stop does.
TERMINAL_RATE = 0.1
#: Signs that end a sentence by themselves, signs after which one always goes on, and what mostly closes where nothing is counted.
SENTENCE = set("。！？…!?.")
NEVER = set("，,、；;：:—–-─·・“‘「『（(【《〈〔[{<")
CLOSERS = set("”’」』\"'）)】》～~")
#: Signs of a context at most, and the share of all sign runs that a context needs to be counted by itself.
CONTEXT, LEAST_SHARE = 3, 0.0001
#: A line of a prompt this short, in letters, is a request's wording and not part of the text handed over.
WORDING = 24
#: How a task is declined, and what is declined.
DECLINE_ZH = re.compile(
    r"(?:无法|不能|不便|不会|不可以|没有?办法|不允许我?|(?:暂)?不支持|恕难|拒绝|不适合|无权)[^。！？\n，；]{0,4}(?:给予|继续|完成|协助|处理|回答|提供|生成|满足|改动|改写|润色|对|为|就|把|将|进行|执行|翻译|续写|帮)"
    r"[^。！？\n]{0,18}(?:改写|内容|请求|片段|问题|要求|版本|润色|任务|指令|文字|文本|翻译|创作|话题|服务|操作|协助|回答)"
    r"|(?:内容|请求|片段|问题|文字|文本|段落|话题|任务)(?:我|本助手|系统|目前|实在|恕|[，,]){0,3}(?:无法|不能|不便|不可以|没法)[^。！？\n，；]{0,4}(?:改写|改动|处理|完成|协助|回答|提供|生成|润色|翻译|续写|继续)"
    r"|作为(?:一[个名位款])?(?:大?语言模型|人工智能|AI|智能助手|聊天机器人|助手)[^。！？\n]{0,12}(?:不|无法|没)"
)
DECLINE_OTHER = re.compile(
    r"\b(?:i(?:'m| am) (?:sorry|afraid|unable|not able)|i (?:can(?:'t|not)|won't|will not|must decline|am not able)|as an ai\b|(?:this|your) request cannot|cannot (?:be completed|help|assist|fulfil|comply|process)|unable to (?:help|assist|process|rewrite|complete|comply)|under my guidelines|not able to (?:process|help|assist|rewrite|complete))"
    r"|je (?:suis désolée?|ne peux pas|regrette)[^.!?]{0,60}(?:demande|texte|contenu|aider|réécrire)|en tant qu['’](?:ia|assistant)"
    r"|(?:es tut mir leid|leider)[^.!?]{0,40}(?:kann|darf)[^.!?]{0,60}(?:nicht|keine)|als ki\b"
    r"|申し訳(?:ありません|ございません)|お手伝いできません|ご要望にはお応え|お応えできません|죄송(?:합니다|하지만)|도와드릴 수 없|처리할 수 없",
    re.IGNORECASE,
)
#: Sentences of a response, from either end, in which it may be declined.
REFUSAL_SENTENCES = 3
#: Pairs of quotation marks, and whose words or doings a sentence tells.
QUOTED = re.compile("“[^“”]*”|‘[^‘’]*’|「[^「」]*」|『[^『』]*』|\"[^\"\n]*\"")
SPEECH = re.compile("(?:[他她]们?|那[^，。的]{1,4})[^，。！？：:]{0,6}[说道问答喝叹笑曰称]")
SELF, THIRD = re.compile("我|本人|本助手|系统|模型|AI"), re.compile("[他她]|那(?:人|老|少|汉|道|女|妇|书|掌|店|船|捕|和|僧)|[说道问答喝叹笑曰][：:，,]?$")
#: A request to give the text back as it is, and one to say it in short.
ECHO = re.compile("原封不动|照原样|照抄|抄录|一个?字也?(?:别|不要|不)(?:动|改)|只需复述|勿作改动|原样(?:复述|返回|输出)|原文复述|一字不[改差动]")
SUMMARY = re.compile("概[述括要]|提要|大意|总结|归纳|摘要|梗概|主旨|要点|简述|(?:写|讲|说)了(?:什么|些什么|啥)|[一两]{1,2}句话|最短的话|讲清情节|缩写|简短地?(?:说|讲)|summar", re.IGNORECASE)
KANA, HANGUL, HAN = re.compile("[ぁ-ゖァ-ヺー]"), re.compile("[가-힣]"), re.compile("[㐀-䶵一-鿿\U00020000-\U0003ffff]")
OTHER_LETTER = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=1)
def _dictionaries() -> dict:
    import zstandard

    made = {}
    for name, sample in LANGUAGES.items():
        d = zstandard.ZstdCompressionDict(sample.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made[name] = zstandard.ZstdCompressor(dict_data=d)
    return made


def language(text: str) -> str:
    """The language of most of a text, sentence by sentence; a Han character weighs as much as three letters of a word."""
    weight: dict[str, float] = {}
    for part in re.split(r"(?<=[。！？!?\n…])|(?<=\.)\s", text):
        han, kana, hangul = len(HAN.findall(part)), len(KANA.findall(part)), len(HANGUL.findall(part))
        other = len(OTHER_LETTER.findall(part)) - han - kana - hangul
        if kana >= 2 and kana * 6 >= han:
            weight["ja"] = weight.get("ja", 0) + han + kana
        else:
            weight["zh"] = weight.get("zh", 0) + han
        weight["ko"] = weight.get("ko", 0) + hangul
        weight["western"] = weight.get("western", 0) + other / 3
    best = max(weight, key=weight.get) if weight and max(weight.values()) > 0 else ""
    if best != "western":
        return best
    data = text.encode()
    sizes = {name: len(tool.compress(data)) for name, tool in _dictionaries().items() if name in ("en", "fr", "de")}
    return min(sizes, key=sizes.get)


def is_refusal(text: str) -> bool:
    """Whether the answerer declines, in one of the first or last sentences and outside of quotation marks.

    What a character says within the story is quoted or told of a third person; a response that is quoted as a whole is
    the answerer's own.
    """
    outside, n = text, 1
    while n:
        outside, n = QUOTED.subn("。", outside)
    if not any(c.isalnum() for c in outside):
        outside = text
    parts = [x for x in re.split(r"(?<=[。！？!?\n])|(?<=\.)\s", outside) if any(c.isalnum() for c in x)]
    some = parts if len(parts) <= 2 * REFUSAL_SENTENCES else parts[:REFUSAL_SENTENCES] + parts[-REFUSAL_SENTENCES:]
    for part in some:
        if DECLINE_OTHER.search(part):
            return True
        m = DECLINE_ZH.search(part)
        if m:
            # Who declines stands in front of the negation.
            before = part[: m.start() + re.search("无法|不|没|恕|拒|无权|$", m.group()).start()]
            near = before[-8:]
            if not SPEECH.search(before) and (SELF.search(near) or not THIRD.search(near)):
                return True
    return False


def letters_of(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def passage_of(prompt: str) -> str:
    """A prompt without a short first or last line: the text handed over."""
    parts = [x for x in prompt.split("\n") if any(c.isalnum() for c in x)]
    if len(parts) > 1 and len(letters_of(parts[0])) <= WORDING:
        parts = parts[1:]
    if len(parts) > 1 and len(letters_of(parts[-1])) <= WORDING:
        parts = parts[:-1]
    return "\n".join(parts)


def wording_of(prompt: str) -> str:
    """What may be the request in a prompt: a short first or last line, or what stands before a colon in the first."""
    parts = [x for x in prompt.split("\n") if any(c.isalnum() for c in x)]
    if not parts:
        return ""
    first = parts[0] if len(letters_of(parts[0])) <= WORDING else re.match(f"[^：:—，。]{{0,{WORDING}}}[：:—]|", parts[0]).group()
    last = parts[-1] if len(parts) > 1 and len(letters_of(parts[-1])) <= WORDING else ""
    return f"{first}\n{last}"


def is_copy(prompt: str, response: str, whole: bool = False) -> bool:
    """Whether the prompt, as a dictionary, explains the response (both folded to letters); with ``whole``, all of it."""
    import zstandard

    if not prompt or not response or not (0.95 if whole else COPY_LENGTH[0]) <= len(response) / len(prompt) <= COPY_LENGTH[1]:
        return False
    if prompt == response:
        return True
    a, b = prompt.encode(), response.encode()
    plain = len(zstandard.ZstdCompressor(write_content_size=False).compress(b))
    d = zstandard.ZstdCompressionDict(a, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own = len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False).compress(b))
    return own <= COPY_SIZE * plain


def shown(text: str) -> str:
    """A text without characters that do not show, and without spaces."""
    return "".join(c for c in text if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Co"))


#: A run of signs.
SIGNS = re.compile(r"[^\w\s]+")


def closing(text: str) -> str:
    """The run of signs that closes a text, its last ``CONTEXT`` ones; a letter or digit if it ends in one, "" for an empty text."""
    tail = shown(text[-40:]) or shown(text)
    m = re.search(r"[^\w\s]+$", tail)
    return m.group()[-CONTEXT:] if m else tail[-1:]


def is_end(context: str, terminal: dict[str, bool]) -> bool:
    """Whether a closing context ends a sentence: by its last sign within what closes, or by the longest part of it that was counted."""
    if not context or context[-1].isalnum() or context[-1] in NEVER:
        return False
    if (context.rstrip("".join(CLOSERS)) or " ")[-1] in SENTENCE:
        return True
    for k in range(len(context), 0, -1):
        if context[-k:] in terminal:
            return terminal[context[-k:]]
    return context[-1] in CLOSERS


def defect(prompt: str, response: str | None, asks: bool, terminal: dict[str, bool], folds: dict) -> str | None:
    """The defect of a pair, None if it is sound. ``response`` is in Simplified script; ``asks``: the prompt words a request."""
    text = response or ""
    if not any(c.isalnum() for c in text):
        return "empty"
    if is_refusal(text):
        return "refusal"
    tongue = language(text)
    if tongue not in ("zh", ""):
        return "other_language"
    wording = wording_of(prompt) if asks else ""
    if not ECHO.search(wording):
        own = letters_of(text).translate(folds)
        whole, bare = (letters_of(x).translate(folds) for x in (prompt, passage_of(prompt)))
        if SUMMARY.search(wording):
            # A summary may consist of the text's own sentences: only the whole text, letter by letter, is a copy.
            most = int(DISTANCE * max(len(bare), len(own)))
            if is_copy(bare, own, True) and edit_distance(bare, own, most) <= most:
                return "copy"
        elif is_copy(bare, own) or is_copy(whole, own):
            return "copy"
    if is_end(closing(text), terminal):
        return None
    if not SENTENCE.intersection(text.strip()[:-1]) and not is_end(closing(prompt.split("\n")[0]), terminal) and not is_end(closing(prompt), terminal):
        return None  # neither side is punctuated
    return "truncated"


def pairs_of_style(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("record_key"), F.col("wuxia_text").alias("prompt"), F.col("vernacular_text").alias("response"), F.lit(False).alias("asks"))


def pairs_of_samples(df: DataFrame) -> DataFrame:
    """Prompt: the user's turn. Response: the last turn if it is the assistant's, else null."""
    last = F.try_element_at("conversations", F.lit(-1))
    response = F.when(F.lower(F.trim(last["role"])).isin(*ANSWER), last["content"])
    return df.select(F.col("record_id").alias("record_key"), turn(F.col("conversations"), USER).alias("prompt"), response.alias("response"), F.lit(True).alias("asks"))


def terminal_contexts(pairs: DataFrame) -> dict[str, bool]:
    """Whether each run of signs, of up to ``CONTEXT``, ends responses; counted over all distinct ones.

    A run counts by itself if it is ``LEAST_SHARE`` of all runs, so the table is small whatever the data, and the verdict
    is the same for a table ten times as large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ends = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    places.update(x[-CONTEXT:] for x in SIGNS.findall(t))
                    end = closing(t)
                    if end and not end.isalnum():
                        ends[end] += 1
        keys = list(places | ends)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([places[k] for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], names=["context", "places", "ends"])

    counted = cut(pairs.select("response").distinct().mapInArrow(run, "context string, places bigint, ends bigint"))
    # A run counts for its last signs, too.
    parts = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("context")), lambda k: F.right("context", k))).alias("context"), "places", "ends")
    sums = parts.groupBy("context").agg(F.sum("places").alias("places"), F.sum("ends").alias("ends"))
    total = counted.agg(F.sum("places").alias("total"))
    rows = sums.crossJoin(F.broadcast(total)).where(F.col("places") >= LEAST_SHARE * F.col("total")).select("context", "places", "ends").collect()
    return {c: e >= TERMINAL_RATE * p for c, p, e in rows}


def defects(style_pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_key, defect) of each defective pair of either table, one defect a record.

    In this order: ``empty`` (null, missing, or no letter or digit), ``refusal``, ``other_language``, ``copy``, ``truncated``.
    A null prompt copies nothing. Null keys are left out. A record delivered twice comes out once; of two differing
    deliveries the defect first in the alphabet. Rows are independent; only the result is shuffled.
    """
    spark = style_pairs.sparkSession
    pairs = pairs_of_style(style_pairs).unionByName(pairs_of_samples(samples)).where(F.col("record_key").isNotNull())
    shared = spark.sparkContext.broadcast((terminal_contexts(pairs), fold_pairs(spark)))
    ready: Column = to_simplified(spark, F.col("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminal, (a, b) = shared.value
        folds = str.maketrans(a, b)
        for batch in batches:
            keys, at, out = batch.column(0), [], []
            for i, (prompt, response, asks) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 4)))):
                found = defect(prompt or "", response, asks, terminal, folds)
                if found:
                    at.append(i)
                    out.append(found)
            if at:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(out)], names=["record_key", "defect"])

    judged = spread(pairs.withColumn("response", ready)).mapInArrow(run, "record_key string, defect string")
    return judged.groupBy("record_key").agg(F.min("defect").alias("defect"))
