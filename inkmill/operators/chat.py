"""Chat samples: dialects, prompts, and samples made from text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import fill_template, lead_summary, strip, two_piece_summary
from inkmill.operators.ranking import pick

#: Own wordings, all of them parameters.
RESTYLE = ["把这段白话写成旧体小说的样子：\n{text}", "换一种典雅的说法：\n{text}", "{text}\n\n请润色上文。", "照章回小说的笔法重写：\n{text}"]
ECHO = ["原样照录：\n{text}", "{text}\n\n一字不改，再说一遍。"]
SUMMARY = ["说说大意：\n{text}", "{text}\n\n用一两句话概括。"]
STRESS = ["改雅：\n{text}", "{text}\n（润色）"]
SYSTEMS = ["你是一位熟悉旧小说的编辑。", "你替人润色文字，不改情节。"]
#: System turns of annealed samples: a short one and an empty one.
QUIET_SYSTEMS = ["润色。", ""]


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def unified(conversations: Column, role: str = "role", content: str = "content") -> Column:
    """Turns as (role, content) with the roles system, assistant and user; a null content is empty.

    sys is system; gpt, bot and model are assistant; anything else, human and null included, is user.
    """
    def one(m: Column) -> Column:
        r = F.lower(strip(F.coalesce(m[role], F.lit(""))))
        name = F.when(r.isin("system", "sys"), "system").when(r.isin("assistant", "gpt", "bot", "model"), "assistant").otherwise("user")
        return F.struct(name.alias("role"), F.coalesce(m[content], F.lit("")).alias("content"))

    return F.transform(conversations, one)


def unified_column(df: DataFrame, name: str = "conversations") -> Column:
    """``unified`` where turns may have both pairs of field names: each turn says what it says in either."""
    fields = {f.name for f in df.schema[name].dataType.elementType.fields}
    either = lambda m, names: F.coalesce(*[m[n] for n in names if n in fields])
    turns = F.transform(F.col(name), lambda m: F.struct(either(m, ("role", "from")).alias("role"), either(m, ("content", "value")).alias("content")))
    return unified(turns)


def chat_prompt(turns: Column) -> Column:
    """All turns but the assistant's in chat markup, the assistant's turn opened."""
    shown = F.transform(F.filter(turns, lambda m: m["role"] != "assistant"), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>")))
    return F.array_join(F.concat(shown, F.array(F.lit("<|im_start|>assistant\n"))), "\n")


def chat_response(turns: Column) -> Column:
    """The last assistant turn, stripped and ended; null if there is none."""
    last = F.try_element_at(F.filter(turns, lambda m: m["role"] == "assistant"), F.lit(-1))
    return F.concat(strip(last["content"]), F.lit("<|im_end|>"))


def single_prompt(system: Column, user: Column) -> Column:
    return F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def to_from_value(system: Column, user: Column, assistant: Column) -> Column:
    """The from/value dialect."""
    return F.array(*[F.struct(F.lit(r).alias("from"), c.alias("value")) for r, c in (("system", system), ("human", user), ("gpt", assistant))])


def assistant_only(turns: Column, change) -> Column:
    """``change`` applied to non-empty assistant contents, other turns as they are."""
    return F.transform(turns, lambda m: F.when((m["role"] == "assistant") & (m["content"] != ""), F.struct(m["role"].alias("role"), change(m["content"]).alias("content"))).otherwise(m))


def restyle_samples(df: DataFrame, key: str, plain: str, styled: str, seed: int = 42, wordings: list[str] = RESTYLE, systems: list[str] = SYSTEMS) -> DataFrame:
    """(key, conversations): plain text in, styled text out, with a wording and a system turn picked by hash."""
    ask = fill_template(pick(wordings, f"{seed}w", F.col(key)), F.col(plain))
    return df.where((strip(F.col(plain)) != "") & (strip(F.col(styled)) != "")).select(F.col(key).alias("record_id"), messages(("system", pick(systems, f"{seed}s", F.col(key))), ("user", ask), ("assistant", F.col(styled))).alias("conversations"))


def echo_samples(df: DataFrame, key: str, plain: str, seed: int = 42, wordings: list[str] = ECHO) -> DataFrame:
    """The answer is the given text; ids end in ``_adversarial``."""
    ask = fill_template(pick(wordings, f"{seed}e", F.col(key)), F.col(plain))
    return df.where(strip(F.col(plain)) != "").select(F.concat(F.col(key), F.lit("_adversarial")).alias("record_id"), messages(("system", pick(SYSTEMS, f"{seed}s", F.col(key))), ("user", ask), ("assistant", F.col(plain))).alias("conversations"))


def summary_samples(df: DataFrame, key: str, plain: str, seed: int = 42, wordings: list[str] = SUMMARY) -> DataFrame:
    """The answer is the two-piece summary of the given text; ids end in ``_summary``."""
    ask = fill_template(pick(wordings, f"{seed}m", F.col(key)), F.col(plain))
    return df.where(strip(F.col(plain)) != "").select(F.concat(F.col(key), F.lit("_summary")).alias("record_id"), messages(("system", pick(SYSTEMS, f"{seed}s", F.col(key))), ("user", ask), ("assistant", two_piece_summary(F.col(plain)))).alias("conversations"))


def lead_samples(df: DataFrame, key: str, styled: str, seed: int = 42, wordings: list[str] = SUMMARY) -> DataFrame:
    """Negative samples: the styled text in, its lead summary out."""
    ask = fill_template(pick(wordings, f"{seed}n", F.col(key)), F.col(styled))
    return df.where(strip(F.col(styled)) != "").select(F.concat(F.col(key), F.lit("_negative")).alias("record_id"), messages(("system", F.lit(SYSTEMS[0])), ("user", ask), ("assistant", lead_summary(F.col(styled)))).alias("conversations"))


def styled_metadata(df: DataFrame, key: str, plain: str, styled: str, style: Column) -> DataFrame:
    """(key, conversations in from/value, metadata) with the lengths of both sides."""
    turns = to_from_value(F.concat(F.lit("风格："), style), F.col(plain), F.col(styled))
    return df.select(F.col(key), turns.alias("conversations"), F.struct(style.alias("style"), F.length(plain).alias("plain_length"), F.length(styled).alias("styled_length")).alias("metadata"))
