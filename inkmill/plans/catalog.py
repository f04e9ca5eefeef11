"""The registered queries of the core and the SQL that says the same in a second engine.

Long texts are compared by md5. SQL is left out where it cannot say the operator (decoding, entities, script, sequential
budgets, generators, streams); those are tested on fixtures.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import rules, text
from inkmill.functions.hanfold import to_simplified
from inkmill.operators import chat, chunking, enrich, metrics, ranking, records, sequential, training
from inkmill.plans import pipelines
from inkmill.plans.lineage import shared_folder
from inkmill.sources import files, sinks
from inkmill.sources.tables import read_table, ship_package, spread
from inkmill.streaming import jobs

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship_package(spark)
            return f(spark, d)

        run.__name__ = f.__name__
        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict:
    return dict(_sql)


# -- SQL that recurs ------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return s.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{text.WS}+|{text.WS}+$', '', 'g')"


def _split(x: str) -> str:
    return f"string_split({x}, chr(10))"


def _chain(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{_q(p)}', '', 'g')"
    return x


def _drop(x: str, terms: list[str]) -> str:
    for t in terms:
        x = f"replace({x}, '{t}', '')"
    return x


def _unescape(x: str) -> str:
    for a, b in text.ENTITIES:
        x = f"replace({x}, '{_q(a)}', '{_q(b)}')"
    return x


def _target(x: str, target: int, ends: str, quotes: str = chunking.TARGET_QUOTES) -> str:
    got = f"regexp_extract_all({x}, '(?s).{{{target - 1},}}?[{ends}][{_q(quotes)}]*|.+', 0)"
    return f"list_filter(list_transform({got}, lambda y: {_strip('y')}), lambda y: y <> '')"


def _is_ad(x: str) -> str:
    r = rules.AdRules()
    plain = f"regexp_replace(translate({x}, '{rules.FULL}', '{rules.HALF}'), '{_q(rules.NOISE)}', '', 'g')"
    term = "|".join(r.terms)
    return (
        f"((contains(lower({plain}), 'www') AND contains(lower({plain}), 'com')) OR regexp_matches({x}, '{term}') OR regexp_matches({plain}, '{term}')"
        f" OR regexp_matches({_strip(x)}, '^\\p{{Nd}}{{{r.least_digits},}}$') OR regexp_matches(lower({plain}), '(?s){r.sequence_pattern}'))"
    )


def _without_ads(x: str) -> str:
    return f"array_to_string(list_filter({_split(x)}, lambda l: NOT {_is_ad('l')}), chr(10))"


def _marks(x: str, marks: list[str], blank: str) -> str:
    return _strip(f"regexp_replace({_chain(x, marks)}, '{blank}', chr(10) || chr(10), 'g')")


def _sentences(x: str) -> str:
    e = chunking.SENTENCE_ENDS
    return f"CASE WHEN {x} = '' THEN [] WHEN NOT regexp_matches({x}, '[^{e}][{e}]') THEN [{x}] ELSE regexp_extract_all({x}, '[^{e}]*[{e}]+|[^{e}]+', 0) END"


def _hash(seed: str, key: str) -> str:
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


def _number(seed: str, key: str) -> str:
    return f"CAST('0x' || substr({_hash(seed, key)}, 1, 8) AS BIGINT)"


def _pick(options: list[str], seed: str, key: str) -> str:
    listed = ", ".join("'" + _q(o) + "'" for o in options)
    return f"list_extract([{listed}], CAST({_number(seed, key)} % {len(options)} + 1 AS INT))"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text", "source"))


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """One delivery per chunk id (the least row), with its number in the file as ``seq``."""
    rows = read_table(spark, d, "chunks").groupBy("id").agg(F.min(F.struct("author", "source_file", "text")).alias("r")).select("id", "r.*")
    return rows.withColumn("seq", F.regexp_extract("id", "_([0-9]+)$", 1).try_cast("bigint"))


_CHUNKS = "c AS (SELECT id, author, source_file, text, TRY_CAST(regexp_extract(id, '_([0-9]+)$', 1) AS BIGINT) AS seq FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY author NULLS FIRST, source_file NULLS FIRST, text NULLS FIRST) = 1)"
#: The book of a chunk: its file, or what its id says before the number where no file is named.
_BOOK = "coalesce(source_file, regexp_replace(id, '_[0-9]+$', ''))"


def _books(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_file", F.coalesce("source_file", F.regexp_replace("id", "_[0-9]+$", "")))


def _pair_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "style_pairs").groupBy("id").agg(F.min(F.struct(F.col("wuxia_text").alias("styled"), F.col("vernacular_text").alias("plain"))).alias("r")).select("id", "r.*")
    return rows.where((text.strip(F.col("styled")) != "") & (text.strip(F.col("plain")) != ""))


_PAIRS = f"p AS (SELECT * FROM (SELECT id, wuxia_text AS styled, vernacular_text AS plain FROM style_pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY wuxia_text NULLS FIRST, vernacular_text NULLS FIRST) = 1) WHERE {_strip('styled')} <> '' AND {_strip('plain')} <> '')"


def _turn_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "training_samples").select("record_id", chat.unified(F.col("conversations")).alias("turns")).where(F.col("turns").isNotNull()).distinct()
    return rows


_ROLE = "lower(" + _strip("coalesce(m.role, '')") + ")"
_TURNS = (
    "t AS (SELECT DISTINCT record_id, list_transform(conversations, lambda m: struct_pack(role := CASE WHEN "
    f"{_ROLE} IN ('system', 'sys') THEN 'system' WHEN {_ROLE} IN ('assistant', 'gpt', 'bot', 'model') THEN 'assistant' ELSE 'user' END, content := coalesce(m.content, ''))) AS turns"
    " FROM training_samples WHERE conversations IS NOT NULL)"
)
_PROMPT = "array_to_string(list_concat(list_transform(list_filter(turns, lambda m: m.role <> 'assistant'), lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>'), ['<|im_start|>assistant' || chr(10)]), chr(10))"
_LAST = "list_extract(list_filter(turns, lambda m: m.role = 'assistant'), -1).content"
_RESPONSE = _strip(_LAST) + " || '<|im_end|>'"


# -- splitting and chunking -----------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, format('{{}}_{{}}', doc_id, i) AS chunk_id, length(c) AS n_chars, md5(c) AS chunk_md5
    FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_target('text', 800, chunking.TARGET_ENDS)} AS l FROM documents WHERE text IS NOT NULL))""")
def chunk_fixed_target(spark, d):
    rows = chunking.numbered(_documents(spark, d), chunking.target_chunks(F.col("text")), ["doc_id"], base=1)
    return rows.select("doc_id", F.format_string("%d_%d", "doc_id", "chunk_no").alias("chunk_id"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"""WITH c AS (SELECT source, length(unnest({_target('text', 800, chunking.TARGET_ENDS)})) AS n FROM documents WHERE text IS NOT NULL)
    SELECT source, count(*) AS n, min(n) AS shortest, max(n) AS longest, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean, list_sort(list(n))[CAST(count(*) // 2 + 1 AS INT)] AS median FROM c GROUP BY source""")
def chunk_length_stats(spark, d):
    rows = _documents(spark, d).select("source", F.explode(chunking.target_chunks(F.col("text"))).alias("c"))
    return metrics.length_stats(rows.select("source", F.length("c").cast("bigint").alias("n_chars")), "source", "n_chars")


@query(f"SELECT doc_id, i - 1 AS seq, length(s) AS n_chars, md5(s) AS md5 FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents WHERE text IS NOT NULL))")
def sentence_split(spark, d):
    rows = chunking.numbered(_documents(spark, d), chunking.sentences(F.col("text")), ["doc_id"], "s")
    return rows.select("doc_id", F.col("s_no").cast("bigint").alias("seq"), F.length("s").cast("bigint").alias("n_chars"), F.md5("s").alias("md5"))


def _greedy(body: str) -> str:
    """CTEs that end in k (doc_id, chunk_no, chunk): sentences of ``body`` gathered up to 800 characters."""
    return f"""s AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_sentences('text')} AS l FROM (SELECT doc_id, {body} AS text FROM documents WHERE text IS NOT NULL))),
    r AS (SELECT doc_id, i, x, length(x) AS n, 0 AS g FROM s WHERE i = 1
        UNION ALL SELECT s.doc_id, s.i, s.x, CASE WHEN r.n + length(s.x) > 800 THEN length(s.x) ELSE r.n + length(s.x) END, CASE WHEN r.n + length(s.x) > 800 THEN r.g + 1 ELSE r.g END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
    k AS (SELECT doc_id, CAST(g AS BIGINT) AS chunk_no, string_agg(x, '' ORDER BY i) AS chunk FROM r GROUP BY doc_id, g)"""


@query(f"WITH RECURSIVE {_greedy('text')} SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM k")
def greedy_accumulate(spark, d):
    rows = sequential.greedy_rows(spread(read_table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return rows.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


_LOSSY = f"([^{_q(chunking.LOSSY_ENDS)}]+)([{_q(chunking.LOSSY_ENDS)}]?)"


@query(f"""WITH s AS (SELECT doc_id, {_strip('unnest(b)')} AS body, unnest(e) AS ending, generate_subscripts(b, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_LOSSY}', 1) AS b, regexp_extract_all(text, '{_LOSSY}', 2) AS e FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, md5(body || ending) AS md5 FROM s WHERE body <> ''""")
def sentence_split_lossy(spark, d):
    rows = chunking.numbered(_documents(spark, d), chunking.lossy_sentences(F.col("text")), ["doc_id"], "s")
    return rows.select("doc_id", F.col("s_no").cast("bigint").alias("seq"), F.md5("s").alias("md5"))


_NORMAL = f"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '{text.LINE_ENDS}'), lambda l: {_strip('l')}), lambda l: l <> ''), chr(10))"
_QUOTE_LEAD = f"'^(?:[{_q(chunking.QUOTES)}]{text.WS}*)+'"


def _budget(body: str) -> str:
    """CTEs that end in k (doc_id, chunk_no, chunk): sentences of ``body`` gathered under a budget of 512 characters."""
    return f"""t AS (SELECT doc_id, {body} AS text FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, {_strip('unnest(b)')} AS body, unnest(e) AS ending, generate_subscripts(b, 1) AS j FROM (SELECT doc_id, regexp_extract_all(text, '{_LOSSY}', 1) AS b, regexp_extract_all(text, '{_LOSSY}', 2) AS e FROM t)),
    s AS MATERIALIZED (SELECT doc_id, body || ending AS x, length(body || ending) AS n, right(body || ending, 1) IN ({", ".join("'" + _q(c) + "'" for c in chunking.CLOSING)}) AS closed, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM l WHERE body <> ''),
    r AS (SELECT doc_id, i, CAST(1 AS BIGINT) AS g, CASE WHEN n > 512 THEN 0 ELSE n END AS held, closed, n > 512 AS done FROM s WHERE i = 1
        UNION ALL SELECT s.doc_id, s.i, r.g + CASE WHEN r.done OR s.n > 512 OR (r.held + s.n > 512 AND r.closed) THEN 1 ELSE 0 END,
            CASE WHEN s.n > 512 OR (NOT r.done AND r.held + s.n > 512 AND NOT r.closed) THEN 0 WHEN r.done OR r.held + s.n > 512 THEN s.n ELSE r.held + s.n END, s.closed, s.n > 512 OR (NOT r.done AND r.held + s.n > 512 AND NOT r.closed)
        FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
    w AS (SELECT r.doc_id, r.g, string_agg(s.x, '' ORDER BY r.i) AS x, max(s.n) > 512 AS sliced FROM r JOIN s USING (doc_id, i) GROUP BY 1, 2),
    p AS (SELECT doc_id, g, unnest(k) AS x, generate_subscripts(k, 1) AS h FROM (SELECT doc_id, g, CASE WHEN sliced THEN regexp_extract_all(x, '(?s).{{1,512}}', 0) ELSE [x] END AS k FROM w)),
    q AS (SELECT doc_id, {_strip('x')} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY g, h) AS o FROM p WHERE {_strip('x')} <> ''),
    v AS (SELECT doc_id, o, CASE WHEN o > 1 THEN regexp_extract(x, {_QUOTE_LEAD}) ELSE '' END AS lead, x FROM q),
    y AS (SELECT doc_id, o, regexp_replace(lead, '{text.WS}', '', 'g') AS lead, substr(x, length(lead) + 1) AS rest FROM v),
    z AS (SELECT *, sum(CASE WHEN rest <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o) AS own FROM y),
    u AS (SELECT doc_id, own AS c, o, 1 AS later, rest AS x FROM z WHERE rest <> '' UNION ALL SELECT doc_id, own - CASE WHEN rest <> '' THEN 1 ELSE 0 END, o, 2, lead FROM z WHERE lead <> ''),
    k AS (SELECT doc_id, CAST(c - 1 AS INT) AS chunk_no, string_agg(x, '' ORDER BY o, later) AS chunk FROM u GROUP BY doc_id, c)"""


@query(f"WITH RECURSIVE {_budget(_NORMAL)} SELECT doc_id, chunk_no, CAST(length(chunk) AS INT) AS n_chars, md5(chunk) AS chunk_md5 FROM k")
def token_chunk(spark, d):
    rows = spread(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize_lines(F.col("text")).alias("text"))
    rows = sequential.budget_rows(rows, "doc_id", "text")
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


#: A public tokenizer for the queries; a path, like any other.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query()
def token_chunk_bpe(spark, d):
    rows = spread(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize_lines(F.col("text")).alias("text"))
    rows = sequential.budget_rows(rows, "doc_id", "text", 512, *sequential.library_tokenizer(TOKENIZER))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, i - 1 AS part_no, length(p) AS n_chars, md5(p) AS md5 FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,512}', 0) AS l FROM documents WHERE text IS NOT NULL))")
def force_split(spark, d):
    rows = chunking.numbered(_documents(spark, d), chunking.forced_chunks(F.col("text")), ["doc_id"], "part")
    return rows.select("doc_id", F.col("part_no").cast("bigint").alias("part_no"), F.length("part").cast("bigint").alias("n_chars"), F.md5("part").alias("md5"))


_KEPT = f"list_filter({_split('text')}, lambda l: {_strip('l')} <> '' AND NOT regexp_matches({_strip('l')}, '{rules.HEADER}') AND NOT regexp_matches({_strip('l')}, '{'|'.join(rules.NAVIGATION)}'))"
_OPENED = "regexp_replace(" + _strip("l") + f", '^[话却且再]说{text.WS}*', '')"


@query(f"""WITH {_CHUNKS}, l AS (SELECT id, {_target(f"array_to_string(list_transform({_KEPT}, lambda l: {_OPENED}), '')", 200, chunking.TARGET_ENDS_ZH)} AS l FROM c WHERE text IS NOT NULL)
    SELECT id, i AS chunk_no, length(x) AS n_chars, md5(x) AS md5 FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l)""")
def line_pipeline(spark, d):
    rows = chunking.numbered(_chunk_rows(spark, d), chunking.line_pipeline(F.col("text"), 200), ["id"], base=1)
    return rows.select("id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("md5"))


@query("""SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '_' || lpad(CAST(i - 1 AS VARCHAR), 5, '0') AS id, md5(x) AS md5 FROM (SELECT doc_id, i, """ + _strip("x") + """ AS x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))) WHERE length(x) >= 10""")
def chunk_ids(spark, d):
    rows = sinks.chunk_records(read_table(spark, d, "documents"), text.lines(F.col("text")), F.format_string("doc_%07d", "doc_id"))
    return rows.select("id", F.md5("chunk").alias("md5"))


# -- cleaning -------------------------------------------------------------------------------------------------------


_JOINED = f"array_to_string(list_transform(list_filter(list_transform({_split('text')}, lambda l: {_strip('l')}), lambda l: l <> ''), lambda l: CASE WHEN ends_with(l, '。') THEN l || chr(10) ELSE l END), '')"


@query(f"SELECT doc_id, md5(regexp_replace({_JOINED}, chr(10) || '$', '')) AS md5 FROM documents WHERE text IS NOT NULL")
def hard_wrap_merge(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(text.hard_wrap_merge(F.col("text"))).alias("md5"))


@query(f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '{text.LINE_ENDS}'), lambda l: {_strip('l')}), lambda l: l <> ''), chr(10))) AS md5 FROM documents WHERE text IS NOT NULL""")
def normalize_lines(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(text.normalize_lines(F.col("text"))).alias("md5"))


@query(f"WITH {_CHUNKS} SELECT id, md5(regexp_replace({_drop('text', rules.FURNITURE)}, '[a-zA-Z]', '', 'g')) AS md5 FROM c WHERE text IS NOT NULL")
def remove_terms(spark, d):
    return _chunk_rows(spark, d).where("text is not null").select("id", F.md5(text.remove_terms(F.col("text"), rules.FURNITURE)).alias("md5"))


_TURNED = "array_to_string(list_transform(string_split({x}, '{m}'), lambda y, i: CASE WHEN i = 1 THEN y WHEN i % 2 = 0 THEN '{a}' || y ELSE '{b}' || y END), '')"
_MORE = f"regexp_replace({_drop('text', rules.FURNITURE_MORE)}, '[a-zA-Z]', '', 'g')"


@query(f"SELECT doc_id, md5({_TURNED.format(x=_TURNED.format(x=_MORE, m=chr(34), a='“', b='”'), m=chr(39) * 2, a='‘', b='’')}) AS md5 FROM documents WHERE text IS NOT NULL")
def curl_quotes(spark, d):
    t = text.remove_terms(F.col("text"), rules.FURNITURE_MORE)
    t = text.curl_quotes(text.curl_quotes(t, '"', "“", "”"), "'", "‘", "’")
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(t).alias("md5"))


@query(f"""WITH {_CHUNKS}, l AS (SELECT id, unnest({_split('text')}) AS line, unnest(range(1, len({_split('text')}) + 1)) AS line_no FROM c WHERE text IS NOT NULL)
    SELECT id, CAST(line_no AS BIGINT) AS line_no, md5(line) AS md5 FROM l WHERE {_is_ad('line')}""")
def ad_lines(spark, d):
    lines = _chunk_rows(spark, d).select("id", F.posexplode(text.lines(F.col("text"))).alias("at", "line"))
    return lines.where(rules.AdRules().is_ad(F.col("line"))).select("id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.md5("line").alias("md5"))


@query(f"WITH {_CHUNKS} SELECT id, md5({_without_ads(_unescape('text'))}) AS md5 FROM c WHERE text IS NOT NULL")
def ad_line_filter(spark, d):
    return _chunk_rows(spark, d).where("text is not null").select("id", F.md5(rules.drop_ad_lines(text.unescape_common(F.col("text")))).alias("md5"))


_CLEANED = _without_ads("text")


@query(f"""WITH {_CHUNKS}, b AS (SELECT text AS a, {_CLEANED} AS z FROM c WHERE text IS NOT NULL)
    SELECT count(*) AS records, count(*) FILTER (a <> z) AS changed, CAST(sum(CASE WHEN a <> z THEN len({_split('a')}) - CASE WHEN z = '' THEN 0 ELSE len({_split('z')}) END ELSE 0 END) AS BIGINT) AS removed_lines FROM b""")
def clean_stats(spark, d):
    return metrics.clean_stats(_chunk_rows(spark, d).where("text is not null"), F.col("text"), rules.drop_ad_lines(F.col("text")))


@query(f"WITH {_CHUNKS} SELECT id, md5({_marks('text', rules.MARKS_AUTHOR, '\\n\\n+')}) AS author_md5, md5({_marks('text', rules.MARKS_GENERIC, '\\n{3,}')}) AS generic_md5 FROM c WHERE text IS NOT NULL")
def chapter_marks(spark, d):
    a, b = rules.drop_marks(F.col("text"), rules.MARKS_AUTHOR), rules.drop_marks(F.col("text"), rules.MARKS_GENERIC, r"\n{3,}")
    return _chunk_rows(spark, d).where("text is not null").select("id", F.md5(a).alias("author_md5"), F.md5(b).alias("generic_md5"))


#: Invented lines: headers, navigation, openings, and prose that trips a rule.
LINE_FIXTURE = ["第十二回 夜渡", "  第3章　归途", "第二卷 風起", "序", "返回目录", "未完待续", "话说当夜", "却说那人", "　　再说 三日后", "他序了齿，方才落座。", "ｗｗｗ．某站．ｃｏｍ", "小-说 天.堂", "12345", "123", "手头无钱，只得打了欠条。", "", "正文一行。", "大学生读书", "更 新 最 快"]
_FIXTURE_SQL = ", ".join(f"('{_q(x)}')" for x in LINE_FIXTURE)


@query(f"""WITH {_CHUNKS}, v AS (SELECT DISTINCT unnest({_split('text')}) AS line FROM c WHERE text IS NOT NULL UNION SELECT * FROM (VALUES {_FIXTURE_SQL}) w(line))
    SELECT md5(line) AS line_md5, regexp_matches({_strip('line')}, '{rules.HEADER}') AS header, regexp_matches({_strip('line')}, '{"|".join(rules.NAVIGATION)}') AS navigation, {_is_ad('line')} AS ad,
    regexp_replace({_strip('line')}, '^[话却且再]说{text.WS}*', '') AS opened FROM v""")
def line_rules(spark, d):
    """Every different line of the table, and the invented ones."""
    rows = _chunk_rows(spark, d).select(F.explode(text.lines(F.col("text"))).alias("line")).union(spark.createDataFrame([(x,) for x in LINE_FIXTURE], "line string")).distinct()
    x = F.col("line")
    return rows.select(F.md5("line").alias("line_md5"), rules.is_header(x).alias("header"), rules.is_navigation(x).alias("navigation"), rules.AdRules().is_ad(x).alias("ad"), rules.drop_opening(x).alias("opened"))


_BODY = _strip(f"regexp_replace({_chain('replace(text, chr(13), chr(10))', rules.META)}, '{text.WS}+', ' ', 'g')")


@query(f"SELECT doc_id, md5({_BODY}) AS body_md5, length(CASE WHEN {_BODY} <> '' THEN '### 语料' || chr(10) || '### 正文' || chr(10) || {_BODY} ELSE '' END) AS sample_chars FROM documents WHERE text IS NOT NULL")
def meta_strip(spark, d):
    t = F.col("text")
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(rules.drop_meta(t)).alias("body_md5"), F.length(rules.style_sample(t)).cast("bigint").alias("sample_chars"))


_BAD = "(?i)" + "|".join(f"(?:{p})" for p in rules.UNSOUND)


@query(f"SELECT doc_id, length({_strip('text')}) >= 100 AND NOT regexp_matches(text, '{_q(_BAD)}') AND len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 0.7 * length(text) AS sound FROM documents WHERE text IS NOT NULL")
def valid_text(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", rules.is_sound(F.col("text")).alias("sound"))


_MARKED = _marks("text", rules.MARKS_AUTHOR, "\\n\\n+")


@query(f"""WITH {_CHUNKS}, m AS (SELECT id, length(text) AS original_length, length({_MARKED}) AS cleaned_length FROM c WHERE text IS NOT NULL)
    SELECT * FROM m WHERE cleaned_length BETWEEN 500 AND 1500""")
def length_band(spark, d):
    n = F.length(rules.drop_marks(F.col("text"), rules.MARKS_AUTHOR)).cast("bigint")
    return _chunk_rows(spark, d).select("id", F.length("text").cast("bigint").alias("original_length"), n.alias("cleaned_length")).where(F.col("cleaned_length").between(500, 1500))


#: Escaped texts and what they say: named, decimal and hexadecimal, without a semicolon, a line feed, an escaped escape, no entity.
ENTITY_FIXTURE = [("&lt;甲&gt;&amp;&quot;&#39;", "<甲>&\"'"), ("&#20057;&#x4E59;", "乙乙"), ("&lt甲&copy", "<甲©"), ("&#10;行", "\n行"), ("&amp;lt;", "&lt;"), ("A & B &无;", "A & B &无;"), ("&hellip;&mdash;&ldquo;&rdquo;", "…—“”")]


@query("SELECT DISTINCT id, md5(replace(text, '&nbsp;', chr(160))) AS md5 FROM chunks WHERE contains(text, '&') AND NOT regexp_matches(replace(text, '&nbsp;', ''), '&#?[0-9a-zA-Z]+') UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{i}', md5('{_q(b)}'))" for i, (_, b) in enumerate(ENTITY_FIXTURE)) + ") v(id, md5)")
def html_unescape(spark, d):
    rows = read_table(spark, d, "chunks").select("id", "text").distinct().where(F.contains("text", F.lit("&")))
    rows = rows.union(spark.createDataFrame([(str(i), a) for i, (a, _) in enumerate(ENTITY_FIXTURE)], "id string, text string"))
    return rows.select("id", F.md5(text.html_unescape(F.col("text"))).alias("md5"))


@query()
def traditional_to_simplified(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(to_simplified(spark, F.col("text"))).alias("md5"), F.md5(records.sanitized(spark, F.col("text"))).alias("sanitized_md5"))


@query()
def decode_fallback(spark, d):
    rows = read_table(spark, d, "raw_files").select("path", files.decoded(F.col("content"), files.CODECS_WIDE).alias("d"))
    return rows.select("path", "d.encoding", F.length("d.text").alias("n_chars"), F.md5("d.text").alias("md5"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'utf-16' WHEN doc_id % 3 = 1 AND regexp_matches(text, '[^\\x00-\\x7f]') THEN 'gb18030' ELSE 'utf-8' END AS encoding, length(text) AS n_chars, md5(text) AS md5
    FROM documents WHERE length(text) > 0""")
def decode_codecs(spark, d):
    """The documents written in three encodings and decoded without being told which."""
    @F.pandas_udf("binary")
    def national(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.encode("gb18030"))

    rows = _documents(spark, d).where("length(text) > 0")
    content = F.when(F.col("doc_id") % 3 == 2, F.encode("text", "UTF-16")).when(F.col("doc_id") % 3 == 1, national("text")).otherwise(F.encode("text", "UTF-8"))
    rows = rows.select("doc_id", files.decoded(content).alias("d"))
    return rows.select("doc_id", "d.encoding", F.length("d.text").cast("bigint").alias("n_chars"), F.md5("d.text").alias("md5"))


# -- across records -------------------------------------------------------------------------------------------------


_Q = records.REPAIR_QUOTES.replace("'", "''")


def _shifted(book: str, body: str) -> str:
    return f"""WITH {_CHUNKS.replace("c AS (", "b AS (", 1)}, c AS (SELECT id, {book} AS source_file, seq, {body} AS text FROM b),
    f AS (SELECT source_file, min(seq) AS first FROM c WHERE length({_strip('text')}) >= 5 GROUP BY 1),
    m AS (SELECT c.id, c.source_file, c.seq, c.text, CASE WHEN c.seq > f.first THEN regexp_extract(c.text, '^{text.WS}*(?:[{_Q}]{text.WS}*)+') ELSE '' END AS moved FROM c JOIN f ON c.source_file = f.source_file WHERE c.seq >= f.first AND c.text IS NOT NULL),
    r AS (SELECT *, substr(text, length(moved) + 1) AS rest, length({_strip('substr(text, length(moved) + 1)')}) >= 5 AS keep FROM m),
    t AS (SELECT *, max(CASE WHEN keep THEN seq END) OVER (PARTITION BY source_file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM r),
    g AS (SELECT source_file, target, string_agg(regexp_replace(moved, '{text.WS}', '', 'g'), '' ORDER BY seq) AS given FROM t WHERE moved <> '' AND target IS NOT NULL GROUP BY 1, 2)
    SELECT t.id, md5(t.rest || coalesce(g.given, '')) AS md5 FROM t LEFT JOIN g ON g.source_file = t.source_file AND g.target = t.seq WHERE t.keep"""


@query(_shifted(_BOOK, "text"))
def quote_shift(spark, d):
    return records.shift_quotes(_books(_chunk_rows(spark, d)), "source_file", "seq").select("id", F.md5("text").alias("md5"))


@query(f"""WITH {_CHUNKS}, n AS (SELECT * REPLACE ({_BOOK} AS source_file), (row_number() OVER (PARTITION BY {_BOOK} ORDER BY seq, id) - 1) // 3 AS part FROM c)
    SELECT source_file, CAST(part AS BIGINT) AS part, count(*) AS merged_count, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY seq, id) FILTER (text <> ''), '')) AS md5, string_agg(id, '|' ORDER BY seq, id) AS ids FROM n GROUP BY 1, 2""")
def merge_every_n(spark, d):
    rows = _books(_chunk_rows(spark, d)).withColumn("book", F.col("source_file"))
    out = records.merge_every(rows, 3, "book", "seq", F.lit("part"))
    return out.select(F.col("book").alias("source_file"), "part", F.col("merged_count").cast("bigint").alias("merged_count"), F.md5("text").alias("md5"), F.array_join("merged_from", "|").alias("ids"))


@query("""WITH u AS (SELECT 'chunks' AS dataset, id FROM chunks WHERE author IN ('Yanbeike', 'Weizhou') UNION ALL SELECT 'pairs', id FROM style_pairs UNION ALL SELECT 'records', id FROM combined_records)
    SELECT coalesce(dataset, 'total') AS dataset, count(*) AS records FROM u GROUP BY ROLLUP(dataset)""")
def union_tagged(spark, d):
    chunks = read_table(spark, d, "chunks").where(F.col("author").isin("Yanbeike", "Weizhou"))
    rows = records.tagged_union({"chunks": chunks.select("id"), "pairs": read_table(spark, d, "style_pairs").select("id"), "records": read_table(spark, d, "combined_records").select("id")})
    return rows.rollup("dataset").agg(F.count("*").alias("records")).select(F.coalesce("dataset", F.lit("total")).alias("dataset"), "records")


@query("""SELECT DISTINCT id, coalesce(author, '') AS author, source_file, md5(text) AS md5, dataset, array_to_string(coalesce(merged_from, []), '|') AS merged_from, CAST(coalesce(merged_count, len(coalesce(merged_from, []))) AS BIGINT) AS merged_count FROM combined_records""")
def uniform_fields(spark, d):
    rows = records.uniform(read_table(spark, d, "combined_records"))
    return rows.select("id", "author", "source_file", F.md5("text").alias("md5"), "dataset", F.array_join("merged_from", "|").alias("merged_from"), F.col("merged_count").cast("bigint").alias("merged_count")).distinct()


@query("SELECT DISTINCT id FROM chunks WHERE author IS DISTINCT FROM 'Gufan' AND id NOT IN (SELECT id FROM style_pairs WHERE id IS NOT NULL)")
def anti_join_resume(spark, d):
    chunks = read_table(spark, d, "chunks").where(~F.col("author").eqNullSafe("Gufan"))
    return records.remaining(chunks, read_table(spark, d, "style_pairs")).select("id").distinct()


#: Invented classes of the test corpus.
STYLES = {"serial": "ruoye|serial", "volumes": "lanting|vols", "scans": "press|scan", "hall": "wuxia"}
_STYLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(dataset, '') || ' ' || coalesce(source_file, '')), '{p}') THEN '{n}'" for n, p in STYLES.items()) + " END"


@query(f"SELECT DISTINCT id, {_STYLE} AS style FROM combined_records")
def classify_source(spark, d):
    rows = read_table(spark, d, "combined_records")
    return rows.select("id", rules.first_match(F.concat(F.coalesce("dataset", F.lit("")), F.lit(" "), F.coalesce("source_file", F.lit(""))), STYLES).alias("style")).distinct()


#: Production sizes; a style with fewer sound records is taken whole.
QUOTAS = {"serial": 2400, "volumes": 1800, "scans": 900, "hall": 900}
_QUOTA = "CASE style " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items()) + " END"


@query(f"""WITH s AS (SELECT id, min({_STYLE}) AS style FROM combined_records GROUP BY id), r AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY {_hash('42', 'id')}, id) AS n FROM s)
    SELECT id, style FROM r WHERE n <= {_QUOTA}""")
def quota_sample(spark, d):
    rows = read_table(spark, d, "combined_records")
    style = rules.first_match(F.concat(F.coalesce("dataset", F.lit("")), F.lit(" "), F.coalesce("source_file", F.lit(""))), STYLES)
    return ranking.quota_sample(rows.groupBy("id").agg(F.min(style).alias("style")), "style", "id", QUOTAS)


@query(f"WITH p AS (SELECT DISTINCT id FROM style_pairs), r AS (SELECT id, row_number() OVER (ORDER BY {_hash('42', 'id')}, id) AS n, (SELECT count(*) FROM p) AS c FROM p)"
       " SELECT id, CASE WHEN n <= c * 6 // 9 THEN 'train' WHEN n <= c * 7 // 9 THEN 'test_standard' WHEN n <= c * 8 // 9 THEN 'test_stress' ELSE 'test_adversarial' END AS part FROM r")  # fmt: skip
def split_train_test(spark, d):
    ids = read_table(spark, d, "style_pairs").select("id").distinct()
    total = ids.agg(F.count("*").alias("c"))
    n, c = F.col("position"), F.col("c")
    part = F.when(n <= F.floor(c * 6 / 9), "train").when(n <= F.floor(c * 7 / 9), "test_standard").when(n <= F.floor(c * 8 / 9), "test_stress").otherwise("test_adversarial")
    return ranking.hash_position(ids, "id", 42).crossJoin(F.broadcast(total)).select("id", part.alias("part"))


def _sample_sql(suffix: str, wordings: list[str], seed: str, answer: str, system: str, given: str = "plain") -> str:
    ask = f"replace({_pick(wordings, seed, 'id')}, '{{text}}', {given})"
    return f"WITH {_PAIRS} SELECT id || '{suffix}' AS record_id, md5({system}) AS system_md5, md5({ask}) AS user_md5, md5({answer}) AS answer_md5 FROM p"


def _sample_rows(rows: DataFrame) -> DataFrame:
    m = F.col("conversations")
    return rows.select("record_id", F.md5(m[0]["content"]).alias("system_md5"), F.md5(m[1]["content"]).alias("user_md5"), F.md5(m[2]["content"]).alias("answer_md5"))


_SYSTEM = _pick(chat.SYSTEMS, "42s", "id")
_TWO = f"list_filter(list_transform(list_concat(string_split(plain, '。'), string_split(plain, '！'), string_split(plain, '？')), lambda y: {_strip('y')}), lambda y: length(y) > 10)[1:2]"
_LEAD_T = _strip("styled")
_LEAD = "CASE " + " ".join(f"WHEN instr({_LEAD_T}, '{q}') BETWEEN 21 AND 100 THEN left(left({_LEAD_T}, instr({_LEAD_T}, '{q}')), 50)" for q in "。！？") + f" ELSE left({_LEAD_T}, 30) END"


@query(_sample_sql("", chat.RESTYLE, "42w", "styled", _SYSTEM))
def diversify_instruction(spark, d):
    return _sample_rows(chat.restyle_samples(_pair_rows(spark, d), "id", "plain", "styled"))


@query(_sample_sql("_adversarial", chat.ECHO, "42e", "plain", _SYSTEM))
def echo_samples(spark, d):
    return _sample_rows(chat.echo_samples(_pair_rows(spark, d), "id", "plain"))


@query(_sample_sql("_summary", chat.SUMMARY, "42m", f"'本段讲的是' || CASE WHEN len({_TWO}) > 0 THEN array_to_string({_TWO}, '。') || '。' ELSE left(plain, 50) || '。' END", _SYSTEM))
def summary_samples(spark, d):
    return _sample_rows(chat.summary_samples(_pair_rows(spark, d), "id", "plain"))


@query(_sample_sql("_negative", chat.SUMMARY, "42n", f"'本段讲的是' || {_LEAD} || '等事。'", f"'{chat.SYSTEMS[0]}'", "styled"))
def negative_samples(spark, d):
    return _sample_rows(chat.lead_samples(_pair_rows(spark, d), "id", "styled"))


@query(f"""WITH {_CHUNKS} SELECT id, md5(left(array_to_string(list_transform(list_filter(list_zip(l, range(0, len(l))), lambda z: z[2] % 3 = 0), lambda z: z[1]), '。'), 300)) AS md5 FROM (SELECT id, regexp_split_to_array(text, '[。！？]') AS l FROM c WHERE text IS NOT NULL)""")
def rule_simplify(spark, d):
    return _chunk_rows(spark, d).where("text is not null").select("id", F.md5(text.every_third(F.col("text"))).alias("md5"))


@query(f"WITH {_PAIRS} SELECT id, length(plain) AS plain_length, length(styled) AS styled_length, md5('风格：wuxia' || '|' || plain || '|' || styled) AS md5, round(length(styled) / length(plain), 6) AS ratio FROM p")
def stage_two_samples(spark, d):
    rows = chat.styled_metadata(_pair_rows(spark, d), "id", "plain", "styled", F.lit("wuxia"))
    m = F.col("conversations")
    joined = F.concat_ws("|", m[0]["value"], m[1]["value"], m[2]["value"])
    rows = rows.select("id", m[1]["value"].alias("plain"), m[2]["value"].alias("styled"), F.col("metadata.plain_length").cast("bigint").alias("plain_length"), F.col("metadata.styled_length").cast("bigint").alias("styled_length"), F.md5(joined).alias("md5"))
    return enrich.length_ratio(rows, "plain", "styled").drop("plain", "styled")


# -- chat -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_TURNS}, e AS (SELECT DISTINCT record_id, unnest(turns) AS m, generate_subscripts(turns, 1) AS i FROM t) SELECT record_id, i - 1 AS turn, m.role AS role, md5(m.content) AS md5 FROM e")
def conv_normalize(spark, d):
    rows = _turn_rows(spark, d).select("record_id", F.posexplode("turns").alias("turn", "m"))
    return rows.select("record_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.md5("m.content").alias("md5")).distinct()


@query(f"WITH {_TURNS} SELECT DISTINCT record_id, md5({_PROMPT}) AS prompt_md5, md5({_RESPONSE}) AS response_md5 FROM t")
def chatml_prompt(spark, d):
    return _turn_rows(spark, d).select("record_id", F.md5(chat.chat_prompt(F.col("turns"))).alias("prompt_md5"), F.md5(chat.chat_response(F.col("turns"))).alias("response_md5")).distinct()


@query(f"WITH {_PAIRS} SELECT id, md5('<|im_start|>system' || chr(10) || '按原意改写。' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || plain || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS md5 FROM p")
def single_turn_prompt(spark, d):
    return _pair_rows(spark, d).select("id", F.md5(chat.single_prompt(F.lit("按原意改写。"), F.col("plain"))).alias("md5"))


@query(f"WITH {_PAIRS} SELECT id, 'system,human,gpt' AS dialect, md5('旧体' || '|' || plain || '|' || styled) AS md5 FROM p")
def conv_to_sharegpt(spark, d):
    turns = chat.to_from_value(F.lit("旧体"), F.col("plain"), F.col("styled"))
    rows = _pair_rows(spark, d).select("id", turns.alias("m"))
    return rows.select("id", F.array_join(F.transform("m", lambda x: x["from"]), ",").alias("dialect"), F.md5(F.array_join(F.transform("m", lambda x: x["value"]), "|")).alias("md5"))


@query("SELECT DISTINCT id, md5(wuxia_text) AS input_md5, md5(vernacular_text) AS output_md5 FROM style_pairs")
def review_projection(spark, d):
    return read_table(spark, d, "style_pairs").select("id", F.md5("wuxia_text").alias("input_md5"), F.md5("vernacular_text").alias("output_md5")).distinct()


@query(f"""WITH {_TURNS}, e AS (SELECT DISTINCT record_id, list_transform(turns, lambda m: CASE WHEN m.role = 'assistant' AND m.content <> '' THEN {_without_ads(_unescape('m.content'))} ELSE m.content END) AS l FROM t)
    SELECT record_id, md5(array_to_string(l, '|')) AS md5 FROM e""")
def assistant_clean(spark, d):
    turns = chat.assistant_only(F.col("turns"), lambda c: rules.drop_ad_lines(text.unescape_common(c)))
    return _turn_rows(spark, d).select("record_id", F.md5(F.array_join(F.transform(turns, lambda m: m["content"]), "|")).alias("md5")).distinct()


#: Invented replies.
REPLIES = ["<|im_start|>user\n你好<|im_end|>\n<|im_start|>assistant\n好的，天色已晚。<|im_end|>", "<|im_start|>assistant\n风起。<|im_end|>余下<|endoftext|>", "```python\n雨歇。\n```", "好的，请稍候片刻。好的，月出。", "  平常一句。  ", "Assistant: 一\n\n```\n二", "<|im_start|>assistant\n甲<|im_end|>乙<|im_start|>assistant\n丙<|endoftext|>丁"]
_START = "'<|im_start|>assistant' || chr(10)"
_STEPS = ", ".join(f"s{k + 1} AS (SELECT id, raw, CASE WHEN starts_with(x, '{p}') THEN {_strip(f'substr(x, {len(p) + 1})')} ELSE x END AS x FROM s{k})" for k, p in enumerate(text.POLITE))


@query(f"""WITH {_TURNS}, y AS (SELECT DISTINCT record_id AS id, {_LAST} AS x FROM t),
    r AS (SELECT id, CASE {_number('42r', 'id')} % 4 WHEN 0 THEN '<|im_start|>user' || chr(10) || '问<|im_end|>' || chr(10) || {_START} || x || '<|im_end|>尾' WHEN 1 THEN '好的，请稍候片刻。好的，' || x || '<|endoftext|>余'
        WHEN 2 THEN '```python' || chr(10) || x || chr(10) || '```' ELSE {_START} || 'Assistant: ' || x || '<|im_end|><|im_end|>' END AS raw FROM y WHERE x IS NOT NULL UNION ALL SELECT * FROM (VALUES {", ".join(f"('{i}', '{x}')" for i, x in enumerate(REPLIES))}) v(id, raw)),
    a AS (SELECT id, raw, list_extract(string_split(raw, {_START}), -1) AS tail, contains(raw, {_START}) AS marked FROM r),
    s0 AS (SELECT id, raw, {_strip("CASE WHEN marked THEN list_extract(string_split(CASE WHEN contains(tail, '<|im_end|>') THEN regexp_replace(tail, '(?s)^(.*)<[|]im_end[|]>.*$', '\\1') ELSE tail END, '<|endoftext|>'), 1) ELSE raw END")} AS x FROM a), {_STEPS}
    SELECT id, md5(array_to_string(list_filter({_split('x')}, lambda l: {_strip('l')} NOT IN ('', '```', '```python', 'Assistant:', 'assistant:')), chr(10))) AS cleaned_md5, md5({_strip("list_extract(string_split(raw, '<|im_end|>'), 1)")}) AS short_md5 FROM s{len(text.POLITE)}""")
def reply_cleanup(spark, d):
    """Answers of the table as a generator may return them, and invented replies."""
    x = F.try_element_at(F.filter("turns", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    rows = _turn_rows(spark, d).select(F.col("record_id").alias("id"), x.alias("x")).where("x is not null").distinct()
    kind, start = ranking.hash_number("42r", F.col("id")) % 4, F.lit("<|im_start|>assistant\n")
    raw = F.when(kind == 0, F.concat(F.lit("<|im_start|>user\n问<|im_end|>\n"), start, "x", F.lit("<|im_end|>尾"))).when(kind == 1, F.concat(F.lit("好的，请稍候片刻。好的，"), "x", F.lit("<|endoftext|>余")))
    raw = raw.when(kind == 2, F.concat(F.lit("```python\n"), "x", F.lit("\n```"))).otherwise(F.concat(start, F.lit("Assistant: "), "x", F.lit("<|im_end|><|im_end|>")))
    rows = rows.select("id", raw.alias("raw")).union(spark.createDataFrame([(str(i), x) for i, x in enumerate(REPLIES)], "id string, raw string"))
    return rows.select("id", F.md5(text.clean_reply(F.col("raw"))).alias("cleaned_md5"), F.md5(text.short_reply(F.col("raw"))).alias("short_md5"))


_PREFIXES = ["请将白话改作带古意的叙述——\n", "读者嫌它口水，请修得凝练些：\n"]
_USER = "list_extract(list_filter(turns, lambda m: m.role = 'user'), -1).content"


@query(f"""WITH {_TURNS}, u AS (SELECT DISTINCT record_id, {_USER} AS x FROM t)
    SELECT record_id, md5(CASE WHEN contains(x, '{_PREFIXES[0]}') THEN substr(x, {len(_PREFIXES[0]) + 1}) ELSE x END) AS one_md5, md5(CASE WHEN contains(x, '{_PREFIXES[0]}') THEN substr(x, {len(_PREFIXES[0]) + 1}) WHEN contains(x, '{_PREFIXES[1]}') THEN substr(x, {len(_PREFIXES[1]) + 1}) ELSE x END) AS many_md5 FROM u""")
def instruction_prefix(spark, d):
    x = F.try_element_at(F.filter("turns", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    rows = _turn_rows(spark, d).select("record_id", x.alias("x")).distinct()
    return rows.select("record_id", F.md5(text.drop_prefix(F.col("x"), _PREFIXES[0])).alias("one_md5"), F.md5(text.drop_prefixes(F.col("x"), _PREFIXES)).alias("many_md5"))


# -- training rows --------------------------------------------------------------------------------------------------

MOST, PAD = 640, 0
_IDS = lambda x: f"list_transform(regexp_extract_all({x}, '(?s).', 0), lambda c: unicode(c))"
_MASK_ROWS = f"{_TURNS}, i AS (SELECT DISTINCT record_id, {_IDS(_PROMPT)} AS p, {_IDS(_RESPONSE)} AS a FROM t WHERE {_LAST} IS NOT NULL)"


def _mask_sql(soft: str) -> str:
    labels = f"list_concat(CASE WHEN {soft} THEN p ELSE list_transform(p, lambda x: -100) END, a)[1:{MOST}]"
    return f"""WITH {_MASK_ROWS}, m AS (SELECT record_id, len(p) <= {MOST} AS fits, list_resize(list_concat(p, a)[1:{MOST}], {MOST}, {PAD}) AS ids, least(len(p) + len(a), {MOST}) AS n, list_resize({labels}, {MOST}, -100) AS labels FROM i)
        SELECT record_id, CASE WHEN fits THEN md5(array_to_string(ids, ',')) ELSE md5('') END AS ids_md5, CASE WHEN fits THEN n ELSE 0 END AS used, CASE WHEN fits THEN md5(array_to_string(labels, ',')) ELSE md5('') END AS labels_md5 FROM m"""


def _masked_rows(spark, d, soft=None) -> DataFrame:
    rows = _turn_rows(spark, d).select("record_id", training.char_ids(chat.chat_prompt(F.col("turns"))).alias("p"), training.char_ids(chat.chat_response(F.col("turns"))).alias("a")).where("a is not null").distinct()
    return training.masked(rows, F.col("p"), F.col("a"), MOST, PAD, soft)


def _shown(rows: DataFrame) -> DataFrame:
    used = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select("record_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), used.alias("used"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@query(_mask_sql("false"))
def mask_labels_hard(spark, d):
    return _shown(_masked_rows(spark, d))


@query(_mask_sql(f"{_number('42', 'record_id')} % 10000 < 2000"))
def mask_labels_soft(spark, d):
    return _shown(_masked_rows(spark, d, training.soft_rows(F.col("record_id"))))


@query(f"""WITH {_MASK_ROWS}, f AS (SELECT len(p) AS p, least(len(a), {MOST} - len(p)) AS a FROM i WHERE len(p) <= {MOST})
    SELECT count(*) AS rows, count(*) * {MOST} AS positions, CAST(sum({MOST} - a) AS BIGINT) AS ignored, CAST(sum(a) AS BIGINT) AS learned FROM f""")
def mask_counts(spark, d):
    return training.mask_counts(_masked_rows(spark, d).where(F.size("input_ids") > 0))


BLOCK, EOS, BATCH = 512, 3, 100


@query(f"""WITH s AS (SELECT doc_id // {BATCH} AS batch, doc_id, list_concat({_IDS('text')}, [{EOS}]) AS ids FROM documents WHERE text IS NOT NULL),
    o AS (SELECT batch, ids, coalesce(sum(len(ids)) OVER (PARTITION BY batch ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
    e AS (SELECT batch, start + unnest(range(0, len(ids))) AS pos, unnest(ids) AS id FROM o)
    SELECT batch, CAST(pos // {BLOCK} AS BIGINT) AS block, md5(array_to_string(list_resize(list(id ORDER BY pos), {BLOCK}, {PAD}), ',')) AS md5, count(*) AS used FROM e GROUP BY 1, 2""")
def pack_sequences(spark, d):
    rows = read_table(spark, d, "documents").where("text is not null").select(F.floor(F.col("doc_id") / BATCH).alias("batch"), "doc_id", training.token_column(F.col("text")).alias("ids"))
    out = training.packed(rows, "batch", "doc_id", "ids", BLOCK, EOS, PAD)
    return out.select("batch", "block", F.md5(F.array_join("input_ids", ",")).alias("md5"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("used"))


# -- counts and scores ----------------------------------------------------------------------------------------------


@query("SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM training_samples), 6) AS share FROM training_samples GROUP BY split")
def mix_shares(spark, d):
    return metrics.mix_shares(read_table(spark, d, "training_samples"), "split")


@query("SELECT author, count(*) AS records FROM chunks GROUP BY author")
def author_counts(spark, d):
    return metrics.by_author(read_table(spark, d, "chunks"))


@query(f"WITH s AS (SELECT DISTINCT id, {_STYLE} AS style FROM combined_records) SELECT style, count(*) AS n FROM s GROUP BY style")
def style_counts(spark, d):
    return classify_source(spark, d).groupBy("style").agg(F.count("*").alias("n"))


@query(f"""WITH {_CHUNKS} SELECT count(*) AS total, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (length({_MARKED}) BETWEEN 500 AND 1500) AS kept, count(*) FILTER (length({_MARKED}) < 500) AS short, count(*) FILTER (length({_MARKED}) > 1500) AS long FROM c""")
def extraction_counts(spark, d):
    n = F.length(rules.drop_marks(F.col("text"), rules.MARKS_AUTHOR))
    rows = _chunk_rows(spark, d).select("text", n.alias("n"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(F.col("n").between(500, 1500)).alias("kept"), F.count_if(F.col("n") < 500).alias("short"), F.count_if(F.col("n") > 1500).alias("long"))


def _scored(spark, d) -> DataFrame:
    rows = spread(_pair_rows(spark, d))
    return rows.select("id", metrics.rouge_l(F.col("styled"), F.col("plain")).alias("rouge_l"))


def _signs(x: str) -> str:
    return f"regexp_extract_all(regexp_replace({x}, '{text.WS}', '', 'g'), '(?s).', 0)"


#: The longest common subsequence as the longest rising run of matching places: a place takes that of the least one not below it.
_ROUGE = f"""{_PAIRS}, e AS (SELECT id, {_signs('styled')} AS a, {_signs('plain')} AS b FROM p),
    m AS (SELECT id, len(a) AS na, len(b) AS nb, flatten(list_transform(a, lambda c: list_transform(list_reverse(list_filter(range(1, len(b) + 1), lambda i: b[i] = c)), lambda i: [i]))) AS s FROM e),
    n AS (SELECT id, na, nb, CASE WHEN len(s) = 0 THEN 0 ELSE len(list_reduce(s, lambda t, x: list_concat(list_concat(list_filter(t, lambda v: v < x[1]), x), list_filter(t, lambda v: v >= x[1])[2:]))) END AS n FROM m),
    g AS (SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * (n / nb) * (n / na) / (n / na + n / nb) END AS rouge_l FROM n)"""


@query(f"WITH {_ROUGE} SELECT id, round(rouge_l, 6) AS rouge_l, rouge_l < 0.8 AS is_rewritten FROM g")
def rouge_l_eval(spark, d):
    return _scored(spark, d).select("id", F.round("rouge_l", 6).alias("rouge_l"), (F.col("rouge_l") < 0.8).alias("is_rewritten"))


@query(f"""WITH {_ROUGE}, s AS (SELECT count(*) AS total, round(avg(rouge_l), 6) AS average, count(*) FILTER (rouge_l < 0.8) AS rewrites, round(count(*) FILTER (rouge_l < 0.8) / count(*), 6) AS rewrite_rate FROM g)
    SELECT *, CASE WHEN average >= 0.95 THEN 'excellent' WHEN average >= 0.85 THEN 'good' WHEN average >= 0.70 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN rewrite_rate <= 0.05 THEN 'keeps' WHEN rewrite_rate <= 0.15 THEN 'drifts' ELSE 'rewrites' END AS rewrite_band FROM s""")
def rouge_summary(spark, d):
    return metrics.evaluation_summary(_scored(spark, d))


#: Invented scores: ties, and every edge of a band.
SCORES = [0.95, 0.85, 0.7, 0.8, 0.8, 0.1, 1.0, 0.99, 0.5]
_SCORES = ", ".join(f"('score{i}', CAST({s} AS DOUBLE))" for i, s in enumerate(SCORES))
_BAND = "CASE WHEN s >= 0.95 THEN 'excellent' WHEN s >= 0.85 THEN 'good' WHEN s >= 0.70 THEN 'fair' ELSE 'poor' END"


#: Scores of the table's pairs and the invented ones.
_ALL_SCORES = f"{_ROUGE}, v AS (SELECT id, CAST(rouge_l AS DOUBLE) AS s FROM g UNION ALL SELECT * FROM (VALUES {_SCORES}) w(i, s))"


def _all_scores(spark, d) -> DataFrame:
    return _scored(spark, d).union(spark.createDataFrame([(f"score{i}", s) for i, s in enumerate(SCORES)], "id string, rouge_l double"))


@query(f"WITH {_ALL_SCORES} SELECT id, {_BAND} AS band, s < 0.8 AS is_rewritten FROM v")
def eval_bands(spark, d):
    rows = _all_scores(spark, d)
    return rows.select("id", metrics.verdict(F.col("rouge_l")).alias("band"), (F.col("rouge_l") < 0.8).alias("is_rewritten"))


@query(f"WITH {_ALL_SCORES} (SELECT id, round(s, 6) AS rouge_l, 'best' AS side FROM v ORDER BY s DESC, id LIMIT 5) UNION ALL (SELECT id, round(s, 6), 'worst' FROM v ORDER BY s, id LIMIT 5)")
def top_bottom_k(spark, d):
    return metrics.extremes(_all_scores(spark, d), "rouge_l", "id", 5).select("id", F.round("rouge_l", 6).alias("rouge_l"), "side")


@query("SELECT event_type, count(*) AS steps, min(value) AS least, max_by(value, event_id) AS last, min_by(value, event_id) AS first, max_by(value, event_id) - min_by(value, event_id) AS delta FROM events GROUP BY event_type")
def loss_history(spark, d):
    return metrics.loss_summary(read_table(spark, d, "events"), "event_id", "value", ["event_type"])


@query("SELECT event_id, event_type FROM events WHERE event_id % 50 = 0 AND event_id > 0")
def step_filter(spark, d):
    return metrics.every_nth(read_table(spark, d, "events"), "event_id", 50).select("event_id", "event_type")


@query("SELECT count(*) AS n, count(*) // 128 AS steps FROM training_samples")
def step_estimate(spark, d):
    return read_table(spark, d, "training_samples").agg(F.count("*").alias("n")).select("n", training.step_estimate(F.col("n"), 16, 8).alias("steps"))


@query(f"WITH {_CHUNKS} SELECT id, md5(text) AS md5 FROM c ORDER BY {_BOOK}, seq, id LIMIT 300")
def shard_limit(spark, d):
    """The table written as JSON shards in one order and read back in it, up to a cap."""
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    rows = _books(_chunk_rows(spark, d)).orderBy("source_file", "seq", "id").select("id", "text")
    sinks.write_json_lines(rows, folder)
    return files.ordered_shards(spark, f"{folder}/*.json", "id string, text string", 300).select("id", F.md5("text").alias("md5"))


# -- names and sources ----------------------------------------------------------------------------------------------


_STEM = "CASE WHEN regexp_matches(regexp_replace({x}, '^.*[/\\\\]', ''), '^.+\\.[^.]*$') THEN regexp_replace(regexp_replace({x}, '^.*[/\\\\]', ''), '\\.[^.]*$', '') ELSE regexp_replace({x}, '^.*[/\\\\]', '') END".format(x="source_file")


@query(f"""WITH s AS (SELECT DISTINCT source_file, {_STEM} AS st FROM training_samples WHERE source_file IS NOT NULL)
    SELECT source_file, CASE WHEN regexp_matches(st, '{text.BOOK_NAME}') THEN regexp_extract(st, '{text.BOOK_NAME}', 1) ELSE st END AS book, CASE WHEN regexp_matches(st, '{text.BOOK_NAME}') THEN regexp_extract(st, '{text.BOOK_NAME}', 2) ELSE 'unknown' END AS author FROM s""")
def book_info(spark, d):
    rows = read_table(spark, d, "training_samples").select("source_file").where("source_file is not null").distinct()
    book, author = text.book_info(F.col("source_file"))
    return rows.select("source_file", book.alias("book"), author.alias("author"))


NAMES = {"Yanbeike": "north_guest", "Weizhou": "reed_boat"}


@query("""SELECT DISTINCT source_file, CASE WHEN contains(source_file, '_') THEN split_part(source_file, '_', 1) ELSE 'Unknown' END AS author, CASE WHEN contains(source_file, 'Yanbeike') THEN 'north_guest' WHEN contains(source_file, 'Weizhou') THEN 'reed_boat' ELSE 'unknown' END AS mapped FROM chunks WHERE source_file IS NOT NULL""")
def author_from_name(spark, d):
    rows = read_table(spark, d, "chunks").select("source_file").where("source_file is not null").distinct()
    return rows.select("source_file", text.author_of(F.col("source_file")).alias("author"), text.mapped_name(F.col("source_file"), NAMES).alias("mapped"))


PATHS = ["a/甲.txt", "b/甲.txt", "c/甲.txt", "a/乙.txt", "b/丙.TXT", "丙.TXT"]


_PATHS = "SELECT path FROM raw_files WHERE path IS NOT NULL UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") v(path)"


@query(f"""WITH p AS ({_PATHS}), b AS (SELECT path, regexp_replace(path, '^.*[/\\\\]', '') AS base FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) - 1 AS n FROM b)
    SELECT path, CASE WHEN n = 0 THEN base ELSE regexp_replace(base, '\\.[^.]*$', '') || '_' || n || regexp_extract(base, '\\.[^.]*$') END AS name FROM n""")
def dedup_names(spark, d):
    return records.unique_names(read_table(spark, d, "raw_files").select("path").where("path is not null").union(spark.createDataFrame([(p,) for p in PATHS], "path string")))


PROMPT_LINES = ['{"system": "旧体", "user": "写一句"}', '{"system": "", "user": "再写"}', '{"user": "无系统"}', " 直说 ", "", "{坏的"]


#: Records of the table as prompt lines: by hash some as JSON with both keys, some with the user's text alone, some as plain text.
_PROMPTED = f"""SELECT CASE {_number('42p', 'id')} % 3 WHEN 0 THEN CAST(to_json(struct_pack(system := author, "user" := text)) AS VARCHAR) WHEN 1 THEN CAST(to_json(struct_pack("user" := text)) AS VARCHAR) ELSE text END AS value FROM combined_records
    UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{p}')" for p in PROMPT_LINES) + ") v(value)"


@query(f"""WITH v AS ({_PROMPTED}), j AS (SELECT {_strip('value')} AS value, CASE WHEN starts_with({_strip('value')}, '{{') AND json_valid(value) THEN value END AS o FROM v WHERE {_strip('value')} <> '')
    SELECT coalesce(CASE WHEN o IS NOT NULL AND o ->> '$.user' IS NOT NULL THEN nullif(o ->> '$.system', '') END, '默认') AS system, md5(CASE WHEN o IS NOT NULL AND o ->> '$.user' IS NOT NULL THEN o ->> '$.user' ELSE value END) AS user_md5 FROM j""")
def prompt_lines(spark, d):
    kind = ranking.hash_number("42p", F.col("id")) % 3
    lines = read_table(spark, d, "combined_records").select(F.when(kind == 0, F.to_json(F.struct(F.col("author").alias("system"), F.col("text").alias("user")))).when(kind == 1, F.to_json(F.struct(F.col("text").alias("user")))).otherwise(F.col("text")).alias("value"))
    rows = files.prompts(lines.union(spark.createDataFrame([(p,) for p in PROMPT_LINES], "value string")), "默认")
    return rows.select("system", F.md5("user").alias("user_md5"))


@query("SELECT DISTINCT coalesce(nullif(regexp_replace(" + _strip("coalesce(author, '')") + ", '[/\\\\]', '_', 'g'), ''), 'unknown') AS folder FROM chunks")
def author_folders(spark, d):
    return read_table(spark, d, "chunks").select(sinks.safe_name(F.coalesce("author", F.lit(""))).alias("folder")).distinct()


# -- written and read again -----------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {_CHUNKS} SELECT id, author, source_file, md5(text) AS md5 FROM c")
def json_round_trip(spark, d):
    folder = _folder(spark)
    sinks.write_json_lines(_chunk_rows(spark, d).select("id", "author", "source_file", "text"), folder)
    rows = files.json_lines(spark, folder, "id string, author string, source_file string, text string")
    return rows.select("id", "author", "source_file", F.md5("text").alias("md5"))


@query(f"WITH {_CHUNKS} SELECT id, md5(text) AS md5, {_number('42j', 'id')} % 5 = 0 AS broken FROM c")
def json_rejects(spark, d):
    """JSON lines of which some are cut off: those that can be read, and the others with their text."""
    folder = _folder(spark)
    rows = _chunk_rows(spark, d).select("id", "text")
    line, bad = F.to_json(F.struct("id", "text"), {"ignoreNullFields": "false"}), ranking.hash_number("42j", F.col("id")) % 5 == 0
    rows.select(F.when(bad, F.concat(F.lit("#"), line)).otherwise(line).alias("value")).write.text(folder)
    got = files.json_lines_with_rejects(spark, folder, "id string, text string").select(F.coalesce("id", F.from_json(F.substring("_corrupt_record", 2, 1 << 30), "id string")["id"]).alias("id"), F.coalesce("text", F.from_json(F.substring("_corrupt_record", 2, 1 << 30), "text string")["text"]).alias("text"), F.col("_corrupt_record").isNotNull().alias("broken"))
    kept = files.json_lines(spark, folder, "id string, text string", strict=False).select("id", F.lit(True).alias("_kept"))
    return got.join(kept, "id", "left").where(F.col("broken") == F.col("_kept").isNull()).select("id", F.md5("text").alias("md5"), "broken")


@query(f"WITH {_CHUNKS} SELECT id, CAST(seq // 100 AS BIGINT) AS bucket, md5(text) AS md5 FROM c WHERE seq IS NOT NULL")
def bucket_round_trip(spark, d):
    folder = _folder(spark)
    sinks.write_buckets(_chunk_rows(spark, d).where("seq is not null").select("id", "seq", "text"), folder, "seq")
    rows = spark.read.schema("id string, seq bigint, text string, bucket bigint").json(folder)
    return rows.select("id", "bucket", F.md5("text").alias("md5"))


@query(f"WITH {_CHUNKS} SELECT coalesce(nullif(regexp_replace({_strip("coalesce(author, '')")}, '[/\\\\]', '_', 'g'), ''), 'unknown') AS folder, id, md5(text) AS md5 FROM c")
def author_round_trip(spark, d):
    folder = _folder(spark)
    sinks.write_by_author(_chunk_rows(spark, d).select("id", "author", "text"), folder)
    rows = spark.read.schema("id string, text string, _author string").json(folder)
    return rows.select(F.col("_author").alias("folder"), "id", F.md5("text").alias("md5"))


@query("SELECT doc_id, md5(replace(text, chr(13), '')) AS md5 FROM documents WHERE text IS NOT NULL")
def text_round_trip(spark, d):
    """One file per document, written and scanned again."""
    folder = _folder(spark)
    rows = read_table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    sinks.write_texts(rows, folder, "name", "text")
    got = files.whole_texts(spark, f"{folder}/*/*.txt").select(F.regexp_extract("path", "name=([0-9]+)/", 1).cast("bigint").alias("doc_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))
    return got.select("doc_id", F.md5("text").alias("md5"))


@query("SELECT author, count(*) AS records FROM chunks GROUP BY author")
def json_array_round_trip(spark, d):
    """A small result as one JSON array, written and read again."""
    folder = _folder(spark)
    sinks.json_array_text(metrics.by_author(read_table(spark, d, "chunks")), ["author"]).coalesce(1).write.option("lineSep", "\n").text(folder)
    return files.json_array(spark, folder, "author string, records bigint")


@query("SELECT doc_id, rater, level FROM level_labels WHERE level >= 3")
def score_filter(spark, d):
    return metrics.at_least(read_table(spark, d, "level_labels"), "level", 3)


# -- generators and streams -----------------------------------------------------------------------------------------


def echo_client():
    """A generator for tests: a pure function of the text, silent for one text in seven."""
    return lambda t: None if len(t) % 7 == 0 else f"{len(t)}:{t[:10]}"


@query(f"WITH {_CHUNKS}, r AS (SELECT id, text FROM c WHERE length(text) > 0 AND id NOT IN (SELECT id FROM style_pairs WHERE id IS NOT NULL)) SELECT id, {_strip('CAST(length(text) AS VARCHAR) || chr(58) || left(text, 10)')} AS generated FROM r WHERE length(text) % 7 <> 0")
def llm_map_resume(spark, d):
    rows = _chunk_rows(spark, d).where(F.length("text") > 0).select("id", "text")
    return enrich.enrich_rest(rows, read_table(spark, d, "style_pairs").select("id"), "id", "text", echo_client, policy=enrich.Policy(threads=2, pause=0)).select("id", "generated")


def flaky_client():
    """A generator that fails on the first call for a text and then says how much of it was handed over, and its last words."""
    seen = set()

    def ask(t: str) -> str:
        if t not in seen:
            seen.add(t)
            raise TimeoutError
        return f"  {len(t)}:{t[-3:]} "

    return ask


@query(f"WITH {_CHUNKS} SELECT id, {_strip("length(left(text, 200)) || chr(58) || right(left(text, 200), 3)")} AS generated FROM c WHERE length(text) > 0")
def llm_policy(spark, d):
    """Retries, a bound on the text handed over, and stripped answers."""
    rows = _chunk_rows(spark, d).where(F.length("text") > 0).select("id", "text")
    return enrich.enrich(rows, "text", flaky_client, policy=enrich.Policy(tries=2, pause=0, head=200, threads=2)).select("id", "generated")


class _Batched:
    def many(self, texts: list[str]) -> list[str]:
        return [f"{len(t)}" for t in texts]


@query(f"WITH {_CHUNKS} SELECT id, CAST(length(text) AS VARCHAR) AS generated FROM c WHERE length(text) > 0")
def llm_batched(spark, d):
    rows = _chunk_rows(spark, d).select("id", "text")
    return enrich.enrich(rows, "text", _Batched, policy=enrich.Policy(batch=16)).select("id", "generated")


@query(f"WITH {_CHUNKS} SELECT id, {_strip('CAST(length(text) AS VARCHAR) || chr(58) || left(text, 10)')} AS generated FROM c WHERE length(text) > 0 AND length(text) % 7 <> 0 ORDER BY id LIMIT 100")
def llm_limit(spark, d):
    """The first hundred answers, however many texts have to be asked for."""
    rows = _chunk_rows(spark, d).where(F.length("text") > 0).select("id", "text")
    return enrich.enrich_rest(rows, rows.limit(0), "id", "text", echo_client, 100, policy=enrich.Policy(tries=1, pause=0, threads=2)).select("id", "generated")


@query(f"WITH {_CHUNKS} SELECT id, length(text) AS n_chars FROM c")
def stream_resume(spark, d):
    """JSON shards streamed in two runs, the second over more files and some lines again, each key written once."""
    folder, out, mark = (_folder(spark) for _ in range(3))
    rows = _chunk_rows(spark, d).select("id", "text")
    late = ranking.hash_number("42t", F.col("id")) % 3 == 0
    for some in (rows.where(~late), rows):
        sinks.write_json_lines(some, folder, "append")
        stream = jobs.stream_json(spark, folder, "id string, text string", 4)
        jobs.append_once(stream, out, mark, lambda b: b.select("id", F.length("text").cast("bigint").alias("n_chars"))).awaitTermination()
    return spark.read.parquet(out).select("id", "n_chars")


@query(_shifted(_BOOK, "text").replace("SELECT t.id, md5(t.rest || coalesce(g.given, '')) AS md5 FROM t", "SELECT t.source_file, t.seq, md5(t.rest || coalesce(g.given, '')) AS md5 FROM t") + " AND t.seq < (SELECT max(u.seq) FROM t u WHERE u.keep AND u.source_file = t.source_file)")
def stream_quotes(spark, d):
    """The streaming form of the quote repair; the newest kept record of each book waits in the state."""
    folder, out = _folder(spark), _folder(spark)
    _books(_chunk_rows(spark, d)).where("seq is not null").select("source_file", "seq", "text").write.parquet(folder)
    stream = spark.readStream.schema("source_file string, seq bigint, text string").parquet(folder)
    got = jobs.shift_quotes_stream(stream, "source_file", "seq", "text")
    return jobs.read_written(got.select("source_file", "seq", F.md5("text").alias("md5")), out)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    schema = read_table(spark, d, "events").schema
    # The memory table is for tests and small reports; a job writes to a sink of its own.
    folder = d if d.endswith("/") else d + "/"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return jobs.read_memory(jobs.windowed_counts(stream, "ts", "event_type"), f"windows_{uuid.uuid4().hex}")


def _documents_as_files(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select(F.format_string("shelf/b%07d_w%d.txt", "doc_id", F.col("doc_id") % 7).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return spread(rows)


_FILE = "'b' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '_w' || (doc_id % 7)"
_MERGED = f"regexp_replace({_JOINED}, chr(10) || '$', '')"
_CURLED = _TURNED.format(x=_TURNED.format(x=_MORE, m=chr(34), a="“", b="”"), m=chr(39) * 2, a="‘", b="’")


@query(f"WITH RECURSIVE {_greedy(_MERGED)} SELECT {_FILE} || '.txt_' || chunk_no AS id, 'b' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS author, md5(chunk) AS md5 FROM k WHERE chunk <> ''")
def files_corpus_chunks(spark, d):
    return pipelines.corpus_chunks(_documents_as_files(spark, d)).select("id", "author", F.md5("text").alias("md5"))


@query(f"WITH RECURSIVE {_budget(_NORMAL.replace('(text,', f'({_CURLED},', 1))} SELECT 'raw_' || {_FILE} || '_' || lpad(CAST(chunk_no AS VARCHAR), 5, '0') AS id, md5({_strip('chunk')}) AS md5 FROM k WHERE length({_strip('chunk')}) >= 10")
def files_budget_corpus(spark, d):
    return pipelines.budget_corpus(_documents_as_files(spark, d), "raw").select("id", F.md5("text").alias("md5"))


@query(f"""SELECT 'b' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '_' || i AS _id, 'b' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS source, 'w' || (doc_id % 7) AS author, CAST(length(c) AS INT) AS length, md5(c) AS md5
    FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_target('text', 800, chunking.TARGET_ENDS)} AS l FROM documents WHERE length({_strip('text')}) > 0))""")
def files_book_chunks(spark, d):
    return pipelines.book_chunks(_documents_as_files(spark, d)).select("_id", "source", "author", "length", F.md5("text").alias("md5"))


@query(f"""WITH l AS (SELECT doc_id, {_target(f"array_to_string(list_transform({_KEPT}, lambda l: {_OPENED}), '')", 800, chunking.TARGET_ENDS_ZH)} AS l FROM documents WHERE text IS NOT NULL)
    SELECT 'scan_' || {_FILE} || '_' || i AS _id, CAST(length(x) AS INT) AS length, md5(x) AS md5 FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l)""")
def files_scanned_chunks(spark, d):
    return pipelines.scanned_book_chunks(_documents_as_files(spark, d), "scan").select("_id", "length", F.md5("text").alias("md5"))


@query("SELECT 'shelf/b' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '_w' || (doc_id % 7) || '.txt' AS path, 'utf-8' AS encoding, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def files_transcoded(spark, d):
    return pipelines.transcoded(_documents_as_files(spark, d)).select("path", "encoding", F.md5("content").alias("md5"))


@query()
def raw_corpus_chunks(spark, d):
    return pipelines.corpus_chunks(spread(read_table(spark, d, "raw_files"))).select("id", "author", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


@query()
def raw_budget_corpus(spark, d):
    return pipelines.budget_corpus(spread(read_table(spark, d, "raw_files")), "raw").select("id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


@query()
def raw_book_chunks(spark, d):
    return pipelines.book_chunks(spread(read_table(spark, d, "raw_files"))).select("_id", "source", "author", "length")


@query(f"""WITH s AS (SELECT id, {_STYLE} AS style, text FROM combined_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY dataset NULLS FIRST, source_file NULLS FIRST, text NULLS FIRST) = 1),
    v AS (SELECT * FROM s WHERE style IS NOT NULL AND text IS NOT NULL AND length({_strip('text')}) >= 100 AND NOT regexp_matches(text, '{_q(_BAD)}') AND len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 0.7 * length(text)),
    r AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY {_hash('42', 'id')}, id) AS n FROM v),
    k AS (SELECT id, style, text, left(array_to_string(list_transform(list_filter(list_zip(l, range(0, len(l))), lambda z: z[2] % 3 = 0), lambda z: z[1]), '。'), 300) AS plain FROM (SELECT *, regexp_split_to_array(text, '[。！？]') AS l FROM r WHERE n <= {_QUOTA}))
    SELECT id, style, length(plain) AS plain_length, length(text) AS styled_length FROM k WHERE length(plain) > 0""")
def stage_two_quota(spark, d):
    one = read_table(spark, d, "combined_records").groupBy("id").agg(F.min(F.struct("dataset", "source_file", "text")).alias("r")).select("id", "r.*")
    out = pipelines.stage_two(one, STYLES, QUOTAS)
    return out.select("id", "metadata.style", F.col("metadata.plain_length").cast("bigint").alias("plain_length"), F.col("metadata.styled_length").cast("bigint").alias("styled_length"))


@query(f"""WITH {_PAIRS}, r AS (SELECT id, row_number() OVER (ORDER BY {_hash('42', 'id')}, id) AS n FROM p)
    SELECT id || CASE WHEN n <= 6500 THEN '' WHEN n <= 7300 THEN '_adversarial' WHEN n <= 8000 THEN '_summary' WHEN n <= 8600 THEN '' WHEN n <= 8800 THEN '_stress' ELSE '_adversarial' END AS record_id,
        CASE WHEN n <= 8000 THEN 'train' WHEN n <= 8600 THEN 'test_standard' WHEN n <= 8800 THEN 'test_stress' ELSE 'test_adversarial' END AS split,
        md5(CASE WHEN n > 5688 AND n <= 6500 THEN {_pick(chat.QUIET_SYSTEMS, "42s", "id")} ELSE {_pick(chat.SYSTEMS, "42s", "id")} END) AS system_md5 FROM r WHERE n <= 9000""")
def diversified_sets(spark, d):
    made = pipelines.diversified(_pair_rows(spark, d), 6500, 800, 700, 600, 200, 200)
    return made.select("record_id", "split", F.md5(F.col("conversations")[0]["content"]).alias("system_md5"))


_FA, _FB = f"{_number('42a', 'doc_id')} % (length(text) + 1)", f"{_number('42b', 'doc_id')} % (length(text) + 1)"
_LO, _HI = f"CAST(least({_FA}, {_FB}) AS INT)", f"CAST(greatest({_FA}, {_FB}) AS INT)"


@query(f"""SELECT doc_id, md5(CASE WHEN {_number('42f', 'doc_id')} % 10000 < 2000 AND length(text) > 0 THEN '<prefix>' || left(text, {_LO}) || '<suffix>' || substr(text, {_HI} + 1) || '<middle>' || substr(text, {_LO} + 1, {_HI} - {_LO}) ELSE text END) AS md5 FROM documents WHERE text IS NOT NULL""")
def fill_in_middle(spark, d):
    return pipelines.fill_in_middle(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", F.md5("text").alias("md5"))


@query(f"SELECT DISTINCT record_id FROM training_samples WHERE {_number('42r', 'record_id')} % 10000 < 2000")
def share_sample(spark, d):
    return pipelines.share_sample(read_table(spark, d, "training_samples"), "record_id", 0.2).select("record_id").distinct()


@query(f"WITH {_MASK_ROWS} SELECT record_id FROM i WHERE {_number('42', 'record_id')} % 10000 < 2000 AND len(p) <= {MOST}")
def label_markers(spark, d):
    """Of rows whose prompts are learnt, too, the role markers are; of the others none."""
    return pipelines.stray_markers(_masked_rows(spark, d, training.soft_rows(F.col("record_id"))), F.col("labels")).select("record_id")


@query("SELECT DISTINCT id FROM combined_records WHERE contains(lower(coalesce(source_file, '') || coalesce(dataset, '')), 'gufan') OR contains(lower(coalesce(source_file, '') || coalesce(dataset, '')), '冷月')")
def source_mentions(spark, d):
    return pipelines.mentions(read_table(spark, d, "combined_records"), ["source_file", "dataset"], ["Gufan", "冷月"]).select("id").distinct()


@query(_shifted(_BOOK, f"regexp_replace({_drop('text', rules.FURNITURE)}, '[a-zA-Z]', '', 'g')").replace("SELECT t.id, ", "SELECT t.id, CAST(length(t.rest || coalesce(g.given, '')) AS INT) AS n_chars, "))
def repaired_chunks(spark, d):
    rows = _books(_chunk_rows(spark, d)).drop("seq")
    return pipelines.repaired_chunks(rows).select("id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


def _combined(spark, d) -> DataFrame:
    rows = _books(_chunk_rows(spark, d)).drop("seq")
    return pipelines.combined(spark, {"merged": rows.where("author = 'Yanbeike'"), "single": rows}, {"merged": 2}, {"single": ["Weizhou", "Gufan"]})


@query(f"""WITH {_CHUNKS}, m AS (SELECT id, {_BOOK} AS book, text, (row_number() OVER (PARTITION BY {_BOOK} ORDER BY seq NULLS FIRST, id) - 1) // 2 AS part, row_number() OVER (PARTITION BY {_BOOK} ORDER BY seq NULLS FIRST, id) AS n FROM c WHERE author = 'Yanbeike'),
    u AS (SELECT 'merged_' || book || '_pair_' || lpad(CAST(part AS VARCHAR), 5, '0') AS id, 'merged' AS dataset, count(*) AS merged_count, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n) FILTER (text <> ''), '') AS text, string_agg(id, '|' ORDER BY n) AS ids FROM m GROUP BY book, part
        UNION ALL SELECT id, 'single', 0, text, '' FROM c WHERE author IN ('Weizhou', 'Gufan'))
    SELECT id, dataset, CAST(merged_count AS INT) AS merged_count, ids, CAST(length(ltrim(replace(text, '{records.STRAY}', ''), '{_q(records.LEADING)}')) AS INT) AS n_chars FROM u""")
def combined_fields(spark, d):
    """The combined corpus without its wording: script changes no length."""
    return _combined(spark, d).select("id", "dataset", "merged_count", F.array_join("merged_from", "|").alias("ids"), F.length("text").alias("n_chars"))


@query()
def combined_corpus(spark, d):
    return _combined(spark, d).select("id", "dataset", "merged_count", F.md5("text").alias("md5"))
