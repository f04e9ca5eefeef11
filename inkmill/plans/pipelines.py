"""Whole paths through the operators: from raw files to chunks, records, samples and packed training blocks.

Each is one lineage of DataFrame transformations, so that filters and columns are pushed to the scan; nothing is written
between the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import rules, text
from inkmill.operators import chat, chunking, enrich, ranking, records, sequential, training
from inkmill.sources import files, sinks


def decoded_files(raw: DataFrame, codecs=files.CODECS_WIDE) -> DataFrame:
    """(path, file_name, author, encoding, text) of (path, content); files that no codec reads are left out."""
    out = raw.select("path", F.regexp_replace("path", r"^.*[/\\]", "").alias("file_name"), files.decoded(F.col("content"), codecs).alias("d"))
    return out.select("path", "file_name", text.author_of(F.col("file_name")).alias("author"), "d.encoding", "d.text").where("text is not null")


def corpus_chunks(raw: DataFrame, most: int = 800) -> DataFrame:
    """(id, author, source_file, text): decoded, unwrapped, cut into sentences, gathered up to ``most`` characters."""
    whole = decoded_files(raw).withColumn("text", text.hard_wrap_merge(F.col("text"))).where(F.length(text.strip(F.col("text"))) > 0)
    rows = sequential.greedy_rows(whole, "file_name", "text", most)
    return rows.select(F.format_string("%s_%d", "file_name", "chunk_no").alias("id"), text.author_of(F.col("file_name")).alias("author"), F.col("file_name").alias("source_file"), F.col("chunk").alias("text"))


def budget_corpus(raw: DataFrame, prefix: str, most: int = 512, least: int = 10, encode=None, decode=None) -> DataFrame:
    """(id, source_file, text): cleaned of furniture, quotes curled, lines normalised, cut under a budget of tokens (characters without ``encode``)."""
    t = text.remove_terms(F.col("text"), rules.FURNITURE_MORE)
    t = text.normalize_lines(text.curl_quotes(text.curl_quotes(t, '"', "“", "”"), "'", "‘", "’"))
    rows = decoded_files(raw).select("file_name", t.alias("text"))
    rows = sequential.budget_rows(rows, "file_name", "text", most, encode, decode)
    rows = rows.select(F.format_string("%s_%s_%05d", F.lit(prefix), text.stem(F.col("file_name")), "chunk_no").alias("id"), F.col("file_name").alias("source_file"), text.strip(F.col("chunk")).alias("text"))
    return rows.where(F.length("text") >= least)


def book_chunks(raw: DataFrame, target: int = 800) -> DataFrame:
    """(_id, text, source, author, length): one book per file, cut at ``target``, ids from 1."""
    book, author = text.book_info(F.col("file_name"))
    rows = decoded_files(raw).select(book.alias("book"), author.alias("writer"), "text").where(F.length(text.strip(F.col("text"))) > 0)
    rows = chunking.numbered(rows, chunking.target_chunks(F.col("text"), target), ["book", "writer"], base=1)
    safe = F.regexp_replace("book", r"[/\\]", "_")
    return rows.select(F.format_string("%s_%d", safe, "chunk_no").alias("_id"), F.col("chunk").alias("text"), F.col("book").alias("source"), F.col("writer").alias("author"), F.length("chunk").alias("length"))


def scanned_book_chunks(raw: DataFrame, prefix: str, target: int = 800) -> DataFrame:
    """(_id, text, source, length): the line pipeline over scanned books."""
    rows = chunking.numbered(decoded_files(raw), chunking.line_pipeline(F.col("text"), target), ["file_name"], base=1)
    return rows.select(F.format_string("%s_%s_%d", F.lit(prefix), text.stem(F.col("file_name")), "chunk_no").alias("_id"), F.col("chunk").alias("text"), F.col("file_name").alias("source"), F.length("chunk").alias("length"))


def repaired_chunks(chunks: DataFrame, least: int = 5) -> DataFrame:
    """Chunks without furniture, closing quotes given back to the chunk before; ``id`` ends in the chunk's number."""
    rows = chunks.withColumn("text", text.remove_terms(F.col("text"), rules.FURNITURE)).withColumn("_seq", F.regexp_extract("id", "_([0-9]+)$", 1).try_cast("bigint"))
    return records.shift_quotes(rows, "source_file", "_seq", "text", least).drop("_seq")


def combined(spark: SparkSession, sources: dict[str, DataFrame], merged: dict[str, int], authors: dict[str, list] | None = None) -> DataFrame:
    """Sources tagged and united in the shape of ``records.COMBINED``; those in ``merged`` have every n records as one.

    Author filters come first, then merging, then the script: the costly steps see only rows that stay.
    """
    parts = {}
    for name, df in sources.items():
        rows = df.where(F.col("author").isin(*authors[name])) if authors and name in authors else df
        if name in merged:
            rows = rows.withColumn("_seq", F.regexp_extract("id", "_([0-9]+)$", 1).try_cast("bigint")).withColumn("_book", F.col("source_file"))
            made = records.merge_every(rows, merged[name], "_book", "_seq", F.concat(F.lit(f"{name}_"), "_book"))
            rows = made.drop("_book", "part")
        parts[name] = rows
    out = records.uniform(records.tagged_union(parts))
    return out.withColumn("text", records.sanitized(spark, F.col("text")))


def sound_by_style(rows: DataFrame, styles: dict[str, str]) -> DataFrame:
    """Sound rows with their style; rows of no style are left out."""
    tag = F.concat(F.coalesce("dataset", F.lit("")), F.lit(" "), F.coalesce("source_file", F.lit("")))
    return rows.where(rules.is_sound(F.col("text"))).withColumn("style", rules.first_match(tag, styles)).where("style is not null")


def style_quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    return {k: int(v * total) for k, v in shares.items()}


def stage_two(rows: DataFrame, styles: dict[str, str], quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """(id, conversations, metadata) in the from/value dialect: sound rows up to each style's quota, simplified by rule."""
    chosen = ranking.quota_sample(sound_by_style(rows, styles), "style", "id", quotas, seed)
    chosen = chosen.select("id", F.col("text").alias("styled"), text.every_third(F.col("text")).alias("plain"), "style").where(F.length("plain") > 0)
    return chat.styled_metadata(chosen, "id", "plain", "styled", F.col("style"))


def diversified(pairs: DataFrame, polish: int, echo: int, summary: int, standard: int, stress: int, adversarial: int, annealing: float = 0.125, seed: int = 42) -> DataFrame:
    """(record_id, conversations, split) of (id, plain, styled): training and test samples from one seeded order.

    The order is cut by position: polish, echo and summary samples for training, then the three test sets. The last
    ``annealing`` of the polish samples have a short or an empty system turn. Records beyond the sizes are left out.
    """
    ranked = ranking.hash_position(pairs, "id", seed, name="_at")
    edges = [0]
    for n in (polish, echo, summary, standard, stress, adversarial):
        edges.append(edges[-1] + n)
    part = lambda k: ranked.where((F.col("_at") > edges[k]) & (F.col("_at") <= edges[k + 1]))
    quiet = F.col("_at") > edges[1] - int(polish * annealing)
    first = chat.restyle_samples(part(0).where(~quiet), "id", "plain", "styled", seed)
    last = chat.restyle_samples(part(0).where(quiet), "id", "plain", "styled", seed, systems=chat.QUIET_SYSTEMS)
    train = [first, last, chat.echo_samples(part(1), "id", "plain", seed), chat.summary_samples(part(2), "id", "plain", seed)]
    tests = {"test_standard": chat.restyle_samples(part(3), "id", "plain", "styled", seed), "test_stress": chat.restyle_samples(part(4), "id", "plain", "styled", seed, chat.STRESS).withColumn("record_id", F.concat("record_id", F.lit("_stress"))), "test_adversarial": chat.echo_samples(part(5), "id", "plain", seed)}
    out = [df.withColumn("split", F.lit("train")) for df in train] + [df.withColumn("split", F.lit(k)) for k, df in tests.items()]
    made = out[0]
    for df in out[1:]:
        made = made.unionByName(df)
    return made


def packed_corpus(rows: DataFrame, length: int = 4096, eos: int = 3, pad: int = 0, batch: int = 1000, encode=None) -> DataFrame:
    """(batch, block, input_ids, attention_mask, labels) of (doc, text): cleaned, tokenised and packed, a batch of documents at a time."""
    body = rules.style_sample(F.col("text"))
    made = rows.select(F.floor(F.col("doc") / batch).alias("batch"), "doc", body.alias("text")).where("text <> ''")
    made = made.select("batch", "doc", training.token_column(F.col("text"), encode).alias("ids")).where(F.size("ids") > 0)
    return training.packed(made, "batch", "doc", "ids", length, eos, pad)


def masked_corpus(samples: DataFrame, most: int = 1024, pad: int = 0, encode=None, soft: float = 0.0) -> DataFrame:
    """(record_id, input_ids, attention_mask, labels) of chat samples; rows without an answer or with a prompt beyond ``most`` are left out."""
    turns = samples.select("record_id", chat.unified_column(samples).alias("turns"))
    sides = turns.select("record_id", chat.chat_prompt(F.col("turns")).alias("p"), chat.chat_response(F.col("turns")).alias("a")).where("a is not null")
    ids = sides.select("record_id", training.token_column(F.col("p"), encode).alias("p"), training.token_column(F.col("a"), encode).alias("a"))
    made = training.masked(ids, F.col("p"), F.col("a"), most, pad, training.soft_rows(F.col("record_id"), soft) if soft else None)
    return made.where(F.size("input_ids") > 0).select("record_id", "input_ids", "attention_mask", "labels")


def rewritten_files(spark: SparkSession, glob: str, out: str, client, policy: enrich.Policy = enrich.Policy()) -> None:
    """Every non-blank text file through a generator, under its own name in ``out``; files without an answer are left out."""
    rows = files.whole_texts(spark, glob).where(F.length(text.strip(F.col("text"))) > 0)
    made = enrich.enrich(rows.select(F.regexp_replace("path", r"^.*[/\\]", "").alias("name"), "text"), "text", client, policy=policy)
    sinks.write_texts(made, out, "name", "generated")


def fill_in_middle(rows: DataFrame, key: str, body: str, share: float = 0.2, seed: int = 42, marks: tuple[str, str, str] = ("<prefix>", "<suffix>", "<middle>")) -> DataFrame:
    """``rows`` with a share of the texts rearranged to prefix, suffix, middle, cut at two hashed places; others as they are."""
    n = F.length(body)
    a, b = ranking.hash_number(f"{seed}a", F.col(key)) % (n + 1), ranking.hash_number(f"{seed}b", F.col(key)) % (n + 1)
    lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
    t = F.col(body)
    moved = F.concat(F.lit(marks[0]), F.left(t, lo), F.lit(marks[1]), F.substring(t, hi + 1, n), F.lit(marks[2]), F.substring(t, lo + 1, hi - lo))
    chosen = (ranking.hash_number(f"{seed}f", F.col(key)) % 10000 < int(share * 10000)) & (n > 0)
    return rows.withColumn(body, F.when(chosen, moved).otherwise(t))


def share_sample(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A repeatable share of the rows, by hash."""
    return rows.where(ranking.hash_number(f"{seed}r", F.col(key)) % 10000 < int(share * 10000))


def stray_markers(rows: DataFrame, labels: Column) -> DataFrame:
    """Training rows whose learnt labels, read as characters, hold a role marker; there should be none."""
    learnt = F.array_join(F.transform(F.filter(labels, lambda x: x >= 0), lambda x: F.char(x)), "")
    return rows.where(F.contains(learnt, F.lit("<|im_start|>")))


def mentions(rows: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """Rows in whose ``columns``, lower case and run together, any of ``terms`` occurs."""
    tag = F.lower(F.concat(*[F.coalesce(c, F.lit("")) for c in columns]))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(tag, F.lit(t.lower()))
    return rows.where(hit)


def transcoded(raw: DataFrame, codecs=files.CODECS_WIDE) -> DataFrame:
    """(path, encoding, content): every readable file as UTF-8 bytes, for a new path; nothing is overwritten in place."""
    return decoded_files(raw, codecs).select("path", "encoding", F.encode("text", "UTF-8").alias("content"))
