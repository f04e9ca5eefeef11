"""Queries of the training-data operators, with production parameters and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import badpairs, booksplit, crosssplit, encoding, grades, leaks, mixing, pieces, sitelines, tokenids
from inkmill.sources.tables import read_table, ship_package, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_keys(read_table(spark, d, "chunks"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(read_table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_pairs(read_table(spark, d, "training_samples"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    samples = read_table(spark, d, "training_samples")
    return crosssplit.overlap_report(samples, crosssplit.cross_split_pairs(samples))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.site_lines(read_table(spark, d, "chunks")).select("id", "line_no").distinct()


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks")
    return sitelines.site_templates(chunks, sitelines.site_lines(chunks, slots=True))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("id", "source_file", "text").distinct()
    return sitelines.without_site_lines(chunks, sitelines.site_lines(chunks))


def p4_mix(spark: SparkSession, d: str) -> DataFrame:
    mixture = mixing.mix(read_table(spark, d, "combined_records"), read_table(spark, d, "mix_targets"))
    return mixture.select("id", "copy_no", "dataset", "author", "n_chars", "text")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_targets")
    return mixing.mixed_shares(mixing.mix(read_table(spark, d, "combined_records"), targets), targets)


def p4_authors(spark: SparkSession, d: str) -> DataFrame:
    return mixing.author_shares(mixing.mix(read_table(spark, d, "combined_records"), read_table(spark, d, "mix_targets")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return booksplit.same_books(read_table(spark, d, "training_samples"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return booksplit.grouped_split(read_table(spark, d, "training_samples"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return booksplit.split_shares(booksplit.grouped_split(read_table(spark, d, "training_samples")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return badpairs.defects(read_table(spark, d, "style_pairs"), read_table(spark, d, "training_samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(read_table(spark, d, "chunks")).select("id").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(read_table(spark, d, "chunks")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenids.token_ids(spread(read_table(spark, d, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    return leaks.without_leaks(documents, leaks.leaks(documents, read_table(spark, d, "eval_items"))).select("doc_id", "source", "lang")


def p9_places(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each leak and its place in the document."""
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return grades.reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "level_labels")).distinct()


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    levels = grades.reading_levels(documents, read_table(spark, d, "level_labels"))
    return levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"))


QUERIES = [
    p1_found, p1_pieces, p2_found, p2_report, p3_found, p3_templates, p3_cleaned, p4_mix, p4_shares, p4_authors, p5_found, p5_labels, p5_shares,
    p6_found, p7_found, p7_restored, p8_ids, p9_found, p9_clean, p9_places, p10_found, p10_profile,
]


def _with_package(f):
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return f(spark, d)

    query.__name__ = f.__name__
    return query


def queries() -> dict:
    return {f.__name__: _with_package(f) for f in QUERIES}


#: Full-width letters and what they stand for; other full-width signs are no letters and fall away.
_FULL = "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_HALF = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LINES = rf"""
    rows AS (SELECT id, source_file, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
             FROM chunks WHERE text IS NOT NULL AND source_file IS NOT NULL AND id IS NOT NULL),
    keyed AS (SELECT id, source_file, line_no, regexp_replace(lower(translate(line, '{_FULL}', '{_HALF}')), '[^\p{{L}}]+', '', 'g') AS k FROM rows),
    base AS (SELECT source_file, count(DISTINCT id) AS base FROM chunks WHERE source_file IS NOT NULL GROUP BY 1),
    hits AS (SELECT source_file, k, count(DISTINCT id) AS n FROM keyed WHERE k <> '' GROUP BY 1, 2),
    templates AS (SELECT h.source_file, k, n FROM hits h JOIN base b USING (source_file) WHERE n >= 4 AND n >= 0.1 * base)
"""


_NAME = "nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_UNIT = "CAST('0x' || substr(md5('42|' || r.dataset), 1, 8) AS BIGINT) / 4294967296.0"

#: Systematic sampling: expected copies summed along (length class, md5), one offset per source, a copy for each whole number crossed.
_MIX = f"""
    named AS (SELECT id, {_NAME.format(x='dataset')} AS dataset, author, text, length(text) AS n_chars FROM combined_records WHERE id IS NOT NULL AND length(text) > 0),
    one AS (SELECT * FROM named WHERE dataset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY dataset, n_chars, md5(text), author) = 1),
    steps AS (SELECT *, (length(bin(n_chars)) - 1) * 4 + CAST(floor(n_chars * 4 / pow(2.0, length(bin(n_chars)) - 1)) AS INT) - 4 AS step, md5('42|' || id) AS place FROM one),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY step, place, id) AS seat FROM steps),
    wish AS (SELECT {_NAME.format(x='dataset')} AS dataset, sum(CAST(target_share AS DECIMAL(18, 9))) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1),
    sizes AS (SELECT dataset, sum(n_chars) AS available FROM one GROUP BY 1),
    shares AS (SELECT w.*, s.available, CAST(w.target_share AS DOUBLE) / CAST(sum(w.target_share) OVER () AS DOUBLE) AS share FROM wish w JOIN sizes s USING (dataset)),
    plan AS (SELECT *, least(share * min(available * max_repeats / share) OVER () / available, max_repeats) AS copies FROM shares),
    counted AS (SELECT r.*, least(CAST(floor(seat * copies + {_UNIT}) - floor((seat - 1) * copies + {_UNIT}) AS INT), max_repeats) AS n FROM ranked r JOIN plan p ON p.dataset = r.dataset),
    mixture AS (SELECT id, unnest(range(1, n + 1)) AS copy_no, dataset, author, n_chars, text FROM counted WHERE n > 0),
    wanted AS (SELECT {_NAME.format(x='dataset')} AS dataset, sum(target_share) AS target_share FROM mix_targets GROUP BY 1),
    got AS (SELECT dataset, sum(n_chars) AS actual_chars, count(*) AS records, max(copy_no) AS most_copies FROM mixture GROUP BY 1)
"""


def oracle_sql() -> dict:
    """SQL for what SQL can say; the others are tested against brute force, round trips and held-out labels."""
    return {
        "p1_found": "SELECT DISTINCT id FROM chunks WHERE length(text) > 1000",
        "p3_found": f"WITH {_LINES} SELECT DISTINCT id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN templates USING (source_file, k)",
        "p4_mix": f"WITH {_MIX} SELECT id, CAST(copy_no AS INT) AS copy_no, dataset, author, CAST(n_chars AS BIGINT) AS n_chars, text FROM mixture",
        "p4_shares": f"""WITH {_MIX} SELECT w.dataset, w.target_share, round(w.target_share / sum(w.target_share) OVER (), 9) AS wanted_share, CAST(coalesce(actual_chars, 0) AS BIGINT) AS actual_chars,
            round(coalesce(actual_chars, 0) / sum(actual_chars) OVER (), 9) AS actual_share, coalesce(records, 0) AS records, CAST(coalesce(most_copies, 0) AS INT) AS most_copies FROM wanted w LEFT JOIN got USING (dataset)""",
        "p4_authors": f"WITH {_MIX} SELECT coalesce({_NAME.format(x='author')}, 'unknown') AS author, CAST(sum(n_chars) AS BIGINT) AS actual_chars, round(sum(n_chars) / (SELECT sum(n_chars) FROM mixture), 9) AS actual_share FROM mixture GROUP BY 1",
        "p3_templates": f"""WITH {_LINES}, rest AS (SELECT source_file, id, k FROM keyed ANTI JOIN templates USING (source_file, k) WHERE length(k) > 8),
            wide AS (SELECT source_file, left(k, 4) || '*' || right(k, 4) AS k, count(DISTINCT id) AS n FROM rest GROUP BY 1, 2 HAVING count(DISTINCT k) > 1)
            SELECT source_file, k AS template, n AS documents, false AS slot FROM templates UNION ALL SELECT source_file, k, n, true FROM wide JOIN base USING (source_file) WHERE n >= 4 AND n >= 0.1 * base""",
        "p3_cleaned": f"""WITH {_LINES}, d AS (SELECT DISTINCT id, source_file, text FROM chunks),
            e AS (SELECT id, source_file, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM d WHERE text IS NOT NULL AND id IS NOT NULL AND source_file IS NOT NULL),
            f AS (SELECT x.id, x.source_file, x.text, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE t.k IS NULL) AS clean FROM (SELECT *, regexp_replace(lower(translate(line, '{_FULL}', '{_HALF}')), '[^\\p{{L}}]+', '', 'g') AS fold FROM e) x
                LEFT JOIN templates t ON t.source_file = x.source_file AND t.k = x.fold GROUP BY ALL)
            SELECT d.id, d.source_file, CASE WHEN f.id IS NULL THEN d.text ELSE coalesce(f.clean, '') END AS text FROM d LEFT JOIN f ON f.id = d.id AND f.source_file = d.source_file AND f.text = d.text""",
    }
