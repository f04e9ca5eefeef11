"""Train, validation and test labels that keep all records of one entity together.

Records and the entities they share (books here) are a bipartite graph; its connected components are found with
alternating large-star and small-star steps, and a component's label comes from a hash of its identifier, so that it
depends on nothing but the component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.hanfold import fold_key, half_width
from inkmill.llm.sitelines import small_side
from inkmill.plans.lineage import cut

#: Label and share; shares are ranges of a hash.
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
ROUNDS = 40
#: A node of this many neighbours, and of this share of all edges, is a hub: hubs are few, and joined without gathering their edges.
HUB_EDGES, HUB_SHARE = 100_000, 0.0001
#: Components of at least this share of all records are placed by size instead of by hash.
HEAVY = 0.005
#: Notes that name a copy or a volume, not another book.
COPY_NOTES = "全本|足本|完本|校对|校訂|校订|精校|修订|修訂|整理|完整|全集|全文|未删节|未刪節|txt|epub|扫描|掃描"
NUMERALS = "0-9一二三四五六七八九十百两兩〇零"


def bare_name(name: Column) -> Column:
    """A file name without suffix, volume, copy number and notes on the copy."""
    t = F.trim(half_width(name))
    t = F.regexp_replace(t, r"(?i)\.(txt|text|epub|md|html?|jsonl?)$", "")
    t = F.regexp_replace(t, r"[(（【\[]\s*(?:[上中下]|[上中下]?[卷册冊部集]|第?[%s]+[卷册冊部集]?|[^()（）【】\[\]]*(?:%s)[^()（）【】\[\]]*)\s*[)）】\]]" % (NUMERALS, COPY_NOTES), "")
    t = F.regexp_replace(t, r"第\s*[%s]+\s*[卷册冊部集](?=$|[\s_·\-—])" % NUMERALS, "")
    t = F.regexp_replace(t, r"(?:^|(?<=[\s_·\-—》]))(?:卷|vol\.?|v)\s*[%s]+(?=$|[\s_·\-—])" % NUMERALS, "")
    t = F.regexp_replace(t, r"(?<=[\p{L}》])[_\-\s]+[0-9]{1,3}$", "")
    return F.regexp_replace(t, r"\s*[(（]?[0-9]{1,3}[)）]$", "")


#: How title and author stand in a name, in the order in which the forms are tried.
FORMS = [
    r"^.*?《([^》]+)》\s*(?:作者\s*[::]?)?\s*([^_\-—]+)",
    r"^\s*[\[【]([^\]】]+)[\]】]\s*([^_]+)",
    r"^(.*?)[\s_]*作者\s*[::]\s*([^_\-]+)",
    r"(?:^|[/\\])([^/\\]+)[/\\]([^/\\]+)$",
    r"^(.+?)__(.+?)-[^\-]+$",
    r"^(.+?)[_]+([^_]+)$",
    r"^(.+?)\s*[·•・]\s*(.+)$",
    r"^(.+?)\s+-+\s+(.+)$",
]


def book_keys(df: DataFrame, source: str = "source_file") -> DataFrame:
    """(source, book) of the distinct names: title and author in any order, script, width and packing.

    Read are ``title_author``, ``author_title``, ``title·author``, ``title__author-site``, ``title 作者：author``,
    ``《title》author_site``, ``[author]title`` and ``folder/author/title``, each with or without a suffix, a copy number, a
    volume or a note on the copy. Null and blank names are left out. Written once: names are few beside records.
    """
    spark = df.sparkSession
    names = df.select(source).where(F.col(source).isNotNull()).distinct().withColumn("_t", bare_name(F.col(source)))
    pair = F.array(F.col("_t"), F.lit(""))
    for form in reversed(FORMS):
        pair = F.when(F.col("_t").rlike(form), F.array(F.regexp_extract("_t", form, 1), F.regexp_extract("_t", form, 2))).otherwise(pair)
    names = names.withColumn("_pair", pair)
    fold = lambda c: fold_key(spark, F.regexp_replace(c, r"[0-9]+", ""))
    book = F.concat_ws("|", F.array_sort(F.array(fold(F.col("_pair")[0]), fold(F.col("_pair")[1]))))
    return cut(names.select(source, book.alias("book")).where(F.length("book") > 1))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of an undirected graph of string nodes; a component is named by its least node.

    Alternating large-star and small-star; each round ends in a checkpoint in the shared folder. Nothing is collected
    but two numbers per round. Both steps need the least neighbour per node, which an aggregate finds map-side; it is
    joined back to the edges by a shuffle, but for hubs (``HUB_EDGES``, at most 1 / ``HUB_SHARE`` of them), whose least
    neighbours are sent to where their edges lie, so that no task gathers a hub.
    """

    def to_least(e: DataFrame, least: DataFrame, most: float) -> DataFrame:
        hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.col("m").alias("hub")))
        marked = e.join(hubs, "u", "left")
        rest = marked.where("hub is null").drop("hub").join(least.where(F.col("n") <= most).drop("n"), "u")
        return rest.select("u", "v", "m").union(marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")))

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e: DataFrame, most: float) -> DataFrame:
        both = neighbours(e)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return to_least(both.where(F.col("v") > F.col("u")), least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame, most: float) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = to_least(down, least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()

    rows = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = rows.select("u").union(rows.select("v")).distinct()
    now = cut(rows.where(F.col("u") != F.col("v")).distinct())
    state = (now.count(), None)
    for _ in range(rounds):
        most = max(HUB_EDGES, HUB_SHARE * 2 * state[0])
        now = cut(small_star(large_star(now, most).where(F.col("u") != F.col("v")).distinct(), most))
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(total) == state:
            break
        state = tuple(total)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def same_books(df: DataFrame, source: str = "source_file") -> DataFrame:
    """(source_a, source_b; a < b): different names of one book, by the components of names that share a book key.

    A name gives one edge to its book key; null and blank names belong to no book.
    """
    keys = book_keys(df, source)
    graph = keys.select(F.concat(F.lit("n:"), F.col(source)).alias("a"), F.concat(F.lit("b:"), F.col("book")).alias("b"))
    found = connected_components(graph, "a", "b").where(F.col("node").startswith("n:")).select(F.expr("substring(node, 3)").alias("name"), "component")
    return found.alias("x").join(found.alias("y"), (F.col("x.component") == F.col("y.component")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.name").alias(f"{source}_a"), F.col("y.name").alias(f"{source}_b"))


def label_column(component: Column, seed: int = 42, shares=SHARES) -> Column:
    """The label of a component: its hash in proportional ranges."""
    point = F.pmod(F.xxhash64(F.lit(seed), component), F.lit(1 << 40)) / float(1 << 40)
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        out = F.when(point < upto, name) if out is None else out.when(point < upto, name)
    return out.otherwise(shares[-1][0])


def placed_labels(sizes: list[tuple[str, int]], total: int, shares=SHARES) -> tuple[dict[str, str], list[tuple[str, float]]]:
    """(label of each heavy component, shares for the rest): largest first, each to the label that lacks most."""
    lack = {name: share * total for name, share in shares}
    chosen = {}
    for component, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        name = max(lack, key=lack.get)
        chosen[component] = name
        lack[name] -= n
    rest = {name: max(0.0, x) for name, x in lack.items()}
    whole = sum(rest.values())
    return chosen, [(name, x / whole if whole else dict(shares)[name]) for name, x in rest.items()]


def grouped_split(df: DataFrame, key: str = "record_id", source: str = "source_file", seed: int = 42) -> DataFrame:
    """(key, component, label) of every distinct key: records that share a book, under any name, get one label.

    A record delivered under several names ties these together. Records without a name, or with a blank one, are
    components of their own; null keys are left out.
    """
    rows = df.select(key, source).where(F.col(key).isNotNull()).distinct()
    named = rows.join(small_side(book_keys(rows, source)), source, "left")
    graph = named.select(F.concat(F.lit("r:"), F.col(key)).alias("a"), F.coalesce(F.concat(F.lit("b:"), F.col("book")), F.concat(F.lit("r:"), F.col(key))).alias("b"))
    # Books tied by a record are few; records hang on their least book, so the loop runs over books alone.
    first = graph.groupBy("a").agg(F.min("b").alias("least"), F.count_distinct("b").alias("n"))
    ties = graph.join(first.where("n > 1"), "a").where(F.col("b") != F.col("least")).select("least", F.col("b").alias("other"))
    books = connected_components(ties, "least", "other")
    out = first.join(books, F.col("least") == F.col("node"), "left").select(F.expr("substring(a, 3)").alias(key), F.coalesce("component", "least").alias("component"))
    # A component of many records would tilt the hash's ranges: those above HEAVY of all records, 1 / HEAVY at most,
    # are placed by size, and the ranges make up for them.
    sizes = out.groupBy("component").agg(F.count("*").alias("n"))
    total = rows.select(key).distinct().count()
    heavy = [tuple(r) for r in sizes.where(F.col("n") >= max(2, HEAVY * total)).collect()]
    chosen, rest = placed_labels(heavy, total)
    label = label_column(F.col("component"), seed, rest)
    if chosen:
        label = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(chosen.items()) for x in kv])[F.col("component")], label)
    return out.withColumn("label", label)


def split_shares(labels: DataFrame) -> DataFrame:
    """(label, records, share)."""
    total = labels.agg(F.count("*").alias("total"))
    return labels.groupBy("label").agg(F.count("*").alias("records")).crossJoin(F.broadcast(total)).select("label", "records", F.round(F.col("records") / F.col("total"), 6).alias("share"))
