"""Readers of corpora, logs, event files and sitemaps."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake import schemas
from clauselake.functions.urls import url_host
from clauselake.operators.keyed import small_side, spread_join, top_per_key
from clauselake.operators.suffixes import suffix_rules
from clauselake.session import durable, exists
from clauselake.sources.arrays import read_json_array

# File kinds of a corpus, and the event file name.
CORPUS_GLOB = "*.{txt,md,html,htm,TXT,MD,HTML,HTM}"
EVENT_NAME = r"log_(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z_(\w+)\.json$"


def read_corpus(spark: SparkSession, path: str, glob: str = CORPUS_GLOB) -> DataFrame:
    """``filename, content`` of every text, Markdown and HTML file; unreadable ones are skipped."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))
    )


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """One event per JSON file, with the type and time its name holds."""
    raw = (
        spark.read.schema(schemas.EVENT_FILES)
        .option("multiLine", True)
        .option("pathGlobFilter", "log_*.json")
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("file_name"))
    )
    return with_event_name(raw)


def with_event_name(events: DataFrame, name: str = "file_name") -> DataFrame:
    """Add ``event_type`` and ``event_time`` from a file name such as
    ``log_2025-11-20T19-11-15-383Z_search_query.json``."""

    def part(i: int) -> Column:
        return F.regexp_extract(name, EVENT_NAME, i)

    text = F.concat(
        part(1), F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("."), part(5)
    )
    return events.withColumn("event_type", F.nullif(part(6), F.lit(""))).withColumn(
        "event_time", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    )


def read_jsonl_logs(spark: SparkSession, path: str, date: str = "*") -> DataFrame:
    """Log entries of one day (or all days); blank lines fall out."""
    return (
        spark.read.schema(schemas.DEEP_LOG_ENTRIES)
        .option("pathGlobFilter", f"deep_log_{date}.jsonl")
        .option("mode", "DROPMALFORMED")
        .json(path)
    )


def stream_jsonl_logs(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of new files."""
    return (
        spark.readStream.schema(schemas.DEEP_LOG_ENTRIES)
        .option("pathGlobFilter", "deep_log_*.jsonl")
        .json(path)
    )


def read_analysis_log(spark: SparkSession, path: str) -> DataFrame:
    """Analysis log kept as one JSON array, read in splits by many tasks; an empty frame when there is no file."""
    raw = read_json_array(spark, path, schemas.ANALYSIS_LOG) if exists(spark, path) else spark.createDataFrame([], schemas.ANALYSIS_LOG)
    return raw.select(
        "id", "domain", "url", "timestamp", "success", "error", "score",
        F.col("policyType").alias("policy_type"), F.col("analysisTimeMs").alias("analysis_time_ms"),
        F.col("feedbackType").alias("feedback_type"), F.col("feedbackUrl").alias("feedback_url"),
        F.col("feedbackAt").alias("feedback_at"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages: page_id, url, html."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_terms(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Language table ``lang, concept, term`` (JSON lines) as the operators take it.

    It is a word list, not data: a few thousand rows at most, checked before it is collected.
    """
    rows = spark.read.schema("lang string, concept string, term string").json(path).limit(20_001)
    found = rows.collect()
    if len(found) > 20_000:
        raise ValueError("a language table holds at most 20000 words")
    table: dict[str, dict[str, str]] = {}
    for r in found:
        table.setdefault(r["lang"], {})[r["concept"]] = r["term"]
    return table


def read_public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """Rules ``kind, name, private`` of a public suffix list file, as ``operators.suffixes`` takes them.

    A line is a rule up to its first white space; empty lines and ``//`` comments fall out. Rules between the marks
    ``===BEGIN PRIVATE DOMAINS===`` and ``===END PRIVATE DOMAINS===`` are private.
    """
    whole = spark.read.text(path, wholetext=True)
    marked = F.regexp_replace("value", r"(?m)^//\s*===(BEGIN|END) PRIVATE DOMAINS===.*$", "\u0001$1")
    parts = whole.select(F.posexplode(F.split(marked, "\u0001BEGIN|\u0001END")).alias("part", "lines"))
    lines = parts.select((F.col("part") % 2 == 1).alias("private"), F.explode(F.split("lines", r"\r?\n")).alias("line"))
    rule = F.regexp_extract("line", r"^\s*(\S+)", 1)
    return suffix_rules(lines.select(rule.alias("rule"), "private").where(~F.startswith("rule", F.lit("//"))))


def sitemap_lines(robots: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``Sitemap:`` lines of robots.txt bodies: url, pos, sitemap_url."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return robots.select(url, F.posexplode(found).alias("pos", "sitemap_url"))


def sitemap_sources(domains: DataFrame, robots_lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Sitemaps per domain: the robots lines (the first ``limit`` if given), else ``/sitemap.xml``."""
    named = robots_lines.withColumn("domain", url_host(F.col("url")))
    if limit is not None:
        named = top_per_key(named, ["domain"], [F.col("pos"), F.col("sitemap_url")], limit)
    listed = named.select("domain", "sitemap_url")
    missing = domains.select("domain").distinct().join(listed, "domain", "left_anti")
    return listed.join(domains.select("domain").distinct(), "domain", "left_semi").unionByName(
        missing.withColumn(
            "sitemap_url", F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap.xml"))
        )
    )


def index_ways(edges: DataFrame, longest: int | None) -> DataFrame:
    """``parent, index, steps`` of the shortest ways along ``parent, index`` to other indexes, of at most ``longest`` steps."""
    newest = durable(edges.select("parent", "index", F.lit(1).alias("steps")))
    ways, length = newest, 1
    while longest is None or length < longest:
        # A way of up to twice the length begins with a shortest one of the full length.
        far = newest.where(F.col("steps") == length).select("parent", F.col("index").alias("_via"), F.col("steps").alias("_first"))
        step = far.join(ways.select(F.col("parent").alias("_via"), "index", "steps"), "_via").where("parent != index").select(
            "parent", "index", (F.col("_first") + F.col("steps")).alias("steps"), F.lit(False).alias("_known"))
        newest = durable(step.unionByName(ways.withColumn("_known", F.lit(True))).groupBy("parent", "index").agg(
            F.min("steps").alias("steps"), F.bool_or("_known").alias("_known")).where(~F.col("_known")).drop("_known"))
        if newest.isEmpty():
            break
        ways, length = ways.unionByName(newest), length * 2
    return ways


def alike_files(owners: DataFrame, most: int = 100) -> DataFrame:
    """``url, bundle``: files that the same indexes lead to (``index, url, extra``) have one number; those of very many indexes one each."""
    few = owners.groupBy("url").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select("url")
    owner = F.concat_ws(":", F.col("index").cast("string"), F.col("extra").cast("string"))
    listed = owners.join(few, "url", "left_semi").groupBy("url").agg(F.array_join(F.array_sort(F.collect_list(owner)), ",").alias("_key"))
    alone = owners.join(few, "url", "left_anti").select("url", F.concat(F.lit("alone "), "url").alias("_key")).distinct()
    keyed = durable(listed.unionByName(alone))
    numbers = durable(keyed.select("_key").distinct().select("_key", F.monotonically_increasing_id().alias("bundle")))
    return durable(keyed.join(numbers, "_key").select("url", "bundle"))


def read_sitemap_urls(sitemaps: DataFrame, url: str = "url", body: str = "body", max_depth: int | None = None,
                      first: str | None = None) -> DataFrame:
    """All addresses of url sets, and those of every url set that an index file reaches.

    Result: sitemap_url, loc. An index may name further indexes, to any depth (or ``max_depth`` steps); each index
    reaches a file once, however many ways lead to it, and indexes that name each other end there. Files
    that are not in the table give nothing. ``first`` names a column to add, true in one row of each address of a sitemap.

    The rows can be many times the input (each index repeats what the indexes below it give). They are made only in
    the last step, by each task for itself; before, 64 indexes that reach the same files are the bits of one number.
    """
    xml = F.col(body)
    locs = F.regexp_extract_all(
        xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)
    )
    is_index = F.coalesce(F.rlike(xml, F.lit(r"(?i)<sitemapindex[\s>]")), F.lit(False))
    plain = sitemaps.where(~is_index).select(F.col(url).alias("url"), F.explode(locs).alias("loc"))
    edges = durable(sitemaps.where(is_index).select(
        F.col(url).alias("_from"), F.explode(F.array_distinct(locs)).alias("_to")).distinct())
    marked = [] if first is None else [F.col("_first").alias(first)]
    result = [F.col("url").alias("sitemap_url"), F.col("loc"), *marked]
    copies = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")
    if edges.isEmpty() and first is None:
        return plain.select(*result)
    counted = durable(plain.groupBy("url", "loc").agg(F.count(F.lit(1)).alias("n")))

    # Indexes by number; those which are next by name share the bits of one block.
    nodes = durable(edges.select("_from").distinct().sort("_from").select("_from", F.monotonically_increasing_id().alias("_id")))
    block = F.shiftright("_id", 6)
    bit = F.col("_id").bitwiseAND(63).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    numbered = edges.join(nodes.withColumnRenamed("_from", "_f"), F.col("_from").eqNullSafe(F.col("_f"))).select(F.col("_id").alias("parent"), "_to")
    onward = numbered.join(nodes, F.col("_to") == F.col("_from")).select("parent", F.col("_id").alias("index")).where("parent != index")
    # Ways are only followed between indexes that lead to others; the files of those that do not count as their parents' own.
    leading = onward.select(F.col("parent").alias("index"), F.lit(True).alias("leads")).distinct()
    onward = durable(onward.join(leading, "index", "left"))
    ways = index_ways(onward.where("leads"), None if max_depth is None else max_depth - 1)
    direct = durable(numbered.join(counted.select(F.col("url").alias("_to")).distinct(), "_to").select(F.col("parent").alias("index"), F.col("_to").alias("url")))
    below = onward.where("leads IS NULL").withColumnRenamed("index", "_below").join(direct.withColumnRenamed("index", "_below"), "_below")
    owners = durable(direct.withColumn("extra", F.lit(1)).unionByName(
        below.select(F.col("parent").alias("index"), "url", F.lit(1 if max_depth is None else 2).alias("extra"))).groupBy(
        "index", "url").agg(F.min("extra").alias("extra")))
    files = alike_files(owners)
    owned = owners.join(files, "url").select("index", "bundle", "extra").distinct()
    itself = nodes.select(F.col("_id"), F.col("_id").alias("index"), F.lit(0).alias("steps"))
    held = ways.select(F.col("parent").alias("_id"), "index", "steps").unionByName(itself)
    step = "steps" if max_depth is not None else F.lit(0).alias("steps")
    held = held.groupBy(block.alias("block"), "index", step).agg(F.bit_or(mask).alias("mask")).join(owned, "index")
    if max_depth is not None:
        held = held.where(F.col("steps") + F.col("extra") <= max(max_depth, 1))
    # An index that is a file too has its own addresses besides.
    both = nodes.join(counted.select("url").distinct(), F.col("_from").eqNullSafe(F.col("url"))).select("_id", "url", (-1 - F.col("_id")).alias("bundle"))
    reached = durable(held.groupBy("block", "bundle").agg(F.bit_or("mask").alias("mask")).unionByName(
        both.select(block.alias("block"), "bundle", mask.alias("mask"))))
    files = files.unionByName(both.select("url", "bundle")).withColumnRenamed("url", "_url")
    held = durable(counted.join(files, F.col("url").eqNullSafe(F.col("_url"))).groupBy("bundle", "loc").agg(F.sum("n").alias("n")))

    names = small_side(nodes.groupBy(block.alias("block")).agg(F.collect_list(F.struct(bit.alias("bit"), F.col("_from").alias("url"))).alias("_names")))

    def told(rows: DataFrame, *columns: str) -> DataFrame:
        has = F.getbit("mask", F.col("_of.bit")) == 1
        return rows.join(names, "block").select("mask", *columns, F.explode("_names").alias("_of")).where(has)

    # The rows are made in as many tasks as the session names, however few bytes they start from.
    spark = sitemaps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    single = held
    own = counted.join(nodes, F.col("url").eqNullSafe(F.col("_from")), "left_anti").select("url", "loc", copies).withColumn("_first", F.col("_copy") == 1)
    parts = [own]
    if first is not None:
        # What is in several bundles is first in the first of them that an index reaches.
        several = held.groupBy("loc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("loc")
        single = spread_join(held, several, ["loc"], "left_anti")
        before = Window.partitionBy("block", "loc").orderBy("bundle").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.coalesce(F.bit_or("mask").over(before), F.lit(0).cast("bigint"))
        shared = reached.join(spread_join(held, several, ["loc"], "left_semi"), "bundle").repartition(tasks, "block", "loc").withColumn("_new", F.col("mask").bitwiseAND(F.bitwise_not(seen)))
        parts.append(told(shared, "loc", "n", "_new").select("_of", "loc", "_new", copies).select(
            F.col("_of.url").alias("url"), "loc", ((F.col("_copy") == 1) & (F.getbit("_new", F.col("_of.bit")) == 1)).alias("_first")))
    # Addresses of a bundle in lists of some hundreds, so that a large one is told by many tasks.
    single = single.select("bundle", "loc", copies)
    lists = single.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / 500).alias("_lists"))
    at = F.pmod(F.xxhash64("loc", "_copy"), F.col("_lists")).alias("_list")
    filled = spread_join(single, lists, ["bundle"]).groupBy("bundle", at).agg(
        F.collect_list(F.struct("loc", (F.col("_copy") == 1).alias("_first"))).alias("_locs"))
    asked = reached.join(lists, "bundle").select("block", "mask", "bundle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lists") - 1)).alias("_list"))
    rows = asked.repartition(tasks, "bundle", "_list").hint("merge").join(filled.repartition(tasks, "bundle", "_list"), ["bundle", "_list"])
    parts.append(told(rows, "_locs").select(F.col("_of.url").alias("url"), F.explode("_locs").alias("_l")).select("url", "_l.loc", "_l._first"))
    told_all = parts[0].select(*result)
    for part in parts[1:]:
        told_all = told_all.unionByName(part.select(*result))
    return told_all
