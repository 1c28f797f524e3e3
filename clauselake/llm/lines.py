"""Line deduplication by a tree of log templates, in DataFrame functions only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable, whole_text
from clauselake.session import release

#: Leading tokens that, with the token count, choose the leaf of a line.
DEPTH = 4
#: Constant tokens that a line needs, in number and as a share of all, for its others to count as variable fields.
CONSTANT, CONSTANT_SHARE = 3, 0.5
#: Stretches of a line that are compared within a leaf, and how many of them may be variable fields.
STRETCHES, VARIABLE = 8, 2
PAIRS = [f"p{i}" for i in range(STRETCHES // 2)]
LOW = (1 << 32) - 1


def _split(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"[\x09-\x0D]", " ")), " +")


def _tokens(line: Column) -> Column:
    """White-space tokens; one with a digit is a variable field, `<*>`."""
    return _split(F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>"))
                  .otherwise(line))


def _is_template(t: Column) -> Column:
    """True if enough tokens are constant; rows of numbers are not."""
    constant = F.size(F.filter(t, lambda x: x != "<*>"))
    return (constant >= CONSTANT) & (constant >= F.size(t) * F.lit(CONSTANT_SHARE))


def _row(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__line_row", F.xxhash64("doc_id", "text"))


def parsed(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, at, n, line, leaf, p0 .. p3)`` per line that has words, hashes instead of texts.

    ``line`` identifies the line with its fields replaced, ``leaf`` the count and leading tokens, and
    ``p0 .. p3`` the eight stretches of a line of eight tokens or more, two 32-bit hashes in each. A line with
    too few constant tokens keeps its numbers and has no stretches: it is compared by its exact tokens.
    """
    rows = _row(docs).select(
        F.col("__line_row").alias("row"), "doc_id", F.posexplode(F.split(whole_text(), "\n")).alias("at", "line"))
    rows = rows.select("row", "doc_id", "at", "line", F.inline(F.array(F.struct(_tokens(F.col("line")).alias("g")))))
    rows = rows.select("row", "doc_id", "at", F.inline(F.array(F.struct(
        _is_template(F.col("g")).alias("fits"), F.when(_is_template(F.col("g")), F.col("g")).otherwise(_split(F.col("line"))).alias("t")))))
    n = F.size("t")
    cut = [(n * i / STRETCHES).cast("int") for i in range(STRETCHES + 1)]
    stretch = [F.hash(F.slice("t", a + 1, b - a)).cast("long") for a, b in itertools.pairwise(cut)]
    pairs = [F.when((n >= STRETCHES) & F.col("fits"), F.shiftleft(a, 32).bitwiseOR(b.bitwiseAND(F.lit(LOW)))).alias(f"p{i}")
             for i, (a, b) in enumerate(zip(stretch[::2], stretch[1::2], strict=True))]
    return rows.where(~((n == 1) & (F.col("t")[0] == ""))).select(
        "row", "doc_id", "at", n.alias("n"), F.xxhash64("t").alias("line"),
        F.xxhash64(n, F.slice("t", 1, DEPTH)).alias("leaf"), *pairs)


def templates(lines: DataFrame, min_docs: int = 2, short_docs: int = 10, least: int = 3, short: int = 8) -> DataFrame:
    """``(line, doc_id, row, at)``: recurring lines with the first place of their template.

    Lines of ``short`` tokens or more that share a leaf belong to the template of that leaf's most
    frequent stretches (ties to the first seen) when at most ``VARIABLE`` of eight stretches differ; any other line is its own
    template, and a line with too few constant tokens recurs only as it stands. A template recurs in ``min_docs`` documents (``short_docs`` if it has fewer than
    ``short`` tokens, never under ``least``), counted by pairs of document and variant, in two
    documents at least. Everything before the last sums is pre-aggregated by line.
    """
    place = F.struct("doc_id", "row", "at")
    by_doc = lines.groupBy("line", "row").agg(
        F.min(place).alias("first"), F.first("n").alias("n"), F.first("leaf").alias("leaf"),
        *[F.first(p).alias(p) for p in PAIRS])
    distinct = durable(by_doc.groupBy("line").agg(
        F.count("*").alias("docs"), F.min("first").alias("first"), F.max("row").alias("hi"),
        F.min("row").alias("lo"), F.first("n").alias("n"), F.first("leaf").alias("leaf"),
        *[F.first(p).alias(p) for p in PAIRS]))
    long = distinct.where((F.col("n") >= short) & F.col("p0").isNotNull())
    shared = long.groupBy("leaf").agg(F.count("*").alias("v")).where("v > 1")
    inside = long.join(shared.select("leaf"), "leaf")
    stretch = [half for p in PAIRS for half in (F.shiftrightunsigned(p, 32), F.col(p).bitwiseAND(F.lit(LOW)))]
    common = inside.select("leaf", "docs", "first", F.posexplode(F.array(*stretch)).alias("i", "s")) \
        .groupBy("leaf", "i", "s").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")) \
        .groupBy("leaf").agg(*[
            F.min(F.when(F.col("i") == i, F.struct(-F.col("docs"), "first", "s")))["s"].alias(f"c{i}") for i in range(STRETCHES)])
    differ = sum((s != F.col(f"c{i}")).cast("int") for i, s in enumerate(stretch))
    member = inside.join(common, "leaf").where(differ <= VARIABLE).select("line", F.col("leaf").alias("template"))
    placed = distinct.select("line", "docs", "first", "hi", "lo", "n").join(member, "line", "left") \
        .withColumn("lone", F.when(F.col("template").isNull(), F.col("line")))
    need = F.when(F.col("n") >= short, min_docs).otherwise(short_docs)
    alone = placed.where("template is null").where((F.col("docs") >= need) & (F.col("n") >= least)) \
        .select("line", "first")
    merged = placed.where("template is not null")
    whole = merged.groupBy("template").agg(
        F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("hi").alias("hi"), F.min("lo").alias("lo")) \
        .where(F.col("docs") >= min_docs).where("hi != lo").select("template", "first")
    return alone.union(merged.select("line", "template").join(whole, "template").select("line", "first"))


def drop_recurring_lines(docs: DataFrame, keep_first: bool = True, min_docs: int = 2, short_docs: int = 10,
                         into: tuple[str, str] = ("lines_cut", "lines_kept")) -> DataFrame:
    """All rows and columns of ``docs (doc_id, text, ...)``, with recurring template lines cut from ``text``.

    Two columns are added, the numbers of lines cut and kept (``n_chars`` is set anew where it exists).
    The first line of each template stays (by ``doc_id``, then place) unless ``keep_first`` is false.
    Rows are documents: repeated rows (same id and text) are one document and are cut alike. Null and
    empty texts stay as they are; a null ``doc_id`` is an id like any other and comes first. Lines of
    white space only are never cut. Other columns pass through, whatever their names (``into`` names
    the two added; others of these names are replaced). An empty table gives an empty one.
    """
    lines = durable(parsed(docs))
    found = templates(lines, min_docs, short_docs)
    cut = lines.select("row", "at", "line").join(found, "line")
    if keep_first:
        cut = cut.where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    cut = durable(cut.groupBy("row").agg(F.collect_set("at").alias("__line_cut")).withColumnRenamed("row", "__line_row"))
    # The written and shuffled lines can go before the texts are shuffled.
    del lines, found
    release(docs.sparkSession)
    whole = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("__line_cut"))
    joined = _row(docs.drop(*into)).join(cut, "__line_row", "left").select("*", F.inline(F.array(F.struct(
        whole.alias("__line_all"), F.when(F.col("__line_cut").isNotNull(), kept).alias("__line_kept")))))
    text = F.when(F.col("__line_cut").isNull(), F.col("text")).otherwise(F.array_join(
        F.transform("__line_kept", lambda i: F.element_at("__line_all", i + 1)), "\n"))
    out = joined.withColumn("text", text).withColumn(into[0], F.coalesce(F.size("__line_cut"), F.lit(0))) \
        .withColumn(into[1], F.coalesce(F.size("__line_kept"), F.size("__line_all"), F.lit(0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.drop("__line_row", "__line_cut", "__line_all", "__line_kept")
