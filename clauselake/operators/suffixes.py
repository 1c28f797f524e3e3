"""Registrable domains by a table of public suffix rules.

Rules meet distinct hosts, not rows: every host gives its suffixes, a suffix looks up the rule of its own name,
the exception of its own name and the wildcard above it, and the best rule of a host is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions import urls as ur
from clauselake.operators.keyed import small_side, spread_join


def suffix_rules(lines: DataFrame, rule: str = "rule", private: str | None = "private") -> DataFrame:
    """``(kind, name, private)`` from rules as the public suffix list writes them; empty and repeated ones fall out.

    ``kind`` is ``rule``, ``wildcard`` or ``exception``; ``name`` is the rule without its mark. A name that is listed
    both as private and not counts as not private.
    """
    text = F.lower(F.trim(rule))
    kind = F.when(F.startswith(text, F.lit("!")), "exception").when(F.startswith(text, F.lit("*.")), "wildcard").otherwise("rule")
    name = F.regexp_replace(text, r"^(!|\*\.)", "")
    own = F.coalesce(F.col(private), F.lit(False)) if private else F.lit(False)
    return lines.select(kind.alias("kind"), name.alias("name"), own.alias("private")).where("name <> ''") \
        .groupBy("kind", "name").agg(F.min("private").alias("private"))


def host_parts(hosts: DataFrame, rules: DataFrame, host: str = "host", private: bool = True) -> DataFrame:
    """``(host, subdomain, root_domain, tld)`` of every distinct host; null hosts fall out.

    An exception wins over every rule, then the rule with most labels, else the last label is the suffix.
    ``private=False`` leaves out the rules of private owners. A host that is a suffix itself has no
    registrable domain: ``root_domain`` is null.
    """
    distinct = hosts.select(F.col(host).alias("host")).where("host is not null").distinct()
    listed = rules if private else rules.where(~F.col("private"))
    cut = distinct.select("host", F.posexplode(ur.host_suffixes(F.col("host"))).alias("_pos", "_suffix"))
    above = ur.parent_domain(F.col("_suffix"))
    asked = cut.select("host", "_pos", "_suffix", F.inline(F.array(
        F.struct(F.lit("rule").alias("kind"), F.col("_suffix").alias("name")),
        F.struct(F.lit("wildcard").alias("kind"), above.alias("name")),
        F.struct(F.lit("exception").alias("kind"), F.col("_suffix").alias("name")))))
    hit = asked.join(small_side(listed.select("kind", "name")), ["kind", "name"])
    exception = F.col("kind") == "exception"
    best = hit.groupBy("host").agg(F.min_by(
        F.when(exception, ur.parent_domain(F.col("_suffix"))).otherwise(F.col("_suffix")),
        F.struct((~exception).cast("int"), F.col("_pos"))).alias("_found"))
    labels = F.split("host", r"\.")
    tld = F.coalesce("_found", F.element_at(labels, -1))
    extra = F.size(labels) - F.size(F.split("tld", r"\."))
    root = F.get(ur.host_suffixes(F.col("host")), extra - 1)
    sub = F.when(F.length("host") > F.length("root_domain"),
                 F.substring("host", F.lit(1), F.length("host") - F.length("root_domain") - 1))
    return distinct.join(best, "host", "left").withColumn("tld", tld).withColumn("root_domain", root) \
        .select("host", sub.alias("subdomain"), "root_domain", "tld")


def with_roots(df: DataFrame, rules: DataFrame, hosts: dict[str, str], private: bool = True) -> DataFrame:
    """Add the registrable domain of each host column, under the name ``hosts`` gives it.

    All columns share one table of distinct hosts; a host with most of the rows is spread over tasks.
    """
    every = None
    for host in hosts:
        own = df.select(F.col(host).alias("host"))
        every = own if every is None else every.unionByName(own)
    parts = host_parts(every, rules, private=private).select("host", "root_domain")
    for host, root in hosts.items():
        df = spread_join(df, parts.select(F.col("host").alias(host), F.col("root_domain").alias(root)), [host], "left")
    return df
