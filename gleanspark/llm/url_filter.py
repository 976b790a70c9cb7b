"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

A URL is expanded into every suffix of its host (at label bounds) joined with every prefix of its path whose length some
rule has.  Rules are listed by the first four bytes of their SHA-256.  Expansions meet the lists in an equi-join on that
prefix alone; the full digest and the expression itself then confirm, and of the rules that fit the longest wins.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; a rule never fits an empty
host; of rules equally long the one with the longer host wins; rules that repeat with one verdict are one rule, with
different verdicts ``block`` wins; URLs of any length are read whole; repeated and null page ids are separate rows; an empty
table or rule set gives default verdicts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import ascii_lower

#: Rule sets up to this many rows (about 100 bytes each) are broadcast; larger ones are joined by a shuffle, in which Spark
#: splits the expressions that many URLs share.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def hash_prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict); ``rules`` has host, path and verdict (allow or block)."""
    prepared = (
        rules.select(F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
        .where("r_host <> ''")
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("r_verdict"))  # block sorts after allow
        .withColumn("digest", F.sha2(expression(F.col("r_host"), F.col("r_path")), 256))
        .withColumn("prefix", hash_prefix(F.col("digest")))
    )
    listed = prepared.groupBy("prefix").agg(F.collect_list(F.struct("digest", "r_host", "r_path", "r_verdict")).alias("rules"))
    # Lengths are bounded by the longest rule, not by the number of rules.
    lengths = sorted(r[0] for r in prepared.select(F.length("r_path")).distinct().collect())
    n_rules = prepared.count()
    if n_rules <= BROADCAST_RULES:
        listed = F.broadcast(listed)

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]).cast("array<string>"), lambda p: p.isNotNull())
    every = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    tried = urls.select("page_id", "host", "path", F.explode(every).alias("e")).select("page_id", "host", "path", "e.h", "e.p")
    tried = tried.withColumn("u_digest", F.sha2(expression(F.col("h"), F.col("p")), 256)).withColumn("u_prefix", hash_prefix(F.col("u_digest")))
    near = tried.join(listed, F.col("u_prefix") == F.col("prefix"))
    confirmed = F.filter("rules", lambda r: (r["digest"] == F.col("u_digest")) & (r["r_host"] == F.col("h")) & (r["r_path"] == F.col("p")))
    fit = near.select("page_id", "host", "path", F.inline(confirmed))
    rule = F.concat("r_host", "r_path")
    best = fit.groupBy("page_id", "host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    u, b = urls.alias("u"), best.alias("b")
    same = F.col("u.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("u.host") == F.col("b.host")) & (F.col("u.path") == F.col("b.path"))
    return u.join(b, same, "left").select("u.page_id", "u.host", "u.path", F.col("b.best.rule").alias("rule"), F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"))
