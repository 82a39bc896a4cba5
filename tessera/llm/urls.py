"""URL rules by expansion into host suffixes and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash prefix that the join is on (4 bytes).
PREFIX = 8
#: A list of at most so many rules is broadcast (under 100 MB); a longer one is joined by a shuffle.
BROADCAST_RULES = 500_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash sign or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All pairs of a host suffix, at a label, and a path prefix, of one of `lengths`, as text."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat(h, F.substr(path, F.lit(1), n))))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of `pages` (page_id, url) with host, path, rule and verdict, by `rules` (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins, then block
    before allow. Distinct (host, path) are expanded into host-suffix and path-prefix expressions, joined with the rules
    on the first 4 bytes of SHA-256, and confirmed on the whole digest; the best rule for each goes back to the rows.
    Path prefixes are taken at the lengths that rules have, so any prefix can be a rule. Pages with one common host
    spread over the join, as their key is the hash of host and path together.

    Null url, or one without ://: host and path empty, rule null, verdict `default`. A rule with a null or empty host
    fits nothing; a null path counts as empty. Repeated pages give repeated rows. Further columns are ignored.
    """
    listed = rules.select(F.col("host").alias("rule_host"), F.coalesce(F.col("path"), F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host <> ''")
    listed = listed.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())  # bounded by the longest path
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = F.broadcast(listed) if listed.count() <= BROADCAST_RULES else listed
    places = rows.where("host <> ''").select("host", "path").distinct()
    hits = (
        places.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX))
        .join(known, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.rule_verdict")
    )
    # urls without a host fit nothing and stay out of the join, where they would all have one key; AQE splits a frequent url
    judged = rows.where("host <> ''").join(hits, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
