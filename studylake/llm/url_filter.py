"""URL filters as a sort-merge range join.

A rule (host, path) fits a URL if its host equals the URL's host or a parent domain of it and the
URL's path starts with the rule's path. Every URL therefore has one canonical key per parent domain
that some rule names: the domain's labels in reverse, then the path. Under such a key a rule is the
interval of all keys that it begins, and the intervals of one domain are nested or disjoint. Keys and
rule starts are sorted together and swept once: each rule start carries the stack of rules that are
open there, and a key takes the last stack before it, popped to the rules that still contain it. The
innermost one left is the domain's answer, the longest over the domains is the URL's.

Each (domain, block) is swept on its own. Blocks bound the work for a domain with a third of all URLs:
a domain with n URLs and r rules has n / max(r, block_rows) blocks, and its rules are repeated in
each, so repeats never outnumber URLs plus rules. The joins by which keys learn of a domain's rules and
blocks are salted: a domain's keys are spread over ``spread`` parts, its one row repeated in each.

Only built-in column functions are used.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the default
verdict. Rules with a null in host, path or verdict are ignored. Of equal rules with different verdicts
"block" holds. Equal urls get equal rows; repeated rows stay repeated. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.llm.common import ascii_lower


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host: Column, path: Column) -> Column:
    return F.concat(_reversed_host(host), F.lit("\x00"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Rules with the stack of rules of the same host that contain them, outermost first.

    The containing rules are found by equality on the prefixes of a rule's own path, not by comparing
    all rules of a host."""
    prefixes = rules.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    prefixes = prefixes.select("host", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    outer = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    nested = prefixes.join(outer, (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("p")))
    entry = F.struct(F.length("p").alias("n"), F.col("p").alias("path"), F.col("verdict").alias("verdict"))
    return nested.groupBy("host", "path").agg(F.array_sort(F.collect_list(entry)).alias("stack"))


def url_verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow", block_rows: int = 1024, spread: int = 64) -> DataFrame:
    """``urls`` (page_id, url) judged by ``rules`` (host, path, verdict): page_id, host, path, rule, verdict."""
    pages = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    salt = F.pmod(F.xxhash64("path", "host"), F.lit(spread)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    keys = pages.filter("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("domain"), salt)
    sizes = rules.groupBy(F.col("host").alias("domain")).agg(F.count("*").alias("n_rules"))
    keys = keys.join(salted(sizes.select("domain")), ["domain", "salt"], "left_semi")

    blocks = F.ceil(F.col("n") / F.greatest(F.col("n_rules"), F.lit(block_rows)))
    blocks = keys.groupBy("domain").agg(F.count("*").alias("n")).join(sizes, "domain").select("domain", blocks.alias("blocks"))
    points = keys.join(salted(blocks), ["domain", "salt"]).select(
        "domain", F.pmod(F.xxhash64("host", "path"), F.col("blocks")).alias("block"),
        _key(F.col("domain"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).alias("stack"), "host", "path",
    )
    starts = rule_stacks(rules).withColumnRenamed("host", "domain").join(blocks, "domain")
    starts = starts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    starts = starts.select(
        "domain", "block", _key(F.col("domain"), F.col("path")).alias("key"), F.lit(0).alias("kind"), "stack",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )

    sweep = Window.partitionBy("domain", "block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.unionByName(points).repartition("domain", "block").withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    still = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    answers = swept.select("host", "path", "domain", F.try_element_at(still, F.lit(-1)).alias("r")).filter("r is not null")
    answer = F.struct(F.concat("domain", F.col("r.path")).alias("rule"), F.col("r.verdict").alias("verdict"))
    rank = F.struct(F.length("domain") + F.col("r.n"), F.length("domain"))
    best = answers.groupBy("host", "path").agg(F.max_by(answer, rank).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
