"""Allow and block lists over URLs: host-suffix and path-prefix expressions joined by short hash prefixes.

A rule is a host and the beginning of a path. It fits its host and all subdomains where the URL's
path starts with the rule's. As in published safe-browsing lookups,

* a URL is expanded into expressions, one for each suffix of its host and each beginning of its path
  that has the shape (labels of the host, length of the path) of some rule;
* the first bytes of each expression's SHA-256 are joined with those of the rules. Only these bytes
  travel with the URL;
* what meets by its prefix counts only if the whole digests agree, and of the rules that fit the
  longest decides.

Each different (host, path) is judged once. Spark broadcasts the rules if its own size check allows and
splits a prefix that very many URLs share otherwise: both sides of that join come from a shuffle.

Defined cases: a URL that is null or has no ``://`` has an empty host and path; no rule fits an empty
host. An empty table gives an empty table, repeated rows stay, all columns are kept. A rule without a
host fits nothing, a null path fits every path, actions other than allow and block are ignored. Of rules
of one length the one with the longer host decides, of equal rules the blocking one. Very long URLs are
expanded to the shapes of the rules only, so the number of expressions doesn't grow with the URL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, store

#: Bytes of a digest that are joined.
PREFIX_BYTES = 4
#: What a URL is that no rule fits.
DEFAULT = "allow"


def lower_ascii(text: Column) -> Column:
    """A-Z as small letters, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, and from there to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _dots(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))


def _digest(host: Column, path: Column) -> Column:
    """The digest of an expression; no host holds a slash, so host and path stay apart."""
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def prepared(rules: DataFrame) -> DataFrame:
    """One row for each rule: ``prefix``, ``digest``, ``rule``, ``action``, and its shape ``dots``, ``width``."""
    host, path = lower_ascii(F.coalesce(F.col("host"), F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    digest = _digest(F.col("host"), F.col("path"))
    return (
        rules.filter(F.col("action").isin("allow", "block")).select(host.alias("host"), path.alias("path"), "action")
        .filter(F.col("host") != "").groupBy("host", "path").agg(F.max("action").alias("action"))
        .select(
            F.substring(digest, 1, PREFIX_BYTES).alias("prefix"), digest.alias("digest"), F.concat("host", "path").alias("rule"), "action",
            F.length("host").alias("host_width"), _dots(F.col("host")).alias("dots"), F.length("path").alias("width"))
    )


def shapes(rules: DataFrame) -> list[tuple[int, list[int]]]:
    """For each number of dots of a rule's host the path lengths of such rules.

    This goes to the driver: it is bounded by the labels of a host name times the lengths of a path,
    however many rules there are.
    """
    found = rules.groupBy("dots").agg(F.array_sort(F.collect_set("width")).alias("widths")).collect()
    return sorted((r.dots, list(r.widths)) for r in found)


def verdicts(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` and the deciding ``rule`` and ``action`` of those different targets that a rule fits."""
    known = store(prepared(rules), "rules")
    by_dots = shapes(known)
    if not by_dots:
        return targets.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")).limit(0)
    host, path, at = F.col("host"), F.col("path"), F.col("at")
    suffix = F.call_function("substring_index", host, F.lit("."), -(at["dots"] + 1))
    beginning = F.substring(path, F.lit(1), at["width"])

    def asked(dots: int, widths: list[int]) -> Column:
        short = F.filter(F.array(*map(F.lit, widths)), lambda w: w <= F.length(path))
        shaped = F.transform(short, lambda w: F.struct(F.lit(dots).alias("dots"), w.alias("width")))
        return F.when((host != "") & (_dots(host) >= dots), shaped).otherwise(F.array().cast("array<struct<dots:int,width:int>>"))

    expressions = (
        targets.select("host", "path").distinct()
        .select("host", "path", F.explode(reduce(F.concat, [asked(*s) for s in by_dots])).alias("at"))
        .select("host", "path", "at", F.substring(_digest(suffix, beginning), 1, PREFIX_BYTES).alias("prefix"))
    )
    met = expressions.join(known.drop("dots", "width"), "prefix")
    confirmed = _digest(suffix, beginning) == F.col("digest")
    rank = F.struct(F.length("rule").alias("length"), "host_width", F.col("action").alias("action"), F.col("rule").alias("rule"))
    return (
        met.groupBy("host", "path").agg(F.max(F.when(confirmed, rank)).alias("best"))
        .filter(F.col("best").isNotNull()).select("host", "path", "best.rule", "best.action")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """All rows and columns of ``pages`` plus a struct ``judged`` of host, path, rule and verdict.

    ``rules`` has the columns host, path and action. See the module's text for nulls, empty tables and ties.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    names = {name: fresh(pages, name) for name in ("target_host", "target_path", "judged")}
    parsed = pages.withColumn(names["target_host"], host).withColumn(names["target_path"], path)
    found = store(verdicts(parsed.select(F.col(names["target_host"]).alias("host"), F.col(names["target_path"]).alias("path")), rules), "verdicts")
    found = found.select(
        F.col("host").alias(names["target_host"]), F.col("path").alias(names["target_path"]),
        F.struct("host", "path", "rule", F.col("action").alias("verdict")).alias(names["judged"]))
    unruled = F.struct(
        F.col(names["target_host"]).alias("host"), F.col(names["target_path"]).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    joined = parsed.join(found, [names["target_host"], names["target_path"]], "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], F.coalesce(F.col(names["judged"]), unruled).alias(names["judged"]))
