"""Allow and block rules on hosts and paths, applied to urls with a sort-merge range join.

A rule is a (host, path) pair and fits its host and all subdomains, where the url's path starts with the rule's.  Written
as a canonical key, reversed host labels then path, a rule becomes an interval of keys: from the key itself up to, not
including, the key followed by the byte FF.  A url has one key for each of its host's suffixes that a rule could name.
Urls and the ends of the intervals are sorted together; a sweep along the order keeps the stack of open intervals, whose
top is the longest fitting rule of that suffix.  The longest over all suffixes wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.common import lower_ascii
from assay.session import width

# Copies of all rules together that the salts of hot hosts may make.
RULE_COPIES = 4_000_000

_OPEN, _URL, _CLOSE = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path goes on to
    ``?``, ``#`` or the end.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1)),
        F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1),
    )


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, ".").cast("binary"), F.lit(b"\x00"), path.cast("binary"))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path) triples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _boundaries(rules: DataFrame) -> DataFrame:
    """(suffix, key, kind, top): both ends of every rule's interval and the top of the stack behind each."""
    plain = (
        rules.where(F.col("host") != "").groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.array_join(_labels(F.col("host")), ".").alias("suffix"), _key(_labels(F.col("host")), F.col("path")).alias("key"),
            F.struct(
                (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"),
            ).alias("own"),
        )
    )
    ends = plain.select(
        "suffix", "own",
        F.explode(F.array(
            F.struct(F.col("key").alias("key"), F.lit(_OPEN).alias("kind")),
            F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(_CLOSE).alias("kind")),
        )).alias("end"),
    ).select("suffix", "own", "end.key", "end.kind")
    sweep = Window.partitionBy("suffix").orderBy("key")
    depth = ends.withColumn("depth", F.sum(F.when(F.col("kind") == _OPEN, 1).otherwise(-1)).over(sweep))
    # The interval on top at a depth is the last that opened to that depth: intervals nest or don't touch.
    level = Window.partitionBy("suffix", "depth").orderBy("key")
    opened = F.last(F.when(F.col("kind") == _OPEN, F.col("own")), ignorenulls=True).over(level)
    none = F.expr("named_struct('size', -1, 'host_size', -1, 'rule', cast(null as string), 'verdict', cast(null as string))")
    return depth.select("suffix", "key", "kind", F.when(F.col("depth") > 0, opened).otherwise(none).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The rule with the most characters of host and path wins, then the longer host; of equal rules with both verdicts, the
    one that sorts last (``block``).  ``rule`` is null and ``verdict`` the default where none fits; so it is for null urls.
    Repeated rows are judged one by one.  An empty rule table gives the default everywhere.
    """
    spark = pages.sparkSession
    ends = _boundaries(rules)
    seen = ends.agg(F.count("*"), F.max(F.size(F.split("suffix", r"\.")))).first()
    parts = width(spark)
    # A hot host is split by salt; every salt sweeps past all its rules.
    salts = int(min(parts, max(16, RULE_COPIES // max(1, seen[0]))))
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.slice(_labels(F.col("host")), 1, max(1, seen[1] or 0))
    levels = F.when(F.col("host") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(labels)))
    asks = (
        rows.select("*", labels.alias("labels"), F.explode(levels).alias("n"))
        .withColumn("prefix", F.slice("labels", 1, F.col("n")))
        .select(
            "row", "page_id", "host", "path", F.when(F.col("n") > 0, F.array_join("prefix", ".")).alias("suffix"),
            _key(F.col("prefix"), F.col("path")).alias("key"), F.lit(_URL).alias("kind"),
            F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"),
        )
    )
    events = asks.unionByName(
        ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")),
        allowMissingColumns=True,
    )
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind")
    found = events.withColumn("found", F.last("top", ignorenulls=True).over(sweep)).where(F.col("kind") == _URL)
    best = found.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("suffix").isNotNull() & F.col("found.rule").isNotNull(), F.col("found"))).alias("best"),
    )
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
