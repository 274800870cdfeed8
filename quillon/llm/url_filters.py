"""URL filters: block and allow rules on hosts and path prefixes, by a range sweep.

A rule fits its host with all subdomains, and every path that starts with the
rule's. Reversed-host keys (``com.example.``) turn "host and subdomains" into
one interval of keys, and the bytes of the path do the same for prefixes.
Intervals of either kind nest or are disjoint, so a sorted sweep needs only a
stack: an interval's start pushes a rule, its end pops it.

Two sweeps run, each a sort with a running ``last``: the first finds the stack
of rule hosts for each url, the second, within a rule host, the longest path
prefix. The stack after each boundary is a property of the rules alone and is
computed from them, so the sweep carries it as a value. URLs are dealt out by a
hash of the row, so that no host or url can be hot; the boundaries go to each
part and are spilled to disk like any other rows, not held in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower

RULES_SCHEMA = "action string, host string, path string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from right to left, each followed by a dot: a subdomain's key starts with its parent's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def path_key(path: Column) -> Column:
    """Hexadecimal UTF-8: byte order, with room for an end mark (``G``) above every prefix's extension."""
    return F.hex(F.encode(path, "UTF-8"))


def sweep(points: DataFrame, marks: DataFrame, by: list[str], payload: str, parts: int) -> DataFrame:
    """``points`` with the ``payload`` of the last mark at or before each, in the order of ``by``.

    ``points`` carry ``_part``. A mark's payload is never null.
    """
    extra = [c for c in points.columns if c not in by and c != "_part"]
    each = marks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), *by, payload)
    both = each.withColumn("_kind", F.lit(0)).unionByName(points.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("_part").orderBy(*by, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(payload, F.last(payload, ignorenulls=True).over(w)).where("_kind = 1").select("_part", *by, *extra, payload)


def host_marks(rules: DataFrame) -> DataFrame:
    """Boundaries of the rule hosts' intervals: ``_key`` and the stack of rule hosts from there on."""
    hosts = rules.select("host").distinct().withColumn("_key", host_key(F.col("host")))
    labels = F.split("host", r"\.", -1)
    up = hosts.select("host", "_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    known = up.join(hosts.select(F.col("host").alias("up")), "up").groupBy("host", "_key").agg(F.sort_array(F.collect_set("up")).alias("stack"))
    # "/" follows "." and is in no host: the end of all keys that start with this one.
    end = known.select(F.concat(F.expr("left(_key, length(_key) - 1)"), F.lit("/")).alias("_key"), F.array_remove("stack", F.col("host")).alias("stack"))
    return known.select("_key", "stack").unionByName(end)


def path_marks(rules: DataFrame) -> DataFrame:
    """Boundaries within each rule host: ``_key`` and the innermost rule from there on."""
    each = rules.withColumn("_p", path_key(F.col("path")))
    empty = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("action"))
    top = F.struct("path", "action")
    begin = each.select("host", F.lit("").alias("_key"), empty.alias("top")).distinct().join(each.where("path = ''").select("host"), "host", "left_anti")
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring("path", F.lit(1), n))
    wider = each.where("path <> ''").select("host", "_p", F.explode(prefixes).alias("path")).join(rules, ["host", "path"])
    outer = wider.groupBy("host", "_p").agg(F.max_by(top, F.length("path")).alias("up"))
    end = each.join(outer, ["host", "_p"], "left").select("host", F.concat("_p", F.lit("G")).alias("_key"), F.coalesce("up", empty).alias("top"))
    return begin.unionByName(each.select("host", F.col("_p").alias("_key"), top.alias("top"))).unionByName(end)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` for each row of ``pages``.

    ``rules`` has ``action`` (block or allow), ``host`` and ``path``. The longest
    ``host || path`` that fits wins, of equally long ones the more specific host.
    Where no rule fits, null urls included, ``rule`` is null and the verdict is
    ``default``. Rules with a null or empty host or a null path are ignored; of
    rules with one host and path, block wins. Repeated rows are judged each on
    its own. Other columns of ``pages`` aren't read.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.where("host <> '' and path is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("action").alias("action"))
    # The row's number keeps repeated rows apart; the random part spreads hot hosts.
    row = F.monotonically_increasing_id()
    points = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"), row.alias("_row"))
    points = points.withColumn("_key", host_key(F.col("_host"))).withColumn("_part", F.pmod(F.xxhash64("_row", "_id"), F.lit(parts)).cast("int"))
    seen = sweep(points, host_marks(rules), ["_key"], "stack", parts)
    fits = seen.drop("_key").select("*", F.explode_outer("stack").alias("host")).drop("stack")
    fits = fits.withColumn("_key", path_key(F.col("_path")))
    # Rows without a rule host keep host null: the sweep sorts them first, before any mark.
    last = sweep(fits, path_marks(rules), ["host", "_key"], "top", parts).where("host is null or top is not null")
    name = F.concat("host", F.col("top.path"))
    best = F.struct(F.length(name).alias("n"), F.length("host").alias("h"), name.alias("rule"), F.col("top.action").alias("action"))
    last = last.withColumn("_best", F.when(F.col("host").isNotNull() & F.col("top.path").isNotNull(), best))
    ranked = last.groupBy("_part", "_row", "_id", "_host", "_path").agg(F.max("_best").alias("_max"))
    return ranked.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_max.rule").alias("rule"), F.coalesce("_max.action", F.lit(default)).alias("verdict"),
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of (action, host, path) from literals."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("action", "host", "path"), strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))
