"""Quality rules: text statistics within a document and line frequency across documents.

Everything is built from DataFrame functions. Statistics need no shuffle: each
is an expression over the document's own text. Line frequency takes three
narrow shuffles (hashes and counts, never texts): distinct texts per host and
line, the frequent lines joined back, and the words each document loses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, let, split_join, written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """``max_line_docs``: distinct texts of one host that may carry a line; beyond
    it, only the document with the smallest id keeps the line.
    ``min_left``: a document is depleted when less than this share of its words is left."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_line_docs: int = 50
    min_left: float = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the document holds twice or more.

    The windows are sorted by hash, neighbours with one hash are the repeats,
    and their starts, sorted again, are merged: n log n for any length.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def repeated(s: Column) -> Column:
        here = F.sequence(F.lit(1), F.size(s))
        hit = lambda i: (F.get(s, i - 2)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i - 1)["h"])
        starts = F.transform(F.filter(here, lambda i: F.coalesce(hit(i), F.lit(False))), lambda i: F.get(s, i - 1)["p"])
        return let(F.sort_array(starts), covered)

    def windows(h: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("p")),
        )
        return let(F.sort_array(each), repeated)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 3, let(hashes, windows)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the base columns. A null text has no words, like an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    stats = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    # A one-row Generate keeps the optimizer from copying the expression into each column.
    out = docs.select("*", F.explode(F.array(stats)).alias("_q_stats")).select("*", "_q_stats.*").drop("_q_stats")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normal(t: Column) -> Column:
    """Lower case, white space other than line ends collapsed; most texts need no replacing."""
    low, some = F.lower(t), r"[\x09\x0B-\x0D]|\x20\x20"
    return F.when(low.rlike(some), F.regexp_replace(low, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(low)


def lost_lines(docs: DataFrame, id_col: str, text: str, host: str, rules: Rules, places: bool = False) -> DataFrame:
    """For each (id, text hash): ``n_lost`` words in lines above the limit.

    Equal texts count as one document, so that a much copied document isn't
    taken for boilerplate. Null hosts form one host. ``places`` adds the
    numbers of the lines, from 0, which one document's text bounds. A line of
    one host that makes up much of all lines is joined by broadcast, however
    many texts hold it, so that it is no task's alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    each = F.transform(F.split(normal(t), "\n"), lambda x, k: F.struct(F.trim(x).alias("x"), k.alias("k")))
    # Lines without a word are left out.
    each = F.transform(F.filter(each, lambda r: r["x"] != ""), lambda r: F.struct(F.xxhash64(r["x"]).alias("h"), F.size(F.split(r["x"], " ")).alias("w"), r["k"].alias("k")))
    mark = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("w"), F.lit(None).cast("int").alias("k")))  # one for each row of docs
    keyed = docs.select(F.col(id_col).alias("_q_id"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.xxhash64(t).alias("_q_th"), F.concat(each, mark).alias("_lines"))
    each = keyed.select("_q_id", "_host", "_q_th", F.explode("_lines").alias("_l")).select("_q_id", "_host", "_q_th", "_l.h", "_l.w", *["_l.k"] * places)
    each = written(each)
    texts = each.where("h is not null").groupBy("_host", "h", "_q_th").agg(F.min("_q_id").alias("_q_id"), F.count("*").alias("n"))
    known = texts.groupBy("_host", "h").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("_q_id").alias("first"))
    often = F.col("texts") > rules.max_line_docs
    # Lines below the limit are only of use here where their copies would be one task's rows.
    known = written(known.where(often | (F.col("n") > 1000)).select("_host", "h", "n", often.alias("often"), "first"))
    hit = split_join(each, known, ["_host", "h"], "n", known.agg(F.sum("n")).first()[0] or 0)
    gone = F.coalesce(F.col("often"), F.lit(False)) & ~F.col("_q_id").eqNullSafe(F.col("first"))
    out = [(F.sum(F.when(gone, F.col("w")).otherwise(0)) / F.sum(F.when(F.col("h").isNull(), 1).otherwise(0))).cast("long").alias("n_lost")]
    if places:
        out.append(F.collect_set(F.when(gone, F.col("k"))).alias("_q_lost"))
    return hit.groupBy("_q_id", "_q_th").agg(*out)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules(), clean: bool = False) -> DataFrame:
    """``docs`` with the base columns, ``n_lost`` and ``kept``.

    ``clean`` also takes the lines above the limit out of ``text``. Null ids
    form one id; repeated rows get one verdict; a null text has no words and
    so fails the base rules. Other columns pass through untouched, unless they
    have the name of a result column, which then replaces them.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept")
    docs = docs.drop(*made)
    t = F.coalesce(F.col(text), F.lit(""))
    base = statistics(docs if clean else docs.withColumn("_q_th", F.xxhash64(t)), text, rules)
    if clean:
        base = base.where(~F.col("base_failed")).withColumn("_q_th", F.xxhash64(t))
    else:
        base = base.drop(text)
    lost = lost_lines(docs, id_col, text, host, rules, clean).withColumnRenamed("_q_th", "_q_lth")
    out = base.join(lost, base[id_col].eqNullSafe(lost["_q_id"]) & (base["_q_th"] == lost["_q_lth"]), "left").drop("_q_id", "_q_th", "_q_lth")
    out = out.withColumn("n_lost", F.coalesce("n_lost", F.lit(0)))
    left = (F.col("n_words") - F.col("n_lost")) >= rules.min_left * F.col("n_words")
    out = out.withColumn("kept", ~F.col("base_failed") & left)
    if clean:
        whole = F.split(F.col(text), "\n")
        keep = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("_q_lost"))
        left = F.array_join(F.transform(keep, lambda k: F.get(whole, k)), "\n")
        out = out.withColumn(text, F.when(F.size("_q_lost") > 0, left).otherwise(F.col(text))).drop("_q_lost")
    return out
