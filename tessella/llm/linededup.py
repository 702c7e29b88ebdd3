"""Repeated runs of lines: suffix ranks by prefix doubling, later copies deleted.

Only DataFrame functions are used.  The corpus is one sequence of line ids in
(doc_id, line) order.  Lines that occur once end every repeated run, so only
the others are ranked.  Ranks of 2^k lines come from pairs of ranks of 2^(k-1)
lines, sorted over the cluster; blocks of 2^k lines that occur once drop out.

A run is deleted if it holds at least ``min_words`` words and an equal run
stands earlier.  Which lines that concerns follows from the smallest runs of
min_words words that begin or end at each line: a line lies in a repeated run
exactly if it lies in such a smallest one.  The members of a smallest run of l
lines are an interval of the suffix array, the suffixes whose longest common
prefix has at least l lines; it is named by the ranks of its first and of its
last 2^k lines, k = floor(log2 l).  Its first member stays, the others go, and
what goes is merged into maximal runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, save, text_of, whole_ids

MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows keyed by (pid, th): a null id sorts last, rows equal in id and text are one document."""
    return docs.withColumn("pid", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("th", F.xxhash64(text_of(F.col("text"))))


def line_table(docs: DataFrame) -> DataFrame:
    """(pid, th, m, h1, h2, w): 128-bit id and words of each document's m-th line that isn't blank."""
    lines = F.transform(
        F.split(text_of(F.col("text")), "\n", -1),
        lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), F.regexp_count(x, F.lit(r"\S+")).alias("w")),
    )
    one = _keyed(docs.select("doc_id", "text")).select("pid", "th", F.filter(lines, lambda s: s.w > 0).alias("lines")).dropDuplicates(["pid", "th"])
    return one.select("pid", "th", F.posexplode("lines").alias("m", "s")).select("pid", "th", "m", "s.h1", "s.h2", "s.w")


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` that occur twice or more, with ``name``: a number that sorts as they do."""
    often = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    return save(often.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), f"lines-{name}")


def suffix_ranks(lines: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Repeated lines in unbroken stretches (seg), with r0 .. rk: ranks of the next 1, 2, .. 2^k lines.

    A rank is null where the stretch ends sooner or the block occurs once.
    Doubling ends at ``depth`` or when no block is left.
    """
    doc = Window.partitionBy("pid", "th").orderBy("m")
    now = lines.join(_ranked(lines, ["h1", "h2"], "r0"), ["h1", "h2"]).select("pid", "th", "m", "w", "r0")
    now = save(now.withColumn("seg", F.col("m") - F.row_number().over(doc)), "lines-active")
    level = 0
    while level < depth:
        step = Window.partitionBy("pid", "th", "seg").orderBy("m")
        pairs = now.withColumn("next", F.lead(f"r{level}", 1 << level).over(step))
        both = pairs.where(f"r{level} is not null and next is not null")
        ranks = _ranked(both, [f"r{level}", "next"], f"r{level + 1}")
        if ranks.isEmpty():
            break
        now, old = save(pairs.join(ranks, [f"r{level}", "next"], "left").drop("next"), "lines-active"), now
        drop_saved(old, ranks)
        level += 1
    return now, level


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(pid, th, runs): merged intervals of not-blank lines whose content stands earlier."""
    lines = save(line_table(docs), "lines")
    depth = max(0, min_words.bit_length() - 1)  # min_words lines hold as many words at least
    active, levels = suffix_ranks(lines, depth)

    w = Window.partitionBy("pid", "th", "seg").orderBy("m")
    take = lambda c: F.aggregate(  # noqa: E731  lines until min_words words are reached
        c,
        F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("l")),
        lambda a, x: F.when(a.s >= min_words, a).otherwise(F.struct((a.s + x).alias("s"), (a.l + 1).alias("l"))),
        lambda a: F.when(a.s >= min_words, a.l),
    )
    ahead = F.collect_list("w").over(w.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("w").over(w.rowsBetween(1 - min_words, 0)))
    sized = active.withColumn("lf", take(ahead)).withColumn("lb", take(behind))
    blocks = sized.select(
        "pid", "th",
        F.explode(F.array_distinct(F.filter(F.array(
            F.struct(F.col("m").alias("at"), F.col("lf").alias("l")),
            F.struct((F.col("m") - F.col("lb") + 1).alias("at"), F.col("lb").alias("l")),
        ), lambda s: s.l.isNotNull()))).alias("b"),
    ).select("pid", "th", "b.at", "b.l").distinct()
    level = reduce(lambda a, k: F.when(F.col("l") >= 1 << k, k).otherwise(a), range(1, depth + 1), F.lit(0))
    blocks = blocks.withColumn("k", level).where(F.col("k") <= levels)
    ranks = active.select("pid", "th", "m", F.array(*[f"r{k}" for k in range(levels + 1)]).alias("r"))
    first = blocks.join(ranks.withColumnRenamed("m", "at"), ["pid", "th", "at"]).withColumn("a", F.element_at("r", F.col("k") + 1)).drop("r")
    first = first.where("a is not null").withColumn("m", (F.col("at") + F.col("l") - F.expr("shiftleft(1, k)")).cast("int"))
    named = first.join(ranks, ["pid", "th", "m"]).withColumn("b", F.element_at("r", F.col("k") + 1)).where("b is not null")
    named = save(named.select("pid", "th", "at", "l", "a", "b"), "lines-blocks")

    here = F.struct("pid", "th", "at")
    # saved, so that the join's sides are plain shuffles, of which Spark splits what one block has too much of
    least = save(named.groupBy("l", "a", "b").agg(F.min(here).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "lines-least")
    later = named.join(least, ["l", "a", "b"]).where(here > F.col("least")).select("pid", "th", F.col("at").alias("lo"), (F.col("at") + F.col("l") - 1).alias("hi")).distinct()
    # merge what overlaps or touches
    by_lo = Window.partitionBy("pid", "th").orderBy("lo", "hi")
    reach = F.max("hi").over(by_lo.rowsBetween(Window.unboundedPreceding, -1))
    isles = later.withColumn("new", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(1)))
    isles = isles.withColumn("isle", F.sum("new").over(by_lo.rowsBetween(Window.unboundedPreceding, 0)))
    runs = isles.groupBy("pid", "th", "isle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("pid", "th").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, text without later copies, n_lines, n_removed and the removed line spans.

    Every row stays, if need be with empty text.  Null text stays null and has
    one blank line.  Rows equal in id and text count once and lose the same
    lines.  Blank lines don't take part; they go if they stand inside a run.
    A doc_id that is no whole number is a TypeError.
    """
    whole_ids(docs)
    runs = repeated_runs(docs, min_words)
    lines = F.split(text_of(F.col("text")), "\n", -1)
    whole = _keyed(docs.select(*dict.fromkeys((*keep, "doc_id", "text")))).join(runs, ["pid", "th"], "left")
    full = F.filter(F.transform(F.col("_lines"), lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    spans = F.transform("runs", lambda r: F.struct(F.col("_full")[r.lo].alias("first"), F.col("_full")[r.hi].alias("last")))
    out = whole.withColumn("_lines", lines).withColumn("_full", F.when(F.col("runs").isNotNull(), full)).withColumn("spans", F.coalesce(spans, F.expr("cast(array() as array<struct<first:int,last:int>>)")))
    # what stands between one span and the next, in one pass over both
    after = F.concat(F.array(F.lit(-1)), F.transform("spans", lambda s: s["last"]))
    before = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(after, before, lambda a, b: F.slice("_lines", a + 2, b - a - 1)))
    out = out.withColumn("_kept", F.when(F.col("runs").isNotNull(), kept))
    return out.select(
        *[c for c in keep if c != "text"],
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
        "spans",
    )
