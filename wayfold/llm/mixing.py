"""Mixing sources to target weights with hash-threshold histograms. DataFrame operations only.

``mix(docs)`` decides how many times each row is taken; ``take(docs)`` returns the mix itself.

Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words; a target stops at
``max_repeats`` times its source's size and the excess is shared anew by weight, which ends at one level for
all sources that are not stopped: target = min(max_repeats * size, level * weight). Every row is taken
floor(target / size) times; the rows whose hash lies under the source's threshold once more. The threshold comes from
histograms: sums of words by source and hash bucket, a running sum over at most 4096 buckets, and a finer histogram of
the one bucket in which the budget runs out, until all 60 hash bits are used. Rows are never sorted.

Defined results: a null text has size 0; empty and all-blank texts too; a source of size 0 has target 0; rows that share
a doc_id share a hash and are taken alike; the item at the boundary is taken if more than half of it fits
(or exactly half); an empty table gives no rows; extra columns stay in ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import fresh, materialize, sized_broadcast, text_of

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
LEVEL_BITS = 12
LEVELS = 5
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target. One row per source."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (position % len(WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * MAX_REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level if this source and all with a larger cap per weight are not stopped, and those before are
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    found = weighed.withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"))


def _thresholds(light: DataFrame, sources: DataFrame) -> DataFrame:
    """source -> bound: rows whose 60-bit hash is below it are taken once more."""
    state = sources.select("source", F.lit(0).cast("long").alias("prefix"), F.col("extra").alias("left"), F.lit(0).cast("long").alias("bound"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        rows = light.select(F.col("source").alias("s"), "size", F.shiftright("u", shift + LEVEL_BITS).alias("p"), F.shiftright("u", shift).alias("bucket"))
        inside = rows.join(state, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix")))
        buckets = inside.groupBy("source", "prefix", "left", "bound", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = buckets.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        if level < LEVELS - 1:
            # the first bucket that does not fit whole; if all fit, a bucket after the last
            over = F.col("before") + F.col("words") > F.col("left")
            state = summed.groupBy("source").agg(
                F.coalesce(F.min(F.when(over, F.struct("bucket", "before"))), F.max(F.struct((F.col("bucket") + 1).alias("bucket"), (F.col("before") + F.col("words")).alias("before")))).alias("at"), F.first("left").alias("left")
            )
            state = state.select("source", F.col("at.bucket").alias("prefix"), (F.col("left") - F.col("at.before")).alias("left"), F.shiftleft("at.bucket", shift).alias("bound"))
        else:
            fits = 2 * F.col("before") + F.col("words") <= 2 * F.col("left")
            state = summed.groupBy("source").agg(F.max(F.when(fits, F.col("bucket") + 1)).alias("top"), F.first("bound").alias("bound"))
            state = state.select("source", F.greatest(F.coalesce("top", "bound"), "bound").alias("bound"))
        if level:
            # a source without rows in its boundary bucket has fitted whole; its bound stands
            old = previous.select(F.col("source").alias("s"), F.col("bound").alias("kept"))
            last = {"bound": F.col("kept"), "prefix": F.lit(-1).cast("long"), "left": F.lit(0.0)}
            state = old.join(state, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), *(F.coalesce(F.col(c), last[c]).alias(c) for c in state.columns if c != "source"))
        previous = state = materialize(state, f"mix-level{level}")
    return state


def _hashed(docs: DataFrame) -> Column:
    """60 bits of a row's hash, the same in every run: of its id, or of its text where it has none."""
    return F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), text_of(docs))), 1, 15), 16, 10).cast("long")


def _copies(u: Column) -> Column:
    return F.least(F.lit(MAX_REPEATS), F.col("whole") + F.when(u < F.col("bound"), 1).otherwise(0)).cast("long")


def source_plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all rows, and one row per source: _source, source_size, target, whole, bound."""
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    light = materialize(docs.select(docs["doc_id"], docs["source"], size.alias("size"), _hashed(docs).alias("u")), "mix-light")
    sources = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = materialize(sources.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    bounds = _thresholds(light, sources)
    plan = sources.alias("a").join(bounds.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", F.coalesce("b.bound", F.lit(0)).alias("bound"))
    plan = materialize(plan.withColumnRenamed("source", "_source").drop("extra"), "mix-plan")
    return light, sized_broadcast(plan, plan.count())


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    light, plan = source_plan(docs)
    joined = light.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", _copies(F.col("u")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken. Copies share their doc_id and text; texts do not shuffle."""
    source, whole, bound, copy = fresh(docs, "source", "whole", "bound", "copy")
    plan = source_plan(docs)[1].select(F.col("_source").alias(source), F.col("whole").alias(whole), F.col("bound").alias(bound))
    joined = docs.join(plan, docs["source"].eqNullSafe(F.col(source)))
    copies = F.least(F.lit(MAX_REPEATS), F.col(whole) + F.when(_hashed(docs) < F.col(bound), 1).otherwise(0)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).drop(source, whole, bound, copy)


ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS u FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM s),
    l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
    f AS (SELECT *, (SELECT lv FROM l WHERE lv * weight <= cap ORDER BY cap / weight, lv LIMIT 1) AS flat FROM l),
    t AS (SELECT source, source_size, least(cap, coalesce(flat, 0) * weight) AS target FROM f),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
    u AS (SELECT source, u, sum(size) AS words FROM d GROUP BY source, u),
    b AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
    SELECT d.doc_id, d.size::BIGINT AS size, e.source_size, e.target,
           (d.size * least(3, e.whole + CASE WHEN 2 * b.before + b.words <= 2 * (e.target - e.whole * e.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.u = b.u
"""
