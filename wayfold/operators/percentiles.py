"""Exact percentiles of very long columns: selection by refined histograms, so that no key's values meet in one task.

``percentile`` of Spark gathers the counts of all different values of a key. Here each round counts the values of every key in ``BUCKETS`` equal
parts of the range that still matters (partial sums, then at most BUCKETS rows a key), finds the part in which the wanted rank
lies, and goes on within the least and largest value found there, until these are equal. Ranges shrink by BUCKETS at least, so
a few rounds do. The driver holds two numbers for each key and wanted rank, MAX_KEYS keys at most.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, MAX_KEYS = 4096, 10_000


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """0 to BUCKETS - 1, growing with v; a range beyond the largest double is taken by halves."""
    share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def order_statistics(rows: DataFrame, ranks: dict[tuple, list[int]], bounds: dict[tuple, tuple[float, float]]) -> dict[tuple, dict[int, float]]:
    """For each key the values at ``ranks`` (from 0) of ``rows`` (columns k, an array of strings, and v). ``bounds``: least and largest value of a key."""
    spark = rows.sparkSession
    found: dict[tuple, dict[int, float]] = {k: {} for k in ranks}
    todo = {(k, r): (*bounds[k], 0) for k, own in ranks.items() for r in own}
    while True:
        for (k, r), (lo, hi, _) in list(todo.items()):
            if lo == hi:
                found[k][r] = lo
                del todo[k, r]
        if not todo:
            return found
        listed = spark.createDataFrame([(list(k), r, lo, hi, below) for (k, r), (lo, hi, below) in todo.items()], "k array<string>, r long, lo double, hi double, below long")
        inside = rows.join(F.broadcast(listed), "k").where("v >= lo AND v <= hi")  # two rows a percentile and key, MAX_KEYS keys at most
        counted = inside.groupBy("k", "r", "below", _bucket(F.col("v"), F.col("lo"), F.col("hi")).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("k", "r").orderBy("b"))
        at = counted.withColumn("upto", upto).where("upto > r AND upto - n <= r")
        todo = {(tuple(x["k"]), x["r"]): (x["lo"], x["hi"], x["upto"] - x["n"]) for x in at.collect()}


def exact_percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], held: bool = False) -> DataFrame:
    """``keys`` and one column for each of ``wanted`` (name -> column and share), equal to Spark's ``percentile``; nulls and NaN do not count.

    Keys of any type, null among them; a key without values has nulls. Raises ValueError beyond MAX_KEYS keys, for which ``percentile`` is the
    better plan. ``held``: the rows are persisted already, and are not held a second time.
    """
    spark = rows.sparkSession
    columns = sorted({c for c, _ in wanted.values()})
    # names of our own, whatever the input's are
    named = rows.select(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]).cast("array<string>").alias("k"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    if not held:
        named = named.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good = lambda c: F.when(~F.isnan(c), F.col(c))
        stats = named.groupBy("k").agg(*[F.first(f"key{i}").alias(f"key{i}") for i in range(len(keys))], *[f(good(f"v{i}")).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
        whole = stats.limit(MAX_KEYS + 1).collect()
        if len(whole) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} keys: use percentile")
        values: dict[str, dict[tuple, float]] = {name: {} for name in wanted}
        for i, c in enumerate(columns):
            sizes = {tuple(r["k"]): r[f"n{i}"] for r in whole if r[f"n{i}"]}
            at = {(name, k): q * (n - 1) for name, (col, q) in wanted.items() if col == c for k, n in sizes.items()}
            ranks = {k: sorted({f(p) for (_, other), p in at.items() if other == k for f in (floor, ceil)}) for k in sizes}
            bounds = {tuple(r["k"]): (r[f"lo{i}"], r[f"hi{i}"]) for r in whole if r[f"n{i}"]}
            found = order_statistics(named.select("k", F.col(f"v{i}").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), ranks, bounds)
            for (name, k), p in at.items():
                lo, hi = found[k][floor(p)], found[k][ceil(p)]
                values[name][k] = lo if floor(p) == ceil(p) else (ceil(p) - p) * lo + (p - floor(p)) * hi
        schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], *[f"`{name}` double" for name in wanted]])
        return spark.createDataFrame([(*[r[f"key{i}"] for i in range(len(keys))], *[values[name].get(tuple(r["k"])) for name in wanted]) for r in whole], schema)
    finally:
        if not held:
            named.unpersist()
