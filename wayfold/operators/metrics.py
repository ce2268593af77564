"""Evaluation: ratios, synchronized error, stop agreement, latency, contract records and comparisons. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import planar, synchronized
from wayfold.operators.percentiles import exact_percentiles
from wayfold.schema import BYTES_PER_POINT

METRICS = ("cr", "stored_points", "avg_sed_m", "p95_sed_m", "max_sed_m", "latency_us_per_point")


def byte_ratio(original_points: Column, encoded_bytes: Column) -> Column:
    """Original bytes over encoded bytes; infinite without encoded bytes."""
    return F.when(encoded_bytes == 0, F.lit(float("inf"))).otherwise(original_points * BYTES_PER_POINT / F.when(encoded_bytes != 0, encoded_bytes))


def point_ratio(original_points: Column, stored: Column) -> Column:
    return original_points / F.greatest(F.lit(1), stored)


def two_point_reconstruction(stops: DataFrame, moves: DataFrame) -> DataFrame:
    """Timed points of a segmented compression: a stop at its start and at its end, moves as kept. obj_id, t, lat, lon, ord."""
    ends = stops.select("obj_id", "lat", "lon", F.explode(F.array("start_t", "end_t")).alias("t"))
    return ends.select("obj_id", "t", "lat", "lon").unionByName(moves.select("obj_id", "t", "lat", "lon"))


def keypoint_reconstruction(stops: DataFrame, moves: DataFrame) -> DataFrame:
    """Timed points of a result's keypoints: a stop is one point at its start."""
    return stops.select("obj_id", F.col("start_t").alias("t"), "lat", "lon").unionByName(moves.select("obj_id", "t", "lat", "lon"))


def _timeline(points: DataFrame, compressed: DataFrame, keys, block_s: float | None = None) -> DataFrame:
    """Both sides in time order, raw points (side 0) with their error ``sed`` (null without compressed points) and compressed ones (side 1)
    with ``stored``: the backward as-of join of each point with its timed segment, by one window. With ``block_s`` a key's time is cut into
    blocks of so many seconds, each a partition of its own; the last compressed point before a block and the first after it are carried in."""
    none = F.lit(None).cast("double")
    raw = points.select(*keys, "t", F.lit(0).alias("side"), "seq", "lat", "lon", F.lit(0).cast("long").alias("stored"), F.lit(None).cast("struct<t:double,lat:double,lon:double>").alias("k"))
    stored = F.col("stored").cast("long") if "stored" in compressed.columns else F.lit(1).cast("long")
    key = compressed.select(*keys, "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("seq"), none.alias("lat"), none.alias("lon"), stored.alias("stored"), F.struct("t", "lat", "lon").alias("k"))
    both = raw.unionByName(key)
    if block_s:
        both = both.withColumn("block", F.floor(F.col("t") / block_s))
        ends = both.groupBy(*keys, "block").agg(F.min("k").alias("first"), F.max("k").alias("last"))  # by time first
        track = Window.partitionBy(*keys).orderBy("block")  # one row per block
        ends = ends.withColumn("before", F.last("last", ignorenulls=True).over(track.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("first", ignorenulls=True).over(track.rowsBetween(1, Window.unboundedFollowing)))
        # the carried points travel as rows of their block (side 2), so that a block's rows meet in one exchange and no join moves a key's rows
        carried = ends.select(*keys, "block", "before", "after").withColumns({"t": F.lit(None).cast("double"), "side": F.lit(2), "seq": F.lit(None).cast("long"), "lat": none, "lon": none, "stored": F.lit(0).cast("long"), "k": F.lit(None).cast("struct<t:double,lat:double,lon:double>")})
        both = both.withColumns({c: F.lit(None).cast("struct<t:double,lat:double,lon:double>") for c in ("before", "after")}).unionByName(carried)
    w = Window.partitionBy(*keys, *(["block"] if block_s else [])).orderBy("t", "side", "seq")
    a, b = F.last("k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("k", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    if block_s:
        whole = Window.partitionBy(*keys, "block")
        a, b = F.coalesce(a, F.max("before").over(whole)), F.coalesce(b, F.max("after").over(whole))
    both = both.withColumn("a", a).withColumn("b", b).where("side < 2")
    lat, lon, t, a, b = F.col("lat"), F.col("lon"), F.col("t"), F.col("a"), F.col("b")
    sed = (
        F.when(b.isNull(), planar(lat, lon, a["lat"], a["lon"]))
        .when(a.isNull(), planar(lat, lon, b["lat"], b["lon"]))
        .otherwise(synchronized(lat, lon, t, a["lat"], a["lon"], a["t"], b["lat"], b["lon"], b["t"]))
    )
    return both.select(*keys, "seq", "t", "side", "stored", F.when(F.col("side") == 0, sed).alias("sed"))


def synchronized_errors(points: DataFrame, compressed: DataFrame, keys=("obj_id",), block_s: float | None = None) -> DataFrame:
    """keys, seq, t, sed. Objects without compressed points have no rows. ``block_s``: seconds of a time block, for objects too long for one task."""
    return _timeline(points, compressed, keys, block_s).where("side = 0 AND sed IS NOT NULL").drop("side", "stored")


def evaluation(points: DataFrame, compressed: DataFrame, keys=("obj_id",)) -> DataFrame:
    """The metric record of each object, errors and stored points (sum of ``stored``, else a point each) from one pass."""
    p = lambda q: F.percentile("sed", F.lit(q))
    rows = _timeline(points, compressed, keys).groupBy(*keys).agg(
        F.count("seq").alias("n_raw_points"), F.sum("stored").alias("stored_points"), F.avg("sed").alias("avg_sed_m"), p(0.95).alias("p95_sed_m"), F.max("sed").alias("max_sed_m"),
        (100 * F.avg((F.col("sed") <= 5).cast("double"))).alias("pct_5m"),
    )
    rows = rows.where("n_raw_points > 0")
    return rows.select(*keys, "n_raw_points", point_ratio(F.col("n_raw_points"), F.col("stored_points")).alias("cr"), "stored_points", "avg_sed_m", "p95_sed_m", "max_sed_m", "pct_5m")


def error_stats(errors: DataFrame, keys=("obj_id",)) -> DataFrame:
    """Mean, maximum and root mean square."""
    return errors.groupBy(*keys).agg(F.avg("sed").alias("average_sed"), F.max("sed").alias("max_sed"), F.sqrt(F.avg(F.col("sed") * F.col("sed"))).alias("rmse"), F.count("*").alias("n"))


def error_bundle(errors: DataFrame, keys=("obj_id",)) -> DataFrame:
    """Error statistics with percentiles, shares within 5 and 10 m and the quantiles p5 to p99 as an array."""
    p = lambda q: F.percentile("sed", F.lit(q))
    return errors.groupBy(*keys).agg(
        F.avg("sed").alias("mean"), p(0.5).alias("median"), p(0.1).alias("p10"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("sed").alias("max"), F.sqrt(F.avg(F.col("sed") * F.col("sed"))).alias("rmse"),
        (100 * F.avg((F.col("sed") <= 5).cast("double"))).alias("pct_5m"), (100 * F.avg((F.col("sed") <= 10).cast("double"))).alias("pct_10m"),
        F.percentile("sed", F.array(*[F.lit(k / 100) for k in range(5, 100)])).alias("quantiles"),
    )


def error_outliers(errors: DataFrame, segmented: DataFrame, last_key: DataFrame, k: int = 10) -> DataFrame:
    """The k largest errors per object with their segment; points past the last keypoint are skipped (``last_key``: obj_id, t)."""
    end = last_key.groupBy("obj_id").agg(F.max("t").alias("end_t"))
    inside = errors.join(end, "obj_id").where(F.col("t") <= F.col("end_t"))
    rank = F.row_number().over(Window.partitionBy("obj_id").orderBy(F.desc("sed"), "seq"))
    top = inside.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(segmented.select("obj_id", "seq", "seg_id", "kind"), ["obj_id", "seq"]).select("obj_id", "rank", "seq", "sed", "seg_id", "kind")


def segment_spans(points: DataFrame, kept: DataFrame) -> DataFrame:
    """Seconds of the kept segment around each point, up to the last kept point: mean, p95 and maximum per object."""
    w = Window.partitionBy("obj_id").orderBy("t")
    span = F.coalesce(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"))
    keys = kept.select("obj_id", "t", F.lit(1).alias("side"), span.alias("span"))
    both = points.select("obj_id", "t", F.lit(0).alias("side"), F.lit(None).cast("double").alias("span")).unionByName(keys)
    ahead = Window.partitionBy("obj_id").orderBy("t", "side").rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumn("span", F.first("span", ignorenulls=True).over(ahead)).where("side = 0 AND span IS NOT NULL")
    return rows.groupBy("obj_id").agg(F.avg("span").alias("mean_span"), F.percentile("span", F.lit(0.95)).alias("p95_span"), F.max("span").alias("max_span"))


def better_count(other: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """objects and ``name``: in how many of them ``own.own`` is below ``other.other``."""
    return other.join(own, "obj_id").agg(F.count("*").alias("objects"), F.sum(F.when(F.col("own") < F.col("other"), 1).otherwise(0)).alias(name))


def retention(kept: DataFrame) -> DataFrame:
    """Gaps in time and space between neighbours of the kept points: mean, p95, maximum."""
    w = Window.partitionBy("obj_id").orderBy("t", "seq")
    gap, jump = F.col("t") - F.lag("t").over(w), planar(F.col("lat"), F.col("lon"), F.lag("lat").over(w), F.lag("lon").over(w))
    rows = kept.select("obj_id", gap.alias("gap"), jump.alias("jump")).where("gap IS NOT NULL")
    return rows.groupBy("obj_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("gap", "jump") for n, f in (("mean", F.avg), ("p95", lambda c: F.percentile(c, F.lit(0.95))), ("max", F.max))])


def stop_errors(segmented: DataFrame, stops: DataFrame) -> DataFrame:
    """Error of each stop's fixes against its representative, which holds over the whole stop."""
    reps = stops.select("obj_id", "seg_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    return segmented.where("kind = 'stop'").join(reps, ["obj_id", "seg_id"]).select("obj_id", "seg_id", "seq", "t", planar(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")).alias("sed"))


def segment_counts(segments: DataFrame, keys=("obj_id",), points: str = "n_points") -> DataFrame:
    """Stops, moves, mean seconds and mean points of each kind, all points. ``points`` may name a keypoint count."""
    of = lambda kind, c: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"n_{kind}s")
    rows = segments.withColumn("duration", F.col("end_t") - F.col("start_t"))
    return rows.groupBy(*keys).agg(
        n("stop"), n("move"), of("stop", "duration").alias("mean_stop_s"), of("move", "duration").alias("mean_move_s"),
        of("stop", points).alias("mean_stop_points"), of("move", points).alias("mean_move_points"), F.sum(points).alias("total_points"),
    )


def interval_iou(s1, e1, s2, e2) -> Column:
    """Overlap over union of two closed time intervals; 0 without either."""
    inter, union = F.least(e1, e2) - F.greatest(s1, s2), F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / F.when(union > 0, union))


def stop_f1(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5, keys=("obj_id",)) -> DataFrame:
    """Per object: tp, fp, fn, precision, recall, f1, matched_iou_mean.

    Stops of one side do not overlap, so above a threshold of a half a stop has at most one partner; ties at exactly a half go to
    the earliest prediction and then the earliest truth, as taking them in turn does. Lower thresholds are refused.
    """
    if threshold < 0.5:
        raise ValueError("the threshold must be at least 0.5")
    keys = list(keys)
    cols = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("seg_id", "start_t", "end_t")])
    p, g = cols(predicted.where("kind = 'stop'"), "p"), cols(truth.where("kind = 'stop'"), "g")
    pairs = p.join(g, keys).where((F.col("p_start_t") < F.col("g_end_t")) & (F.col("g_start_t") < F.col("p_end_t")))
    iou = interval_iou(F.col("p_start_t"), F.col("p_end_t"), F.col("g_start_t"), F.col("g_end_t"))
    pairs = pairs.withColumn("iou", iou).where(F.col("iou") >= threshold)
    first_p = F.row_number().over(Window.partitionBy(*keys, "p_seg_id").orderBy(F.desc("iou"), "g_start_t"))
    first_g = F.row_number().over(Window.partitionBy(*keys, "g_seg_id").orderBy("p_start_t"))
    pairs = pairs.withColumn("r", first_p).where("r = 1").withColumn("r", first_g).where("r = 1")
    found = pairs.groupBy(*keys).agg(F.count("*").alias("tp"), F.avg("iou").alias("matched_iou_mean"))
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    rows = n(p, "np").join(n(g, "ng"), keys, "full").join(found, keys, "left").fillna(0, ["np", "ng", "tp"]).fillna(0.0, ["matched_iou_mean"])
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp = F.col("tp")
    rows = rows.withColumn("precision", ratio(tp, F.col("np"))).withColumn("recall", ratio(tp, F.col("ng")))
    both = F.col("precision") + F.col("recall")
    return rows.select(*keys, "tp", (F.col("np") - tp).alias("fp"), (F.col("ng") - tp).alias("fn"), "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"), "matched_iou_mean")


def listed_stop_f1(predicted: Column, truth: Column, threshold: float = 0.5) -> Column:
    """struct<f1, precision, recall, matched_iou_mean> of two arrays of an object's stops in time order, struct<start_t, end_t>.

    Partners as in ``stop_f1``; above a half each stop has at most one, at exactly a half the earlier wins.
    """
    iou = lambda p, g: interval_iou(p["start_t"], p["end_t"], g["start_t"], g["end_t"])
    state = F.struct(F.array().cast("array<double>").alias("found"), F.lit(0).alias("used"))
    at = F.sequence(F.lit(1), F.size(truth))

    def step(acc: Column, p: Column) -> Column:
        open_ = F.filter(F.zip_with(truth, F.when(F.size(truth) > 0, at).otherwise(F.array().cast("array<int>")), lambda g, i: F.struct((-iou(p, g)).alias("m"), i.alias("i"))), lambda x: (x["m"] <= -threshold) & (x["i"] > acc["used"]))
        best = F.array_min(open_)
        return F.when(best.isNull(), acc).otherwise(F.struct(F.array_append(acc["found"], -best["m"]).alias("found"), best["i"].alias("used")))

    found = F.aggregate(predicted, state, step, lambda acc: acc["found"])
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    tp = F.size(found)
    p, r = ratio(tp, F.size(predicted)), ratio(tp, F.size(truth))
    mean = ratio(F.aggregate(found, F.lit(0.0), lambda s, x: s + x), tp)
    return F.struct(ratio(2 * p * r, p + r).alias("f1"), p.alias("precision"), r.alias("recall"), mean.alias("matched_iou_mean"))


def road_jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per object: overlap of the sets of road ids, nulls apart; NaN if both are empty, 0 if one is."""
    sets = lambda df, c: df.groupBy("obj_id").agg(F.collect_set("road_id").alias(c))
    rows = sets(left, "a").join(sets(right, "b"), "obj_id", "full")
    empty = F.array().cast("array<string>")
    rows = rows.select("obj_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    union = F.size(F.array_union("a", "b"))
    return rows.select("obj_id", F.when(union == 0, F.lit(float("nan"))).otherwise(F.size(F.array_intersect("a", "b")) / F.when(union > 0, union)).alias("jaccard"))


def ordered_means(rows: DataFrame, keys: list[str], means: dict[str, Column], order: list[str], *more: Column) -> DataFrame:
    """``keys``, a mean for each of ``means`` (name -> value) whose sum is added up in ``order`` row by row, and ``more`` aggregates.

    A sum of doubles depends on its order in the last digits, and a mean half-way between two rounded values on these: with an order given, the
    result does not depend on how rows are dealt to tasks. The sum runs along a sorted partition, so no list of a key's values is held.
    """
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_{n}": c for n, c in means.items()})
    rows = rows.withColumns({f"_sum_{n}": F.sum(f"_{n}").over(so_far) for n in means})
    return rows.groupBy(*keys).agg(*[(F.max_by(f"_sum_{n}", F.struct(*order)) / F.nullif(F.count(f"_{n}"), F.lit(0))).alias(n) for n in means], *more)


def latency_stats(latencies: DataFrame, column: str, keys=(), order=()) -> DataFrame:
    """Count, mean, max, min and nearest-rank p95 (index rounded half to even). ``order``: columns in whose order values are summed.

    The rank comes from counts of equal values, partially aggregated, so no list of a key's values is held.
    """
    one = [] if keys else ["_all"]
    keys, latencies = list(keys) or one, latencies.withColumns({c: F.lit(0) for c in one})
    count, most, least = F.count(column).alias("count"), F.max(column).alias("max"), F.min(column).alias("min")
    if order:
        stats = ordered_means(latencies, keys, {"mean": F.col(column)}, list(order), count, most, least).select(*keys, "count", "mean", "max", "min")
    else:
        stats = latencies.groupBy(*keys).agg(count, F.avg(column).alias("mean"), most, least)
    counts = latencies.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(column))
    rank = F.rint(0.95 * (F.sum("_n").over(Window.partitionBy(*keys)) - 1)) + 1
    p95 = counts.withColumn("_upto", upto).withColumn("_rank", rank).where(F.col("_upto") >= F.col("_rank")).groupBy(*keys).agg(F.min(column).alias("p95"))
    return stats.join(p95, keys, "left").drop(*one)


def pipeline_latency(stages: Column, names=("segmentation", "stop_compression", "move_compression", "map_matching", "encoding")) -> Column:
    """Sum over the named stages of a map; a missing stage counts 0."""
    return sum((F.coalesce(stages[n], F.lit(0.0)) for n in names), F.lit(0.0))


def normalise_metric(value: Column) -> Column:
    """A metric as double; missing or unreadable becomes NaN."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(float("nan")))


def contract_aggregate(records: DataFrame, order: str | None = None) -> DataFrame:
    """pipeline, metric, value -> mean, median and p95 without NaN (nulls if all are). ``order``: a column by which records are ordered; it adds
    ``place``, the number of a pipeline (from 0) in order of first appearance."""
    good = F.when(~F.isnan("value"), F.col("value"))
    found = records.groupBy("pipeline", "metric").agg(F.avg(good).alias("mean"), F.percentile(good, F.lit(0.5)).alias("median"), F.percentile(good, F.lit(0.95)).alias("p95"))
    if order is None:
        return found
    first = records.groupBy(F.col("pipeline").alias("_pipeline")).agg(F.min(order).alias("_first"))
    places = first.select("_pipeline", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first", "_pipeline")) - 1).alias("place"))  # a row per pipeline
    return found.join(F.broadcast(places), F.col("pipeline").eqNullSafe(F.col("_pipeline"))).drop("_pipeline")


def strategy_summary(rows: DataFrame) -> DataFrame:
    """strategy, cr, original_bytes, encoded_bytes -> files, mean, least, largest and global ratio, totals."""
    total = F.sum("encoded_bytes")
    return rows.groupBy("strategy").agg(F.count("*").alias("files"), F.avg("cr").alias("cr_mean"), F.min("cr").alias("cr_min"), F.max("cr").alias("cr_max"), F.when(total > 0, F.sum("original_bytes") / F.when(total > 0, total)).otherwise(0.0).alias("cr_global"), F.sum("original_bytes").alias("original_bytes"), total.alias("encoded_bytes"))


def same_streams(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per object: whether two compressed streams hold the same points."""
    cols = ["obj_id", "seq"]
    both = left.select(*cols, F.lit(1).alias("a")).join(right.select(*cols, F.lit(1).alias("b")), cols, "full")
    return both.groupBy("obj_id").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("identical"))


def ranked_deltas(rows: DataFrame, k: int = 5) -> DataFrame:
    """family, obj_id, baseline, hybrid (mean errors) -> the k largest improvements and degradations per family."""
    d = rows.withColumn("delta", F.col("hybrid") - F.col("baseline"))
    rank = lambda o: F.row_number().over(Window.partitionBy("family").orderBy(o, "obj_id"))
    best = d.withColumn("rank", rank(F.asc("delta"))).withColumn("side", F.lit("improvement"))
    worst = d.withColumn("rank", rank(F.desc("delta"))).withColumn("side", F.lit("degradation"))
    return best.unionByName(worst).where(F.col("rank") <= k).select("family", "side", "rank", "obj_id", "delta")


def variant_summary(rows: DataFrame) -> DataFrame:
    """variant, average_sed, cr, pct_5m -> statistics per variant. A variant has a row for each object, so percentiles are selected, not gathered."""
    shares = {"median_sed": ("average_sed", 0.5), "p95_sed": ("average_sed", 0.95), "p99_sed": ("average_sed", 0.99), "median_cr": ("cr", 0.5)}
    picked = exact_percentiles(rows, ["variant"], shares).withColumnRenamed("variant", "_variant")
    means = rows.groupBy("variant").agg(F.avg("average_sed").alias("mean_sed"), F.avg("cr").alias("mean_cr"), F.avg("pct_5m").alias("mean_pct_5m"))
    joined = means.join(F.broadcast(picked), F.col("variant").eqNullSafe(F.col("_variant")))  # a row per variant
    return joined.select("variant", "mean_sed", "median_sed", "p95_sed", "p99_sed", "mean_cr", "median_cr", "mean_pct_5m")


def branch_counts(segments: DataFrame, capacity: int, refine: bool = False) -> DataFrame:
    """Moves that go to line simplification, to the buffer, and on to refinement."""
    long = F.sum(F.when(F.col("n_points") > capacity, 1).otherwise(0))
    return segments.where("kind = 'move'").agg(F.sum(F.when(F.col("n_points") <= capacity, 1).otherwise(0)).alias("short_moves"), long.alias("long_moves"), (long if refine else F.lit(0)).cast("long").alias("refine_calls"))


def evenly_spaced(points: DataFrame, n: int) -> DataFrame:
    """At most n points per object at evenly spaced places, first and last among them."""
    size = F.count("*").over(Window.partitionBy("obj_id"))
    place = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("size") - 1) / max(1, n - 1)))))
    sizes = points.groupBy("obj_id").agg(F.count("*").alias("size")).where(F.col("size") > n).select("obj_id", place.alias("place"))
    w = Window.partitionBy("obj_id").orderBy("seq")
    ranked = points.withColumn("_size", size).withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    few = ranked.where(F.col("_size") <= n)
    many = ranked.where(F.col("_size") > n).join(sizes, ["obj_id", "place"], "left_semi")
    return few.unionByName(many).select(points.columns)


def running_counters(segmented: DataFrame) -> DataFrame:
    """Points, stops and moves seen so far, and the crude size estimate of a tenth of the points (1 at least)."""
    w = Window.partitionBy("obj_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.coalesce(F.col("seg_id") != F.lag("seg_id").over(Window.partitionBy("obj_id").orderBy("seq")), F.lit(True)), F.col("kind"))
    rows = segmented.withColumn("opened", first)
    n = F.count("*").over(w)
    return rows.select("obj_id", "seq", n.alias("points"), F.sum(F.when(F.col("opened") == "stop", 1).otherwise(0)).over(w).alias("stops"), F.sum(F.when(F.col("opened") == "move", 1).otherwise(0)).over(w).alias("moves"), F.greatest(F.lit(1), F.floor(n / 10)).cast("long").alias("estimate"))
