"""Simplification of moves or whole trajectories. ``keys`` names the sequence: obj_id, or obj_id and seg_id."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wayfold.operators import kernels
from wayfold.operators.segmentation import arrays, ordered
from wayfold.schema import BUFFER_CAPACITY, BYTES_PER_LITERAL, BYTES_PER_MATCH, DP_EPSILON_M, MIN_CAPACITY, ReferenceCoding

WHOLE, PER_SEGMENT = ("obj_id",), ("obj_id", "seg_id")
FACTOR = "struct<tag:string,literal:string,ref_id:long,start:int,length:int,mismatch:string>"


def _kept(points: DataFrame, keys, choose) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        return table.take(pa.array(choose(*arrays(table, "lat", "lon", "t"))))

    return points.groupBy(*keys).applyInArrow(run, points.schema)


def line_simplify(points: DataFrame, keys=WHOLE, eps: float = DP_EPSILON_M) -> DataFrame:
    """Points that line simplification keeps (offline)."""
    return _kept(points, keys, lambda lat, lon, t: kernels.douglas_peucker(lat, lon, eps))


def buffer_simplify(points: DataFrame, keys=WHOLE, capacity: int = BUFFER_CAPACITY) -> DataFrame:
    """Points that stay in a bounded buffer (online)."""
    return _kept(points, keys, lambda lat, lon, t: kernels.squish(lat, lon, t, capacity))


def dynamic_capacity(n: Column, share: float = 0.3, least: int = 10) -> Column:
    return F.greatest(F.lit(least), F.floor(n * share)).cast("int")


def buffer_simplify_dynamic(points: DataFrame, keys=WHOLE, share: float = 0.3, least: int = 10) -> DataFrame:
    """Bounded buffer whose capacity is a share of the sequence."""
    return _kept(points, keys, lambda lat, lon, t: kernels.squish(lat, lon, t, max(least, int(share * len(lat)))))


def hybrid_simplify(points: DataFrame, keys=WHOLE, capacity: int = BUFFER_CAPACITY, eps: float = DP_EPSILON_M, refine: bool = False) -> DataFrame:
    """Line simplification for short sequences, the buffer for long ones (refined, if asked)."""
    if capacity < MIN_CAPACITY:
        raise ValueError(f"capacity must be at least {MIN_CAPACITY}")
    return _kept(points, keys, lambda lat, lon, t: kernels.hybrid(lat, lon, t, capacity, eps, refine))


def chain_simplify(points: DataFrame, keys=WHOLE, capacity: int = BUFFER_CAPACITY, eps: float = DP_EPSILON_M) -> DataFrame:
    """The buffer, then line simplification: the geometric pipeline's move compressor."""
    return _kept(points, keys, lambda lat, lon, t: kernels.chained(lat, lon, t, capacity, eps))


def is_road_change(keys=WHOLE) -> Column:
    """Whether a point is the first, the first on a new road, or the last of its sequence."""
    w = Window.partitionBy(*keys).orderBy("seq")
    first, last = F.row_number().over(w) == 1, F.lead("seq").over(w).isNull()
    return first | last | ~F.col("road_id").eqNullSafe(F.lag("road_id").over(w))


def road_changes(points: DataFrame, keys=WHOLE) -> DataFrame:
    """First point, first point on each new road, last point. The last never counts as a change itself."""
    return points.withColumn("_keep", is_road_change(keys)).where("_keep").drop("_keep")


def speed_representation(points: DataFrame, keys=WHOLE, coding: ReferenceCoding | None = None) -> DataFrame:
    """keys, seq, road_id, direction, offset_m, speed: entries where the road or the speed changes."""
    coding = coding or ReferenceCoding()
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        got = kernels.speed_entries(*arrays(table, "lat", "lon", "t"), table.column("road_id").to_pylist(), coding.gamma)
        part = table.take(pa.array([g[0] for g in got], pa.int64()))
        cols = [part.column(k) for k in keys] + [part.column("seq"), part.column("road_id"), pa.array([1] * len(got), pa.int32()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.float64())]
        return pa.table(cols, names=[*keys, "seq", "road_id", "direction", "offset_m", "speed"])

    return points.groupBy(*keys).applyInArrow(run, f"{kinds}, seq long, road_id string, direction int, offset_m double, speed double")


def retained_points(points: DataFrame, keys=PER_SEGMENT, coding: ReferenceCoding | None = None) -> DataFrame:
    """Points of the speed representation and the last point, with ``reason``: road_change, speed_change or forced_last."""
    coding = coding or ReferenceCoding()

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        road, n = table.column("road_id").to_pylist(), len(table)
        got = [g[0] for g in kernels.speed_entries(*arrays(table, "lat", "lon", "t"), road, coding.gamma)]
        reason = ["road_change" if k == 0 or road[k] != road[k - 1] else "speed_change" for k in got]
        if got and got[-1] != n - 1:
            got.append(n - 1)
            reason.append("forced_last")
        return table.take(pa.array(got)).append_column("reason", pa.array(reason, pa.string()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(*keys).applyInArrow(run, kinds + ", reason string")


def referential_coding(move_points: DataFrame, coding: ReferenceCoding | None = None, observation: Observation | None = None) -> DataFrame:
    """obj_id, seg_id, e, v (factors), encoded_bytes, references: moves of an object in order, each a reference for the next.

    ``observation`` counts while the result is made: moves, matches, literals, bytes, and the most references held at once.
    """
    coding = coding or ReferenceCoding()

    def cell(f) -> dict:
        if isinstance(f, tuple):
            return {"tag": "match", "literal": None, "ref_id": f[0], "start": f[1], "length": f[2], "mismatch": None if f[3] is None else str(f[3])}
        return {"tag": "literal", "literal": None if f is None else str(f), "ref_id": None, "start": None, "length": None, "mismatch": None}

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        coder, rows = kernels.ReferenceCoder(coding), []
        seg = table.column("seg_id").to_numpy()
        for a, b in kernels.runs(seg):
            part = table.slice(a, b - a + 1)
            lat, lon, t = arrays(part, "lat", "lon", "t")
            factors = coder.code(kernels.speed_entries(lat, lon, t, part.column("road_id").to_pylist(), coding.gamma), float(t[-1]))
            rows.append({"obj_id": part.column("obj_id")[0].as_py(), "seg_id": int(seg[a]), "e": [cell(f) for f in factors["E"]], "v": [cell(f) for f in factors["V"]], "references": len(coder.refs)})
        kind = pa.list_(pa.struct([("tag", pa.string()), ("literal", pa.string()), ("ref_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("mismatch", pa.string())]))
        return pa.Table.from_pylist(rows, schema=pa.schema([("obj_id", pa.string()), ("seg_id", pa.int64()), ("e", kind), ("v", kind), ("references", pa.int64())]))

    coded = move_points.groupBy("obj_id").applyInArrow(run, f"obj_id string, seg_id long, e array<{FACTOR}>, v array<{FACTOR}>, references long")
    coded = coded.withColumn("encoded_bytes", factor_bytes(F.col("e")) + factor_bytes(F.col("v")))
    if observation is None:
        return coded
    of = lambda tag: F.coalesce(F.sum(F.size(F.filter("e", lambda f: f["tag"] == tag)) + F.size(F.filter("v", lambda f: f["tag"] == tag))), F.lit(0))
    return coded.observe(observation, F.count(F.lit(1)).alias("moves"), of("match").alias("matches"), of("literal").alias("literals"), F.coalesce(F.sum("encoded_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("references"), F.lit(0)).alias("most_references"))


def _decoded(factors: Column, earlier: Column) -> Column:
    """The items that ``factors`` stand for; ``earlier``: the decoded sequences that they may refer to, the first as number 1."""

    def items(f: Column) -> Column:
        copied = F.slice(F.element_at(earlier, f["ref_id"].cast("int")), f["start"] + 1, f["length"])
        mismatch = F.when(f["mismatch"].isNull(), F.array().cast("array<string>")).otherwise(F.array(f["mismatch"]))
        return F.when(f["tag"] == "match", F.concat(copied, mismatch)).otherwise(F.array(f["literal"]))

    return F.flatten(F.transform(factors, items))


def decoded_moves(coded: DataFrame) -> DataFrame:
    """obj_id, seg_id, roads array<string>, speeds array<long> (quantised): what ``referential_coding`` wrote, decoded.

    A native fold over the moves of an object in order: each is decoded against those before it, which is all that factors name.
    """
    rows = coded.groupBy("obj_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "e", "v"))).alias("moves"))
    none = F.array().cast("array<array<string>>")

    def step(state: Column, move: Column) -> Column:
        return F.struct(F.concat(state["e"], F.array(_decoded(move["e"], state["e"]))).alias("e"), F.concat(state["v"], F.array(_decoded(move["v"], state["v"]))).alias("v"))

    folded = rows.withColumn("all", F.aggregate("moves", F.struct(none.alias("e"), none.alias("v")), step))
    each = folded.select("obj_id", F.explode(F.arrays_zip(F.col("moves.seg_id").alias("seg_id"), F.col("all.e").alias("roads"), F.col("all.v").alias("speeds"))).alias("m"))
    return each.select("obj_id", "m.seg_id", "m.roads", F.transform("m.speeds", lambda v: v.cast("long")).alias("speeds"))


def factor_bytes(factors: Column) -> Column:
    """16 bytes per match, 4 per literal; 0 for a null."""
    return F.coalesce(F.aggregate(factors, F.lit(0).cast("long"), lambda s, f: s + F.when(f["tag"] == "match", BYTES_PER_MATCH).otherwise(BYTES_PER_LITERAL)), F.lit(0).cast("long"))


def stream_ratio(points: DataFrame, coded: DataFrame) -> DataFrame:
    """obj_id, ratio: points per record of the coded speeds (1 record at least)."""
    n = points.groupBy("obj_id").agg(F.count("*").alias("n"))
    v = coded.groupBy("obj_id").agg(F.sum(F.size("v")).alias("v"))
    return n.join(v, "obj_id", "left").select("obj_id", (F.col("n") / F.greatest(F.lit(1), F.coalesce("v", F.lit(0)))).alias("ratio"))


def diagnostics(points: DataFrame, retained: DataFrame) -> DataFrame:
    """Per object: points in moves, points kept by reason and the share kept (0 without points)."""
    of = lambda reason, name: F.sum(F.when(F.col("reason") == reason, 1).otherwise(0)).alias(name)
    n = points.groupBy("obj_id").agg(F.count("*").alias("input_points"))
    k = retained.groupBy("obj_id").agg(F.count("*").alias("kept_points"), of("road_change", "road_changes"), of("speed_change", "speed_changes"), of("forced_last", "forced_last"))
    return n.join(k, "obj_id", "left").fillna(0).withColumn("retention_ratio", F.col("kept_points") / F.col("input_points"))
