"""Sources of points: delimited files with column aliases, strict and replay readers, fleet logs, and a view over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.schema import ALIASES


def resolve_columns(columns: list[str], mapping: dict[str, str] | None = None) -> dict[str, str | None]:
    """Source column of each logical field: the mapping's, else the first alias in the header, else none."""
    given = mapping or {}
    return {field: given.get(field) or next((a for a in names if a in columns), None) for field, names in ALIASES.items()}


def file_stem(path: Column | None = None) -> Column:
    return F.regexp_extract(path if path is not None else F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def from_frame(df: DataFrame, mapping: dict[str, str] | None = None, default_obj_id: str | None = None, order: Column | None = None) -> DataFrame:
    """Points of any frame. Needs latitude, longitude and time columns, else KeyError; a missing id takes the default or the file stem."""
    found = resolve_columns(df.columns, mapping)
    for needed in ("lat", "lon", "ts"):
        if found[needed] is None:
            raise KeyError(needed)
    obj = F.col(found["obj_id"]).cast("string") if found["obj_id"] else F.lit(default_obj_id) if default_obj_id else file_stem()
    road = F.col(found["road_id"]).cast("string") if found["road_id"] else F.lit(None).cast("string")
    ts = F.col(found["ts"]).cast("timestamp")
    rows = df.select(obj.alias("obj_id"), F.col(found["lat"]).cast("double").alias("lat"), F.col(found["lon"]).cast("double").alias("lon"), (F.unix_micros(ts) / 1e6).alias("t"), road.alias("road_id"), (order if order is not None else F.monotonically_increasing_id()).alias("_o"))
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("obj_id").orderBy("_o")) - 1).cast("long")).drop("_o")


def read_csv(spark: SparkSession, path: str, sep: str = ",", mapping: dict[str, str] | None = None, default_obj_id: str | None = None) -> DataFrame:
    """Delimited files with a header; order within a file is the file's."""
    return from_frame(spark.read.option("header", True).option("sep", sep).csv(path), mapping, default_obj_id)


def read_directory(spark: SparkSession, path: str, max_files: int | None = None, least_points: int = 2) -> DataFrame:
    """All ``*.csv`` of a folder, object = file stem, files in numeric order of their stems, short files left out."""
    rows = from_frame(spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path).withColumn("obj_id", file_stem()))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("obj_id"))).where(F.col("_n") >= least_points).drop("_n")
    if max_files is None:
        return rows
    rank = F.dense_rank().over(Window.orderBy(F.coalesce(F.expr("try_cast(obj_id AS bigint)"), F.lit(0)), "obj_id"))
    chosen = rows.select("obj_id").distinct().withColumn("_r", rank).where(F.col("_r") <= max_files).select("obj_id")
    return rows.join(chosen, "obj_id", "left_semi")


def strict(df: DataFrame, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Rows whose time has the format and whose coordinates are numbers; others are dropped. First alias of each wins."""
    found = resolve_columns(df.columns)
    ts = F.try_to_timestamp(F.col(found["ts"]), F.lit(time_format))
    good = df.select("*", ts.alias("_ts"), F.expr(f"try_cast(`{found['lat']}` AS double)").alias("_lat"), F.expr(f"try_cast(`{found['lon']}` AS double)").alias("_lon"))
    return good.dropna(subset=["_ts", "_lat", "_lon"]).drop("_ts", "_lat", "_lon")


def replay(df: DataFrame, start: str, interval_s: float = 1.0, obj_id: str | None = None) -> DataFrame:
    """Stamps rows with a clock that advances with every row, also with those then dropped for bad coordinates."""
    if "latitude" not in df.columns or "longitude" not in df.columns:
        raise ValueError("the file must contain 'latitude' and 'longitude'")
    name = F.lit(obj_id) if obj_id else file_stem()
    rows = df.select(name.alias("obj_id"), F.expr("try_cast(latitude AS double)").alias("lat"), F.expr("try_cast(longitude AS double)").alias("lon"), F.monotonically_increasing_id().alias("_o"))
    w = Window.partitionBy("obj_id").orderBy("_o")
    clock = F.unix_micros(F.lit(start).cast("timestamp")) / 1e6 + (F.row_number().over(w) - 1) * interval_s
    rows = rows.withColumn("t", clock).dropna(subset=["lat", "lon"])
    return rows.select("obj_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "lat", "lon", "t", F.lit(None).cast("string").alias("road_id"))


def read_replay(spark: SparkSession, path: str, start: str, interval_s: float = 1.0, obj_id: str | None = None) -> DataFrame:
    """``replay`` of a file; a missing one raises FileNotFoundError."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return replay(df, start, interval_s, obj_id)


def stage_replay(df: DataFrame, path: str, start: str, interval_s: float = 1.0, rows_per_batch: int = 100, obj_id: str | None = None) -> None:
    """Write what ``replay`` gives so that ``replay_stream`` can play it: one folder for every ``rows_per_batch`` beats of the clock."""
    begin = F.unix_micros(F.lit(start).cast("timestamp")) / 1e6
    beat = F.round((F.col("t") - begin) / interval_s).cast("long")
    replay(df, start, interval_s, obj_id).withColumn("batch", F.floor(beat / rows_per_batch)).repartition("batch").write.partitionBy("batch").parquet(path)


def replay_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of staged points, in the clock's order: each micro-batch brings the next beats of all objects.

    The clock is Spark's own micro-batch source, so a query that stops goes on from its checkpoint where it was. The beats' number meets the staged folders,
    of which only the wanted one is read. After the last folder micro-batches are empty, until the query is stopped.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).option("startTimestamp", 0).load()
    staged = spark.read.parquet(path)
    joined = staged.join(F.broadcast(clock.select("value")), F.col("batch") == F.col("value"))  # one row
    return joined.select("obj_id", "seq", "lat", "lon", "t", "road_id")


def fleet_log(lines: DataFrame) -> DataFrame:
    """Tab-separated fleet rows (id, vehicle, date, three times, x, y, speed); header and short rows are dropped."""
    parts = F.split("value", "\t")
    rows = lines.select(parts.alias("p"), F.monotonically_increasing_id().alias("_o")).where(F.size("p") >= 9)
    cell = lambda k: F.trim(F.get("p", k))
    ts = F.try_to_timestamp(F.concat_ws(" ", cell(2), cell(3)), F.lit("M/d/yyyy H:mm:ss"))
    rows = rows.select(cell(1).alias("obj_id"), ts.alias("timestamp"), cell(6).alias("lon"), cell(7).alias("lat"), "_o").where("timestamp IS NOT NULL")
    return from_frame(rows, order=F.col("_o"))


def lenient(df: DataFrame) -> DataFrame:
    """Points sorted by time within their file (obj_id: its stem), unparsable rows dropped; without a time column, a clock of 1 Hz from
    2020-01-01."""
    found, stem = resolve_columns(df.columns), F.coalesce(F.nullif(file_stem(), F.lit("")), F.lit("file"))
    lat, lon = (F.expr(f"try_cast(`{found[k]}` AS double)") for k in ("lat", "lon"))
    rows = df.select(stem.alias("obj_id"), lat.alias("lat"), lon.alias("lon"), *([F.try_to_timestamp(F.col(found["ts"]).cast("string")).alias("ts")] if found["ts"] else []), F.monotonically_increasing_id().alias("_o")).dropna()
    w = Window.partitionBy("obj_id").orderBy("_o")
    if not found["ts"]:
        rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1577836800) + F.row_number().over(w) - 1))
    return rows.select("obj_id", (F.row_number().over(Window.partitionBy("obj_id").orderBy("ts", "_o")) - 1).cast("long").alias("seq"), "lat", "lon", (F.unix_micros("ts") / 1e6).alias("t"), F.lit(None).cast("string").alias("road_id"))


def check_file_id(name: str) -> str:
    """A file id: digits only."""
    if not name or not name.isascii() or not name.isdigit():
        raise ValueError(f"not a file id: {name!r}")
    return name


def list_file_ids(spark: SparkSession, path: str) -> DataFrame:
    """file_id, bytes: the ``*.csv`` files of a folder whose stems are file ids, to be taken in numeric order. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(file_stem(F.col("path")).alias("file_id"), F.col("length").alias("bytes"))
    return files.where(F.col("file_id").rlike("^[0-9]+$"))


def matched(df: DataFrame) -> DataFrame:
    """Pre-matched rows: matched coordinates and the way as road id."""
    return from_frame(df, {"lat": "matched_latitude", "lon": "matched_longitude", "road_id": "osm_way_id"})


#: Columns of ``events_in_order`` that give the rows' order in their files.
FILE_ORDER = ["_file", "_row"]


def events_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table with each row's place: its file and its number there."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic trajectories over the ``events`` table: dwells and moves of 12 rows in turn, one fix per 5 seconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("user_id", "ts", "event_id", "value", "event_type").withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("moving", F.when(F.floor(F.col("seq") / 12) % 2 == 1, 1).otherwise(0))
    rows = rows.withColumn("steps", F.sum("moving").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    v = F.col("value")
    lat = F.lit(40.7) + F.col("user_id") * F.lit(1e-3) + F.col("steps") * F.lit(2e-4) + (v - 10 * F.floor(v / 10)) * F.lit(1e-6) + (F.col("event_id") % 997) * F.lit(1e-9)
    lon = F.lit(-74.0) + F.col("steps") * F.lit(1e-4) + F.col("moving") * (v - 25 * F.floor(v / 25)) * F.lit(1e-5)
    return rows.select(F.col("user_id").cast("string").alias("obj_id"), "seq", lat.alias("lat"), lon.alias("lon"), (F.col("seq") * 5).cast("double").alias("t"), F.col("event_type").alias("road_id"))


EVENTS_SQL = """
    ev AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
    mv AS (SELECT *, CASE WHEN floor(seq / 12) % 2 = 1 THEN 1 ELSE 0 END AS moving FROM ev),
    st AS (SELECT *, sum(moving) OVER (PARTITION BY user_id ORDER BY seq) AS steps FROM mv),
    pts AS (SELECT user_id::VARCHAR AS obj_id, seq::BIGINT AS seq,
                   40.7::DOUBLE + user_id * 1e-3::DOUBLE + steps * 2e-4::DOUBLE + (value - 10 * floor(value / 10)) * 1e-6::DOUBLE + (event_id % 997) * 1e-9::DOUBLE AS lat,
                   -74.0::DOUBLE + steps * 1e-4::DOUBLE + moving * (value - 25 * floor(value / 25)) * 1e-5::DOUBLE AS lon,
                   (5 * seq)::DOUBLE AS t, event_type AS road_id FROM st)"""
