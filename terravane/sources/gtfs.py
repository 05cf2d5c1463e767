"""Timetable feeds: the six text files as typed tables with the loader's row rules.

Rows that can't be used are dropped where they are read: stops without usable coordinates, routes without a numeric type, trips of an
unknown route or service, events of an unknown trip or stop or with times that can't be read. Columns are found by name. Where a
key occurs more than once, the last row of the file counts for joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...], missing_ok: bool = False) -> DataFrame | None:
    """The named columns of a file as text; spaces around unquoted values go, doubled quotes become one."""
    try:
        df = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return None
        raise
    names = {c.strip().lstrip("\ufeff"): c for c in df.columns}
    lost = [c for c in columns if c not in names]
    if lost:
        raise ValueError(f"{path} has no column {', '.join(lost)}")
    return df.select(*[F.col(f"`{names[c]}`").alias(c) for c in columns])


def _last(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the last of the file; file order is the order of Spark's row numbers within a read."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def load_calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """calendar (service_id, mask, start_date, end_date) and exceptions (service_id, date, type); either file may be missing."""
    days = _csv(spark, f"{path}/calendar.txt", ("service_id", *DAYS, "start_date", "end_date"), missing_ok=True)
    if days is None:
        calendar = spark.createDataFrame([], "service_id string, mask int, start_date int, end_date int")
    else:
        mask = sum((F.when(F.col(d) == "1", F.lit(1 << k)).otherwise(F.lit(0)) for k, d in enumerate(DAYS)), F.lit(0))
        date = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
        calendar = _last(days.where(_filled("service_id")), "service_id").select("service_id", mask.alias("mask"), date("start_date").alias("start_date"), date("end_date").alias("end_date"))
    dates = _csv(spark, f"{path}/calendar_dates.txt", ("service_id", "date", "exception_type"), missing_ok=True)
    if dates is None:
        exceptions = spark.createDataFrame([], "service_id string, date int, type int")
    else:
        exceptions = dates.select("service_id", F.col("date").try_cast("int").alias("date"), F.col("exception_type").try_cast("int").alias("type")).where(_filled("service_id") & F.col("date").isNotNull() & F.col("type").isNotNull())
    return calendar, exceptions


def load_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """stops, routes, trips, events, calendar and exceptions of a feed's folder."""
    calendar, exceptions = load_calendar(spark, path)
    raw = _csv(spark, f"{path}/stops.txt", ("stop_id", "stop_name", "stop_lat", "stop_lon"))
    stops = raw.select("stop_id", F.coalesce(F.nullif("stop_name", F.lit("")), "stop_id").alias("stop_name"), S.gtfs_e7(F.col("stop_lat")).alias("lat_e7"), S.gtfs_e7(F.col("stop_lon")).alias("lon_e7"))
    stops = _last(stops.where(_filled("stop_id") & F.col("lat_e7").isNotNull() & F.col("lon_e7").isNotNull()), "stop_id")
    raw = _csv(spark, f"{path}/routes.txt", ("route_id", "route_short_name", "route_long_name", "route_type"))
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), "route_id").alias(c)
    routes = _last(raw.select("route_id", name("route_short_name"), name("route_long_name"), F.col("route_type").try_cast("int").alias("route_type")).where(_filled("route_id") & (F.col("route_type") >= 0)), "route_id")
    services = calendar.select("service_id").union(exceptions.select("service_id")).distinct()
    raw = _csv(spark, f"{path}/trips.txt", ("route_id", "service_id", "trip_id"))
    trips = _last(raw.where(_filled("trip_id")), "trip_id").join(services, "service_id", "left_semi").join(routes.select("route_id", S.mode_of(F.col("route_type")).alias("mode")), "route_id")
    raw = _csv(spark, f"{path}/stop_times.txt", ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"))
    events = raw.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("bigint").alias("sequence"), S.gtfs_seconds(F.col("arrival_time")).alias("arrival_sec"), S.gtfs_seconds(F.col("departure_time")).alias("departure_sec"))
    events = events.where("sequence >= 0 and arrival_sec is not null and departure_sec is not null")
    events = events.join(trips.select("trip_id", "route_id", "service_id", "mode"), "trip_id").join(stops.select("stop_id"), "stop_id", "left_semi")
    return {"stops": stops, "routes": routes, "trips": trips, "events": events, "calendar": calendar, "exceptions": exceptions}


def write_gtfs(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as Parquet, events dealt by trip and in order, so that a trip's events lie together."""
    for name, df in tables.items():
        out = df.repartition("trip_id").sortWithinPartitions("trip_id", "sequence") if name == "events" else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")


def read_polyline(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file with lon,lat a line."""
    return spark.read.csv(path, schema="lon double, lat double").where("lon is not null and lat is not null")


def read_styles(text: str, known: set[str] | None = None) -> dict[str, str]:
    """key = value lines; # begins a comment, footer.* is left out, an unknown key is an error."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip() if not line.strip().startswith("#") else ""
        if not line:
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or not key:
            raise ValueError(f"not a setting: {line!r}")
        if key.startswith("footer."):
            continue
        if known is not None and key not in known:
            raise ValueError(f"unknown setting {key}")
        out[key] = value
    return out
