"""File-based ingestion: sensor observations (JSON), identity lookups, visits, berths. Fetching is a caller's job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulefold.functions.projection import to_lonlat
from rulefold.operators.relation import Relation

OBSERVATIONS = """
_embedded STRUCT<observations: ARRAY<STRUCT<
  parameterType: STRUCT<type: STRING, description: STRING>,
  procedure: STRUCT<name: STRING, description: STRING,
    parameters: ARRAY<STRUCT<name: STRING, description: STRING, uom: STRING, reference: STRING>>>,
  featureOfInterest: STRUCT<id: STRING, location: STRING,
    geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>, spatialReference: STRUCT<wkid: STRING>>>,
  result: ARRAY<STRUCT<phenomenonTime: STRING, parameters: ARRAY<STRUCT<name: STRING, value: DOUBLE>>>>>>>
"""
#: Parameter codes that are kept, what they measure, and the factor to canonical units.
CODES = {
    "PWV10": ("wind.velocity", 1.0), "WV10": ("wind.velocity", 1.0), "PWD10": ("wind.direction", 1.0), "WD10": ("wind.direction", 1.0),
    "PH10": ("tide.height", 0.01), "H10": ("tide.height", 0.01), "PHW": ("tide.high_water", 0.01), "HW": ("tide.high_water", 0.01),
    "PLW": ("tide.low_water", 0.01), "LW": ("tide.low_water", 0.01),
    "PTSR10": ("tidal_stream.rate", 1.0), "TSR10": ("tidal_stream.rate", 1.0), "PTSRDA10": ("tidal_stream.rate", 1.0), "TSRBA10": ("tidal_stream.rate", 1.0),
    "PTSD10": ("tidal_stream.direction", 1.0), "TSD10": ("tidal_stream.direction", 1.0), "PTSDDA10": ("tidal_stream.direction", 1.0),
}
AIS = "mmsi STRING, callSign STRING, maxDraught DOUBLE, timeLastUpdate BIGINT"
VISIT = """event_id STRING, id STRING, port STRING,
vessel STRUCT<name: STRING, mmsi: STRING, beam: DOUBLE, lengthOverall: DOUBLE, shipCategoryCode: STRING>,
berth_visits ARRAY<STRUCT<start: TIMESTAMP, end: TIMESTAMP, has_inbound: BOOLEAN, has_outbound: BOOLEAN, locations: ARRAY<STRING>>>"""
#: Fixed value: the port whose visits count.
PORT = "NLRTM"


def kafka_options(servers: str, topic: str, starting: str = "latest", certificates: dict[str, str] | None = None, lossy: bool = False) -> dict[str, str]:
    """Options for spark.readStream.format("kafka"): starting is 'latest', 'earliest' or JSON offsets; certificates are
    ssl settings without their prefix; lossy goes on where offsets are gone instead of failing. (The connector is a
    package of its own.)"""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": str(not lossy).lower()}
    if certificates:
        options["kafka.security.protocol"] = "SSL"
        options |= {f"kafka.ssl.{k}": v for k, v in certificates.items()}
    return options


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each measured or predicted value of a JSON response (one document a file)."""
    return flatten_observations(spark.read.json(path, schema=OBSERVATIONS, multiLine=True))


def poll_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The responses that a poller leaves in a folder, as a stream of readings with the name of their file as `poll`
    (names have to sort by time, and each file is complete once it has its name). The checkpoint of the query holds which
    files it has read, so a restart reads none twice; the folder may be in any store that Spark reads."""
    files = spark.readStream.schema(OBSERVATIONS).option("multiLine", True).json(folder)
    return flatten_observations(files.withColumn("poll", F.col("_metadata.file_name")), keep=("poll",))


def flatten_observations(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(sensor, code, measure, time, value, lon, lat): codes that are not known are dropped, and so are features that
    are not points with two coordinates, or are in a reference system that is not known (none: longitude and latitude).
    Values are in canonical units. `keep` names columns of the responses to keep."""
    one = responses.select(*keep, F.explode("_embedded.observations").alias("o"))
    place = F.col("o.featureOfInterest.geometry")
    valid = one.filter((place["type"] == "Point") & (F.size(place["coordinates"]) >= 2)).withColumn("__at", _lonlat(place))
    valid = valid.filter(F.col("__at").isNotNull())
    times = valid.select(*keep, F.col("o.featureOfInterest.id").alias("sensor"), F.col("__at.lon").alias("lon"), F.col("__at.lat").alias("lat"), F.explode("o.result").alias("r"))
    values = times.select(*keep, "sensor", "lon", "lat", F.col("r.phenomenonTime").try_cast("timestamp").alias("time"), F.explode("r.parameters").alias("p"))
    known = F.create_map(*(F.lit(x) for k, (m, f) in CODES.items() for x in (k, m)))
    factor = F.create_map(*(F.lit(x) for k, (m, f) in CODES.items() for x in (k, f)))
    code = F.col("p.name")
    rows = values.filter(code.isin(list(CODES)) & F.col("p.value").isNotNull())
    return rows.select(*keep, "sensor", code.alias("code"), known[code].alias("measure"), "time", (F.col("p.value") * factor[code]).alias("value"), "lon", "lat")


def _lonlat(place: Column) -> Column:
    """Coordinates of a point; where one of them is null, as it is."""
    x, y = F.get(place["coordinates"], F.lit(0)), F.get(place["coordinates"], F.lit(1))
    code = F.coalesce(place["spatialReference"]["wkid"], F.lit("4326"))
    return F.when(code == "4326", F.struct(x.alias("lon"), y.alias("lat"))).otherwise(to_lonlat(x, y, code))


def rejected_features(responses: DataFrame) -> DataFrame:
    """(sensor, reason) of the features that flatten_observations() drops."""
    one = responses.select(F.explode("_embedded.observations.featureOfInterest").alias("f"))
    place = F.col("f.geometry")
    reason = F.when(place.isNull(), "no geometry").when(~place["type"].eqNullSafe(F.lit("Point")), F.concat(F.lit("not a point: "), F.coalesce(place["type"], F.lit("null"))))
    reason = reason.when(~F.coalesce(F.size(place["coordinates"]) >= 2, F.lit(False)), "fewer than two coordinates")
    reason = reason.when(_lonlat(place).isNull(), F.concat(F.lit("no position in EPSG:"), place["spatialReference"]["wkid"]))
    return one.select(F.col("f.id").alias("sensor"), reason.alias("reason")).filter("reason is not null")


def messages(changes: DataFrame, key: str) -> DataFrame:
    """(key, value) strings for a Kafka sink (or any other) from the changes of a relation (key, op, values): the value
    is JSON, {"Update": {"key": ..., "value": {...}}} or {"Delete": {"key": ...}}."""
    rest = [c for c in changes.columns if c not in (key, "op")]
    update = F.to_json(F.struct(F.struct(F.col(key).alias("key"), F.struct(*rest).alias("value")).alias("Update")))
    delete = F.to_json(F.struct(F.struct(F.col(key).alias("key")).alias("Delete")))
    return changes.select(F.col(key).cast("string").alias("key"), F.when(F.col("op") == "D", delete).otherwise(update).alias("value"))


def visit_faults(visits: DataFrame, port: str = PORT) -> DataFrame:
    """(fault, n): why visits do not count, each by the first reason of: another port, then the vessel's missing fields."""
    v = F.col("vessel")
    fault = F.when(~F.col("port").eqNullSafe(F.lit(port)), "another port")
    for name in ("name", "mmsi", "beam", "lengthOverall", "shipCategoryCode"):
        fault = fault.when(v[name].isNull(), f"no {name}")
    return visits.select(fault.alias("fault")).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def publish(series: DataFrame, measures: Sequence[str]) -> Relation:
    """Sensors that have every one of the measures, a row for each day with points: an array of (time, value) for each
    measure, in time order (empty on days without). A day bounds the arrays, however long a series is.

    Names of array columns are what follows the last dot of the measure.
    """

    def points(m: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("measure") == m, F.struct("time", "value"))))

    wanted = series.filter(F.col("measure").isin(list(measures)))
    whole = wanted.groupBy("sensor").agg(F.collect_set("measure").alias("__m")).filter(F.size("__m") == len(measures)).select("sensor")
    days = wanted.groupBy("sensor", F.to_date("time").alias("day")).agg(*(points(m).alias(m.rsplit(".", 1)[-1]) for m in measures))
    return Relation(days.join(whole, "sensor", "left_semi"), ("sensor", "day"))


def publish_latest(series: DataFrame, measures: Sequence[str], horizon: str = "2 days") -> Relation:
    """One row for each sensor that has every one of the measures within the `horizon` before its last point: an array of
    (time, value) for each measure, in time order. The horizon bounds the arrays, however long a series is."""
    wanted = series.filter(F.col("measure").isin(list(measures)) & F.col("time").isNotNull())
    last = wanted.groupBy("sensor").agg((F.max("time") - F.expr(f"interval {horizon}")).alias("__from"))
    recent = wanted.join(last, "sensor").filter(F.col("time") > F.col("__from"))
    points = lambda m: F.array_sort(F.collect_list(F.when(F.col("measure") == m, F.struct("time", "value"))))
    names = [m.rsplit(".", 1)[-1] for m in measures]
    made = recent.groupBy("sensor").agg(*(points(m).alias(n) for m, n in zip(measures, names, strict=True)))
    return Relation(made.filter(" and ".join(f"size({n}) > 0" for n in names)), ("sensor",))


def classify_visits(visits: DataFrame, now: Column, port: str = PORT) -> DataFrame:
    """A row for each place of the berth visit that decides a visit's direction: visit columns, direction, time, place.

    Inbound: the first berth visit that starts after `now` and has an inbound movement. Else outbound: the first with
    an outbound movement, at its end, whenever that is. Neither, another port or missing vessel data: no row.
    """
    v = F.col("vessel")
    whole = visits.filter((F.col("port") == port) & v["name"].isNotNull() & v["mmsi"].isNotNull() & v["beam"].isNotNull() & v["lengthOverall"].isNotNull() & v["shipCategoryCode"].isNotNull())
    inbound = F.get(F.filter("berth_visits", lambda b: (b["start"] > now) & b["has_inbound"]), F.lit(0))
    outbound = F.get(F.filter("berth_visits", lambda b: b["has_outbound"]), F.lit(0))
    chosen = F.when(inbound.isNotNull(), F.struct(F.lit("Inbound").alias("direction"), inbound["start"].alias("time"), inbound["locations"].alias("places")))
    chosen = chosen.when(outbound.isNotNull(), F.struct(F.lit("Outbound").alias("direction"), outbound["end"].alias("time"), outbound["locations"].alias("places")))
    rows = whole.withColumn("__c", chosen).filter("__c is not null")
    return rows.select(*visits.columns, F.col("__c.direction").alias("direction"), F.col("__c.time").alias("time"), F.explode("__c.places").alias("place"))


def with_draught(vessels: DataFrame, lookups: DataFrame) -> DataFrame:
    """vessels with draught and call sign from identity lookups, joined on mmsi (the latest answer for each)."""
    w = Window.partitionBy("mmsi").orderBy(F.col("timeLastUpdate").desc_nulls_last())
    last = lookups.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return vessels.join(last.select("mmsi", F.col("maxDraught").alias("draught"), F.col("callSign").alias("call_sign")), "mmsi")


def active(vessels: Relation, now: Column, time: str = "time") -> Relation:
    """Vessels whose time is not past; `now` is explicit, so results can be repeated."""
    return vessels.filter(F.col(time) >= now)


def berths(messages: DataFrame, schema: str, kind: str = "Berth") -> Relation:
    """Berths by urn from JSON messages (value, seq): unreadable ones and other kinds are dropped, the last one wins."""
    rows = messages.select(F.from_json("value", schema).alias("m"), "seq").filter((F.col("m.urn").isNotNull()) & (F.col("m.type") == kind))
    return Relation.from_changelog(rows.select("m.*", "seq", F.lit("U").alias("op")), ["urn"], ["seq"])
