"""Interpolation of time series, in long form by windows and on arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_MINUTES = 60
_POINT = "struct<t:timestamp,v:double>"


def seconds(time: Column) -> Column:
    """Whole seconds since the epoch (a timestamp without zone counts as UTC)."""
    return F.unix_seconds(time.cast("timestamp"))


def interpolate(queries: DataFrame, series: DataFrame, key: str, time: str = "time", value: str = "value", tie: Sequence[str] = (), circular: bool = False) -> DataFrame:
    """queries (key, time, ...) with `value`, predicted from the series (key, time, value) of the same key.

    Between two points strictly before and after, linear by whole seconds. Otherwise the nearest point by whole
    minutes, at most 60 away; among equals the earlier one. Else null. circular=True interpolates angles over the short
    way round and gives 0 to 360. Points of equal time: the last by `tie`.
    """
    return interpolate_fields(queries, {value: series}, key, time, value, tie, (value,) if circular else ())


def interpolate_fields(
    queries: DataFrame, fields: dict[str, DataFrame], key: str, time: str = "time", value: str = "value", tie: Sequence[str] = (), circular: Sequence[str] = ()
) -> DataFrame:
    """queries with a column for each field, predicted from the field's own series as interpolate() does; `circular` names
    the fields that are angles.

    All fields go through one shuffle and one sort in either direction, however many they are. Rows are keyed by key and
    day; each field's last point before a day and first one after it are carried into it (from one row for each key and
    day), so a busy key is many tasks.
    """
    own = [c for c in queries.columns if c not in (key, time)]
    order = list(tie) or [value]
    names = {f"__{i}": name for i, name in enumerate(fields)}
    day = F.unix_date(F.col("__t").cast("date")).alias("__day")
    q = queries.select(key, F.col(time).cast("timestamp").alias("__t"), F.struct(F.col(time).alias("__time"), *own).alias("__q"))
    kind = q.schema["__q"].dataType
    points = None
    for f, name in names.items():
        found = fields[name].filter(F.col(value).isNotNull() & F.col(time).isNotNull())
        last = found.groupBy(key, F.col(time).cast("timestamp").alias("__t")).agg(F.max_by(F.col(value).cast("double"), F.struct(*order)).alias("v"))
        last = last.select(key, day, "__t", F.lit(f).alias("__f"), F.struct(F.col("__t").alias("t"), "v").alias("__p"))
        points = last if points is None else points.unionByName(last)
    of = lambda f: F.when(F.col("__f") == f, F.col("__p"))
    none = F.lit(None).cast(_POINT)
    ends = points.groupBy(key, "__day").agg(*(e for f in names for e in (F.min(of(f)).alias(f"{f}first"), F.max(of(f)).alias(f"{f}last"))))
    asked = q.select(key, day).distinct().withColumns({f"{f}{end}": none for f in names for end in ("first", "last")})
    ends = ends.unionByName(asked).groupBy(key, "__day").agg(*(e for f in names for e in (F.min(f"{f}first").alias(f"{f}first"), F.max(f"{f}last").alias(f"{f}last"))))
    days = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(key).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"{f}before": F.last(f"{f}last", ignorenulls=True).over(days) for f in names})
    ends = ends.withColumns({f"{f}after": F.last(f"{f}first", ignorenulls=True).over(back) for f in names})
    near = [F.when(F.col(f + end).isNotNull(), F.struct(F.lit(f).alias("f"), F.col(f + end).alias("p"))) for f in names for end in ("before", "after")]
    edges = ends.select(key, "__day", F.explode(F.array_compact(F.array(*near))).alias("__e"))
    edges = edges.select(key, "__day", F.col("__e.p.t").alias("__t"), F.col("__e.f").alias("__f"), F.col("__e.p").alias("__p"))
    w = Window.partitionBy(key, "__day").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(key, "__day").orderBy(F.col("__t").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = q.select(key, day, "__t", F.lit(1).alias("__side"), "__q", F.lit(None).cast("string").alias("__f"), none.alias("__p")).unionByName(
        points.unionByName(edges).select(key, "__day", "__t", F.lit(0).alias("__side"), F.lit(None).cast(kind).alias("__q"), "__f", "__p")
    )
    both = both.withColumns({f"{f}a": F.last(of(f), ignorenulls=True).over(w) for f in names})
    both = both.withColumns({f"{f}b": F.last(of(f), ignorenulls=True).over(after) for f in names})
    made = [predicted(F.col("__t"), F.col(f"{f}a"), F.col(f"{f}b"), name in circular).alias(name) for f, name in names.items()]
    return both.filter("__side = 1").select(key, F.col("__q.__time").alias(time), *(F.col(f"__q.{c}").alias(c) for c in own), *made)


def predicted(t: Column, a: Column, b: Column, circular: bool = False) -> Column:
    """Value at t from the points (t, v) at or before it and after it; either may be null."""
    slope = b["v"] - a["v"]
    if circular:
        slope = F.pmod(slope + 180, F.lit(360.0)) - 180
    span = (seconds(b["t"]) - seconds(a["t"])).cast("double")
    line = a["v"] + F.try_divide(slope, span) * (seconds(t) - seconds(a["t"]))
    if circular:
        line = F.pmod(line, F.lit(360.0))
    before, later = _minutes(t, a["t"]), _minutes(t, b["t"])
    near_a, near_b = before <= TOLERANCE_MINUTES, later <= TOLERANCE_MINUTES
    fallback = F.when(near_a & (b.isNull() | (before <= later)), a["v"]).when(near_b, b["v"])
    return F.when((a["t"] < t) & (t < b["t"]), line).otherwise(fallback)


def _minutes(a: Column, b: Column) -> Column:
    return F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 60_000_000)


def first_that_predicts(*predictions: Column) -> Column:
    """The prediction of the first of several codes that has one: each code brackets within itself."""
    return F.coalesce(*predictions)


# Series as arrays of struct(time, value), ordered by time.


def combine(*series: Column) -> Column:
    """All points of several series, in order of time."""
    return F.array_sort(F.concat(*series), lambda a, b: F.when(a["time"] < b["time"], -1).when(a["time"] > b["time"], 1).otherwise(0))


def remove_before(series: Column, time: Column) -> Column:
    """Points strictly after a time."""
    return F.filter(series, lambda p: p["time"] > time)


def map_values(series: Column, function) -> Column:
    return F.transform(series, lambda p: F.struct(p["time"].alias("time"), function(p["value"]).alias("value")))


def predict_array(series: Column, time: Column, circular: bool = False) -> Column:
    """The same prediction on an array of points, for short series that travel with their row."""
    point = lambda p: F.struct(p["time"].alias("t"), p["value"].alias("v"))
    a = F.get(F.reverse(F.filter(series, lambda p: p["time"] <= time)), F.lit(0))
    b = F.get(F.filter(series, lambda p: p["time"] > time), F.lit(0))
    return predicted(time, F.when(a.isNotNull(), point(a)), F.when(b.isNotNull(), point(b)), circular)
