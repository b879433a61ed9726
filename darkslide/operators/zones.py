"""Zone offsets for times that have none: the nearest known time, a default, the commonest offset, UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REACH = 36 * 3600


def nearest_donor(asked: DataFrame, donors: DataFrame, by: list[str] | None = None, reach: int = REACH, width: int = 3600) -> DataFrame:
    """(id, value, distance) for every asked row with a donor at most reach seconds away: the nearest, the first by ord among equally near.

    asked: id, t (whole seconds), by...; donors: t, value, ord, by.... Only distinct seconds are compared, so that no
    burst of rows weighs on a task: within buckets of `width` seconds the donors before and after each asked second
    are found by a window of at most twice that many lines; what lies beyond a bucket comes from the first and last
    donors of the buckets around it, of which there are as many as the time has hours. Null times and values take no
    part.
    """
    by = by or []
    none = F.lit(None).cast("struct<t:bigint,ord:bigint,value:bigint>")
    d = donors.where("t is not null and value is not null").groupBy(*by, F.col("t").cast("bigint").alias("t")).agg(F.min(F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("value").cast("bigint").alias("value"))).alias("d"))
    d = d.select(*by, "t", F.struct("t", "d.ord", "d.value").alias("d"))
    q = asked.where("t is not null").select(*by, F.col("t").cast("bigint").alias("t")).distinct()
    lines = d.unionByName(q.withColumn("d", none)).withColumn("b", F.floor(F.col("t") / width))
    w = Window.partitionBy(*by, "b").orderBy("t")
    lines = lines.withColumn("before", F.last("d", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    # what follows is taken as what precedes in the order turned round, which is one running pass
    back = Window.partitionBy(*by, "b").orderBy(F.desc("t"))
    lines = lines.withColumn("after", F.last("d", ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0)))
    ends = lines.groupBy(*by, "b").agg(F.max("d").alias("last"), F.min("d").alias("first"))
    o = Window.partitionBy(*by).orderBy("b")
    ends = ends.withColumn("earlier", F.last("last", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    o_back = Window.partitionBy(*by).orderBy(F.desc("b"))
    ends = ends.withColumn("later", F.last("first", ignorenulls=True).over(o_back.rowsBetween(Window.unboundedPreceding, -1))).select(*by, "b", "earlier", "later")
    found = lines.where("d is null").join(ends, [*by, "b"])
    pick = lambda x: F.when(F.abs(x["t"] - F.col("t")) <= reach, F.struct(F.abs(x["t"] - F.col("t")).alias("distance"), x["ord"].alias("ord"), x["value"].alias("value")))
    best = F.array_min(F.array_compact(F.array(pick(F.coalesce("before", "earlier")), pick(F.coalesce("after", "later")))))
    found = found.select(*by, "t", best.alias("m")).where("m is not null")
    return asked.withColumn("t", F.col("t").cast("bigint")).join(found, [*by, "t"]).select("id", F.col("m.value").alias("value"), F.col("m.distance").alias("distance"))


def first_mode(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n): the commonest value, of equally common ones that which is seen first; nulls do not count."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    if not by:
        return counts.orderBy(F.desc("n"), "_first").limit(1).select(value, "n")
    best = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("_first")).alias("_f"), value)).alias("m"))
    return best.select(*by, f"m.{value}", "m.n")


def fill_offsets(df: DataFrame, default_zone: str | None = None) -> DataFrame:
    """df with offset_s and tz_step filled where they were unknown.

    df: id, ord, t (seconds), offset_s (null: unknown), tz_step, source. Times from names stay wall clocks. The
    others take the offset of the nearest known time within 36 hours (not from names), else that of the default
    zone at that time, else the commonest known offset, else UTC. Donors are the offsets known at first.
    """
    fixed = F.col("source").isin("filename", "filename-date", "unknown") | F.col("t").isNull()
    asked = df.where(F.col("offset_s").isNull() & ~fixed)
    donors = df.where(F.col("offset_s").isNotNull() & (F.coalesce("tz_step", F.lit("")) != "filename")).select("t", F.col("offset_s").alias("value"), "ord")
    near = nearest_donor(asked.select("id", "t"), donors).select("id", F.col("value").alias("_near"))
    out = df.join(near, "id", "left")
    default = F.lit(None).cast("long")
    if default_zone:
        at = F.timestamp_seconds("t")
        default = (F.unix_timestamp(F.from_utc_timestamp(at, default_zone)) - F.unix_timestamp(at)).cast("long")
    mode = first_mode(donors, "value", "ord").select("value")
    common = F.coalesce(mode.scalar().cast("long"), F.lit(None).cast("long"))
    ask = F.col("offset_s").isNull() & ~fixed
    offset = F.when(~ask, F.col("offset_s")).otherwise(F.coalesce(F.col("_near"), default, common, F.lit(0).cast("long")))
    step = F.when(~ask, F.col("tz_step")).when(F.col("_near").isNotNull(), "neighbor").when(default.isNotNull(), "default").when(common.isNotNull(), "common").otherwise("utc")
    return out.withColumn("tz_step", step).withColumn("offset_s", offset).drop("_near")


def pin_wall_clock(wall: F.Column, zone: str = "UTC") -> F.Column:
    """(instant_s, offset_s) of wall-clock seconds in a zone; a wall clock in a gap moves forward, a doubled one takes the earlier offset's."""
    t = F.timestamp_seconds(wall)
    instant = F.unix_timestamp(F.to_utc_timestamp(t, zone))
    return F.struct(instant.alias("instant_s"), (wall - instant).alias("offset_s"))


def running_known(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with `last_known`: the value of the latest row, by order, that has one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last_known", F.last(value, ignorenulls=True).over(w))
