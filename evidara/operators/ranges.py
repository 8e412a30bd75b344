"""Exact quantiles and interval joins without a task that holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.plans.lineage import cut

#: Rows of a group whose places are told by counting its distinct values in one window.
SMALL = 100_000
#: Equal shares into which a sketch cuts what is left of a group, and its accuracy, which is ten times finer.
SHARES, ACCURACY = 500, 5_000
#: The level of the longest intervals.
TOP = 62


def _order_statistics(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (g, v), targets (g, p: place from 0) -> (g, p, v): the value at each place in order.

    What can hold a place is one stretch of values, at first all. A sketch of the stretch names two bounds around the place,
    exact counts tell how many rows lie below and between them, and the next round reads only what is between, some 250
    times fewer. A stretch of few rows, or of one value, ends it.
    """
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    n = rows.groupBy("g").agg(F.count("*").alias("m"))
    state = cut(targets.join(n, "g").select("g", "p", low.alias("low"), high.alias("high"), F.lit(0).cast("long").alias("below"), "m"), "stretch")
    inside = lambda found: rows.join(found, "g").where("v >= low AND v <= high")
    while not (wide := state.where((F.col("m") > SMALL) & (F.col("low") < F.col("high")))).isEmpty():
        sketch = F.percentile_approx("v", [i / SHARES for i in range(SHARES + 1)], ACCURACY)
        bounds = inside(wide).groupBy("g", "p", "low", "high", "below", "m").agg(sketch.alias("b"))
        share = (F.col("p") - F.col("below")) / F.col("m") * SHARES
        at = lambda place: F.element_at("b", F.least(F.greatest(place, F.lit(0)), F.lit(SHARES)).cast("int") + 1)
        bounds = bounds.select("g", "p", "low", "high", "below", "m", at(F.floor(share) - 1).alias("a"), at(F.ceil(share) + 1).alias("z"))
        counted = inside(bounds).groupBy("g", "p", "low", "high", "below", "m", "a", "z").agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("z"))).alias("between"))
        under = F.col("below") + F.col("under")
        holds = (under <= F.col("p")) & (F.col("p") < under + F.col("between")) & (F.col("between") < F.col("m"))  # else the stretch is counted as it is
        pick = lambda yes, no: F.when(holds, yes).otherwise(no)
        narrow = counted.select("g", "p", pick(F.col("a"), F.col("low")).alias("low"), pick(F.col("z"), F.col("high")).alias("high"), pick(under, F.col("below")).alias("below"), pick(F.col("between"), F.lit(0)).cast("long").alias("m"))
        state = cut(state.where((F.col("m") <= SMALL) | (F.col("low") >= F.col("high"))).unionByName(narrow), "stretch")
    counts = inside(state).groupBy("g", "p", "below", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "p").orderBy("v"))
    placed = counts.withColumn("stop", F.col("below") + upto)
    return placed.where((F.col("stop") > F.col("p")) & (F.col("stop") - F.col("c") <= F.col("p"))).select("g", "p", "v")


def quantiles(rows: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by, n and a column for each name of fractions: exact quantiles, interpolated between the two nearest places.

    Nulls and NaN don't count; a group without a value is left out, and a whole table without one gives one row of nulls (with
    n = 0) if by is empty. No task holds more than SMALL distinct values of a group, whatever its size.
    """
    by = by or []
    if any(not 0 <= f <= 1 for f in fractions.values()):
        raise ValueError("fractions are from 0 to 1")
    key = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    own = cut(rows.select(key.alias("g"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v)), "values")
    sizes = cut(own.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(f) * (F.col("n") - 1)).alias("at")) for k, f in fractions.items())))
    asked = sizes.select("g", wanted.alias("x")).select("g", "x.name", "x.at")
    places = asked.select("g", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("p")).distinct()
    found = cut(_order_statistics(own, places), "places")
    at = lambda place, name: found.select("g", F.col("p").alias(place), F.col("v").alias(name))
    both = asked.select("g", "name", "at", F.floor("at").alias("p0"), F.ceil("at").alias("p1")).join(at("p0", "v0"), ["g", "p0"]).join(at("p1", "v1"), ["g", "p1"])
    pairs = both.select("g", "name", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("p0"))).alias("q"))
    wide = pairs.groupBy("g").agg(*(F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in fractions))
    out = sizes.join(wide, "g")
    if by:
        return out.select("g.*", "n", *fractions)
    one = own.sparkSession.range(1).select(F.struct(F.lit(0).alias("all")).alias("g"))
    return one.join(out, "g", "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), *fractions)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, how: str = "inner") -> DataFrame:
    """Every point (a whole number) with every interval that holds it, ends included: all columns of both.

    An interval belongs to the level of its length, a power of two, and lies in two cells of that level at most (the longest in four); a point
    lies in one cell of each level that there is. So the join is an equality of level and cell and reads no pair that is
    further apart than twice the interval's length, whether intervals are many, nested, overlapping or long. A null stop is open,
    a null start or point belongs to nothing; with how="left" points without an interval stay, with nulls. Column names must
    differ.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    names = "".join([*points.columns, *intervals.columns])
    level, cell, row = (f"{name}_{names}" for name in ("level", "cell", "row"))
    a, z = F.col(start).cast("long"), F.col(stop).cast("long")
    length = F.coalesce(F.least(F.ceil(F.log2((z - a + 1).cast("double"))) + 1, F.lit(TOP)), F.lit(TOP)).cast("int")
    held = intervals.where(a.isNotNull() & (F.col(stop).isNull() | (z >= a))).withColumn(level, length)
    shifted = lambda c: F.expr(f"shiftright({c}, `{level}`)")
    held = held.withColumn(cell, F.explode(F.sequence(shifted(f"CAST(`{start}` AS BIGINT)"), shifted(f"coalesce(CAST(`{stop}` AS BIGINT), {2**63 - 1})"))))
    levels = [r[0] for r in held.select(level).distinct().collect()]  # 62 at most
    p = F.col(point).cast("long")
    own = points.withColumn(row, F.monotonically_increasing_id()) if how == "left" else points
    cells = F.array(*(F.struct(F.lit(n).alias("l"), F.shiftright(p, n).alias("c")) for n in levels)) if levels else F.array().cast("array<struct<l:int,c:bigint>>")
    spread = own.where(p.isNotNull()).withColumn(cell + "_", F.explode(cells))
    spread = spread.withColumns({level: F.col(cell + "_")["l"], cell: F.col(cell + "_")["c"]}).drop(cell + "_")
    met = spread.join(held, [level, cell]).where((p >= a) & (F.col(stop).isNull() | (p <= z))).drop(level, cell)
    if how == "inner":
        return met.select(*points.columns, *intervals.columns)
    found = cut(met, "met")
    alone = cut(own, "points").join(found.select(row).distinct(), row, "left_anti") if levels else own
    rest = alone.select(*points.columns, *(F.lit(None).cast(t).alias(c) for c, t in intervals.dtypes))
    return found.select(*points.columns, *intervals.columns).unionByName(rest)
