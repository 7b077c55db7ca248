"""From lane readings to time bins, and their alignment with dimensions, rain and calendars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.functions.scalar import day_type
from stormlane.operators.scans import PIECE, fresh, with_neighbours, with_next
from stormlane.sources.tables import kept

#: A dimension is broadcast up to this many rows (they are counted); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def sized(dim: DataFrame) -> DataFrame:
    """The dimension with a broadcast hint if its counted size allows."""
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def lanes_to_detector(df: DataFrame, how: str = "weighted", keys: tuple = ("detector_id", "time")) -> DataFrame:
    """One row per key: total volume, mean occupancy, and the speed weighted by volume (null without vehicles), the plain
    mean, or that of the slowest lane."""
    speed = {"weighted": F.sum(F.col("speed") * F.col("volume")) / F.nullif(F.sum(F.when(F.col("speed").isNotNull(), F.col("volume"))), F.lit(0)), "mean": F.avg("speed"), "slowest": F.min("speed")}[how]
    return df.groupBy(*keys).agg(speed.alias("speed"), F.sum("volume").alias("volume"), F.avg("occupancy").alias("occupancy"))


def bin_time(df: DataFrame, minutes: int = 15, keys: tuple = ("detector_id",)) -> DataFrame:
    """Tumbling bins per key: number of readings, total volume, mean speed and occupancy."""
    window = F.window("time", f"{minutes} minutes")
    binned = df.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.avg("speed").alias("speed"), F.avg("occupancy").alias("occupancy"))
    return binned.select(*keys, F.col("w.start").alias("bin"), "n", "volume", "speed", "occupancy")


def join_detector(readings: DataFrame, dim: DataFrame) -> DataFrame:
    return readings.join(sized(dim), "detector_id")


def unmatched_ids(readings: DataFrame, dim: DataFrame) -> DataFrame:
    """Ids that only one side has."""
    a, b = readings.select("detector_id").distinct(), dim.select("detector_id").distinct()
    return a.join(b, "detector_id", "left_anti").withColumn("side", F.lit("readings")).unionByName(b.join(a, "detector_id", "left_anti").withColumn("side", F.lit("dimension")))


def asof_version(df: DataFrame, versions: DataFrame, key: str, time: str, valid_from: str, value: str, piece: str | None = None) -> DataFrame:
    """Each row with the ``value`` of the latest version of its key that is not after its time, or null.

    Rows and versions are sorted together, and the last version's value is carried on: rows don't multiply by their key's versions.
    Versions come before rows of the same time. Times are cut into pieces (days, or ``piece``: a year for versions of dates), so that a key's history is no single
    group; numbers instead of times are not, and have one.
    """
    rest = df.columns
    at, row, version, data, found = fresh(df, versions, names=("_at", "_row", "_version", "_data", "_found"))
    events = versions.select(F.col(key), F.col(valid_from).alias(at), F.lit(0).alias(row), F.struct(valid_from, value).alias(version))
    rows = df.select(F.col(key), F.col(time).alias(at), F.lit(1).alias(row), F.struct(*rest).alias(data))
    both = rows.unionByName(events, allowMissingColumns=True)
    if dict(both.dtypes)[at].startswith(("timestamp", "date")):
        carried = with_neighbours(both, [key], at, [at, row], F.col(version), back=found, piece=piece or PIECE)
    else:
        order = Window.partitionBy(key).orderBy(at, row).rowsBetween(Window.unboundedPreceding, 0)
        carried = both.withColumn(found, F.last(version, ignorenulls=True).over(order))
    return carried.where(F.col(row) == 1).select(*[F.col(data)[c].alias(c) for c in rest], F.col(found)[valid_from].alias(valid_from), F.col(found)[value].alias(value))


def rain_value(how: str = "mid") -> Column:
    return {"min": F.col("min_mm"), "max": F.col("max_mm"), "mid": (F.col("min_mm") + F.col("max_mm")) / 2}[how]


def rain_join(df: DataFrame, rain: DataFrame, how: str = "mid") -> DataFrame:
    """Adds rain of the row's (district, hour): 0 if the hour has a bulletin that doesn't name the district, null without one."""
    amount, told = fresh(df, rain, names=("_rain", "_told"))
    values = rain.select("hour", "district", rain_value(how).alias(amount))
    hours = rain.select("hour").distinct().withColumn(told, F.lit(True))
    joined = df.join(values, ["hour", "district"], "left").join(hours, "hour", "left")
    return joined.withColumn("rain", F.coalesce(amount, F.when(F.col(told), F.lit(0.0)))).drop(amount, told)


def territory_rain(rain: DataFrame) -> DataFrame:
    return rain.groupBy("hour").agg(F.max("max_mm").alias("rain"))


def calendar_join(df: DataFrame, holidays: DataFrame, time: str = "time") -> DataFrame:
    """Adds date, holiday (its name or null) and day_type."""
    dated = df.withColumn("date", F.to_date(time))
    return dated.join(sized(holidays.select("date", F.col("name").alias("holiday"))), "date", "left").withColumn("day_type", day_type(F.col("date"), F.col("holiday").isNotNull()))


def lag_weeks(df: DataFrame, keys: list[str], value: str, date: str = "date", weeks: int = 1) -> DataFrame:
    """Adds the value of the same key ``weeks`` weeks before, or null."""
    before = df.select(*keys, F.date_add(date, 7 * weeks).alias(date), F.col(value).alias(f"{value}_before"))
    return df.join(before, [*keys, date], "left")


def nearest_district(points: DataFrame) -> DataFrame:
    """Per district the one whose centroid of (x, y) is nearest; of equals the first by name. One row a district is compared;
    the centroids are broadcast if their counted number allows."""
    centre = points.groupBy("district").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    a, b = centre.alias("a"), sized(centre).alias("b")
    apart = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2)
    pairs = a.join(b, F.col("a.district") != F.col("b.district")).select(F.col("a.district").alias("district"), F.col("b.district").alias("other"), apart.alias("apart"))
    return pairs.groupBy("district").agg(F.min_by("other", F.struct("apart", "other")).alias("nearest"))


def _square(c: str, size: float) -> Column:
    """The number of the square of the row's level that a coordinate is in; squares of a level lie whole in those of the next."""
    return F.floor(F.col(c) / (F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))))


def _finest_level(places: DataFrame, size: float, top: int, shared: int = 4, deepest: int = 40) -> int:
    """The first level below ``top`` at which a place has, on the average, ``shared`` places in its square, itself included."""
    for high in range(top, top - deepest, -8):
        placed = places.withColumn("level", F.explode(F.sequence(F.lit(high - 7), F.lit(high))))
        counts = placed.groupBy("level", _square("cx", size), _square("cy", size)).agg(F.count("*").cast("double").alias("n"))
        found = counts.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).where(F.col("mean") <= shared).collect()
        if found:
            return max(r.level for r in found)
    return top - deepest + 1


def nearest_cell(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Per point (id, x, y) the nearest of the cells (cell_id, cx, cy); of equals the smallest cell_id.

    Sides of squares are ``size`` times powers of two, from one square for all down to few cells each, however dense they are. A point
    meets one cell near each square around which there are any, which bounds how far its nearest one is; then all cells of the squares
    within that bound. Of cells at one place the smallest alone counts, points at one place are compared once. Points with a null
    coordinate (or NaN) have no cell, nor has any point if there are no cells. Points farther from all cells than these are from
    each other meet a large part of them.
    """
    real = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(real("x", "y"))
    places = kept(cells.select("cell_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).where(real("cx", "cy")).groupBy("cx", "cy").agg(F.min("cell_id").alias("cell_id")))
    both = points.select("x", "y").unionByName(places.select(F.col("cx").alias("x"), F.col("cy").alias("y")))
    extent = both.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    top = max(0, math.ceil(math.log2(max(extent, size) / size))) + 1
    finest = _finest_level(places, size, top)
    levels = F.explode(F.sequence(F.lit(finest), F.lit(top)))
    on = ["level", "i", "j"]
    apart = lambda x, y: F.pow(F.col("x") - F.col(x), 2) + F.pow(F.col("y") - F.col(y), 2)
    placed = places.withColumn("level", levels).withColumn("i", _square("cx", size)).withColumn("j", _square("cy", size))
    steps = lambda name: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias(name)
    one = placed.groupBy(*on).agg(F.min(F.struct("cx", "cy")).alias("c")).select("*", steps("di")).select("*", steps("dj"))
    known = one.groupBy("level", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(F.min_by("c", F.struct(F.abs("di") + F.abs("dj"), "c")).alias("c"))
    spots = points.select("x", "y").distinct()
    tried = spots.withColumn("level", levels).withColumn("i", _square("x", size)).withColumn("j", _square("y", size))
    bound = tried.join(sized(known), on).groupBy("x", "y").agg((F.sqrt(F.min(apart("c.cx", "c.cy"))) * (1 + 1e-9) + 1e-150).alias("d"))
    # the squares of a level whose sides are about as long as the bound
    level = F.least(F.lit(top), F.greatest(F.lit(finest), F.ceil(F.log2(F.col("d") / size)).cast("int")))
    asked = bound.withColumn("level", level)
    for c, number in (("x", "i"), ("y", "j")):
        asked = asked.withColumn("low", F.col(c) - F.col("d")).withColumn("high", F.col(c) + F.col("d")).withColumn(number, F.explode(F.sequence(_square("low", size), _square("high", size)))).drop("low", "high")
    met = asked.join(sized(placed), on)
    nearest = met.groupBy("x", "y").agg(F.min(F.struct(apart("cx", "cy").alias("apart"), "cell_id")).alias("found"))
    return points.join(nearest, ["x", "y"]).groupBy("id").agg(F.min("found").alias("found")).select("id", "found.cell_id")


def spine(df: DataFrame, keys: list[str], at: str, step: str) -> DataFrame:
    """All bins from the first to the last of each key, with the values of those that exist."""
    a, b = fresh(df, names=("_a", "_b"))
    ends = df.groupBy(*keys).agg(F.min(at).alias(a), F.max(at).alias(b))
    return ends.select(*keys, F.explode(F.sequence(a, b, F.expr(f"interval {step}"))).alias(at)).join(df, [*keys, at], "left")


def fill_linear(df: DataFrame, keys: list[str], at: str, value: str, step: str, max_gap: int = 2, piece: str = PIECE) -> DataFrame:
    """On the spine: gaps of up to ``max_gap`` bins are filled along the line between their neighbours; longer ones stay null.

    The known bins before and after are carried from piece to piece (see ``scans``). Steps are fixed lengths of time.
    """
    full = spine(df, keys, at, step)
    before, after = fresh(full, names=("_before", "_after"))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v")))
    full = with_neighbours(full, keys, at, [at], known, before, after, piece)
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    bins = lambda a, b: micros(a, b) / micros(F.col(at), F.col(at) + F.expr(f"interval {step}"))
    p, n = F.col(before), F.col(after)
    line = p["v"] + (n["v"] - p["v"]) * bins(p["t"], F.col(at)) / F.nullif(bins(p["t"], n["t"]), F.lit(0.0))
    return full.withColumn("filled", F.coalesce(F.col(value), F.when(bins(p["t"], n["t"]) - 1 <= max_gap, line))).drop(before, after)


def fill(df: DataFrame, keys: list[str], at: str, value: str, step: str, how: str = "ffill", season: Column | None = None, piece: str = PIECE) -> DataFrame:
    """On the spine: the last known value (ffill), known rows only (drop), or the mean of the key and season (seasonal).

    ``season`` is an expression over the spine's ``at``: the hour of day unless given; ``weekly_slot`` is the plan's slot.
    """
    if how == "seasonal" and _is_fixed(step):
        return _fill_seasonal(df, keys, at, value, step, F.hour(at) if season is None else season, piece)
    full = spine(df, keys, at, step)
    if how == "drop":
        return full.where(F.col(value).isNotNull()).withColumn("filled", F.col(value))
    if how == "ffill":
        return with_neighbours(full.drop("filled"), keys, at, [at], F.col(value), back="filled", piece=piece)
    if how != "seasonal":
        raise ValueError(f"no filling is called {how}")
    slot, mean = fresh(full, names=("_slot", "_mean"))
    seasons = full.withColumn(slot, F.hour(at) if season is None else season)
    means = seasons.groupBy(*keys, slot).agg(F.avg(value).alias(mean))
    return seasons.join(means, [*keys, slot], "left").withColumn("filled", F.coalesce(value, mean)).drop(slot, mean)


def _is_fixed(step: str) -> bool:
    """Whether a step always lasts equally long: hours and parts of them, not days, months or years of a calendar."""
    return all(word.rstrip("s") in ("hour", "minute", "second", "millisecond", "microsecond") for word in step.lower().split()[1::2])


def _fill_seasonal(df: DataFrame, keys: list[str], at: str, value: str, step: str, season: Column, piece: str) -> DataFrame:
    """``fill`` by seasons for bins of a fixed length. The bins of a gap are made from the known bin before it, which holds its key's means by
    number of the season, so that bins, which may be many more than ``df`` has rows, are never shuffled nor sorted."""
    key, first, following, slot, number, mean, means, made = fresh(df, names=("_key", "_first", "_following", "_slot", "_number", "_mean", "_means", "_made"))
    wide, step, season = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', TIMESTAMP_NTZ'1970-01-01' + interval {step})"), F.expr(f"interval {step}"), F.struct(season.alias("s"))
    rows = df.where(F.col(at).isNotNull()).withColumn(key, F.struct(*keys))
    firsts = rows.groupBy(key).agg(F.min(at).alias(first))
    rows = rows.join(firsts, key).where(F.timestamp_diff("MICROSECOND", F.col(first), F.col(at)) % wide == 0).drop(first)
    per_season = rows.where(F.col(value).isNotNull()).groupBy(key, season.alias(slot)).agg(F.avg(value).alias(mean))
    seasons = kept(per_season.select(slot).distinct().withColumn(number, F.monotonically_increasing_id()))
    of_key = per_season.join(sized(seasons), slot).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(number, mean))).alias(means))
    held = with_next(rows, keys, at, following, piece).join(of_key, key, "left")
    bins = F.when(F.col(following) > F.col(at) + step, F.sequence(F.col(at), F.col(following) - step, step)).otherwise(F.array(at))
    full = held.withColumn(made, F.explode(bins))
    others = [F.when(F.col(made) == F.col(at), F.col(c)).alias(c) for c in df.columns if c not in (*keys, at)]
    full = full.select(*keys, F.col(made).alias(at), *others, means).withColumn(slot, season)
    return full.join(sized(seasons), slot, "left").withColumn("filled", F.coalesce(value, F.col(means)[F.col(number)])).drop(slot, number, means)


def weekly_slot(at: str, minutes: int = 15) -> Column:
    """Weekday or weekend, and the bin of ``minutes`` within the day: the season of a reading."""
    return F.struct((F.weekday(at) >= 5).alias("weekend"), F.floor((F.hour(at) * 60 + F.minute(at)) / minutes).cast("int").alias("bin"))


def rain_slots(rain: DataFrame, how: str = "mid") -> DataFrame:
    """Hourly values as four quarter-hour slots; a period ends at HH:45, so they are HH-1:45 to HH:30."""
    shifts = F.explode(F.sequence(F.lit(-1), F.lit(2))).alias("shift")
    return rain.select("district", "hour", rain_value(how).alias("rain"), shifts).select("district", (F.col("hour") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("shift") * 15)).alias("slot"), "rain")


def align_rain(rain: DataFrame, how: str = "slots", value: str = "mid", max_gap: int = 3) -> DataFrame:
    """(district, slot, rain): hourly values on quarter hours. slots: the four slots of the period that ends at HH:45; ffill: from
    the hour on until the district's next value; linear: along the line between hours, gaps of over ``max_gap`` slots staying null.
    """
    if how == "slots":
        return rain_slots(rain, value)
    hourly = rain.select("district", F.col("hour").alias("slot"), rain_value(value).cast("double").alias("rain"))
    filled = {"ffill": lambda: fill(hourly, ["district"], "slot", "rain", "15 minutes"), "linear": lambda: fill_linear(hourly, ["district"], "slot", "rain", "15 minutes", max_gap)}[how]()
    return filled.select("district", "slot", F.col("filled").alias("rain"))


def coverage_daily(readings: DataFrame, expected: int = 2880, period: str = "time") -> DataFrame:
    """Per detector and day the distinct periods present and their share of those expected; days without a reading have no row."""
    present = readings.groupBy("detector_id", F.to_date("time").alias("date")).agg(F.count_distinct(period).alias("present"))
    return present.withColumn("share", F.col("present") / F.lit(expected))


def territory_join(readings: DataFrame, rain: DataFrame) -> DataFrame:
    """Each reading (with column hour) and the highest rain of any district in its hour; null in hours without a bulletin."""
    return readings.join(sized(territory_rain(rain).withColumnRenamed("rain", "territory_rain")), "hour", "left")


def segment_route(segments: DataFrame, routes: DataFrame, centreline: DataFrame) -> DataFrame:
    """Per route the segment readings, those on the centreline, and their share. routes: (segment_id, route); centreline: ids.

    Readings of segments without a route count under a null route.
    """
    known = centreline.select("segment_id").distinct().withColumn("known", F.lit(1))
    joined = segments.join(sized(routes), "segment_id", "left").join(sized(known), "segment_id", "left")
    counts = joined.groupBy("route").agg(F.count("*").alias("n"), F.count("known").alias("n_matched"))
    return counts.withColumn("match_rate", F.col("n_matched") / F.col("n"))


def grid_to_district(grid: DataFrame, dim: DataFrame, size: float) -> DataFrame:
    """Mean and largest rain per district and end time of nowcast cells (cell_id, cx, cy, ending, rain), each detector's district
    taking the cell nearest to it (see ``nearest_cell``), a cell once per district."""
    near = nearest_cell(dim.select(F.col("detector_id").alias("id"), "x", "y"), grid.select("cell_id", "cx", "cy").distinct(), size)
    owned = dim.join(near, dim["detector_id"] == near["id"]).select("district", "cell_id").distinct()
    return grid.join(owned, "cell_id").groupBy("district", "ending").agg(F.avg("rain").alias("mean_rain"), F.max("rain").alias("max_rain"))


def rain_lags(rain: DataFrame, lags: tuple = (1, 2), how: str = "mid") -> DataFrame:
    """Each hour's value with those of the hours before, by time and not by row: an absent hour gives null."""
    base = rain.select("district", "hour", rain_value(how).alias("rain"))
    out = base
    for k in lags:
        out = out.join(base.select("district", (F.col("hour") + F.expr(f"interval {k} hours")).alias("hour"), F.col("rain").alias(f"rain_{k}")), ["district", "hour"], "left")
    return out


def exclude_days(df: DataFrame, holidays: DataFrame, cyclones: DataFrame, mode: str = "drop", time: str = "time") -> DataFrame:
    """Without readings on holidays or under a strong cyclone signal; mode keep returns all, feature flags them."""
    from stormlane.operators.intervals import interval_join

    if mode == "keep":
        return df
    (date,) = fresh(df, names=("_date",))
    dated = df.withColumn(date, F.to_date(time))
    days = sized(holidays.select(F.col("date").alias(date)).distinct())
    if mode == "drop":
        return interval_join(dated.join(days, date, "left_anti").drop(date), cyclones.select("start", "end"), time, "left_anti")
    flagged = dated.join(days.withColumn("on_holiday", F.lit(True)), date, "left").drop(date).withColumn("on_holiday", F.coalesce("on_holiday", F.lit(False)))
    under = interval_join(flagged, cyclones.select("start", "end"), time, "left_semi").withColumn("under_cyclone", F.lit(True))
    return under.unionByName(interval_join(flagged, cyclones.select("start", "end"), time, "left_anti").withColumn("under_cyclone", F.lit(False)))
