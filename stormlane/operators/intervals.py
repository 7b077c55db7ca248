"""Merging, joining and encoding of time intervals, and runs of consecutive days or readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.operators.scans import PIECE, fresh
from stormlane.sources.tables import kept


#: Ranges of start times that un-keyed intervals are merged in; one summary of each goes to the driver.
RANGES = 32
_EPOCH = "TIMESTAMP_NTZ'1970-01-01'"


def _micros(time: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {time})")


def _numbered(df: DataFrame, by: list[str], carried: str, max_gap: str, name: str) -> DataFrame:
    """``df`` with the number of islands that have opened within ``by`` up to the row: 0 where it goes on what was carried there.

    An interval opens an island if it starts later than ``max_gap`` after all before it have ended; ``carried`` is the latest end
    before the first of ``by``, or null.
    """
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col(carried))
    opens = F.when(before.isNull() | (F.col("start") > before + F.expr(f"interval {max_gap}")), 1).otherwise(0)
    return df.withColumn(name, opens).withColumn(name, F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _as_time(micros: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))


def _merged_whole(df: DataFrame, max_gap: str, first: list[Column], again: list[Column], ranges: int) -> DataFrame:
    """Islands of all rows, by ranges of start times between quantiles.

    Each range hands over its latest end, the driver carries the maximum on over at most ``ranges`` of them, and ranges are merged on
    their own. What they found is written once; the numbers of islands per range, added up the same way, number all islands from 1.
    """
    part, carried, local, island = fresh(df, names=("_part", "_carried", "_local", "_island"))
    some = df.where("start is not null").withColumn(part, _micros("start"))
    found = some.agg(F.percentile_approx(part, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(found))]).cast("array<bigint>")
    some = some.withColumn(part, F.size(F.filter(bounds, lambda b: b <= F.col(part))))
    tops, latest, before = {r[0]: r[1] for r in some.groupBy(part).agg(F.max(_micros("end"))).collect()}, None, {}
    for k in sorted(tops):
        before[k] = latest
        latest = tops[k] if latest is None else max(latest, tops[k] if tops[k] is not None else latest)
    ends = F.array(*[F.lit(before.get(k)) for k in range(len(set(found)) + 1)]).cast("array<bigint>")
    held = _numbered(some.withColumn(carried, _as_time(F.get(ends, F.col(part)))), [part], carried, max_gap, local)
    merged = kept(held.groupBy(part, local).agg(F.min("start").alias("start"), F.max("end").alias("end"), *first))
    opened = {r[0]: r[1] for r in merged.groupBy(part).agg(F.max(local)).collect()}
    sums = [sum(opened.get(j, 0) for j in range(k)) for k in range(len(set(found)) + 1)]
    whole = merged.withColumn(island, (F.get(F.array(*map(F.lit, sums)), F.col(part)) + F.col(local)).cast("int"))
    return whole.groupBy(F.col(island).alias("episode_id")).agg(F.min("start").alias("start"), F.max("end").alias("end"), *again)


def _merged_by_key(df: DataFrame, keys: list[str], max_gap: str, first: list[Column], again: list[Column], piece: str) -> DataFrame:
    """The same per key, by days of the start instead of ranges; what is carried on stays in a window over a key's days."""
    cut, carried, local, base, top = fresh(df, names=("_piece", "_carried", "_local", "_base", "_top"))
    rows = df.where("start is not null").withColumn(cut, F.date_trunc(piece, "start"))
    of_key = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*keys, cut)]
    tops = rows.groupBy(*keys, cut).agg(F.max("end").alias(top)).withColumn(carried, F.max(top).over(of_key)).drop(top)
    met = rows.alias("r").join(tops.alias("s"), same("r", "s")).select("r.*", carried)
    held = _numbered(met, [*keys, cut], carried, max_gap, local)
    merged = held.groupBy(*keys, cut, local).agg(F.min("start").alias("start"), F.max("end").alias("end"), *first)
    counts = merged.groupBy(*keys, cut).agg(F.max(local).alias(top)).withColumn(base, F.coalesce(F.sum(top).over(of_key), F.lit(0))).drop(top)
    whole = merged.alias("r").join(counts.alias("s"), same("r", "s")).select("r.*", (F.col(base) + F.col(local)).cast("int").alias("episode_id"))
    return whole.groupBy(*keys, "episode_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), *again)


def merge_intervals(df: DataFrame, keys: list[str] | None = None, max_gap: str = "0 minutes", ranges: int = RANGES, piece: str = PIECE) -> DataFrame:
    """Episodes of intervals (start, end, level, provisional) that touch, overlap or follow within ``max_gap``, per key.

    Adds max_level, n_signals, provisional and episode_id, 1 to n by start within the key. No key's history, nor that of all
    intervals where there are no keys, is ordered as a whole: ranges of starts, or a key's days, are merged on their own, each from
    the latest end before it. Without keys ``df`` is read more than once. Intervals with a null start are left out; a null end
    ends nothing. Repeats count each.
    """
    first = [F.max("level").alias("max_level"), F.count("*").alias("n_signals"), F.bool_or("provisional").alias("provisional")]
    again = [F.max("max_level").alias("max_level"), F.sum("n_signals").alias("n_signals"), F.bool_or("provisional").alias("provisional")]
    merged = _merged_by_key(df, keys, max_gap, first, again, piece) if keys else _merged_whole(df, max_gap, first, again, ranges)
    return merged.withColumn("n_signals", F.col("n_signals").cast("long"))


def merge_sessions(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same by session windows, to the microsecond, as streams do it; intervals of no length, and those with a null start or
    end, are left out."""
    some = df.where("end > start").withColumn("time", F.col("start").cast("timestamp")).withColumn("lasts", F.expr("timestampdiff(MICROSECOND, start, end)"))
    window = F.session_window("time", F.concat(F.col("lasts").cast("string"), F.lit(" microseconds")))
    merged = some.groupBy(*keys, window.alias("w")).agg(F.max("level").alias("max_level"), F.count("*").alias("n_signals"))
    return merged.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "max_level", "n_signals")


def _by_hour(intervals: DataFrame, hour: str) -> DataFrame:
    """A row for each hour that an interval touches."""
    last = F.date_trunc("hour", F.col("end") - F.expr("interval 1 microsecond"))
    return intervals.where("end > start").withColumn(hour, F.explode(F.sequence(F.date_trunc("hour", "start"), last, F.expr("interval 1 hour"))))


def interval_join(points: DataFrame, intervals: DataFrame, time: str = "time", how: str = "inner", keys: dict[str, str] | None = None) -> DataFrame:
    """Points with the intervals [start, end) that hold them, through hour buckets, so that the join is on equal keys.

    A long interval has a row per hour it touches. ``keys`` names columns of the points and the intervals' columns they must
    equal, so that only intervals of the point's own key meet it. how: inner, left, left_semi or left_anti. A null time or key
    is held by nothing, nor is an interval with a null end or of no length.
    """
    at, hour = fresh(points, intervals, names=("_at", "_hour"))
    held = (F.col(at) == F.col(hour)) & (F.col(time) >= F.col("start")) & (F.col(time) < F.col("end"))
    for own, theirs in (keys or {}).items():
        held &= F.col(own) == F.col(theirs)
    return points.withColumn(at, F.date_trunc("hour", time)).join(_by_hour(intervals, hour), held, how).drop(at, hour)


def segments(signals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Time cut where any signal (start, end, level) of the same ``keys`` starts or ends, by hour: (keys, hour, from, until, level,
    since) with the highest level in force and the latest start at that level. No two segments of a key overlap, so a point lies in
    one at most. Signals with a null key are in none."""
    hours = _by_hour(signals.select(*keys, "start", "end", "level").dropna(subset=list(keys)) if keys else signals.select("start", "end", "level"), "hour")
    within = hours.select(*keys, "hour", "level", F.col("start").alias("since"), F.greatest(F.col("start"), F.col("hour").cast("timestamp_ntz")).alias("a"), F.least(F.col("end"), (F.col("hour") + F.expr("interval 1 hour")).cast("timestamp_ntz")).alias("b"))
    by = [*keys, "hour"]
    edges = within.select(*by, F.explode(F.array("a", "b")).alias("from")).distinct()
    cut = edges.withColumn("until", F.lead("from").over(Window.partitionBy(*by).orderBy("from"))).where("until is not null")
    held = cut.join(within, by).where("a <= `from` and b >= until")
    best = held.groupBy(*by, "from", "until").agg(F.max(F.struct("level", "since")).alias("best"))
    return best.select(*by, "from", "until", "best.level", "best.since")


def collapse_runs(df: DataFrame, keys: list[str], item: str, unit: str) -> DataFrame:
    """Runs of consecutive months or days as 'a..b' (or 'a'): one row per key with all its ranges, in order.

    ``item`` is a date; months count by their first day. Each key's distinct items are numbered in a window of the key.
    """
    day = F.trunc(item, "MM") if unit == "month" else F.col(item)
    form = "yyyy-MM" if unit == "month" else "yyyy-MM-dd"
    number = F.months_between(day, F.lit("1970-01-01").cast("date")).cast("int") if unit == "month" else F.unix_date(day)
    some = df.select(*keys, day.alias("day"), number.alias("number")).distinct()
    order = Window.partitionBy(*keys).orderBy("number")
    runs = some.withColumn("run", F.col("number") - F.row_number().over(order)).groupBy(*keys, "run").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.date_format("a", form)).otherwise(F.concat_ws("..", F.date_format("a", form), F.date_format("b", form)))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("text")))).alias("runs")).select(*keys, F.array_join(F.col("runs.text"), ", ").alias("ranges"))


def encode_warning(points: DataFrame, signals: DataFrame, keys: dict[str, str] | None = None, time: str = "time", how: str = "all") -> DataFrame:
    """Per point the highest level in force (0: none), since when that signal stands in minutes, and its one-hot columns.

    ``keys`` names columns of the points and the signals' columns they must equal, so that a point is only under its own district's
    (or detector's) signals; without keys all signals hold everywhere. Points meet the segments of their key and hour, of which one
    at most holds them: a row a point, repeats included, whatever number of signals overlap. A null time or key has level 0.
    how: ordinal adds level and minutes_since, onehot is_amber, is_red and is_black, binary warned, all every one of them.
    """
    keys = keys or {}
    named = {own: fresh(points, names=(f"_key_{n}",))[0] for n, own in enumerate(keys)}
    at, hour, start, until, since = fresh(points, names=("_at", "_hour", "_from", "_until", "_since"))
    cut = segments(signals, tuple(keys.values())).select(*[F.col(keys[own]).alias(name) for own, name in named.items()], F.col("hour").alias(hour), F.col("from").alias(start), F.col("until").alias(until), "level", F.col("since").alias(since))
    inside = (F.col(at) == F.col(hour)) & (F.col(time) >= F.col(start)) & (F.col(time) < F.col(until))
    for own, name in named.items():
        inside &= F.col(own) == F.col(name)
    joined = points.withColumn(at, F.date_trunc("hour", time)).join(cut, inside, "left")
    out = joined.withColumn("minutes_since", F.timestamp_diff("MINUTE", F.col(since), F.col(time))).withColumn("level", F.coalesce("level", F.lit(0))).drop(at, hour, start, until, since, *named.values())
    for k, name in ((1, "amber"), (2, "red"), (3, "black")):
        out = out.withColumn(f"is_{name}", (F.col("level") == k).cast("int"))
    out = out.withColumn("warned", (F.col("level") > 0).cast("int"))
    added = {"ordinal": ["level", "minutes_since"], "onehot": ["is_amber", "is_red", "is_black"], "binary": ["warned"]}
    return out if how == "all" else out.select(*points.columns, *added[how])


def news_intervals(news: DataFrame) -> DataFrame:
    """From repeated messages (id, status, time): the latest status and the active interval, open-ended until CLOSED."""
    return news.groupBy("id").agg(
        F.max_by("status", F.struct("time", "status")).alias("status"),
        F.min("time").alias("start"),
        F.min(F.when(F.col("status") == "CLOSED", F.col("time"))).alias("end"),
        F.count("*").alias("n_messages"),
    )


def exclude_incidents(df: DataFrame, news: DataFrame, keys: dict[str, str], time: str = "time", open_for: str = "1 day") -> DataFrame:
    """``df`` without the rows that lie within an incident (start, end) of their key; one without an end holds for ``open_for``.

    ``keys`` names columns of ``df`` and the incidents' columns they must equal. Rows with a null time or key stay.
    """
    active = news.select(*keys.values(), "start", F.coalesce("end", F.col("start") + F.expr(f"interval {open_for}")).alias("end"))
    return interval_join(df, active, time, "left_anti", keys)
