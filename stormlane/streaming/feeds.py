"""The batch rules on live feeds. Event time is zoned (watermarks need it); times are UTC wall time.

Each function takes a streaming DataFrame and returns one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stormlane.functions.scalar import member_stamp
from stormlane.sources import bundles, parse


def stream_readings(readings: DataFrame, late: str = "15 minutes") -> DataFrame:
    """Snapshots' readings without those that an overlapping snapshot repeated within ``late``."""
    return readings.withWatermark("time", late).dropDuplicatesWithinWatermark(["time", "detector_id", "lane_id"])


def stream_bins(readings: DataFrame, width: str = "15 minutes", late: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling bins per detector, or sliding ones; a bin is emitted once, when the watermark has passed it."""
    window = F.window("time", width, slide) if slide else F.window("time", width)
    marked = readings.withWatermark("time", late)
    binned = marked.groupBy("detector_id", window.alias("w")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.avg("speed").alias("speed"))
    return binned.select("detector_id", F.col("w.start").alias("bin"), "n", "volume", "speed")


def stream_sliding(readings: DataFrame, width: str = "60 minutes", slide: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    return stream_bins(readings, width, late, slide)


def stream_sessions(signals: DataFrame, keys: list[str], late: str = "6 hours") -> DataFrame:
    """Episodes of touching signals (start, end, level) per key; signals of no length are left out."""
    some = signals.where("end > start").withColumn("seconds", F.concat((F.unix_micros("end") - F.unix_micros("start")).cast("string"), F.lit(" microseconds")))
    window = F.session_window("start", F.col("seconds"))
    merged = some.withWatermark("start", late).groupBy(*keys, window.alias("w")).agg(F.max("level").alias("max_level"), F.count("*").alias("n_signals"))
    return merged.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "max_level", "n_signals")


def stream_episodes(signals: DataFrame, keys: list[str], max_gap: str = "0 minutes", late: str = "6 hours") -> DataFrame:
    """Episodes per key of signals (start, end, level) that touch, overlap or follow within ``max_gap``; signals of no length count.

    A key's open episodes are its state: few, as an episode leaves once the watermark (the latest start less ``late``) has passed its
    end by more than the gap, when no signal in time can reach it any more. An event-time timer lets it leave without new signals of
    its key. Signals with a null key, start or end are left out.
    """
    gap = pd.Timedelta(max_gap)
    kinds = dict(signals.dtypes)
    out = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, start timestamp, end timestamp, max_level int, n_signals bigint"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(e) for e in zip(*state.get)] if state.exists else []
        micros = lambda column: column.astype("datetime64[us]").astype("int64").tolist()
        for frame in frames:
            held += [[a, b, level, 1] for a, b, level in zip(micros(frame["start"]), micros(frame["end"]), frame["level"].tolist())]
        held.sort()
        merged: list[list] = []
        for a, b, level, n in held:
            if merged and a <= merged[-1][1] + gap // pd.Timedelta(microseconds=1):
                last = merged[-1]
                last[1:] = [max(last[1], b), max(last[2], level), last[3] + n]
            else:
                merged.append([a, b, level, n])
        width = gap // pd.Timedelta(microseconds=1)
        passed = state.getCurrentWatermarkMs() * 1000
        done = [e for e in merged if e[1] + width < passed]
        still = [e for e in merged if e[1] + width >= passed]
        if still:
            state.update(tuple(list(c) for c in zip(*still)))
            state.setTimeoutTimestamp(max(min(e[1] for e in still) + width, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        if done:
            columns = {k: [v] * len(done) for k, v in zip(keys, key)}
            times = lambda k: pd.to_datetime([e[k] for e in done], unit="us")
            yield pd.DataFrame(columns | {"start": times(0), "end": times(1), "max_level": [e[2] for e in done], "n_signals": [e[3] for e in done]})

    some = signals.dropna(subset=[*keys, "start", "end"]).withColumn("level", F.coalesce(F.col("level").cast("int"), F.lit(0))).select(*keys, "start", "end", "level")
    state = "start array<bigint>, end array<bigint>, level array<int>, n array<bigint>"
    return some.withWatermark("start", late).groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def stream_archive(spark: SparkSession, path: str, suffix: str = "rawSpeedVol.xml") -> DataFrame:
    """Lane readings of the detector documents in the bundles at a path, as they come, with the archive time of their member; of cut
    documents what is whole."""
    members = bundles.stream_bundles(spark, path, suffix)
    files = members.select(member_stamp(F.col("name")).cast("timestamp").alias("archived"), F.decode("content", "UTF-8").alias("content"))
    return parse.read_archive(files)


def stream_rain(bulletins: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly district maxima; bulletins later than ``late`` are dropped and counted in the query's progress."""
    marked = bulletins.withWatermark("issued", late)
    hourly = marked.groupBy("district", F.window("issued", "60 minutes").alias("w")).agg(F.max("max_mm").alias("max_mm"))
    return hourly.select("district", F.col("w.start").alias("hour"), "max_mm")


def stream_enrich(readings: DataFrame, dim: DataFrame) -> DataFrame:
    """Readings with the columns of a static dimension."""
    return readings.join(dim, "detector_id")


def stream_rain_join(readings: DataFrame, bulletins: DataFrame, late: str = "15 minutes", rain_late: str = "2 hours", reach: str = "60 minutes") -> DataFrame:
    """Readings of a district with the bulletins issued within ``reach`` after them; state ends with both watermarks."""
    a = readings.withWatermark("time", late).withColumnRenamed("district", "of_district")
    b = bulletins.withWatermark("issued", rain_late)
    return a.join(b, F.expr(f"of_district = district and issued >= time and issued <= time + interval {reach}")).drop("of_district")
