"""Day selection over every signal and every cyclone."""

from pyspark.sql import functions as F

import __spark_entry__
from stormlane.operators import days, intervals
from stormlane.plans.views import Views

SF = "/root/testdata/sf0.001"


def test_every_signal_and_cyclone_counts(spark):
    found = {n: __spark_entry__.queries()[n](spark, SF) for n in ("event_days_all", "excluded_days_all", "select_days_all", "select_days_black", "role_counts_all")}
    v = Views(spark, SF)
    touched = {str(r.date) for r in days.touched_days(v.signals, 3).select("date").distinct().collect()}
    rows = {r.date: r for r in found["event_days_all"].collect()}
    assert set(rows) == touched
    assert {int(i) for r in rows.values() for i in r.episode_ids.split()} == set(range(1, intervals.merge_intervals(v.signals).count() + 1))
    plain = {str(r.date) for df in (v.signals, v.cyclones) for r in days.touched_days(df).select("date").distinct().collect()}
    assert {r.date for r in found["excluded_days_all"].collect()} == plain
    chosen = found["select_days_all"].collect()
    assert {r.date for r in chosen if r.role == "event"} == touched
    controls = {r.date for r in chosen if r.role == "control"}
    assert controls and not controls & (touched | plain)
    black = found["select_days_black"].where("role = 'event'").agg(F.min("max_level")).first()[0]
    assert black == 3
    assert tuple(found["role_counts_all"].first()) == (len(touched), len(controls))
