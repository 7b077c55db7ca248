"""Ordered scans over histories that are cut into pieces of time.

A key's rows are ordered within a piece only (a day, unless told otherwise; a piece should hold a good many of a key's rows, as each
has a summary), never over its whole history. What a scan must know of the rows before a piece, or behind it, is a summary of one row
per piece, formed from the columns needed alone. Summaries are carried on in a window over a key's pieces and joined to the pieces' rows,
which are shuffled by key and piece once (for runs the columns needed are shuffled once more, as their summaries need order). So a key that holds nearly all rows is as many tasks as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PIECE = "day"


def fresh(*frames: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The names with as many underscores in front as keep them apart from the columns of the frames."""
    taken, out = {c.lower() for f in frames for c in f.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _placed(df: DataFrame, keys: list[str], at: str, piece: str, place: str) -> DataFrame:
    """``df`` with the struct of its keys and piece. It is never null, and null keys in it are equal to each other, also in joins."""
    return df.withColumn(place, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.date_trunc(piece, F.col(at)).alias("piece")))


def _of_key(keys: list[str], place: str) -> tuple[WindowSpec, WindowSpec]:
    """The pieces of a key onwards, and backwards: what lies ahead is read in the order that makes it the past."""
    key, cut = [F.col(place)[f"k{i}"] for i in range(len(keys))], F.col(place)["piece"]
    return Window.partitionBy(*key).orderBy(cut.asc_nulls_first()), Window.partitionBy(*key).orderBy(cut.desc_nulls_last())


_PAST, _SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def with_neighbours(df: DataFrame, keys: list[str], at: str, order: list[str], known: Column, back: str | None = None, ahead: str | None = None, piece: str = PIECE) -> DataFrame:
    """``df`` with ``back``, the last value of ``known`` that isn't null at or before the row in its key's order, and ``ahead``, the first
    at or after it. ``at`` is the time that cuts pieces and ``order``, which must begin with it, the full order.

    Null keys are a key of their own, null times come first; rows are neither lost nor repeated. Rows that are equal in all of
    ``order`` have no order among themselves.
    """
    place, value, end, carried = fresh(df, names=("_place", "_value", "_end", "_carried"))
    rows = _placed(df, keys, at, piece, place).withColumn(value, known)
    has = F.when(F.col(value).isNotNull(), F.struct(*order))
    onwards, backwards = _of_key(keys, place)
    reverse = [F.col(c).desc_nulls_last() for c in order]
    for name, extreme, pieces, by in ((back, F.max_by, onwards, order), (ahead, F.min_by, backwards, reverse)):
        if name:
            sums = _placed(df, keys, at, piece, place).withColumn(value, known).groupBy(place).agg(extreme(value, has).alias(end))
            facts = sums.select(place, F.last(end, ignorenulls=True).over(pieces.rowsBetween(*_PAST)).alias(carried))
            own = F.last(value, ignorenulls=True).over(Window.partitionBy(place).orderBy(*by).rowsBetween(*_SO_FAR))
            rows = rows.withColumn(name, own).join(facts, place).withColumn(name, F.coalesce(name, carried)).drop(carried)
    return rows.select(*df.columns, *[c for c in (back, ahead) if c])


def with_next(df: DataFrame, keys: list[str], at: str, name: str, piece: str = PIECE) -> DataFrame:
    """``df`` with the time of the row that follows in its key's order of ``at``, or null; of rows at one time all but one are followed
    by that time. Null keys are a key of their own."""
    place, own, head, carried = fresh(df, names=("_place", "_own", "_head", "_carried"))
    rows = _placed(df, keys, at, piece, place)
    facts = rows.groupBy(place).agg(F.min(at).alias(head)).select(place, F.lead(head).over(_of_key(keys, place)[0]).alias(carried))
    rows = rows.withColumn(own, F.lead(at).over(Window.partitionBy(place).orderBy(at))).join(facts, place)
    return rows.select(*df.columns, F.coalesce(own, carried).alias(name))


def with_runs(df: DataFrame, keys: list[str], at: str, order: list[str], value: str, name: str, piece: str = PIECE, span: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the number, from 1, of the run of equal values of its key that the row is in; nulls are equal to each other.

    ``span`` names two more columns, the run's first and last time (null in rows without a time). Only the first and the last run of
    a piece can go on in others: a piece is told their numbers and ends, and the runs between are its own.
    """
    names = ("_place", "_held", "_came", "_changed", "_local", "_first", "_last", "_more", "_low", "_high", "_begun", "_ended", "_opens", "_closes", "_base", "_start", "_end")
    place, held, came, changed, local, first, last, more, low, high, begun, ended, opens, closes, base, start, end = fresh(df, names=names)
    differs = lambda a, b: (~a.eqNullSafe(b)).cast("long")
    inside = Window.partitionBy(place).orderBy(*order)
    rows = _placed(df, keys, at, piece, place).withColumn(held, F.struct(F.col(value).alias("v"), F.col(at).alias("t")))
    rows = rows.withColumn(came, F.lag(held).over(inside))
    rows = rows.withColumn(changed, F.when(F.col(came).isNotNull(), differs(F.col(held)["v"], F.col(came)["v"])).otherwise(F.lit(0)))

    is_new, by = F.col(changed) == 1, F.struct(*order)
    sums = rows.groupBy(place).agg(
        F.min_by(held, by).alias(first),
        F.max_by(held, by).alias(last),
        F.sum(changed).alias(more),
        F.min(at).alias(low),
        F.max(at).alias(high),
        F.max(F.when(is_new, F.col(at))).alias(begun),
        F.min(F.when(is_new, F.col(came)["t"])).alias(ended),
    )
    onwards, backwards = _of_key(keys, place)
    before, behind = F.lag(last).over(onwards), F.lag(first).over(backwards)
    facts = sums.withColumn(opens, F.when(before.isNull(), F.lit(1)).otherwise(differs(before["v"], F.col(first)["v"])))
    facts = facts.withColumn(closes, F.when(behind.isNull(), F.lit(1)).otherwise(differs(behind["v"], F.col(last)["v"])))
    # Where the piece's last run begins and its first one ends, unless a run goes through the whole piece and on.
    begins = F.coalesce(begun, F.when(F.col(opens) == 1, F.col(low)))
    ends = F.coalesce(ended, F.when(F.col(closes) == 1, F.col(high)))
    facts = facts.select(
        place,
        more,
        (F.sum(F.col(opens) + F.col(more)).over(onwards.rowsBetween(*_SO_FAR)) - F.col(more)).alias(base),
        F.coalesce(F.when(F.col(opens) == 0, F.last(begins, ignorenulls=True).over(onwards.rowsBetween(*_PAST))), F.col(low)).alias(start),
        F.coalesce(F.when(F.col(closes) == 0, F.last(ends, ignorenulls=True).over(backwards.rowsBetween(*_PAST))), F.col(high)).alias(end),
    )
    rows = rows.withColumn(local, F.sum(changed).over(inside.rowsBetween(*_SO_FAR)))
    of_run = Window.partitionBy(place, local)
    if span:
        rows = rows.withColumn(low, F.min(at).over(of_run)).withColumn(high, F.max(at).over(of_run))
    out = rows.join(facts, place).withColumn(name, F.col(base) + F.col(local))
    if span:
        out = out.withColumn(span[0], F.when(F.col(local) == 0, F.col(start)).otherwise(F.col(low))).withColumn(span[1], F.when(F.col(local) == F.col(more), F.col(end)).otherwise(F.col(high)))
    return out.select(*df.columns, name, *(span or ()))
