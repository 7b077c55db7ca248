"""Baselines, sensitivity rankings, models and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.operators.intervals import interval_join
from stormlane.operators.quantiles import daily_sketches, middle, sketched_quantiles  # noqa: F401
from stormlane.operators.scans import fresh
from stormlane.sources.tables import kept


def dry_baseline(df: DataFrame, keys: list[str], value: str = "speed", exact: bool = True) -> DataFrame:
    """The median of the value per key; ``exact=False`` takes that of a sketch of bounded size (see ``quantiles``)."""
    return df.groupBy(*keys).agg(middle(value, exact).alias("baseline"))


def normalise(df: DataFrame, key: str = "detector_id", value: str = "speed", how: str = "zscore") -> DataFrame:
    """zscore adds z: the value against its key's own history, null where that never varies. The history is a grouped aggregate.

    ratio adds ratio, the value over its key's median (null where that is 0); prev_week adds ratio, the value over that of the
    same key a week before, by column bin; raw adds nothing.
    """
    if how == "raw":
        return df
    if how == "ratio":
        return df.join(dry_baseline(df, [key], value), key).withColumn("ratio", F.col(value) / F.nullif(F.col("baseline"), F.lit(0.0))).drop("baseline")
    if how == "prev_week":
        (week,) = fresh(df, names=("_before",))
        before = df.select(key, (F.col("bin") + F.expr("interval 7 days")).alias("bin"), F.col(value).alias(week))
        return df.join(before, [key, "bin"], "left").withColumn("ratio", F.col(value) / F.nullif(F.col(week), F.lit(0.0))).drop(week)
    if how != "zscore":
        raise ValueError(f"no normalisation is called {how}")
    mean, sd = fresh(df, names=("_mean", "_sd"))
    own = df.groupBy(key).agg(F.avg(value).alias(mean), F.stddev(value).alias(sd))
    return df.join(own, key).withColumn("z", (F.col(value) - F.col(mean)) / F.nullif(F.col(sd), F.lit(0.0))).drop(mean, sd)


def sensitivity(df: DataFrame, baseline: DataFrame, keys: list[str], value: str = "speed", by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Per key and warning level: rows, and the median of the value over its key's baseline, less 1. Level 0 is left out.

    ``by`` names other columns to group by (a road or district) once each row stands against the baseline of its own key. A
    baseline of 0 gives no ratio: the row counts in n, not in the median. ``exact=False`` takes medians from sketches.
    """
    ratio = df.join(baseline, keys).where("level > 0").withColumn("ratio", F.col(value) / F.nullif(F.col("baseline"), F.lit(0.0)))
    return ratio.groupBy(*(by or keys), "level").agg(F.count("*").alias("n"), (middle("ratio", exact) - 1).alias("sensitivity"))


def sensitivity_by_level(df: DataFrame, keys: list[str], value: str = "speed", exact: bool = True) -> DataFrame:
    """``sensitivity`` against the rows of level 0 of ``df`` itself, in one pass.

    The median of a ratio to a baseline is the median divided by it, as long as rows are grouped by the baseline's own key: so one
    grouped aggregate gives the medians of all levels, level 0 among them, and the baseline goes from there to the others in a window
    over a key's few levels. Rows don't meet baselines, and ``df`` is read once. Keys without rows of level 0, and null keys or
    levels, are left out.
    """
    dry, base = fresh(df, names=("_dry", "_base"))
    medians = df.dropna(subset=[*keys, "level"]).where("level >= 0").groupBy(*keys, "level").agg(F.count("*").alias("n"), middle(value, exact).alias("sensitivity"))
    of_key, is_dry = Window.partitionBy(*keys), F.col("level") == 0
    held = medians.withColumn(dry, F.bool_or(is_dry).over(of_key)).withColumn(base, F.max(F.when(is_dry, F.col("sensitivity"))).over(of_key))
    ratio = F.col("sensitivity") / F.nullif(F.col(base), F.lit(0.0)) - 1
    return held.where(F.col(dry) & (F.col("level") > 0)).select(*keys, "level", "n", ratio.alias("sensitivity"))


def overall(sensitive: DataFrame) -> DataFrame:
    """One figure per detector: the mean over its levels."""
    return sensitive.groupBy("detector_id").agg(F.avg("sensitivity").alias("sensitivity"))


def top(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most sensitive detectors (largest drop), ties by id."""
    return df.where("sensitivity is not null").orderBy("sensitivity", "detector_id").limit(k)


def top_per(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    order = Window.partitionBy(key).orderBy("sensitivity", "detector_id")
    return df.where("sensitivity is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def ranks(df: DataFrame, value: str, name: str, by: tuple = (), ties: str = "mean", buckets: int = 200) -> DataFrame:
    """``df`` with the rank of a numeric value from 1 as ``name``, within ``by``; ties take their mean rank, or the least (ties="min").

    Nothing is ordered as a whole: values fall between boundaries near their quantiles (at most ``buckets``, the only thing the
    driver sees), are ordered within each of these ranges, and the ranges' sizes are added up. Equal values are counted first
    and share a range. Null values have no rank and are left out. ``df`` is read more than once: see ``kept``.
    """
    some, part = df.where(F.col(value).isNotNull()), "_part"
    found = some.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(found))]) if found else F.array().cast("array<double>")
    counts = some.groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn(part, F.size(F.filter(bounds, lambda b: b <= F.col(value))))
    sizes = counts.groupBy(*by, part).agg(F.sum("_n").alias("_size"))
    lower = sizes.withColumn("_lower", F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = (F.col("_n") + 1) / 2 if ties == "mean" else F.lit(1)
    placed = counts.withColumn("_within", within).join(lower.drop("_size"), [*by, part]).select(*by, value, (F.col("_lower") + F.col("_within") + shift).alias(name))
    return some.join(placed, [*by, value])


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties by their mean, one row per detector."""
    return ranks(df, value, name).select("detector_id", name)


def _both_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, detector_id, rx, ry): mean ranks within ``by`` of x and of y, in one pass over both; pairs with a null have none.

    A detector comes once within ``by``.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in ("x", "y")])).alias("s")
    long = kept(pairs.where("x is not null and y is not null").select(*by, "detector_id", sides).select(*by, "detector_id", "s.*"))
    placed = ranks(long, "value", "rank", (*by, "side"))
    return placed.groupBy(*by, "detector_id").agg(*[F.max(F.when(F.col("side") == c, F.col("rank"))).alias(f"r{c}") for c in ("x", "y")])


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank correlation of two rankings over the detectors that both have."""
    both = a.select("detector_id", F.col("sensitivity").alias("x")).join(b.select("detector_id", F.col("sensitivity").alias("y")), "detector_id")
    return _both_ranks(both, []).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def overlap(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    return top(a, k).select("detector_id").intersect(top(b, k).select("detector_id")).agg(F.count("*").alias("n_common"))


def within_regression(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Slope of y on x within groups: sums of products of what remains after the group's means, from grouped sums alone."""
    some = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = some.groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    sxy, sxx = F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")), F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    return sums.agg(F.sum("n").alias("n"), (sxy / F.nullif(sxx, F.lit(0.0))).alias("slope"))


def ablate(rows: DataFrame, variants: dict[str, Column], default: str, k: int = 20) -> DataFrame:
    """What each variant of a cleaning step does to the ranking: (variant, n, spearman, n_common) against ``default``.

    rows: detector_id, level, speed, and whatever the variants look at; a variant is the condition under which a row counts.
    All variants go through one pass over the rows, each row as often as it counts: baseline of level 0, median ratio per level,
    mean per detector. n detectors are ranked both ways (Spearman by mean ranks); n_common are in the first k of both. Rows
    with a null speed, level or detector count nowhere; a variant without detectors in common has n 0 and null.
    """
    counted = F.array(*[F.when(F.coalesce(keep, F.lit(False)), F.lit(name)) for name, keep in variants.items()])
    used = rows.where("speed is not null and level is not null and detector_id is not null").select("detector_id", "level", "speed", F.explode(F.array_compact(counted)).alias("variant"))
    keys = ["variant", "detector_id"]
    scores = kept(sensitivity_by_level(used, keys).groupBy(*keys).agg(F.avg("sensitivity").alias("x")).where("x is not null"))
    return compared(scores, list(variants), default, k)


def compared(scores: DataFrame, variants: list[str], default: str, k: int = 20) -> DataFrame:
    """(variant, n, spearman, n_common) of rankings (variant, detector_id, x) against the ``default`` one, a row for each variant."""
    keys = ["variant", "detector_id"]
    plain = scores.where(F.col("variant") == default).select("detector_id", F.col("x").alias("y"))
    both = _both_ranks(scores.join(plain, "detector_id"), ["variant"]).groupBy("variant").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))
    first = scores.withColumn("place", F.row_number().over(Window.partitionBy("variant").orderBy("x", "detector_id"))).where(F.col("place") <= k).select(*keys)
    common = first.join(first.where(F.col("variant") == default).select("detector_id"), "detector_id").groupBy("variant").agg(F.count("*").alias("n_common"))
    names = scores.sparkSession.createDataFrame([(name,) for name in variants], "variant string")
    return names.join(both, "variant", "left").join(common, "variant", "left").select("variant", F.coalesce("n", F.lit(0)).alias("n"), "spearman", F.coalesce("n_common", F.lit(0)).alias("n_common"))


def within_regression_two(df: DataFrame, y: str, x1: str, x2: str, group: str) -> DataFrame:
    """(n, slope_1, slope_2): y on two regressors together within groups, from grouped sums alone. Rows with a null in any of
    them are left out; regressors that lie on one line within all groups give null."""
    some = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()).select(group, *[F.col(c).cast("double").alias(a) for c, a in ((y, "y"), (x1, "a"), (x2, "b"))])
    pairs = ("aa", "bb", "ab", "ay", "by")
    sums = some.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "yab"], *[F.sum(F.col(p[0]) * F.col(p[1])).alias(p) for p in pairs])
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col(p) - F.col(p[0]) * F.col(p[1]) / F.col("n")).alias(p) for p in pairs])
    whole = F.nullif(F.expr("aa * bb - ab * ab"), F.lit(0.0))
    return total.select("n", (F.expr("ay * bb - by * ab") / whole).alias("slope_1"), (F.expr("by * aa - ay * ab") / whole).alias("slope_2"))


def linear_by(df: DataFrame, y: str, x: str, train: Column) -> DataFrame:
    """``df`` with the prediction of a straight line of y on x that is fitted to the rows in ``train``."""
    line = df.where(train).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"))
    return df.crossJoin(F.broadcast(line)).withColumn("prediction", F.col("_intercept") + F.col("_slope") * F.col(x)).drop("_slope", "_intercept")


def _solved(sums: dict, features: list[str], y: str) -> list[float] | None:
    """Intercept and slopes from sums of products, or None where the rows don't determine them."""
    import numpy as np

    n = sums["n"]
    if n <= len(features):
        return None
    mean = {c: sums[c] / n for c in (*features, y)}
    part = lambda a, b: sums[min(a, b), max(a, b)] - n * mean[a] * mean[b]
    spread = np.sqrt([max(part(f, f), 0.0) for f in features])
    if (spread ** 2 <= 1e-12 * np.array([sums[f, f] for f in features])).any():
        return None
    scaled = np.array([[part(a, b) for b in features] for a in features]) / np.outer(spread, spread)
    if np.linalg.matrix_rank(scaled, tol=1e-9) < len(features):
        return None
    slopes = np.linalg.solve(scaled, [part(f, y) for f in features] / spread) / spread
    return [float(mean[y] - sum(s * mean[f] for s, f in zip(slopes, features))), *map(float, slopes)]


def linear_cv(df: DataFrame, y: str, features: list[str], fold: str = "fold") -> tuple[DataFrame, dict]:
    """``df`` with the prediction of a line of ``y`` on ``features`` that was fitted without the row's own fold, and the intercept and
    slopes by fold.

    Sums of products per fold come from one aggregate; each fold's line follows from the sums of all others, so nothing is read once
    per fold. Sums go to the driver, a row per fold. Rows with a null in any of the columns are not learnt from and get no prediction;
    nor does a fold whose other rows don't determine a line (too few, a constant feature, features on one line).
    """
    columns = [*features, y]
    some = df.where(F.col(fold).isNotNull()).dropna(subset=columns).select(F.col(fold).alias("fold"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    pairs = [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]
    sums = some.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"s{k}") for k in range(len(columns))], *[F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"p{a}_{b}") for a, b in pairs]).collect()
    lines = {}
    for own in sums:
        rest = [r for r in sums if r.fold != own.fold]
        total = {"n": sum(r.n for r in rest)} | {c: sum(r[f"s{k}"] for r in rest) for k, c in enumerate(columns)}
        total |= {(min(columns[a], columns[b]), max(columns[a], columns[b])): sum(r[f"p{a}_{b}"] for r in rest) for a, b in pairs}
        lines[own.fold] = _solved(total, features, y)
    guess = F.lit(None).cast("double")
    for number, line in lines.items():
        if line:
            guess = F.when(F.col(fold) == number, sum((F.lit(s) * F.col(f) for s, f in zip(line[1:], features)), F.lit(line[0]))).otherwise(guess)
    return df.withColumn("prediction", guess), lines


def f1_mae(df: DataFrame, truth: str, guess: str, limit: float = 0.7) -> DataFrame:
    """Mean absolute error, and F1 of values below ``limit``."""
    hit, said = F.col(truth) < limit, F.col(guess) < limit
    tp, fp, fn = F.count_if(hit & said), F.count_if(~hit & said), F.count_if(hit & ~said)
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"))


def split_by_episode(df: DataFrame, episodes: DataFrame, time: str = "time", parts: int = 3, keys: dict[str, str] | None = None) -> DataFrame:
    """Adds episode_id (of the episode that holds the row, or null) and fold, 0 to parts - 1. ``keys`` names columns of the rows and
    the episodes' columns they must equal (a district's own episodes).

    An episode's rows are all in one fold, by its id; rows outside every episode take the fold of their day's number, so that
    dry hours of a day stay together. Episodes must not overlap. A null time has a null fold. With a single episode one fold
    holds all its rows, and a test part of another fold is empty of them.
    """
    named = {own: fresh(df, names=(f"_of_{theirs}",))[0] for own, theirs in (keys or {}).items()}
    spans = episodes.select("start", "end", "episode_id", *[F.col(keys[own]).alias(name) for own, name in named.items()])
    held = interval_join(df, spans, time, "left", named).drop("start", "end", *named.values())
    return held.withColumn("fold", F.pmod(F.coalesce(F.col("episode_id"), F.unix_date(F.to_date(time))), F.lit(parts)).cast("int"))


def _fitted(train: DataFrame, features: list[str], label: str, estimator):
    """The fitted pipeline, or None where no row has a label and all features. The rows to learn from are made once and written, as
    fitting passes over them many times."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    usable = kept(train.dropna(subset=[*features, label]))
    if usable.isEmpty():
        return None
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), estimator]).fit(usable)


def _trees(label: str):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="_x", labelCol=label, maxIter=8, maxDepth=4, seed=1)


def fit_and_score(train: DataFrame, test: DataFrame, features: list[str], label: str, estimator=None) -> DataFrame:
    """The test rows with a prediction of an estimator from Spark's ML library; gradient-boosted trees unless given.

    An estimator of one's own takes its features from ``_x`` and its label from ``label``. Rows with a null feature are left out.
    Without usable rows to learn from, predictions are null.
    """
    model = _fitted(train, features, label, estimator) if estimator else _fitted(train.select(*features, label), features, label, _trees(label))
    return model.transform(test).drop("_x") if model else test.dropna(subset=features).withColumn("prediction", F.lit(None).cast("double"))


def congestion(train: DataFrame, test: DataFrame, features: list[str], ratio: str = "ratio", limit: float = 0.7) -> DataFrame:
    """The test rows with p_congested, the probability of a logistic model that the ratio is below ``limit``, and congested, 1
    from a half on. Rows with a null ratio aren't learnt from, those with a null feature are left out. A training part of one
    class gives that class throughout, an empty one nulls."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    label, plain = "_congested", ["rawPrediction", "probability", "prediction"]
    known = train.where(F.col(ratio).isNotNull()).withColumn(label, (F.col(ratio) < limit).cast("double"))
    model = _fitted(known, features, label, LogisticRegression(featuresCol="_x", labelCol=label, family="binomial", maxIter=100, tol=1e-9))
    if model is None:
        return test.dropna(subset=features).withColumn("p_congested", F.lit(None).cast("double")).withColumn("congested", F.lit(None).cast("int"))
    scored = model.transform(test)
    return scored.withColumn("p_congested", vector_to_array("probability")[1]).withColumn("congested", F.col("prediction").cast("int")).drop("_x", *plain)


def class_scores(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(n, n_true, accuracy, f1) of a yes-or-no guess; f1 is null where neither ever says yes."""
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    return df.agg(F.count("*").alias("n"), F.count_if(truth).alias("n_true"), F.avg((truth == guess).cast("double")).alias("accuracy"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"))


def importances(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, importance) of the gradient-boosted trees: shares that add up to 1, one row a feature, also of those unused;
    null without usable rows."""
    model = _fitted(train.select(*features, label), features, label, _trees(label))
    found = model.stages[-1].featureImportances.toArray().tolist() if model else [None] * len(features)
    return train.sparkSession.createDataFrame(list(zip(features, found)), "feature string, importance double")
