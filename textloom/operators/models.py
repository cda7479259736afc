"""Models kept as tables: standardising, isolation forest, isotonic calibration, feedback."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.rules import fixed
from textloom.session import cut

#: Nodes of a forest that are sent to all tasks.
MAX_NODES = 500_000
TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long"


def profile(rows: DataFrame, features: list[str]) -> DataFrame:
    """``feature``, mean, population deviation, least and greatest."""
    long = rows.unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def standardise(rows: DataFrame, features: list[str]) -> DataFrame:
    """Each feature less its mean, by its population deviation (1 if that is 0)."""
    stats = rows.agg(*[x for c in features for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = rows.join(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in features}).select(*rows.columns)


def importance(rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """Features of each row by the size of their standard score."""
    long = standardise(rows, features).unpivot([key], features, "feature", "z").withColumn("importance", F.abs("z"))
    return long.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("importance"), "feature")))


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(rows: DataFrame, features: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """A forest as a table of nodes. Each tree grows on ``sample`` rows drawn by a hash, in a task of its own."""
    own = rows.select(key, *features)
    count = own.count()
    if count == 0:
        raise ValueError("no rows to fit")
    size = min(sample, count)
    share = min(1.0, 3 * size / count)
    pool = min(1.0, trees * share)  # only rows that some tree may take are repeated for all trees
    u = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    some = own.filter(u(key, F.lit(seed)) < pool * (1 << 30))
    drawn = some.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_u", u(key, "tree", F.lit(seed + 1))).filter(F.col("_u") < share / pool * (1 << 30))
    kept = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_u", key))).filter(F.col("_r") <= size)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("_r")[features].to_numpy(float)
        tree = int(part["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        nodes: list[tuple] = []

        def add(points: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(x.shape[1])
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(points) <= 1 or not len(usable):
                nodes[at] = (tree, at, -1, 0.0, -1, -1, len(points))
                return at
            f = int(rng.choice(usable))
            t = float(rng.uniform(points[:, f].min(), points[:, f].max()))
            low = points[:, f] <= t
            left, right = add(points[low], depth + 1), add(points[~low], depth + 1)
            nodes[at] = (tree, at, f, t, left, right, len(points))
            return at

        add(x, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    return kept.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def flagged(scored: DataFrame, contamination: float = 0.1) -> DataFrame:
    """``scored`` (a column ``score``) with ``is_outlier`` below the contamination quantile and ``confidence``."""
    cut = scored.agg(F.percentile_approx("score", contamination, 10_000).alias("cut"))
    out = scored.join(F.broadcast(cut)).withColumn("is_outlier", F.col("score") < F.col("cut"))
    inlier = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 0.1) / 0.4))
    return out.withColumn("confidence", F.when(F.col("is_outlier"), F.greatest(F.lit(0.5), F.least(F.lit(1.0), (-F.col("score") - 0.1) / 0.4))).otherwise(inlier)).drop("cut")


def outlier_scores(rows: DataFrame, forest: DataFrame, features: list[str], key: str, sample: int = 256, contamination: float = 0.1) -> DataFrame:
    """``key``, ``score`` (-1 to 0, lower is odder), ``is_outlier`` below the contamination quantile, ``confidence``."""
    nodes = forest.toPandas().sort_values(["tree", "node"])  # trees x 2 x sample rows at most
    trees = [t[["feature", "threshold", "left", "right", "size"]].to_numpy(float) for _, t in nodes.groupby("tree")]
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    scale = _average_path(min(sample, int(max(t[0, 4] for t in trees)))) or 1.0

    @F.pandas_udf("double")
    def path(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        total = np.zeros(len(x))
        for t in sent.value:
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                f = t[at[inner], 0].astype(int)
                low = x[inner, f] <= t[at[inner], 1]
                at[inner] = np.where(low, t[at[inner], 2], t[at[inner], 3]).astype(int)
                depth[inner] += 1
            total += depth + np.array([_average_path(int(s)) for s in t[:, 4]])[at]
        return pd.Series(total / len(sent.value))

    scored = rows.select(key, (-F.pow(F.lit(2.0), -path(*features) / scale)).alias("score"))
    return flagged(scored, contamination)


def forest_row(forest: DataFrame, features: list[str], sample: int = 256) -> DataFrame:
    """A forest as one row: ``trees`` (nodes of each tree in order, with the path length that ends at them), ``scale`` and ``depth``.

    ``forest`` is ``isolation_forest``'s table or one that was saved and loaded; more than ``MAX_NODES`` nodes are an error.
    """
    if forest.count() > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    children = forest.select("tree", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent")).filter("node >= 0")
    depth = forest.filter("node = 0").select("tree", "node", F.lit(0).alias("depth"))
    layer, most = depth, 0
    while True:  # one join a level
        layer = cut(layer.select("tree", F.col("node").alias("parent"), "depth").join(children, ["tree", "parent"]).select("tree", "node", (F.col("depth") + 1).alias("depth")))
        if not layer.limit(1).count():
            break
        depth, most = depth.unionByName(layer), most + 1
    n = F.col("size").cast("double")
    left = F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n)
    named = F.element_at(F.array(*map(F.lit, features)), F.when(F.col("feature") >= 0, F.col("feature") + 1))
    place = F.when(named.isNull(), -1).otherwise(F.col("feature"))
    nodes = forest.join(depth, ["tree", "node"]).select("tree", F.struct("node", place.cast("int").alias("feature"), "threshold", "left", "right", (F.col("depth") + left).alias("path"), "size").alias("x"))
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list("x")).alias("t"))
    top = F.least(F.lit(float(sample)), F.max(F.get("t", F.lit(0))["size"]).cast("double"))
    scale = F.when(top <= 1, 1.0).when(top == 2, 1.0).otherwise(2 * (F.ln(top - 1) + 0.5772156649) - 2 * (top - 1) / top)
    return trees.agg(F.array_sort(F.collect_list(F.struct("tree", "t"))).alias("trees"), scale.alias("scale")).withColumn("depth", F.lit(most))


def forest_scores(rows: DataFrame, forest: DataFrame, features: list[str], key: str, sample: int = 256) -> DataFrame:
    """``key``, ``score`` (-1 to 0, lower is odder) by built-in functions alone: each tree is walked from its root as an array.

    Equals ``outlier_scores``'s score; the forest is one row, sent to all tasks, its size checked. Null features count as NaN.
    """
    one = forest_row(forest, features, sample)
    values = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features))

    def walk(tree):
        nodes = tree["t"]
        step = lambda at, _: F.transform(
            F.array(F.get(nodes, at)), lambda x: F.when(x["feature"] < 0, at).when(F.get("_x", x["feature"]) <= x["threshold"], x["left"]).otherwise(x["right"])
        )[0]
        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1))), F.lit(0), step))["path"]

    met = rows.select(key, values.alias("_x")).join(F.broadcast(one))
    mean = F.aggregate("trees", F.lit(0.0), lambda s, t: s + walk(t)) / F.size("trees")
    return met.select(key, (-F.pow(F.lit(2.0), -mean / F.col("scale"))).alias("score"))


def calibration_knots(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Isotonic regression of outcomes on confidences as a table of knots (``x``, ``y``). Values beyond 0 to 1, or other labels, are an error."""
    bad = rows.filter(~F.col(predicted).between(0, 1) | ~F.col(actual).isin(0, 1)).limit(1).count()
    if bad:
        raise ValueError("confidences must lie in 0 to 1 and labels be 0 or 1")
    model = IsotonicRegression(featuresCol=predicted, labelCol=actual, isotonic=True).fit(rows.select(F.col(predicted).cast("double"), F.col(actual).cast("double")))
    return rows.sparkSession.createDataFrame(list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist())), "x double, y double")


#: Knots of a calibration that are sent to all executors.
MAX_KNOTS = 1_000_000


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.60, "MODERATE").otherwise("LOW")


def tier_explanation(confidence: Column) -> Column:
    """How a calibrated confidence is put into words."""
    own = tier(confidence)
    whole = F.floor(confidence * 100).cast("int")
    texts = [F.when(own == name, F.format_string(text, whole)) for name, text in fixed.TIER_TEXTS.items()]
    return F.coalesce(*texts)


def calibrate(rows: DataFrame, knots: DataFrame | None, confidence: str = "confidence") -> DataFrame:
    """``calibrated_confidence`` by interpolation between knots, its ``confidence_tier``, ``tier_label`` and ``explanation``; ``is_calibrated``.

    Without knots the value stays itself. Values beyond 0 to 1 are clipped, a null stays null.
    The knots, a table of distinct ``x`` whose number is checked, are sent to all executors.
    """
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence).cast("double")))
    value = F.when(F.col(confidence).isNotNull(), c)
    if knots is not None:
        found = knots.select("x", "y").limit(MAX_KNOTS + 1).toPandas().sort_values(["x", "y"])
        if not 0 < len(found) <= MAX_KNOTS:
            raise ValueError(f"a calibration has 1 to {MAX_KNOTS} knots")
        sent = rows.sparkSession.sparkContext.broadcast((found["x"].to_numpy(float), found["y"].to_numpy(float)))

        @F.pandas_udf("double")
        def between(values: pd.Series) -> pd.Series:
            return pd.Series(np.interp(values.to_numpy(float), *sent.value)).where(values.notna())

        value = F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), between(value))))  # greatest() passes over nulls
    out = rows.withColumn("calibrated_confidence", value)
    own = F.col("calibrated_confidence")
    label = F.coalesce(*[F.when(tier(own) == name, text) for name, text in fixed.TIER_LABELS.items()])
    return out.withColumns({"confidence_tier": tier(own), "tier_label": label, "explanation": tier_explanation(own), "is_calibrated": F.lit(knots is not None)})


def calibration_summary(rows: DataFrame, key: str, raw: str = "confidence") -> DataFrame:
    """For each ``key`` of calibrated rows: mean, deviation, least and greatest adjustment (calibrated less raw) and rows by tier."""
    own = F.col("calibrated_confidence")
    change = own - F.col(raw)
    tiers = [F.count_if(F.col("confidence_tier") == t).alias(t.lower()) for t in fixed.TIER_LABELS]
    return rows.groupBy(key).agg(F.avg(own).alias("mean"), F.stddev_pop(own).alias("std"), F.avg(change).alias("mean_adjustment"), F.min(change).alias("least"), F.max(change).alias("most"), *tiers)


def fit_report(rows: DataFrame, predicted: str, actual: str, knots: DataFrame | None = None) -> DataFrame:
    """One row: ``calibration_quality`` of raw confidences, the Brier score after calibration and how many percent better that is."""
    raw = rows.select(F.col(predicted).cast("double").alias("p"), F.col(actual).cast("double").alias("y"))
    knots = calibration_knots(raw, "p", "y") if knots is None else knots
    after = calibrate(raw, knots, "p").agg(F.avg(F.pow(F.col("calibrated_confidence") - F.col("y"), 2)).alias("brier_after"))
    out = calibration_quality(raw, "p", "y").join(F.broadcast(after))  # one row each
    better = F.when(F.col("brier") > 0, (F.col("brier") - F.col("brier_after")) / F.col("brier") * 100).otherwise(0.0)
    return out.withColumn("improvement", better)


def quality_with_feedback(quality: DataFrame, statistics: DataFrame) -> DataFrame:
    """The quality of a calibration beside the statistics of its feedback; one row."""
    return quality.join(F.broadcast(statistics))


def reliability(rows: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """Bins ``(low, high]``: number, mean confidence, share of successes. A confidence of 0 falls in none."""
    own = rows.withColumn("bin", F.ceil(F.col(predicted) * bins).cast("int")).filter("bin >= 1")
    return own.groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(F.col(actual).cast("double")).alias("mean_actual"))


def calibration_quality(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Expected calibration error, Brier score, their label and status; one row."""
    total = rows.agg(F.count("*").alias("total"), F.avg(F.pow(F.col(predicted) - F.col(actual), 2)).alias("brier"))
    gap = reliability(rows, predicted, actual).agg(F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("mean_actual"))).alias("gap"))
    out = total.join(F.broadcast(gap)).select("total", "brier", (F.col("gap") / F.col("total")).alias("ece"))
    label = F.when(F.col("ece") < 0.05, "excellent").when(F.col("ece") < 0.10, "good").when(F.col("ece") < 0.15, "fair").otherwise("poor")
    return out.withColumn("quality", label).withColumn("status", F.when(F.col("total") == 0, "NOT_FITTED").when(F.col("ece") < 0.05, "GOOD").otherwise("NEEDS_ATTENTION"))


def uncertain(rows: DataFrame, n: int, key: str, calibrated: str, second: str, first: str) -> DataFrame:
    """The ``n`` rows nearest to a half, by the first of three confidences that is neither null nor 0."""
    value = F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in (calibrated, second, first)], F.lit(0.5))
    return rows.withColumn("used", value).withColumn("uncertainty", F.abs(F.col("used") - 0.5)).orderBy("uncertainty", key).limit(n)


def inside_action(action: Column, names: dict[str, str] = fixed.OUTSIDE_ACTIONS) -> Column:
    """The inside name of an outside action, null for one that is not known."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(pairs, action)


def labelled_feedback(rows: DataFrame, action: str = "user_action", confidence: str = "confidence") -> DataFrame:
    """``was_correct`` and ``is_valid``: a known action and a confidence from 0 to 1."""
    pairs = F.create_map(*[F.lit(x) for kv in fixed.FEEDBACK_ACTIONS.items() for x in kv])
    correct = F.try_element_at(pairs, F.col(action))
    return rows.withColumn("was_correct", correct).withColumn("is_valid", correct.isNotNull() & F.col(confidence).between(0, 1))


def feedback_statistics(rows: DataFrame, needed: int = 100) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("size"), F.least(n / needed, F.lit(1.0)).alias("progress"), (F.count_if(F.col("user_action") == "dismissed") / F.greatest(n, F.lit(1))).alias("dismissal_rate"), (F.count_if("was_correct") / F.greatest(n, F.lit(1))).alias("accuracy"))


def should_collect(confidence: Column, key: Column, seed: int = 42) -> Column:
    """Always near a half, half of the time a little off, a tenth elsewhere; drawn by a hash of the key."""
    off = F.abs(confidence - 0.5)
    chance = F.when(off < 0.1, 1.0).when(off < 0.2, 0.5).otherwise(0.1)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1e6 < chance


def generations(rows: DataFrame, order: list[str], by: str, size: int = 100) -> DataFrame:
    """Feedback of each model (``by``) in batches of ``size`` in order, with what a refit of each would meet: one class, dismissals."""
    own = rows.withColumn("generation", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))
    out = own.groupBy(by, "generation").agg(F.count("*").alias("n"), F.count_if("was_correct").alias("correct"), F.count_if(F.col("user_action") == "dismissed").alias("dismissed"))
    action = F.when(F.col("n") < size, "waiting").when((F.col("correct") == 0) | (F.col("correct") == F.col("n")), "one_class").when(F.col("dismissed") / F.col("n") > 0.20, "refit_with_warning").otherwise("refit")
    return out.withColumn("action", action)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``x`` in order and the non-decreasing values nearest to the ``y``: neighbours are pooled while they fall."""
    at, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(inverse, y) / np.maximum(counts, 1)
    pools: list[list[float]] = []  # value, weight, points
    for mean, weight in zip(means, counts):
        pools.append([mean, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, n, k), (b, m, j) = pools[-2:]
            pools[-2:] = [[(a * n + b * m) / (n + m), n + m, k + j]]
    return at, np.concatenate([np.full(int(k), v) for v, _, k in pools]) if pools else at


def numbered(rows: DataFrame, order: list[str], name: str = "_place") -> DataFrame:
    """``rows`` with their places (from 0) in one order over all, counted by parts of it, so that no task has all rows. Computed once."""
    ordered = cut(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before, total = [], 0
    for number, size in sorted(map(tuple, ordered.groupBy(part.alias("_part")).count().collect())):  # one row a part
        before.append((number, total))
        total += size
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    place = F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return ordered.withColumn("_part", part).join(starts, "_part").withColumn(name, place).select(*rows.columns, name)


#: Feedbacks that are fitted in one task at least, in as many generations as they fill.
TASK_FEEDBACK = 10_000


def refits(rows: DataFrame, order: list[str], by: str, size: int = 100, confidence: str = "confidence", force: bool = False, place: str | None = None) -> DataFrame:
    """What refitting after every ``size`` valid feedbacks gives: for each ``by`` and generation its ``action``, and the Brier score before and after.

    The buffer is cleared after every generation. One of fewer than ``size`` waits, unless
    ``force``; one with a single class is not fitted; a share of dismissals over 0.20 is
    marked. A task fits generations, ``size`` rows each at most, one after another. ``place``: a column
    with each row's place (from 0) in ``order``, when that is at hand (``numbered``).
    """
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1 if place is None else F.col(place)
    own = rows.select(by, F.floor(at / size).alias("generation"), F.col(confidence).cast("double").alias("p"), F.col("was_correct").cast("double").alias("y"), (F.col("user_action") == "dismissed").alias("d"))
    own = own.withColumn("_some", F.floor(F.col("generation") / max(1, TASK_FEEDBACK // size)))

    def one(p: np.ndarray, y: np.ndarray, dismissed: np.ndarray) -> tuple:
        n, good = len(y), int(np.nansum(y))
        if n < size and not force:
            action = "waiting"
        elif good in (0, n):
            action = "one_class"
        else:
            action = "refit_with_warning" if dismissed.mean() > 0.20 else "refit"
        before = after = None
        if action.startswith("refit"):
            known, values = isotonic(p, y)
            before, after = (float(np.nanmean((v - y) ** 2)) for v in (p, np.interp(p, known, values)))
        return n, good, int(dismissed.sum()), action, before, after

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("generation", kind="stable")
        numbers, begins = np.unique(part["generation"].to_numpy(), return_index=True)
        p, y, d = (part[c].to_numpy(kind) for c, kind in (("p", float), ("y", float), ("d", bool)))
        found = [one(p[a:b], y[a:b], d[a:b]) for a, b in zip(begins, np.append(begins[1:], len(part)))]
        out = pd.DataFrame(found, columns=["n", "correct", "dismissed", "action", "brier_before", "brier_after"])
        out.insert(0, by, [part[by].iloc[0]] * len(out))
        out.insert(1, "generation", numbers)
        return out

    kind = rows.schema[by].dataType.simpleString()
    return own.groupBy(by, "_some").applyInPandas(fit, f"{by} {kind}, generation long, n long, correct long, dismissed long, action string, brier_before double, brier_after double")


def export_feedback(rows: DataFrame, path: str) -> None:
    """Feedback as JSON lines; timestamps in ISO form."""
    rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def import_feedback(spark: SparkSession, path: str, schema: str = "user_action string, confidence double, was_correct boolean, feedback_date timestamp") -> DataFrame:
    """Feedback that ``export_feedback`` or another writer has left."""
    return spark.read.schema(schema).json(path)


def train_calibrator(spark: SparkSession, path: str, least: int = 50, most_ece: float = 0.05) -> tuple[DataFrame | None, DataFrame]:
    """Knots from a feedback file, and one row: ``samples``, ``fitted``, ``ece``, ``brier``, ``brier_after``, ``ece_alert``.

    With fewer than ``least`` usable samples, or a single class, there are no knots and the defaults (identity) stay.
    """
    rows = import_feedback(spark, path).filter("confidence BETWEEN 0 AND 1 AND was_correct IS NOT NULL").select("confidence", F.col("was_correct").cast("double").alias("actual"))
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("actual"), F.lit(0.0))).first()
    if n < least or good in (0, n):
        return None, spark.range(1).select(F.lit(n).cast("long").alias("samples"), F.lit(False).alias("fitted"), *[F.lit(None).cast("double").alias(c) for c in ("ece", "brier", "brier_after")], F.lit(False).alias("ece_alert"))
    knots = calibration_knots(rows, "confidence", "actual")
    report = fit_report(rows, "confidence", "actual", knots)
    return knots, report.select(F.col("total").alias("samples"), F.lit(True).alias("fitted"), "ece", "brier", "brier_after", (F.col("ece") > most_ece).alias("ece_alert"))
