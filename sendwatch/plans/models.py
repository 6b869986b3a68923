"""Rate models on the account feature tables (``pyspark.ml`` + exact KNN).

Training data is account-level (one row per sending account after the
volume gate), assembled into a vector column once and checkpointed, so every
fit reads a materialised table instead of re-running the feature joins.

Metrics are computed in Spark: predictions of all models are unioned with a
model/parameter tag and reduced with one ``groupBy`` (RMSE, R^2), rather than
one evaluator job per model.

Differences from the single-machine learners are stated where they exist:
Spark trees cap ``maxDepth`` at 30 and bin continuous features (``maxBins``
raised to 256 here). Forests and bagged trees, and single trees on more rows
than Spark takes cuts from, are grown by
``operators/forest.py`` within the same limits: Spark's own needs a histogram
per node and does not finish with hundreds of full-depth trees. Absolute and
Huber loss are boosted by ``operators/boosting.py``, with the median and Huber
leaf values of the study's library; the spread of a feature's values is binned
there too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params
from sendwatch.operators import boosting, forest, knn
from sendwatch.operators.ranks import value_ranks
from sendwatch.operators.stats import r6
from sendwatch.plans.assemble import FEATURES, TARGETS, split_flag
from sendwatch.session import ensure_checkpoint_dir, materialize, share_package

# --- fixed values: model settings of the reference study --------------------
SWEEP_DEPTHS = range(1, 51)
MAX_SPARK_DEPTH = 30              # Spark's own limit; see depth_sweep
KNN_K_MAX = 50
BEST_K = {"optout": 23, "spam": 43}
BEST_TREE_DEPTH = {"optout": 9, "spam": 6}
BEST_FOREST_DEPTH = {"optout": 17, "spam": 9}
FOREST_TREES = 100
BAGGING_TREES = 400
TUNED_BOOSTER = {"optout": ("huber", 3, 300), "spam": ("lad", 6, 70)}  # loss, depth, trees
HUBER_SIZES = (100, 300, 1000)
RISK_TREE_DEPTH = 7
PERMUTATION_REPEATS = 5
MAX_BINS = 256
SEED = 0
SPARK_TREE_ROWS = MAX_BINS * MAX_BINS  # beyond, Spark's tree takes its cuts from a sample of so many rows
# -----------------------------------------------------------------------------


def _vectorised(df: DataFrame) -> DataFrame:
    va = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    return va.transform(df.select("account_id", *[F.col(c).cast("double").alias(c) for c in FEATURES],
                                  *[F.col(c).cast("double").alias(c) for c in TARGETS.values()]))


def model_frames(features_p1: DataFrame, features_p2: DataFrame, params: Params = DEFAULT_PARAMS):
    """(train, test, scored): period-1 split by account hash, period 2 scored.
    Materialised once (reliable checkpoint) and reused by every fit."""
    p1, p2 = _together([lambda: materialize(_vectorised(features_p1).withColumn("is_train", split_flag(params))),
                        lambda: materialize(_vectorised(features_p2))])
    return fit_rows(p1.where("is_train")), p1.where("NOT is_train"), p2


def _together(jobs: Sequence[Callable[[], Any]], parallelism: int = 8) -> list:
    """What ``jobs`` return. They start at the same time: many are rows of short
    Spark jobs of a task or two, which leave most of a cluster idle one by one."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def fit_rows(train: DataFrame, most: int | None = None) -> DataFrame:
    """The rows that models are fitted on: all. ``most`` is for trials only, no
    job gives it: the rows whose account hash is below the share ``most`` / rows."""
    if most is None:
        return train
    share = min(1.0, most / max(1, train.count()))
    place = F.pmod(F.xxhash64("account_id", F.lit("fit")), F.lit(1 << 30))
    return train.where(place < int(share * (1 << 30)))


def _tree(depth: int, label: str) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(featuresCol="features", labelCol=label, maxDepth=depth,
                                 maxBins=MAX_BINS, seed=SEED)


def fit_trees(train: DataFrame, specs: Sequence[tuple[int, str]], cuts: Callable[[], boosting.Binning] | None = None) -> list:
    """A tree per (depth, label). Spark's own where its cuts come from all rows;
    beyond, ``forest.fit`` on every row once, with cuts from all rows, which
    keeps no node on the driver either."""
    if train.count() <= SPARK_TREE_ROWS:
        return _fit_all([_tree(d, label) for d, label in specs], train)
    binned = cuts() if cuts else boosting.binning(train, FEATURES, MAX_BINS)
    return forest.fit(train, binned, [forest.Spec(label, d, 1, None) for d, label in specs])


def _forest(depth: int, label: str, trees: int = FOREST_TREES) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol=label, maxDepth=depth,
                                 numTrees=trees, featureSubsetStrategy="all", maxBins=MAX_BINS,
                                 seed=SEED)


def _bagging(label: str) -> RandomForestRegressor:
    """Bagged full-depth trees: a forest that considers every feature."""
    return _forest(MAX_SPARK_DEPTH, label, BAGGING_TREES)


@dataclass
class Booster:
    """A boosted model with its cut points, used like a fitted ``pyspark.ml`` model."""

    cuts: boosting.Binning
    model: boosting.Model

    def transform(self, frame: DataFrame) -> DataFrame:
        keep = [c for c in frame.columns if c != "features"]
        return boosting.predict(frame, self.cuts, {"prediction": self.model}, keep)

    @property
    def importances(self) -> list[float]:
        return self.model.importances(len(self.cuts.features))


def fit_boosters(train: DataFrame, specs: Sequence[boosting.Spec], cuts: boosting.Binning | None = None) -> list[Booster]:
    """Boosters of ``specs`` on one training frame, in lockstep."""
    cuts = cuts or boosting.binning(train, FEATURES, MAX_BINS)
    return [Booster(cuts, m) for m in boosting.fit(train, cuts, specs)]


def tuned_spec(target: str) -> boosting.Spec:
    return boosting.Spec(TARGETS[target], *TUNED_BOOSTER[target])


class Fits:
    """The tuned models of one training frame, each fitted when first asked
    for and shared by the jobs that compare, rank and score with them."""

    def __init__(self, train: DataFrame):
        self.train = train
        self._held: dict = {}

    def cuts(self) -> boosting.Binning:
        if "cuts" not in self._held:
            self._held["cuts"] = boosting.binning(self.train, FEATURES, MAX_BINS)
        return self._held["cuts"]

    def boosters(self) -> dict[str, Booster]:
        if "boosters" not in self._held:
            both = fit_boosters(self.train, [tuned_spec(t) for t in TARGETS], self.cuts())
            self._held["boosters"] = dict(zip(TARGETS, both))
        return self._held["boosters"]

    def tuned(self, target: str) -> dict:
        """The target's tree, forest, bagged trees and booster."""
        return self.all([target])[target]

    def all(self, targets: Sequence[str] = tuple(TARGETS)) -> dict[str, dict]:
        """``tuned`` of every target; the fits that are missing run at the same time."""
        cuts, jobs = self.cuts(), [self.boosters]
        missing = [t for t in targets if t not in self._held]
        for t in missing:
            specs = [forest.Spec(TARGETS[t], BEST_FOREST_DEPTH[t], FOREST_TREES, SEED),
                     forest.Spec(TARGETS[t], MAX_SPARK_DEPTH, BAGGING_TREES, SEED)]
            jobs += [partial(fit_trees, self.train, [(BEST_TREE_DEPTH[t], TARGETS[t])], self.cuts),
                     partial(forest.fit, self.train, cuts, specs)]
        boosters, *fitted = _together(jobs)
        for t, (tree,), forests in zip(missing, fitted[::2], fitted[1::2]):
            self._held[t] = dict(zip(("tree", "forest", "bagging"), (tree, *forests)))
        return {t: {**self._held[t], "boosting": boosters[t]} for t in targets}


def _fit_all(estimators: Sequence, data: DataFrame, parallelism: int = 8) -> list:
    return _together([partial(e.fit, data) for e in estimators], parallelism)


def _scored(model, frame: DataFrame, label: str, tags: dict) -> DataFrame:
    out = model.transform(frame).select(
        F.col(label).alias("y"), F.col("prediction").alias("pred"))
    for k, v in tags.items():
        out = out.withColumn(k, F.lit(v))
    return out


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _rmse_by(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE and R^2 (1 - SSE / SST around the group's own mean) per group."""
    se = (F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))
    sst = F.var_pop("y") * F.count("y")
    return scored.groupBy(*keys).agg(r6(F.sqrt(F.avg(se))).alias("rmse"),
                                     r6(F.lit(1.0) - F.try_divide(F.sum(se), sst)).alias("r2"))


def grown_depth(model) -> int:
    """Depth actually reached: a tree's depth, a forest's deepest member."""
    if hasattr(model, "trees"):
        return max(t.depth for t in model.trees)
    return model.depth


def fit_depths(make, depths: Sequence[int], train: DataFrame, parallelism: int = 8) -> dict:
    """Fit one model per depth limit, in waves of ``parallelism`` fits.

    Exact shortcut: splits are chosen greedily node by node, so a model whose
    grown depth stays below its limit stopped for reasons that do not depend
    on the limit (pure or too-small nodes, no gain); every larger limit gives
    the identical model (for forests: same seeded bootstrap samples, all
    features at every split). Its fit is reused for the remaining depths."""
    depths = sorted(depths)
    models: dict = {}
    for i in range(0, len(depths), parallelism):
        wave = depths[i:i + parallelism]
        models.update(zip(wave, _fit_all([make(d) for d in wave], train, parallelism)))
        saturated = [d for d in wave if grown_depth(models[d]) < d]
        if saturated:
            first = saturated[0]
            for d in depths:
                if d > first:
                    models[d] = models[first]
            break
    return models


def tree_nodes(model, spark: SparkSession) -> forest.Nodes:
    """The nodes of a fitted Spark tree, inner ones with their own predictions (from its saved form)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")).toPandas().sort_values("id")
    inner = nodes["leftChild"].to_numpy() >= 0
    return forest.Nodes(np.where(inner, nodes["feature"], 0).astype(np.int8), nodes["cut"].fillna(0.0).to_numpy(np.float64),
                        nodes["leftChild"].to_numpy(np.int32), nodes["rightChild"].to_numpy(np.int32),
                        nodes["prediction"].to_numpy(np.float64))


def staged_tree(nodes: forest.Nodes, frame: DataFrame, label: str, depths: Sequence[int]) -> DataFrame:
    """(label, predictions): of the tree cut off at each of the ascending depths."""
    spark = frame.sparkSession
    share_package(spark)
    handed = spark.sparkContext.broadcast(nodes)  # of at most SPARK_TREE_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f"x{i}").to_numpy() for i in range(len(FEATURES))], axis=1)
            flat = handed.value.staged(x, depths).reshape(-1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(depths))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                                             ["y", "predictions"])

    x = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(FEATURES)]
    return (frame.select(F.col(label).cast("double").alias("y"), *x).mapInArrow(run, "y double, predictions array<double>")
            .withColumnRenamed("y", label))


def depth_sweep(train: DataFrame, test: DataFrame, family: str,
                depths: Iterable[int] = SWEEP_DEPTHS) -> DataFrame:
    """(target, depth, reached, train/test RMSE and R^2) for trees or forests,
    one row per depth. Fitted and scored on all rows.

    One fit per target: splits are chosen greedily node by node (for forests on
    the same bootstrap samples, all features at every split), so the model of a
    depth limit is the upper part of the deepest one, whose inner nodes carry the
    predictions that they would have as leaves. All depths are scored in one pass.

    Models stop at Spark's depth of 30. One that stops growing below that is the
    model of every larger limit, so those rows are exact; where it still grows
    at 30, rows beyond hold the model of depth 30 and say ``reached`` = false."""
    depths = sorted(depths)
    fit_on = fit_rows(train)
    top = max(d for d in depths if d <= MAX_SPARK_DEPTH)
    if family != "tree":
        cuts = boosting.binning(fit_on, FEATURES, MAX_BINS)
        fitted = dict(zip(TARGETS, forest.fit(fit_on, cuts, [forest.Spec(lb, top, FOREST_TREES, SEED)
                                                             for lb in TARGETS.values()])))
    else:
        fitted = dict(zip(TARGETS, fit_trees(fit_on, [(top, lb) for lb in TARGETS.values()])))
    results = []
    for tname, label in TARGETS.items():
        model = fitted[tname]
        grown = model.depth
        steps = sorted({min(d, top, grown) for d in depths})  # distinct models
        if not isinstance(model, forest.Forest):
            nodes = tree_nodes(model, train.sparkSession)
            parts = [staged_tree(nodes, frame, label, steps) for frame in (train, test)]
        else:
            parts = [model.staged(frame, steps) for frame in (train, test)]
        scored = [p.select(F.col(label).alias("y"), F.posexplode("predictions").alias("j", "pred"), F.lit(split).alias("split"))
                  for p, split in zip(parts, ("train", "test"))]
        r = _rmse_by(_union(scored), ["j", "split"])
        r = r.groupBy(F.element_at(F.lit(steps), F.col("j") + 1).alias("model")).agg(
            *[F.max(F.when(F.col("split") == sp, F.col(m))).alias(f"{sp}_{m}")
              for m in ("rmse", "r2") for sp in ("train", "test")])
        rows = [(tname, d, min(d, top, grown), d <= top or grown < top) for d in depths]
        names = train.sparkSession.createDataFrame(rows, "target string, depth int, model int, reached boolean")
        results.append(names.join(r, "model").drop("model"))
    return _union(results).select("target", "depth", "reached",
                                  *[f"{sp}_{m}" for m in ("rmse", "r2") for sp in ("train", "test")])


def best_param(sweep: DataFrame, param: str) -> DataFrame:
    """Per target, the parameter with the smallest test RMSE (ties: smaller)."""
    pick = F.min(F.struct(F.col("test_rmse"), F.col(param))).alias("_b")
    return sweep.groupBy("target").agg(pick).select(
        "target", F.col(f"_b.{param}").alias(param), F.col("_b.test_rmse").alias("test_rmse"))


def knn_sweep(train: DataFrame, test: DataFrame, k_max: int = KNN_K_MAX) -> DataFrame:
    """(target, k, RMSE and R^2 on train and test) for k = 1..k_max."""
    out = []
    for tname, label in TARGETS.items():
        tr, te = (knn.knn_k_sweep(df, train, "account_id", FEATURES, label, k_max)
                  .select("k", r6(F.col("rmse")).alias(f"{split}_rmse"), r6(F.col("r2")).alias(f"{split}_r2"))
                  for df, split in ((train, "train"), (test, "test")))
        out.append(tr.join(te, "k").withColumn("target", F.lit(tname)))
    return _union(out).select("target", "k", "train_rmse", "test_rmse", "train_r2", "test_r2")


def knn_scores(train: DataFrame, scored: DataFrame, target: str = "optout", k: int | None = None) -> DataFrame:
    label = TARGETS[target]
    k = k or BEST_K[target]
    p = knn.knn_predict(scored, train, "account_id", FEATURES, label, k)
    return (scored.select("account_id", label).join(p, "account_id")
            .select("account_id", label, r6(F.col("prediction")).alias("knn_pred")))


def knn_predictions(train: DataFrame, scored: DataFrame) -> DataFrame:
    """(account_id, optout_frac, frac_7726, optout_pred, spam_pred): actual and predicted rates."""
    o = knn_scores(train, scored, "optout").withColumnRenamed("knn_pred", "optout_pred")
    s = knn_scores(train, scored, "spam").withColumnRenamed("knn_pred", "spam_pred")
    return o.join(s, "account_id")


def _importances(model) -> list[float]:
    return model.featureImportances.toArray().tolist() if hasattr(model, "featureImportances") else model.importances


def importance_trees(train: DataFrame, fits: Fits | None = None) -> DataFrame:
    """Impurity importances of the tuned tree, forest, bagged trees and booster
    (the forests' are averaged over their members, the booster's are shares of
    the gains of all its splits)."""
    models = [(n, t, m) for t, tuned in (fits or Fits(train)).all().items() for n, m in tuned.items()]
    shares = _together([partial(_importances, m) for _, _, m in models])
    rows = [(n, t, f, float(v)) for (n, t, _), vals in zip(models, shares) for f, v in zip(FEATURES, vals)]
    out = train.sparkSession.createDataFrame(rows, "model string, target string, feature string, importance double")
    return out.coalesce(1).withColumn("importance", r6(F.col("importance")))


def permuted_values(stacked: DataFrame, value) -> DataFrame:
    """``stacked`` (account_id, j, r, ...) with ``_perm``: ``value`` of another
    account of the same variant. The account of rank i by one hash takes the
    value of the account of rank i by another; ranks come from bounded buckets,
    the same way at every size, so no window spans a variant."""
    keys = ["j", "r"]
    rows = stacked.withColumn("_to", F.xxhash64("account_id", "j", "r")).withColumn(
        "_from", F.xxhash64("account_id", "j", "r", F.lit("from"))).withColumn("_value", value)
    rows = materialize(rows)
    to = value_ranks(rows, keys, "_to").select(*keys, "_to", F.col("start").alias("_rank"))
    source = value_ranks(rows, keys, "_from").select(*keys, "_from", F.col("start").alias("_rank"))
    donors = rows.select(*keys, "_from", F.col("_value").alias("_perm")).join(source, [*keys, "_from"])
    return (rows.join(to, [*keys, "_to"]).drop("_from")
            .join(donors.select(*keys, "_rank", "_perm"), [*keys, "_rank"])
            .drop("_to", "_rank", "_value"))


def permuted_queries(base: DataFrame, repeats: int) -> tuple[DataFrame, DataFrame]:
    """(asked, queries): the distinct rows that permuting one feature of ``base``
    (with ``_row``) gives, 12 x repeats variants. asked: qid, _row, and the
    variants (j, r) ``at`` which the row is met; queries: qid and features.
    A value that falls on its own row, or twice on one row, gives a row that is
    there already: equal rows have equal neighbours and are searched once."""
    variants = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(r).alias("r"), F.col(c).cast("double").alias("own"))
                                   for j, c in enumerate(FEATURES) for r in range(repeats)]))
    stacked = permuted_values(base.select("account_id", "_row", variants.alias("v")).select("account_id", "_row", "v.*"),
                              F.col("own"))
    moved = ~F.col("_perm").eqNullSafe(F.col("own"))
    asked = stacked.groupBy("_row", F.when(moved, F.col("j")).alias("_j"), F.when(moved, F.col("_perm")).alias("_p")).agg(
        F.collect_list(F.struct("j", "r")).alias("at"))
    asked = materialize(asked.withColumn("qid", F.monotonically_increasing_id()))
    wide = asked.select("qid", "_row", "_j", "_p").join(base, "_row")
    return asked.select("qid", "_row", "at"), wide.select("qid", *[
        F.when(F.col("_j") == j, F.col("_p")).otherwise(F.col(c).cast("double")).alias(c) for j, c in enumerate(FEATURES)])


def permutation_importance(train: DataFrame, scored: DataFrame, target: str = "optout",
                           k: int | None = None, repeats: int = PERMUTATION_REPEATS) -> DataFrame:
    """KNN permutation importance on the scored period: increase in MSE when
    one feature's values are permuted across accounts, mean over repeats. The
    distinct rows of all 12 x repeats variants (bounded fan-out) are scored in
    one neighbour search."""
    label = TARGETS[target]
    k = k or BEST_K[target]
    base = materialize(scored.select("account_id", label, *FEATURES).withColumn("_row", F.monotonically_increasing_id()))
    asked, rows = permuted_queries(base, repeats)
    # the work is in the search, not in the bytes of the rows
    rows = rows.repartition(4 * scored.sparkSession.sparkContext.defaultParallelism)
    nn = knn.knn_predict(rows, train.withColumnRenamed("account_id", "qid"), "qid", FEATURES, label, k)
    err = (asked.join(base.select("_row", F.col(label).alias("y")), "_row").join(nn, "qid")
           .withColumn("se", (F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction"))))
    per_variant = err.select("se", F.inline("at")).groupBy("j", "r").agg(F.avg("se").alias("mse"))
    base_pred = knn.knn_predict(base, train, "account_id", FEATURES, label, k)
    base_mse = (base.join(base_pred, "account_id")
                .agg(F.avg((F.col(label) - F.col("prediction")) * (F.col(label) - F.col("prediction")))))
    names = F.element_at(F.array(*[F.lit(c) for c in FEATURES]), F.col("j") + 1)
    return (per_variant.groupBy("j").agg(F.avg("mse").alias("mse"))
            .select(names.alias("feature"), r6(F.col("mse") - base_mse.scalar()).alias("importance"))
            .withColumn("target", F.lit(target)))


def leaderboard(train: DataFrame, scored: DataFrame, fits: Fits | None = None) -> DataFrame:
    """Period-2 RMSE of each tuned model family next to the mean-predictor
    baseline, per target."""
    tuned = (fits or Fits(train)).all()

    def neighbours(tname: str, label: str) -> DataFrame:
        kp = knn.knn_predict(scored, train, "account_id", FEATURES, label, BEST_K[tname])
        return (scored.select("account_id", F.col(label).alias("y")).join(kp, "account_id")
                .select("y", F.col("prediction").alias("pred"))
                .withColumn("target", F.lit(tname)).withColumn("model", F.lit("knn")))

    jobs = []
    for tname, label in TARGETS.items():
        jobs += [partial(_scored, m, scored, label, {"target": tname, "model": n}) for n, m in tuned[tname].items()]
        jobs.append(partial(neighbours, tname, label))
    rm = _rmse_by(_union(_together(jobs)), ["target", "model"])
    base = scored.agg(*[r6(F.stddev_pop(c)).alias(t) for t, c in TARGETS.items()])
    base = (base.unpivot([], list(TARGETS), "target", "rmse").withColumn("model", F.lit("mean"))
            .withColumn("r2", F.lit(0.0)))
    return rm.unionByName(base.select("target", "model", "rmse", "r2"))


def top_predictions(train: DataFrame, scored: DataFrame, target: str = "optout", k: int = 10,
                    fits: Fits | None = None) -> DataFrame:
    """Each tuned model scores period 2; the k accounts with the highest
    predicted rate per model, next to the actual rate (group-limited window)."""
    label = TARGETS[target]
    models = (fits or Fits(train)).tuned(target)
    frames = [m.transform(scored).select("account_id", F.col(label).alias("actual"),
                                         F.col("prediction").alias("pred"), F.lit(n).alias("model"))
              for n, m in models.items()]
    kp = knn.knn_predict(scored, train, "account_id", FEATURES, label, BEST_K[target])
    frames.append(scored.select("account_id", F.col(label).alias("actual")).join(kp, "account_id")
                  .select("account_id", "actual", F.col("prediction").alias("pred"), F.lit("knn").alias("model")))
    w = Window.partitionBy("model").orderBy(F.col("pred").desc(), F.col("account_id").asc())
    return (_union(frames).withColumn("rnk", F.row_number().over(w).cast("bigint")).where(F.col("rnk") <= k)
            .select("model", "rnk", "account_id", "actual", r6(F.col("pred")).alias("pred")))


def risk_ranking(train: DataFrame, scored: DataFrame, top: int = 20, fits: Fits | None = None) -> DataFrame:
    """Two models on one frame: boosted trees (absolute loss, the tuned ones) for the spam
    rate, a depth-7 tree for the opt-out rate; blended for spam weights
    0.0..0.9, top accounts per weight by predicted risk."""
    from sendwatch.plans.score import blend_sweep_top

    opt_label = TARGETS["optout"]
    spam_m = fits.boosters()["spam"] if fits else fit_boosters(train, [tuned_spec("spam")])[0]
    opt_m = fit_trees(train, [(RISK_TREE_DEPTH, opt_label)], fits.cuts if fits else None)[0]
    s = spam_m.transform(scored).select("account_id", F.col("prediction").alias("spam_pred"))
    o = opt_m.transform(scored).select("account_id", F.col("prediction").alias("optout_pred"))
    preds = s.join(o, "account_id").join(scored.select("account_id", *TARGETS.values()), "account_id")
    return blend_sweep_top(preds, spam="spam_pred", optout="optout_pred", k=top)


# --- fixed values: grid-search settings of the reference study --------------
CV_FOLDS = 5
BAGGING_SIZES = [20, 30, 40, 50, 60, 70, 100, 200, 300, 400, 500]
BOOSTING_SIZES = [30, 40, 50, 60, 70, 100, 200, 300]
BOOSTING_LOSSES = ["huber", "lad"]
BOOSTING_DEPTHS = [2, 4, 6, 8]
# -----------------------------------------------------------------------------


def _with_folds(train: DataFrame, folds: int) -> DataFrame:
    """Deterministic fold id from the account hash (partition independent)."""
    return train.withColumn("fold", F.pmod(F.xxhash64("account_id"), F.lit(folds)).cast("int"))


def bagging_grid_cv(train: DataFrame, target: str = "optout", sizes: Sequence[int] = BAGGING_SIZES,
                    folds: int = CV_FOLDS, parallelism: int = 4) -> DataFrame:
    """Mean 5-fold R^2 of bagged full-depth trees for each ensemble size
    (bagging = random forest that considers every feature at every split)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    label = TARGETS[target]
    est = _bagging(label)
    grid = ParamGridBuilder().addGrid(est.numTrees, list(sizes)).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"), foldCol="fold",
                        seed=SEED)
    model = cv.fit(_with_folds(train, folds))
    rows = [(target, int(n), float(m)) for n, m in zip(sizes, model.avgMetrics)]
    return (train.sparkSession.createDataFrame(rows, "target string, n_estimators int, mean_r2 double")
            .withColumn("mean_r2", r6(F.col("mean_r2"))))


def boosting_grid_cv(train: DataFrame, targets: Sequence[str] = tuple(TARGETS), sizes: Sequence[int] = BOOSTING_SIZES,
                     losses: Sequence[str] = BOOSTING_LOSSES, depths: Sequence[int] = (3,), folds: int = CV_FOLDS
                     ) -> DataFrame:
    """(target, loss, max_depth, n_estimators, mean_r2): mean R^2 over folds for each grid point.

    Boosting is sequential and deterministic: the model of n trees is the first
    n trees of the largest. So each (target, loss, depth, fold) is one model,
    all of them grow in lockstep on one binned matrix, and every size is scored
    on the held-out fold in one pass."""
    data = materialize(_with_folds(train, folds).drop("features"))
    cuts = boosting.binning(data, FEATURES, MAX_BINS)
    specs = [boosting.Spec(TARGETS[t], loss, d, max(sizes), k)
             for t in targets for loss in losses for d in depths for k in range(folds)]
    fitted = boosting.fit(data, cuts, specs, folds="fold")
    label_of = {v: k for k, v in TARGETS.items()}
    labels = [TARGETS[t] for t in targets]
    # a model scores only the fold that it has not seen; the work is in the trees, not the bytes of the rows
    tasks = 2 * train.sparkSession.sparkContext.defaultParallelism
    staged = {}
    for k in range(folds):
        names = {f"m{i}": m for i, (s, m) in enumerate(zip(specs, fitted)) if s.fold == k}
        held = data.where(F.col("fold") == k).repartition(tasks)
        staged[k] = materialize(boosting.predict(held, cuts, names, labels, sizes))
    steps = sorted(set(sizes))
    parts = []
    for i, s in enumerate(specs):  # a row per grid point and fold: sums, then R^2
        held = staged[s.fold].select(F.col(s.label).alias("y"), F.posexplode(f"m{i}").alias("j", "p"))
        parts.append(held.groupBy("j").agg(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("mse"),
                                           F.var_pop("y").alias("var"))
                     .select(F.lit(label_of[s.label]).alias("target"), F.lit(s.loss).alias("loss"),
                             F.lit(s.depth).alias("max_depth"),
                             F.element_at(F.lit(steps), F.col("j") + 1).alias("n_estimators"),
                             (F.lit(1.0) - F.try_divide("mse", "var")).alias("r2")))
    return _union(parts).groupBy("target", "loss", "max_depth", "n_estimators").agg(r6(F.avg("r2")).alias("mean_r2"))


def best_grid_point(grid: DataFrame) -> DataFrame:
    """Per target the grid point of the largest mean R^2 (ties: fewer trees, lower depth, first loss)."""
    pick = F.min(F.struct((-F.col("mean_r2")).alias("m"), "n_estimators", "max_depth", "loss"))
    return grid.groupBy("target").agg(pick.alias("b")).select(
        "target", "b.loss", "b.max_depth", "b.n_estimators", (-F.col("b.m")).alias("mean_r2"))


def gbt_scores(train: DataFrame, scored: DataFrame, target: str = "spam", fits: Fits | None = None) -> DataFrame:
    """The target's tuned booster trained on period 1 and scoring period 2:
    account, actual rate, prediction."""
    booster = fits.boosters()[target] if fits else fit_boosters(train, [tuned_spec(target)])[0]
    return booster.transform(scored).select("account_id", TARGETS[target], r6(F.col("prediction")).alias("boosting_pred"))


def huber_scores(train: DataFrame, scored: DataFrame, sizes: Sequence[int] = HUBER_SIZES) -> DataFrame:
    """(target, account_id, actual, n_estimators, pred): Huber boosters of depth 3 for both
    targets, one fit each, every size a prefix of it."""
    specs = [boosting.Spec(label, "huber", 3, max(sizes)) for label in TARGETS.values()]
    fitted = fit_boosters(train, specs)
    steps = sorted(set(sizes))
    keep = ["account_id", *TARGETS.values()]
    staged = boosting.predict(scored, fitted[0].cuts, {t: b.model for t, b in zip(TARGETS, fitted)}, keep, steps)
    rows = F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).alias("actual"), F.col(t).alias("p"))
                              for t, c in TARGETS.items()]))
    return (staged.select("account_id", rows).select("target", "account_id", "actual", F.posexplode("p").alias("j", "pred"))
            .select("target", "account_id", "actual", F.element_at(F.lit(steps), F.col("j") + 1).alias("n_estimators"),
                    r6(F.col("pred")).alias("pred")))
