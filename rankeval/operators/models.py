"""Click models on Spark's gradient-boosted trees, trained and compared over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankeval.operators.metrics import auc, log_loss, ndcg
from rankeval.operators.reports import label_union
from rankeval.operators.sampling import class_weights, holdout
from rankeval.sources.staging import scratch_path, stage


def _fit(
    train: DataFrame, features: Sequence[str], label: str, weight: str | None, max_iter: int, depth: int,
    step: float, validation: str | None, seed: int,
) -> PipelineModel:
    trees = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=max_iter, maxDepth=depth, stepSize=step, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", seed=seed, predictionCol="_prediction",
    )
    trees.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    if weight:
        trees.setWeightCol(weight)
    if validation:
        trees.setValidationIndicatorCol(validation)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    # boosting reads the rows once per tree; the narrow copy spares it the joins behind them
    narrow = stage(train.select(*dict.fromkeys([*features, label, *filter(None, [weight, validation])])))
    return Pipeline(stages=[assembler, trees]).fit(narrow)


def predict(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    scored = model.transform(df).withColumn(name, vector_to_array("_probability")[1])
    return scored.drop("_features", "_probability", "_raw", "_prediction")


def ctr_model(
    train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, balance: bool = True,
    max_iter: int = 500, depth: int = 6, step: float = 0.05, validation: str | None = None, seed: int = 42,
) -> PipelineModel:
    """L1: boosted trees; with ``balance`` clicks weigh (negatives / positives)."""
    if balance:
        ratio = class_weights(train, label).select("scale_pos_weight").scalar()
        base = F.col(weight) if weight else F.lit(1.0)
        train = train.withColumn("_w", base * F.when(F.col(label) == 1, ratio).otherwise(1.0))
        weight = "_w"
    return _fit(train, features, label, weight, max_iter, depth, step, validation, seed)


def evaluate(scored: DataFrame, label: str = "label", by: Sequence[str] = (), feed: str | None = None, score: str = "score") -> DataFrame:
    """AUC and log loss (and NDCG@10 when ``feed`` is given) of a scored table."""
    by = list(by)
    area, loss = auc(scored, score, label, by), log_loss(scored, score, label, by)
    order = ndcg(scored, feed, label, score, 10, by) if feed else None
    if by:
        out = area.join(loss, by)
        return out.join(order.drop("feeds"), by, "left") if feed else out
    out = area.withColumn("log_loss", loss.select("log_loss").scalar())
    return out.withColumn("ndcg", order.select("ndcg").scalar()) if feed else out


def debias_models(
    train: DataFrame, test: DataFrame, features: Sequence[str], position: str = "position_rank", weight: str = "ipw_weight",
    label: str = "label", max_iter: int = 300, depth: int = 6, validation: str | None = None, seed: int = 42,
) -> tuple[dict[str, PipelineModel], dict[str, DataFrame]]:
    """L2: baseline, position-aware scored at position 0, the same with its position, propensity-weighted.

    Returns the three models and the four scored test sets.
    """
    args = dict(label=label, balance=False, max_iter=max_iter, depth=depth, validation=validation, seed=seed)
    models = {
        "baseline": ctr_model(train, features, **args),
        "position_aware": ctr_model(train, [*features, position], **args),
        "ipw_weighted": ctr_model(train, features, weight=weight, **args),
    }
    true_position = f"_true_{position}"
    dropped = test.withColumn(true_position, F.col(position)).withColumn(position, F.lit(0))
    at_zero = predict(models["position_aware"], dropped)
    scored = {
        "baseline": predict(models["baseline"], test),
        "position_aware_dropped": at_zero.withColumn(position, F.col(true_position)).drop(true_position),
        "position_aware_leak": predict(models["position_aware"], test),
        "ipw_weighted": predict(models["ipw_weighted"], test),
    }
    return models, scored


def compare(scored: Mapping[str, DataFrame], label: str = "label", feed: str | None = None) -> DataFrame:
    """L2, L4, U4: one metric row per scored table."""
    return label_union({n: evaluate(d, label, (), feed) for n, d in scored.items()}, "model")


def train_test_matrix(
    train: Mapping[str, DataFrame], test: Mapping[str, DataFrame], features: Sequence[str], keys: Sequence[str],
    label: str = "label", max_iter: int = 500, depth: int = 6, seed: int = 42,
) -> DataFrame:
    """Every training set against every test set, with a hashed tenth held out for early stopping."""
    rows = {}
    for trained_on, rows_in in train.items():
        flagged = holdout(rows_in, keys)
        model = ctr_model(flagged, features, label, balance=False, max_iter=max_iter, depth=depth, validation="is_holdout", seed=seed)
        for tested_on, t in test.items():
            metrics = evaluate(predict(model, t), label).select("n", "auc", "log_loss")
            rows[f"{trained_on}|{tested_on}"] = metrics.select(
                F.lit(trained_on).alias("trained_on"), F.lit(tested_on).alias("tested_on"), "*"
            )
    return label_union(rows, "pair").drop("pair")


def cross_eval(
    models: Mapping[str, PipelineModel], test: DataFrame, label: str = "label", feed: str = "feed_id",
    position: str = "position_rank", drop_position: Sequence[str] = (),
) -> DataFrame:
    """L4: all models on one test set; models named in ``drop_position`` see position 0."""
    scored = {
        n: predict(m, test.withColumn(position, F.lit(0)) if n in drop_position else test) for n, m in models.items()
    }
    return compare(scored, label, feed)


def tree_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The nodes of a model's trees as rows, as Spark saves them: ``tree``, ``node``, ``feature`` (null for a leaf), ``gain``, ``rows``."""
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    names = F.array(*[F.lit(c) for c in model.stages[0].getInputCols()])
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return saved.select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(inner, F.get(names, node["split"]["featureIndex"])).alias("feature"),
        F.when(inner, node["gain"]).alias("gain"), node["rawCount"].alias("rows"))


def feature_importance(spark: SparkSession, models: Mapping[str, PipelineModel], top: int | None = None) -> DataFrame:
    """Importance, number of splits and their mean gain of each feature per model, most important first (``top`` of them if
    given); features that no split uses have none."""
    rows = []
    for name, model in models.items():
        weights = model.stages[-1].featureImportances.toArray()
        pairs = sorted(zip(model.stages[0].getInputCols(), weights), key=lambda p: (-p[1], p[0]))
        rows += [(name, f, float(w), i) for i, (f, w) in enumerate(pairs[:top])]
    listed = spark.createDataFrame(rows, "model string, feature string, importance double, rank int")
    used = [tree_nodes(spark, m).where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.avg("gain").alias("mean_gain")).withColumn("model", F.lit(n)) for n, m in models.items()]
    if not used:
        return listed.withColumn("splits", F.lit(0).cast("long")).withColumn("mean_gain", F.lit(None).cast("double"))
    counts = reduce(DataFrame.unionByName, used)
    return listed.join(counts, ["model", "feature"], "left").withColumn("splits", F.coalesce("splits", F.lit(0).cast("long")))
