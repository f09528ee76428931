"""Fixed baseline models: constants, ridge, logistic and a small tree, fitted on training rows only."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import stored

ALPHA, C, DEPTH, LEAF, SEED = 1.0, 1.0, 3, 8, 7
MODELS = ("zero", "mean", "frequency", "ridge", "logistic", "tree")


def medians(rows: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Exact medians: values are counted, counts run over value order in range partitions, and the middle
    one or two values are picked, so no task holds a column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    counts = rows.select(F.inline(pairs)).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("feature", "part").agg(F.sum("n").alias("held"))  # a row for each range and feature in it
    of = Window.partitionBy("feature")
    before = sizes.select("feature", "part", (F.sum("held").over(of.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(of).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("value")) + F.col("before")
    placed = ranged.join(before, ["feature", "part"]).withColumn("upto", upto)
    middle = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    picked = placed.where(middle(low) | middle(high)).groupBy("feature").agg(((F.min("value") + F.max("value")) / 2).alias("median")).collect()
    return dict.fromkeys(names) | {r["feature"]: r["median"] for r in picked}


def preprocess_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, n, n_missing, median, mean, std (population, after median imputation), constant."""
    middle = medians(rows, names)
    stats = []
    for n in names:
        filled = F.coalesce(F.col(n), F.lit(middle[n]))
        stats.append(F.struct(F.lit(n).alias("feature"), F.count("*").alias("n"), F.count_if(F.col(n).isNull()).alias("n_missing"), F.lit(middle[n]).cast("double").alias("median"), F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("std"), F.coalesce(F.min(filled) == F.max(filled), F.lit(True)).alias("constant")))
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def transform(rows: DataFrame, stats: DataFrame, *, scale: bool) -> tuple[DataFrame, list[str]]:
    """Median-imputed, optionally standardised features; constant and all-missing ones go."""
    used = [r for r in stats.collect() if not r["constant"] and r["median"] is not None]
    out = {}
    for r in used:
        filled = F.coalesce(F.col(r["feature"]), F.lit(r["median"]))
        out[f"z_{r['feature']}"] = (filled - r["mean"]) / r["std"] if scale else filled
    return rows.withColumns(out), list(out)


def fit(rows: DataFrame, names: list[str], target: str, model: str):
    """A function from rows to rows with ``prediction`` (a return, or a probability of up)."""
    if model not in MODELS:
        raise ValueError(f"model has to be one of {MODELS}")
    if model == "zero":
        return lambda df: df.withColumn("prediction", F.lit(0.0))
    if model == "mean":
        value = rows.agg(F.avg(target)).first()[0]
        return lambda df: df.withColumn("prediction", F.lit(value))
    if model == "frequency":
        value = rows.agg((F.count_if(F.col(target) > 0) + 1) / (F.count("*") + 2)).first()[0]
        return lambda df: df.withColumn("prediction", F.lit(float(value)))
    stats = preprocess_stats(rows, names)
    data, columns = transform(rows, stats, scale=model != "tree")
    vectors = VectorAssembler(inputCols=columns, outputCol="_x")
    counts = data.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("sd")).first()
    train = vectors.transform(data.withColumn("_y", F.col(target).cast("double")))
    if model == "ridge":
        # MLlib scales the target by its deviation; this penalty gives the plain sum-of-squares objective
        estimator = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", elasticNetParam=0.0, standardization=False, regParam=ALPHA * (counts["sd"] or 1.0) / counts["n"])
    elif model == "logistic":
        train = train.withColumn("_y", (F.col(target) > 0).cast("double"))
        estimator = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (C * counts["n"]), standardization=False, tol=1e-10, maxIter=200)
    else:
        estimator = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=256, seed=SEED)
    fitted = estimator.fit(train)

    def predict(df: DataFrame) -> DataFrame:
        ready, _ = transform(df, stats, scale=model != "tree")
        out = fitted.transform(vectors.transform(ready))
        value = vector_to_array("probability")[1] if model == "logistic" else F.col("prediction")
        keep = [F.col(c) for c in df.columns if c != "prediction"]
        return out.select(*keep, value.alias("prediction"))

    return predict


def constant(value: float) -> dict:
    return {"kind": "constant", "value": float(value)}


def _nested(node) -> list | float:
    """A tree as nested lists [place of the feature, threshold, left, right]; a leaf is its value."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = node.impurityStats()
        counts = [float(stats.stats()[k]) for k in range(len(stats.stats()))]
        return counts[1] / sum(counts) if len(counts) == 2 else float(node.prediction())
    split = node.split()
    return [int(split.featureIndex()), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())]


def parameters(rows: DataFrame, names: list[str], target: str, model: str, task: str) -> dict:
    """What a fitted model is made of, as plain values: kind, medians of missing values and the model's numbers."""
    if model == "zero":
        return constant(0.0)
    if model == "mean":
        return constant(rows.agg(F.avg(target)).first()[0])
    if model == "frequency":
        return constant(rows.agg((F.count_if(F.col(target) > 0) + 1) / (F.count("*") + 2)).first()[0])
    stats = preprocess_stats(rows, names)
    used = [r for r in stats.collect() if not r["constant"] and r["median"] is not None]
    if not used:
        raise ValueError("no informative feature")
    data, columns = transform(rows, stats, scale=model != "tree")
    train = VectorAssembler(inputCols=columns, outputCol="_x").transform(data.withColumn("_y", F.col(target).cast("double"))).select("_x", "_y")
    inputs = [{"feature": r["feature"], "median": r["median"], "mean": 0.0 if model == "tree" else r["mean"], "scale": 1.0 if model == "tree" else r["std"]} for r in used]
    if model == "tree":
        kind = DecisionTreeClassifier if task == "classification" else DecisionTreeRegressor
        fitted = kind(featuresCol="_x", labelCol="_y", maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=256, seed=SEED).fit(train)
        return {"kind": "tree", "inputs": inputs, "tree": _nested(fitted._call_java("rootNode"))}
    n, sd = train.agg(F.count("*"), F.stddev_pop("_y")).first()
    if model == "ridge":
        fitted = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", elasticNetParam=0.0, standardization=False, regParam=ALPHA * (sd or 1.0) / n).fit(train)
    else:
        fitted = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (C * n), standardization=False, tol=1e-10, maxIter=200).fit(train)
    return {"kind": "linear", "inputs": inputs, "link": "logistic" if model == "logistic" else "identity", "weights": [float(w) for w in fitted.coefficients], "intercept": float(fitted.intercept)}


def expression(saved: dict) -> Column:
    """A model's prediction as an expression of the feature columns."""
    if saved["kind"] == "constant":
        return F.lit(float(saved["value"]))
    z = [(F.coalesce(F.col(i["feature"]), F.lit(i["median"])) - i["mean"]) / i["scale"] for i in saved["inputs"]]
    if saved["kind"] == "linear":
        total = F.lit(saved["intercept"])
        for x, w in zip(z, saved["weights"]):
            total = total + x * w
        grown = F.exp(-F.abs(total))  # never overflows
        return total if saved["link"] == "identity" else F.when(total >= 0, 1 / (1 + grown)).otherwise(grown / (1 + grown))

    def walk(node) -> Column:
        if not isinstance(node, list):
            return F.lit(float(node))
        feature, threshold, left, right = node
        return F.when(z[feature] <= threshold, walk(left)).otherwise(walk(right))

    return walk(saved["tree"])
