"""Train/test split and a baseline model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, is_numeric, is_text, quoted
from ..session import materialize


def _share(key: list[str], seed: int) -> Column:
    """Number in [0, 1) from the first 32 bits of an md5 over the key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


BITS, WHOLE = 12, 60        # hash bits of one histogram, and of the whole hash


def _thresholds(rows: DataFrame, test: float) -> DataFrame:
    """(cls, cut): of each class of ``rows`` (cls, h) the share ``test`` has hashes below ``cut``.

    A class's rows are counted by hash bucket, the bucket in which its share ends is found, and only that bucket is counted again by finer
    buckets, until the share ends between two of them or a bucket holds one hash. Rows that share a key and so a hash stay together.
    """
    sizes = rows.groupBy("cls").agg(F.count("*").alias("n")).withColumn("want", F.round(F.col("n") * test).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    state = materialize(sizes.select("cls", "want", zero.alias("prefix"), zero.alias("taken"), F.when(F.col("want") == 0, zero).alias("cut")), "cuts")
    for level in range(1, WHOLE // BITS + 1):
        left = WHOLE - BITS * level
        going = state.where("cut is null").select(F.col("cls").alias("c"), "want", "prefix", "taken")
        if not going.limit(1).count():
            break
        inside = rows.join(going, F.col("cls").eqNullSafe(F.col("c"))).where(F.shiftright("h", left + BITS) == F.col("prefix"))
        counts = inside.groupBy("cls", "want", "taken", F.shiftright("h", left).alias("bucket")).agg(
            F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.col("taken") + F.sum("n").over(Window.partitionBy("cls").orderBy("bucket"))       # 4,096 rows a class at most
        ends = (counts.withColumn("upto", upto).where(F.col("upto") >= F.col("want")).groupBy(F.col("cls").alias("c"))
                .agg(F.min(F.struct("bucket", "upto", "n", "low", "high")).alias("e")))
        before, upto = F.col("e.upto") - F.col("e.n"), F.col("e.upto")
        nearer = F.when(upto - F.col("want") <= F.col("want") - before, F.col("e.high") + 1).otherwise(F.col("e.low"))
        cut = F.coalesce("cut", F.when(upto == F.col("want"), F.col("e.high") + 1).when(F.col("e.low") == F.col("e.high"), nearer))
        state = materialize(state.join(ends, F.col("cls").eqNullSafe(F.col("c")), "left").select(
            "cls", "want", F.coalesce("e.bucket", "prefix").alias("prefix"), F.coalesce(before, "taken").alias("taken"), cut.alias("cut")), "cuts")
    return state.select("cls", "cut")


def assign_split(df: DataFrame, key: list[str] | str, test: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Adds ``split`` = train or test from a hash of the row key: no shuffle, and
    a row always lands on the same side.

    With ``stratify`` exactly the share ``test`` of every class is set aside, the rows
    whose hashes are below the class's threshold. Rows that repeat a key stay together, so a class with such rows can miss its share by as many.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if stratify is None:
        return df.withColumn("split", F.when(_share(keys, seed) < test, "test").otherwise("train"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[quoted(k) for k in keys]), 64 - WHOLE)
    cuts = _thresholds(materialize(df.select(quoted(stratify).cast("string").alias("cls"), h.alias("h")), "hashes"), test)
    names = {c: f"_{c}_of_split" for c in cuts.columns}
    cuts = cuts.select(*[F.col(c).alias(n) for c, n in names.items()])      # one row a class: Spark broadcasts it when its size allows
    joined = df.join(cuts, quoted(stratify).cast("string").eqNullSafe(F.col(names["cls"])))
    return joined.select(*[quoted(c) for c in df.columns], F.when(h < F.col(names["cut"]), "test").otherwise("train").alias("split"))


def train_test_split(df: DataFrame, key: list[str] | str, test: float = 0.2, seed: int = 42,
                     stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    both = assign_split(df, key, test, seed, stratify)
    return both.where(F.col("split") == "train").drop("split"), both.where(F.col("split") == "test").drop("split")


def baseline(df: DataFrame, target: str, task: str = "classification", key: list[str] | str | None = None, trees: int = 100,
             seed: int = 42, max_categories: int = 100) -> DataFrame:
    """Random forest on the complete rows; one row with the test score.

    Accuracy for classification, R² for regression. Text columns are indexed;
    those with more than ``max_categories`` values by two independent hashes of
    as many buckets, which together tell values apart. ``columns`` are the
    columns the model used.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from .value_counts import distinct_counts

    df = fold_nan(df).na.drop("any")
    numeric = [f.name for f in df.schema.fields if is_numeric(f) and f.name != target]
    text = [f.name for f in df.schema.fields if is_text(f) and f.name != target]
    many = []
    if text:
        few = {r["column"] for r in distinct_counts(df, text).collect() if r["unique_count"] <= max_categories}
        many, text = [c for c in text if c not in few], [c for c in text if c in few]
    names = {c: f"f{i}" for i, c in enumerate(numeric + text + many)}
    classify = task != "regression"
    label = quoted(target).cast("string") if classify else quoted(target).cast("double")
    keys = [key] if isinstance(key, str) else list(key) if key else df.columns
    bucket = lambda c, n: F.pmod(F.xxhash64(F.lit(n), quoted(c)), F.lit(max_categories)).cast("string")
    hashed = {f"{names[c]}_h{n}": bucket(c, n) for c in many for n in range(2)}
    indexed = [names[c] for c in text] + list(hashed)
    data = assign_split(df, keys, seed=seed).select(
        label.alias("target"), "split", *[quoted(c).cast("double").alias(names[c]) for c in numeric], *[quoted(c).alias(names[c]) for c in text],
        *[h.alias(n) for n, h in hashed.items()])
    stages = []
    if indexed:
        stages.append(StringIndexer(inputCols=indexed, outputCols=[c + "_i" for c in indexed], handleInvalid="keep"))
    inputs = [names[c] for c in numeric] + [c + "_i" for c in indexed]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    common = dict(featuresCol="features", numTrees=trees, seed=seed, maxBins=max(32, max_categories + 2))
    if classify:
        stages.insert(0, StringIndexer(inputCol="target", outputCol="label", handleInvalid="keep"))
        stages.append(RandomForestClassifier(labelCol="label", **common))
        judge, metric = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), "accuracy"
    else:
        stages.append(RandomForestRegressor(labelCol="target", **common))
        judge, metric = RegressionEvaluator(labelCol="target", metricName="r2"), "r2"
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    model = Pipeline(stages=stages).fit(train)
    predicted = model.transform(test)
    score = judge.evaluate(predicted)
    return predicted.agg(F.count("*").alias("test_rows")).select(
        F.lit(task).alias("task"), F.lit(metric).alias("metric"), F.round(F.lit(score), 4).alias("score"), "test_rows",
        F.array(*[F.lit(c) for c in numeric + text + many]).alias("columns"))
