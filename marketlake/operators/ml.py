"""Features, splits, tree models and their evaluation on Spark ML."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions import factors as fx
from marketlake.operators import perf
from marketlake.operators import xsection as xs


def feature(name: str, lookback: int = 20) -> Column:
    """A feature column by name; an unknown name is null. Bars need a column r, the one-day return, for two of them."""
    made = {
        "return_1d": lambda: fx.pct_change("close", 1), "return_5d": lambda: fx.pct_change("close", 5), "return_20d": lambda: fx.pct_change("close", 20),
        "volatility": lambda: fx.volatility("r", lookback), "turnover_ratio": lambda: fx.turnover_ratio(lookback), "ma_ratio": lambda: fx.ma_ratio(lookback),
        "high_low_ratio": fx.high_low_ratio, "volume_price_corr": lambda: fx.rolling_corr("r", "volume", lookback),
    }
    return made[name]() if name in made else F.lit(None).cast("double")


def build_features(bars: DataFrame, configs: list[dict], lookforward: int = 5, label_type: str = "return") -> DataFrame:
    """(symbol, date, features..., label) from configs {name, lookback, transform}; transform is raw, zscore or rank over a symbol.

    Rows without any feature are dropped, other gaps take the column's mean. The label is the return, or whether it is
    positive, over the next rows; it stays null where there are none.
    """
    df = bars.withColumn("r", fx.pct_change("close", 1))
    names = [f"{c['name']}_{c.get('lookback', 20)}" if c["name"] not in ("return_1d", "return_5d", "return_20d", "high_low_ratio") else c["name"] for c in configs]
    df = df.withColumns({n: feature(c["name"], c.get("lookback", 20)) for n, c in zip(names, configs, strict=True)})
    df = df.withColumn("label", fx.forward_return(lookforward) if label_type == "return" else fx.forward_binary(lookforward))
    change = {"zscore": xs.ts_zscore, "rank": xs.ts_rank_pct}
    df = df.withColumns({n: change[c["transform"]](n) for n, c in zip(names, configs, strict=True) if c.get("transform") in change})
    df = df.select("symbol", F.to_date("ts").alias("date"), *names, "label").na.drop(how="all", subset=names)
    return xs.fill_mean(df, names)


def split_by_date(df: DataFrame, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Adds split: train up to the date at int(n * train), valid up to that at int(n * (train + valid)), then test. Dates are few."""
    days = df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = days.agg(F.count("*").alias("n"))
    cut = lambda r: F.floor(F.col("n") * r)
    bounds = days.join(F.broadcast(n)).agg(F.max(F.when(F.col("i") == cut(train), F.col("date"))).alias("t1"), F.max(F.when(F.col("i") == cut(train + valid), F.col("date"))).alias("t2"))
    out = df.join(F.broadcast(bounds))  # one row
    return out.withColumn("split", F.when(F.col("date") <= F.col("t1"), "train").when(F.col("date") <= F.col("t2"), "valid").otherwise("test")).drop("t1", "t2")


def fit_trees(train: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 6, rate: float = 0.05, seed: int = 42) -> GBTRegressionModel:
    """Boosted trees. Each level of each tree is a job over all rows, so they are kept, in partitions of some 50,000 rows: small tables are not cut into
    tasks that do nothing but start."""
    rows = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(train.filter(F.col(label).isNotNull())).select("x", label).persist()
    try:
        return _boosted(label, trees, depth, rate, seed).fit(rows.coalesce(max(1, rows.count() // 50_000)))
    finally:
        rows.unpersist()


def _boosted(label: str, trees: int, depth: int, rate: float, seed: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)


def predict(model: GBTRegressionModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(df)).drop("x")


def importances(model: GBTRegressionModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: -x[1])


def train(bars: DataFrame, configs: list[dict], version: str, lookforward: int = 5, **params: float) -> tuple[GBTRegressionModel, DataFrame]:
    """Build, split, fit and evaluate: the model and its row of model versions (version, split, errors, rank IC)."""
    df = build_features(bars, configs, lookforward)
    names = [c for c in df.columns if c not in ("symbol", "date", "label")]
    df = split_by_date(df)
    model = fit_trees(df.filter("split = 'train'"), names, **params)
    scored = predict(model, df.filter("split = 'valid' and label is not null"), names)
    metrics = perf.regression_metrics(scored, "prediction", "label").join(xs.ic_summary(xs.ic_series(scored, "prediction", "label")))  # one row each
    return model, metrics.withColumn("version", F.lit(version)).withColumn("production", F.lit(False))


def add_version(row: DataFrame, model: GBTRegressionModel | None, path: str) -> DataFrame:
    """The table of model versions under ``path`` with one row (version, created, production, metrics...) more; the model is saved beside it."""
    if model is not None:
        model.write().overwrite().save(f"{path}/models/{row.first()['version']}")
    row.write.mode("append").parquet(f"{path}/versions")
    return row.sparkSession.read.schema(row.schema).parquet(f"{path}/versions")


def load_model(spark: SparkSession, path: str, version: str | None = None) -> tuple[GBTRegressionModel, str]:
    """A saved model and its version: the one named, else the one in production."""
    if version is None:
        row = promoted_version(spark.read.parquet(f"{path}/versions")).first()
        if row is None:
            raise ValueError("no version is in production")
        version = row["version"]
    return GBTRegressionModel.load(f"{path}/models/{version}"), version


def score_with(spark: SparkSession, path: str, df: DataFrame, features: list[str], version: str | None = None) -> DataFrame:
    """Rows with the prediction of a saved model and its version."""
    model, name = load_model(spark, path, version)
    return predict(model, df, features).withColumn("version", F.lit(name))


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest row of the table of versions."""
    return versions.orderBy(F.col("created").desc(), F.col("version").desc()).limit(1)


def promoted_version(versions: DataFrame) -> DataFrame:
    """The row in production, the newest of them if there are several."""
    return latest_version(versions.filter("production"))


def promote(versions: DataFrame, version: str) -> DataFrame:
    """The table of versions with one of them in production."""
    return versions.withColumn("production", F.col("version") == version)


def decile_returns(df: DataFrame, pred: str, actual: str, by: str = "date") -> DataFrame:
    """Mean outcome of each tenth of the predictions within a date."""
    tile = F.ntile(10).over(Window.partitionBy(by).orderBy(pred, actual))
    return df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).withColumn("decile", tile).groupBy("decile").agg(F.avg(actual).alias("mean_return"), F.count("*").alias("n"))


def decile_summary(deciles: DataFrame) -> DataFrame:
    """(top_return, spread, monotonicity) of mean outcomes by decile: of the highest, less that of the lowest, and the share of steps that rise. Deciles are ten."""
    step = F.col("mean_return") > F.lag("mean_return").over(Window.orderBy("decile"))
    rows = deciles.withColumn("up", step.cast("double"))
    top, low = F.max_by("mean_return", "decile"), F.min_by("mean_return", "decile")
    return rows.agg(top.alias("top_return"), (top - low).alias("spread"), F.avg("up").alias("monotonicity"))
