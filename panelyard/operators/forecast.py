"""Lagged features, time-ordered folds, model search and multi-horizon forecasting."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.operators.metrics import best_threshold, calibration, confusion, evaluate, ranking_scores
from panelyard.session import checkpointed


def add_lags(panel: DataFrame, area: str, columns: Sequence[str], months: int, date: str = "panel_date") -> DataFrame:
    """Each column's value ``months`` rows earlier in the same area."""
    by_time = Window.partitionBy(area).orderBy(date)
    return panel.withColumns({f"{c}_lag{months}": F.lag(c, months).over(by_time) for c in columns if c in panel.columns})


def modelling_table(
    panel: DataFrame,
    months: int,
    area: str = "SubCounty",
    dynamic: Sequence[str] = tuple(fv.DYNAMIC_FEATURES),
    static: Sequence[str] = tuple(fv.STATIC_FEATURES),
    target: str = fv.TARGET,
    date: str = "panel_date",
    year: str = "Year",
) -> tuple[DataFrame, list[str]]:
    """Rows with a full lag history and target, and the feature names.

    Static features are kept even when null in the table; ``fit`` drops rows
    with a null feature, since no model can take them.
    """
    lagged = add_lags(panel, area, dynamic, months, date)
    lags = [f"{c}_lag{months}" for c in dynamic if c in panel.columns]
    features = lags + [c for c in static if c in panel.columns]
    keys = [c for c in ("County", "county", area, date, year) if c in panel.columns]
    table = lagged.select(*dict.fromkeys(keys), *features, F.col(target).cast("int").alias("label"))
    return table.dropna(subset=[*lags, "label"]), features


def temporal_split(df: DataFrame, cutoff: int = fv.CUTOFF_YEAR, year: str = "Year") -> tuple[DataFrame, DataFrame]:
    """Before the cutoff year, and from it on."""
    return df.filter(F.col(year) < cutoff), df.filter(F.col(year) >= cutoff)


def time_folds(df: DataFrame, splits: int = 5, date: str = "panel_date") -> DataFrame:
    """Add ``fold``: 0 is only trained on; fold k validates after training on all lower folds.

    Distinct dates (bounded by the calendar) are cut into splits+1 runs, so a
    month is never on both sides.
    """
    dates = df.select(date).distinct()
    cut = dates.select(date, (F.ntile(splits + 1).over(Window.orderBy(date)) - 1).alias("fold"))
    return df.join(cut, date)


# --- models ---------------------------------------------------------------------------

def _weights(df: DataFrame, balanced: bool) -> DataFrame:
    """Row weight n / (2 * class size) when balanced, else 1."""
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    by_class = [F.when(F.col("label") == k, F.lit(total / (len(n) * v))) for k, v in n.items()]
    return df.withColumn("weight", F.coalesce(*by_class))


def logistic(features: Sequence[str], rows: int, C: float = 1.0, **_) -> Pipeline:
    """Scaled logistic regression; the penalty 1/C is spread over the rows."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                labelCol="label", weightCol="weight", maxIter=1000, regParam=1.0 / (C * max(rows, 1)), elasticNetParam=0.0
            ),
        ]
    )


def forest(features: Sequence[str], rows: int, trees: int = 200, depth: int | None = 10, leaf: int = 1, seed: int = 42, **_) -> Pipeline:
    """Random forest; an open depth is the largest Spark allows."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
            RandomForestClassifier(
                labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth if depth is not None else 30,
                minInstancesPerNode=leaf, seed=seed,
            ),
        ]
    )


def boosting(
    features: Sequence[str], rows: int, rounds: int = 100, depth: int = 5, rate: float = 0.1, row_share: float = 1.0,
    column_share: float = 1.0, leaf: int = 1, seed: int = 42, **_,
) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
            GBTClassifier(
                labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate,
                subsamplingRate=row_share, featureSubsetStrategy=str(column_share) if column_share < 1 else "all",
                minInstancesPerNode=leaf, seed=seed,
            ),
        ]
    )


def grid(choices: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]


def draws(choices: dict[str, Sequence], n: int = fv.BOOSTING_DRAWS, seed: int = 42) -> list[dict]:
    """``n`` distinct random settings (all of them when there are fewer)."""
    size = 1
    for values in choices.values():
        size *= len(values)
    rng = random.Random(seed)
    settings = []
    for number in rng.sample(range(size), min(n, size)):
        one = {}
        for name, values in choices.items():
            number, at = divmod(number, len(values))
            one[name] = values[at]
        settings.append(one)
    return settings


# model name: (pipeline builder, settings to search, class weights always on)
MODELS: dict[str, tuple[Callable[..., Pipeline], Callable[[], list[dict]], bool]] = {
    "Logistic Regression": (logistic, lambda: grid(fv.LOGISTIC_GRID), False),
    "Random Forest": (forest, lambda: grid(fv.FOREST_GRID), False),
    "Gradient Boosting": (boosting, lambda: draws(fv.BOOSTING_CHOICES), True),
}


def score_rows(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class."""
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*extra)


def fit(build: Callable[..., Pipeline], train: DataFrame, features: Sequence[str], setting: dict, always_weighted: bool = False) -> PipelineModel:
    known = train.dropna(subset=list(features))
    weighted = _weights(known, always_weighted or bool(setting.get("balanced")))
    return build(features, known.count(), **setting).fit(weighted)


def out_of_fold(build, folded: DataFrame, features, setting: dict, splits: int, always_weighted: bool = False) -> DataFrame | None:
    """Scores of every validation fold from a model that saw only earlier folds; one-class folds are skipped."""
    parts = None
    for k in range(1, splits + 1):
        before, now = folded.filter(F.col("fold") < k), folded.filter(F.col("fold") == k)
        if before.select("label").distinct().count() < 2:
            continue
        scored = score_rows(fit(build, before, features, setting, always_weighted), now.dropna(subset=list(features)))
        part = scored.select("fold", "label", "score")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def search(
    name: str, train: DataFrame, features: Sequence[str], splits: int = 5, settings: list[dict] | None = None,
    date: str = "panel_date",
) -> tuple[PipelineModel, dict, float]:
    """Best setting by mean fold ROC-AUC, refitted on all training rows, with its tuned threshold."""
    build, default_settings, weighted = MODELS[name]
    folded = time_folds(train, splits, date).persist()
    best = None
    tried = settings if settings is not None else default_settings()
    for setting in tried:
        oof = out_of_fold(build, folded, features, setting, splits, weighted)
        if oof is None:
            continue
        mean_auc = ranking_scores(oof, "score", "label", ["fold"]).agg(F.avg("roc_auc")).first()[0]
        if mean_auc is not None and (best is None or mean_auc > best[0]):
            best = (mean_auc, setting, oof)
    setting = best[1] if best else tried[0]
    threshold = best_threshold(best[2], "score", "label").first() if best else None
    model = fit(build, train, features, setting, weighted)
    folded.unpersist()
    return model, setting, threshold["threshold"] if threshold else 0.5


def run_horizons(
    panel: DataFrame,
    area: str,
    dynamic: Sequence[str],
    static: Sequence[str] = (),
    target: str = fv.TARGET,
    horizons: Sequence[int] = tuple(fv.HORIZONS_MONTHS),
    models: dict[str, list[dict] | None] | None = None,
    cutoff: int = fv.CUTOFF_YEAR,
    splits: int = 5,
    date: str = "panel_date",
    always: bool = False,
) -> dict[str, DataFrame]:
    """All horizons and models: scores, metrics, confusion and calibration tables.

    A horizon whose training part has one class only is left out. When all are,
    there is no table, or with ``always`` each one without rows. Every table
    carries ``horizon_months`` and ``model``.
    """
    base = checkpointed(panel)
    scored = thresholds = None
    for months in horizons:
        table, features = modelling_table(base, months, area, dynamic, static, target, date)
        train, test = temporal_split(table, cutoff)
        if train.select("label").distinct().count() < 2:
            continue
        for name, settings in (models or dict.fromkeys(MODELS)).items():
            model, _, cut = search(name, train, features, splits, settings, date)
            tags = [F.lit(months).alias("horizon_months"), F.lit(name).alias("model")]
            part = score_rows(model, test.dropna(subset=features)).select(*tags, area, date, "label", "score")
            one = panel.sparkSession.createDataFrame([(months, name, float(cut))], "horizon_months int, model string, threshold double")
            scored = part if scored is None else scored.unionByName(part)
            thresholds = one if thresholds is None else thresholds.unionByName(one)
    if scored is None:
        if not always:
            return {}
        tags = [F.lit(0).alias("horizon_months"), F.lit("").alias("model")]
        scored = base.select(*tags, area, date, F.lit(0).alias("label"), F.lit(0.0).alias("score")).limit(0)
        thresholds = scored.select("horizon_months", "model", F.col("score").alias("threshold"))
    by = ["horizon_months", "model"]
    scored = checkpointed(scored)
    cut = F.col("score") >= F.col("threshold")
    return {
        "scores": scored,
        "metrics": evaluate(scored, "score", "label", by, thresholds),
        "confusion": confusion(scored.join(thresholds, by), "label", cut, by),
        "calibration": calibration(scored, "score", "label", by),
    }


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importances of the last stage as rows (tree models)."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
