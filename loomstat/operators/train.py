"""Training, cross-validation, comparison, tuning and scoring on ``pyspark.ml``.

Feature preparation is part of the fitted ``PipelineModel`` (text columns →
``nan`` for null → alphabetical codes by a distributed mapping; numeric nulls →
the exact medians of all labelled rows, test rows included, as in the reference
workflow; ``VectorAssembler``; a ``StandardScaler`` for the distance-based models),
so scoring can never drift from training.  Classes of any coding (text, boolean,
{-1, 1}, {1, 2}, ...) are numbered in ascending order outside the pipeline; the last
one is the positive class, and the pipeline ends by naming the predicted class.

Model keys (fixed values): classifiers lr svm rf dtc knn nb xgb; regressors
lir pr lar rr dtr rfr xgb.  Regularisation is converted to MLlib's
objectives: logistic ``C`` → ``regParam = 1/(C·n)``; ridge ``alpha`` →
``alpha·std(y)/n`` (the normal solver scales its L2 term by the label std);
lasso ``alpha`` is already MLlib's L1 weight.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import (IndexToString, PolynomialExpansion, SQLTransformer, StandardScaler,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.exprs import col_of, is_datetime_type, is_numeric_type, nan_to_null, text_of
from loomstat.functions.quantiles import column_quantiles
from loomstat.operators import metrics as M
from loomstat.operators.boosting import NewtonBoost
from loomstat.operators.least_squares import LeastSquares
from loomstat.operators.split import kfold, split_dataset
from loomstat.operators.stages import TextCodes
from loomstat.operators.trees import ExactForest, ExactTree

CLASSIFIERS = ("lr", "svm", "rf", "dtc", "knn", "nb", "xgb")
REGRESSORS = ("lir", "pr", "lar", "rr", "dtr", "rfr", "xgb")
MIN_ROWS = {"classification": 20, "regression": 10}
# Default search grids per model key.
DEFAULT_GRIDS: dict[str, dict] = {
    "svm": {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"]},
    "rf": {"n_estimators": [10, 50, 100], "max_depth": [None, 5, 10]},
    "xgb": {"max_depth": [3, 5, 7], "eta": [0.1, 0.3], "n_estimators": [50, 100]},
    "knn": {"n_neighbors": [3, 5, 7, 11]},
    "lr": {"C": [0.01, 0.1, 1, 10]},
    "dtc": {"max_depth": [None, 3, 5, 10]},
    "rfr": {"n_estimators": [10, 50, 100], "max_depth": [None, 5, 10]},
    "dtr": {"max_depth": [None, 3, 5, 10]},
    "lar": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "rr": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "lir": {},
}
LABEL, FEATURES, SCALED = "label", "features", "features_scaled"
MAX_CLASSES = 10_000  # class names are kept in the fitted pipeline; a target with more is refused
PART_ROWS = 1_000_000  # rows of a stored partition
PARALLELISM = 4       # fits that run at the same time in comparisons, searches and curves


# ------------------------------------------------------------------ features
@dataclass
class FeaturePlan:
    target: str
    features: list[str]
    text: list[str]
    numeric: list[str]
    medians: dict[str, float]
    #: Class names in ascending order (classification), else None.
    labels: list[str] | None = None


def class_names(df: DataFrame, target: str) -> list[str]:
    """The classes of a target as text, in ascending order of the values themselves."""
    rows = (df.select(col_of(target).alias("v")).where("v IS NOT NULL").distinct().orderBy("v")
            .select(F.col("v").cast("string")).limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"target {target!r} has more than {MAX_CLASSES} classes; is it a regression target?")
    return [r[0] for r in rows]


def plan_features(df: DataFrame, target: str, features: list[str] | None = None, null_fill: str = "median",
                  task: str = "regression") -> FeaturePlan:
    """Choose feature columns (all but the target), fit the fill values and, for classification, list the classes."""
    feats = features or [c for c in df.columns if c != target]
    numeric = [c for c in feats if is_numeric_type(df.schema[c].dataType) or is_datetime_type(df.schema[c].dataType)
               or isinstance(df.schema[c].dataType, T.BooleanType)]
    medians: dict[str, float] = {}
    if numeric and null_fill == "median":
        nulls = df.agg(*[F.count_if(col_of(c).isNull()).alias(c) for c in numeric]).first()
        need = [c for c in numeric if nulls[c] > 0]
        if need:
            q = column_quantiles(df.select(*[_num(df, c).alias(c) for c in need]), need, [0.5])
            medians = {c: q.get((c, 0.5)) for c in need}
    return FeaturePlan(target, feats, [c for c in feats if c not in numeric], numeric, medians,
                       class_names(df, target) if task == "classification" else None)


def with_label(df: DataFrame, target: str, labels: list[str] | None) -> DataFrame:
    """Add the numeric label: the class number (an unknown class is an error), or the value itself."""
    if labels is None:
        return df.withColumn(LABEL, col_of(target).cast("double"))
    indexer = StringIndexerModel.from_labels(labels, inputCol="__y", outputCol=LABEL, handleInvalid="error")
    return indexer.transform(df.withColumn("__y", text_of(target))).drop("__y")


def _num(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if is_datetime_type(dt):
        return F.unix_micros(col_of(c).cast("timestamp")).cast("double") / 1e6
    return col_of(c).cast("double")


def _sql_num(df: DataFrame, c: str) -> str:
    dt = df.schema[c].dataType
    if is_datetime_type(dt):
        return f"unix_micros(CAST(`{c}` AS TIMESTAMP)) / 1e6"
    return f"CAST(`{c}` AS DOUBLE)"


def feature_stages(df: DataFrame, plan: FeaturePlan, scale: bool, poly_degree: int | None = None) -> tuple[list, str]:
    """Stages from raw columns to the feature vector, and the vector's column."""
    exprs = []
    for c in plan.numeric:
        fill = plan.medians.get(c)
        exprs.append(f"coalesce(nanvl({_sql_num(df, c)}, NULL), {float(fill) if fill is not None else 0.0}) AS `__n_{c}`")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")] if exprs else []
    if plan.text:
        stages.append(TextCodes(plan.text, [f"__i_{c}" for c in plan.text]))
    cols = [f"__n_{c}" if c in plan.numeric else f"__i_{c}" for c in plan.features]
    stages.append(VectorAssembler(inputCols=cols, outputCol=FEATURES))
    out = FEATURES
    if poly_degree:
        stages.append(PolynomialExpansion(degree=poly_degree, inputCol=FEATURES, outputCol="features_poly"))
        out = "features_poly"
    if scale:
        stages.append(StandardScaler(inputCol=out, outputCol=SCALED, withMean=True, withStd=True))
        out = SCALED
    return stages, out


# ------------------------------------------------------------------ estimators
def make_estimator(model: str, task: str, n_rows: int, n_classes: int, features_col: str,
                   weight_col: str | None = None, seed: int = 42, **p):
    if (model, task) in _REGISTRY:
        return _REGISTRY[(model, task)](features_col, LABEL, n_rows, n_classes, **p)
    kw = {"featuresCol": features_col, "labelCol": LABEL}
    wk = {"weightCol": weight_col} if weight_col else {}
    if task == "classification":
        if model == "lr":
            C = float(p.get("C", 1.0))
            return LogisticRegression(maxIter=int(p.get("max_iter", 200)), regParam=1.0 / (C * max(n_rows, 1)),
                                      elasticNetParam=0.0, standardization=False, tol=float(p.get("tol", 1e-4)),
                                      **kw, **wk)
        if model == "rf":
            return ExactForest(n_classes=n_classes, max_depth=p.get("max_depth"), trees=int(p.get("n_estimators", 100)), seed=seed, **kw, **wk)
        if model == "dtc":
            return ExactTree(n_classes=n_classes, max_depth=p.get("max_depth"), **kw, **wk)
        if model == "nb":
            return NaiveBayes(modelType="gaussian", **kw, **wk)
        if model == "xgb":
            return NewtonBoost(n_classes=n_classes, max_depth=int(p.get("max_depth") or 3), eta=float(p.get("eta", 0.3)),
                               rounds=int(p.get("n_estimators", 10)), **kw)
        if model in ("svm", "knn"):
            raise ValueError(f"model '{model}' is built by its own operator")
    else:
        if model == "lir":
            return LinearRegression(solver="normal", regParam=0.0, **kw, **wk)
        if model == "pr":
            return LeastSquares(**kw)
        if model == "lar":
            # (1/2n)·RSS + α‖w‖₁ is MLlib's L1 objective as is (checked against the 1-D closed form)
            return LinearRegression(regParam=float(p.get("alpha", 0.01)), elasticNetParam=1.0,
                                    standardization=False, maxIter=int(p.get("max_iter", 200)), **kw, **wk)
        if model == "rr":
            # RSS + α‖w‖²: the normal-equation solver scales its L2 term by 1/std(y) (population std),
            # so regParam = α·std(y)/n (checked against the closed form)
            y_std = float(p.get("label_std") or 1.0)
            return LinearRegression(regParam=float(p.get("alpha", 0.01)) * y_std / max(n_rows, 1), elasticNetParam=0.0,
                                    standardization=False, solver="normal", **kw, **wk)
        if model == "dtr":
            return ExactTree(max_depth=p.get("max_depth"), **kw, **wk)
        if model == "rfr":
            return ExactForest(max_depth=p.get("max_depth"), trees=int(p.get("n_estimators", 10)), seed=seed, **kw, **wk)
        if model == "xgb":
            return NewtonBoost(max_depth=int(p.get("max_depth") or 3), eta=float(p.get("eta", 0.3)),
                               rounds=int(p.get("n_estimators", 5)), **kw)
    raise ValueError(f"Unknown model '{model}' for {task}")


def feature_kind(model: str, params: dict) -> tuple[bool, int | None]:
    """What a model's features depend on besides the plan: whether they are scaled, and the polynomial degree."""
    return model in ("svm", "knn"), int(params.get("degree", 5)) if model == "pr" else None


def build_estimator(model: str, task: str, n_rows: int, plan: FeaturePlan, features_col: str, weight_col: str | None = None,
                    seed: int = 42, **params):
    """The estimator behind the feature stages."""
    if model == "svm":
        from loomstat.operators.svm import NystroemSvmClassifier
        return NystroemSvmClassifier(featuresCol=features_col, labelCol=LABEL, C=float(params.get("C", 1.0)), weightCol=weight_col,
                                     kernel=params.get("kernel", "rbf"))
    if model == "knn":
        from loomstat.operators.knn import KnnClassifier
        return KnnClassifier(featuresCol=features_col, labelCol=LABEL, k=int(params.get("n_neighbors", 5)))
    return make_estimator(model, task, n_rows, len(plan.labels or []), features_col, weight_col, seed, **params)


def build_pipeline(df: DataFrame, target: str, model: str, task: str, n_rows: int, plan: FeaturePlan,
                   weight_col: str | None = None, seed: int = 42, **params) -> Pipeline:
    """Feature stages and the estimator; it is fitted on rows that have the label column (``with_label``)."""
    if model == "rr" and "label_std" not in params:
        params = {**params, "label_std": df.agg(F.stddev_pop(col_of(target).cast("double"))).first()[0]}
    stages, fcol = feature_stages(df, plan, *feature_kind(model, params))
    return Pipeline(stages=[*stages, build_estimator(model, task, n_rows, plan, fcol, weight_col, seed, **params)])


def name_classes(model: PipelineModel, labels: list[str] | None) -> PipelineModel:
    """Append ``predicted_label`` (the class as text) to a classifier."""
    if labels is None:
        return model
    return PipelineModel(stages=[*model.stages, IndexToString(inputCol="prediction", outputCol="predicted_label",
                                                              labels=labels)])


def classes_of(model: PipelineModel) -> list[str] | None:
    """Class names of a fitted classifier (None for a regressor)."""
    last = model.stages[-1]
    return list(last.getLabels()) if isinstance(last, IndexToString) else None


# ------------------------------------------------------------------ training
@dataclass
class TrainResult:
    model: PipelineModel
    metrics: dict
    predictions: DataFrame
    plan: FeaturePlan
    extra: dict = field(default_factory=dict)

    def metrics_frame(self, spark) -> DataFrame:
        items = sorted(self.metrics.items())
        return spark.createDataFrame([tuple(v for _, v in items)], [k for k, _ in items])


def _with_key(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    if key:
        return df, key
    # deterministic row key from the row's content (identical rows share it)
    return df.withColumn("_row_key", F.xxhash64(*[col_of(c) for c in df.columns])), "_row_key"


def classification_scores(pred: DataFrame, n_classes: int, auc: bool = True) -> dict:
    """Accuracy, weighted F1 and, for two classes with a score, the exact AUC of the last class."""
    m = M.classification_metrics(pred, LABEL, "prediction").first().asDict()
    out = {"accuracy": m["accuracy"], "f1_weighted": m["f1_weighted"]}
    score_col = next((c for c in ("probability", "rawPrediction") if c in pred.columns), None)
    if auc and n_classes == 2 and score_col:
        s = pred.select(LABEL, vector_to_array(F.col(score_col))[1].alias("_s"))
        out["auc"] = M.auc_exact(s, LABEL, "_s", positive="1.0", dp=4).first()["auc"]
    return out


def confusion_table(pred: DataFrame, labels: list[str]) -> DataFrame:
    """``(actual, predicted, cnt)`` with class names, every combination that occurs."""
    names = F.array(*[F.lit(x) for x in labels])
    return pred.groupBy(names[F.col(LABEL).cast("int")].alias("actual"),
                        names[F.col("prediction").cast("int")].alias("predicted")).agg(F.count(F.lit(1)).alias("cnt"))


def regression_scores(pred: DataFrame) -> dict:
    m = M.regression_metrics(pred, LABEL, "prediction").first().asDict()
    return {"mse": m["mse"], "rmse": m["rmse"], "r2": m["r2"]}


def _parallel(spark: SparkSession, run: Callable, items: list) -> list:
    """``run`` of every item, a few at a time (each fit is a Spark job of its own)."""
    if len(items) < 2:
        return [run(x) for x in items]
    pool = ThreadPool(min(PARALLELISM, len(items)))
    try:
        return pool.map(inheritable_thread_target(spark)(run), items)
    finally:
        pool.close()


@dataclass
class Ready:
    """Train and test rows with the features of a kind of model, stored, for several fits."""

    stages: list
    column: str
    train: DataFrame
    test: DataFrame

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


@dataclass
class Prepared:
    """Labelled rows with what every fit on them shares."""

    data: DataFrame
    key: str
    task: str
    n: int
    plan: FeaturePlan
    seed: int

    @property
    def n_classes(self) -> int:
        return len(self.plan.labels or [])

    def fit(self, rows: DataFrame, model: str, n_rows: int, weight_col: str | None = None, **params) -> PipelineModel:
        if model == "rr" and "label_std" not in params:  # of the rows that are fitted
            params = {**params, "label_std": rows.agg(F.stddev_pop(LABEL)).first()[0]}
        pipe = build_pipeline(self.data, self.plan.target, model, self.task, n_rows, self.plan, weight_col, self.seed,
                              **params)
        return name_classes(pipe.fit(rows), self.plan.labels)

    def ready(self, train: DataFrame, test: DataFrame, kind: tuple[bool, int | None]) -> Ready:
        """The feature stages fitted to the train rows, and both parts with the label and the features only."""
        stages, column = feature_stages(self.data, self.plan, *kind)
        fitted = Pipeline(stages=stages).fit(train)
        parts = [fitted.transform(x).select(LABEL, column).persist(StorageLevel.MEMORY_AND_DISK) for x in (train, test)]
        return Ready(fitted.stages, column, *parts)

    def fit_ready(self, ready: Ready, model: str, n_rows: int, **params):
        """As ``fit``, but the estimator alone: the fitted last stage, for rows that have its features."""
        if model == "rr" and "label_std" not in params:
            params = {**params, "label_std": ready.train.agg(F.stddev_pop(LABEL)).first()[0]}
        return build_estimator(model, self.task, n_rows, self.plan, ready.column, None, self.seed, **params).fit(ready.train)

    def scores(self, pred: DataFrame, auc: bool = True) -> dict:
        if self.task == "classification":
            return classification_scores(pred, self.n_classes, auc)
        return regression_scores(pred)


def prepare(df: DataFrame, target: str, task: str, key: str | None, seed: int) -> Prepared:
    data = nan_to_null(df).where(col_of(target).isNotNull())
    data, key = _with_key(data, key)
    n = data.count()
    if n < MIN_ROWS[task]:
        raise ValueError(f"Need at least {MIN_ROWS[task]} rows, got {n}")
    plan = plan_features(data, target, [c for c in data.columns if c not in (target, key)], task=task)
    if task == "classification" and len(plan.labels) < 2:
        raise ValueError("Target needs at least 2 classes")
    return Prepared(with_label(data, target, plan.labels), key, task, n, plan, seed)


def _check_model(model: str, task: str) -> None:
    allowed = registered_models(task)
    if model not in allowed:
        raise ValueError(f"Unknown model '{model}'. Allowed: {', '.join(allowed)}")


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows dealt over partitions of at most ``PART_ROWS``, for fits that pass over them many times."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")), -(-n // PART_ROWS)))


def _split(p: Prepared, test_size: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persisted split, train rows, test rows)."""
    both = _spread(split_dataset(p.data, p.key, test_size, p.seed, stratify=p.plan.target if p.plan.labels else None), p.n)
    both = both.persist(StorageLevel.MEMORY_AND_DISK)
    return both, both.where(F.col("split") == "train"), both.where(F.col("split") == "test")


def _train_on(p: Prepared, train: DataFrame, test: DataFrame, model: str, test_size: float,
              class_weight: str | None = None, return_train_score: bool = False, ready: Ready | None = None,
              **params) -> TrainResult:
    """Fit and evaluate; with ``ready``, on features that are there already (rows count alike)."""
    weight_col = None
    if class_weight == "balanced" and p.task == "classification" and model in ("lr", "svm", "rf", "dtc"):
        from loomstat.operators.split import with_class_weight
        train, weight_col = with_class_weight(train, p.plan.target, "_w"), "_w"
    n_train = p.n - math.ceil(p.n * test_size)
    if ready is None:
        fitted = p.fit(train, model, n_train, weight_col, **params)
        pred = fitted.transform(test)
        scores = p.scores(pred)
    else:
        last = p.fit_ready(ready, model, n_train, **params)
        fitted = name_classes(PipelineModel(stages=[*ready.stages, last]), p.plan.labels)
        pred = fitted.transform(test)
        scores = p.scores(last.transform(ready.test))
    scores |= {"model": model, "task": p.task, "n_train": n_train, "n_test": p.n - n_train}
    if return_train_score:
        main = "accuracy" if p.task == "classification" else "r2"
        scores[f"train_{main}"] = p.scores(fitted.transform(train), auc=False)[main]
        scores["overfit_gap"] = round(scores[f"train_{main}"] - scores[main], 4)
    extra = {"confusion": confusion_table(pred, p.plan.labels)} if p.plan.labels else {}
    return TrainResult(fitted, scores, pred, p.plan, extra)


def train_model(df: DataFrame, target: str, model: str = "rf", task: str = "classification",
                test_size: float = 0.2, key: str | None = None, class_weight: str | None = None,
                return_train_score: bool = False, seed: int = 42, **params) -> TrainResult:
    """Split (stratified for classification), fit, evaluate on the held-out rows.

    ``result.extra["confusion"]`` is the confusion table of a classifier."""
    _check_model(model, task)
    p = prepare(df, target, task, key, seed)
    both, train, test = _split(p, test_size)
    result = _train_on(p, train, test, model, test_size, class_weight, return_train_score, **params)
    both.unpersist()
    return result


def _folds(p: Prepared, n_splits: int) -> DataFrame:
    return kfold(p.data, p.key, n_splits, p.seed, stratify=p.plan.target if p.plan.labels else None).persist(
        StorageLevel.MEMORY_AND_DISK)


def _mean_std(values: list[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def _cv_scores(p: Prepared, folds: DataFrame, model: str, n_splits: int, params: dict) -> list[dict]:
    """Scores of each fold of one parameter set."""
    def one(fold: int) -> dict:
        fitted = p.fit(folds.where(F.col("fold") != fold), model, p.n - p.n // n_splits, **params)
        return p.scores(fitted.transform(folds.where(F.col("fold") == fold)), auc=False)

    return [one(f) for f in range(n_splits)]


def cross_validate(df: DataFrame, target: str, model: str, task: str = "classification", n_splits: int = 5,
                   key: str | None = None, seed: int = 42, **params) -> tuple[DataFrame, dict, PipelineModel]:
    """Per-fold metrics table, mean and population std, and the model refitted on all rows."""
    _check_model(model, task)
    p = prepare(df, target, task, key, seed)
    folds = _folds(p, n_splits)
    scores = _cv_scores(p, folds, model, n_splits, params)
    names = sorted(scores[0])
    table = df.sparkSession.createDataFrame([(f, *[float(s[k]) for k in names]) for f, s in enumerate(scores)],
                                            ["fold", *names])
    summary = {}
    for k in names:
        mean, std = _mean_std([s[k] for s in scores])
        summary |= {f"{k}_mean": round(mean, 4), f"{k}_std": round(std, 4)}
    final = p.fit(folds, model, p.n, **params)
    folds.unpersist()
    return table, summary, final


def compare_models(df: DataFrame, target: str, task: str = "classification", models: list[str] | None = None,
                   test_size: float = 0.2, key: str | None = None,
                   seed: int = 42) -> tuple[DataFrame, TrainResult | None]:
    """(ranking, result of the best model).  All models share one persisted split; a failed model is a row of its own.
    Ranked by (f1, accuracy) or (r2, -rmse)."""
    models = models or list(CLASSIFIERS if task == "classification" else REGRESSORS)
    p = prepare(df, target, task, key, seed)
    both, train, test = _split(p, test_size)

    # Models with the same features share them; what fails there fails for each of these models.
    shared: dict[tuple, Ready | Exception] = {}
    for kind in dict.fromkeys(feature_kind(m, {}) for m in models if m in registered_models(task)):
        try:
            shared[kind] = p.ready(train, test, kind)
        except Exception as e:  # noqa: BLE001
            shared[kind] = e

    def one(m: str) -> tuple:
        try:
            _check_model(m, task)
            ready = shared[feature_kind(m, {})]
            if isinstance(ready, Exception):
                raise ready
            r = _train_on(p, train, test, m, test_size, ready=ready)
            s = r.metrics
            return (m, "ok", *((s["f1_weighted"], s["accuracy"]) if p.plan.labels else (s["r2"], -s["rmse"])), None), r
        except Exception as e:  # noqa: BLE001 — a failed model is a result row
            return (m, "failed", None, None, str(e)[:200]), None

    done = _parallel(df.sparkSession, one, models)
    for ready in shared.values():
        if isinstance(ready, Ready):
            ready.release()
    both.unpersist()
    done.sort(key=lambda x: (x[1] is None, *((-x[0][2], -x[0][3]) if x[1] else (0, 0)), x[0][0]))
    rows = [(*row, rank) for rank, (row, _) in enumerate(done, 1)]
    table = df.sparkSession.createDataFrame(
        rows, "model string, status string, primary double, secondary double, error string, rank int")
    return table, done[0][1]


def param_grid(model: str, grid: dict | None = None, search: str = "grid", n_iter: int = 10,
               seed: int = 42) -> list[dict]:
    g = grid if grid is not None else DEFAULT_GRIDS.get(model, {})
    keys = sorted(g)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[g[k] for k in keys])] or [{}]
    if search == "random" and len(combos) > n_iter:
        combos = random.Random(seed).sample(combos, n_iter)
    return combos


@dataclass
class TuneResult:
    table: DataFrame
    best_params: dict
    best_model: PipelineModel


def tune(df: DataFrame, target: str, model: str, task: str = "classification", search: str = "grid",
         grid: dict | None = None, cv: int = 5, n_iter: int = 10, key: str | None = None,
         seed: int = 42) -> TuneResult:
    """CV score (f1 weighted / r2) of every parameter set, best first, and the best set refitted on all rows."""
    _check_model(model, task)
    p = prepare(df, target, task, key, seed)
    folds = _folds(p, cv)
    metric = "f1_weighted" if task == "classification" else "r2"

    sets = param_grid(model, grid, search, n_iter, seed)
    found: dict[int, list[float]] = {i: [] for i in range(len(sets))}
    kinds = sorted({feature_kind(model, x) for x in sets}, key=str)
    for fold in range(cv):
        for kind in kinds:  # sets with the same features share them
            ready = p.ready(folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold), kind)

            def one(i: int) -> float:
                fitted = p.fit_ready(ready, model, p.n - p.n // cv, **sets[i])
                return p.scores(fitted.transform(ready.test), auc=False)[metric]

            mine = [i for i, x in enumerate(sets) if feature_kind(model, x) == kind]
            for i, value in zip(mine, _parallel(df.sparkSession, one, mine)):
                found[i].append(value)
            ready.release()

    done = [(*(round(v, 4) for v in _mean_std(found[i])), x) for i, x in enumerate(sets)]
    done.sort(key=lambda r: (-r[0], str(r[2])))
    best = p.fit(folds, model, p.n, **done[0][2])
    folds.unpersist()
    table = df.sparkSession.createDataFrame([(str(x), m, s) for m, s, x in done],
                                            "params string, mean_score double, std_score double")
    return TuneResult(table, done[0][2], best)


def learning_curve(df: DataFrame, target: str, model: str, task: str = "classification", cv: int = 5,
                   key: str | None = None, seed: int = 42,
                   sizes: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Train / validation score (accuracy or r2) mean ± population std per training size.

    Subsets are nested: the first fraction of the training fold in hash order."""
    from loomstat.operators.split import hash_order
    p = prepare(df, target, task, key, seed)
    folds = kfold(p.data, p.key, cv, seed, stratify=target if p.plan.labels else None)
    folds = folds.withColumn("_u", (hash_order(p.key, seed + 1) % 1000000) / 1e6).persist(StorageLevel.MEMORY_AND_DISK)
    main = "accuracy" if task == "classification" else "r2"

    def one(at: tuple[float, int]) -> tuple[float, float]:
        frac, fold = at
        train = folds.where((F.col("fold") != fold) & (F.col("_u") < frac))
        fitted = p.fit(train, model, p.n)
        return (p.scores(fitted.transform(train), auc=False)[main],
                p.scores(fitted.transform(folds.where(F.col("fold") == fold)), auc=False)[main])

    done = _parallel(df.sparkSession, one, [(s, f) for s in sizes for f in range(cv)])
    rows = []
    for i, frac in enumerate(sizes):
        part = done[i * cv:(i + 1) * cv]
        rows.append((frac, *[round(x, 4) for k in (0, 1) for x in _mean_std([d[k] for d in part])]))
    folds.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "train_fraction double, train_mean double, train_std double, val_mean double, val_std double")


# ------------------------------------------------------------------ scoring
def score(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All rows with ``prediction`` (a classifier's class number), the class as ``predicted_label``, probabilities."""
    out = model.transform(df)
    cols = [col_of(c) for c in keep or df.columns] + [F.col("prediction")]
    if "predicted_label" in out.columns:
        cols.append(F.col("predicted_label"))
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return out.select(*cols)


def prediction_distribution(scored: DataFrame, task: str = "classification") -> DataFrame:
    if task == "classification":
        by = "predicted_label" if "predicted_label" in scored.columns else "prediction"
        return scored.groupBy(by).agg(F.count(F.lit(1)).alias("cnt"))
    return scored.agg(F.min("prediction").alias("min"), F.max("prediction").alias("max"),
                      F.avg("prediction").alias("mean"))


def score_json(model: PipelineModel, records: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """Score records held as JSON text in ``json_col`` (one record per row)."""
    parsed = records.select("*", F.from_json(col_of(json_col), schema).alias("_rec")).select("*", "_rec.*") \
                    .drop("_rec")
    return model.transform(parsed)


def feature_importance(model: PipelineModel, plan: FeaturePlan, top: int | None = None) -> list[tuple[str, float]]:
    """(feature, importance), largest first: impurity importances, or absolute coefficients of a linear model."""
    for est in reversed(model.stages):
        if hasattr(est, "featureImportances"):
            weights = est.featureImportances.toArray()
        elif hasattr(est, "coefficientMatrix"):
            weights = abs(est.coefficientMatrix.toArray()).mean(0)
        elif hasattr(est, "coefficients") and len(est.coefficients) == len(plan.features):
            weights = abs(est.coefficients.toArray())
        else:
            continue
        pairs = sorted(zip(plan.features, (float(x) for x in weights)), key=lambda t: (-t[1], t[0]))
        return [(f, round(v, 4)) for f, v in pairs[:top]]
    return []


def importance_report(result: TrainResult) -> tuple[list[tuple[str, float]], dict]:
    """Importances and the metrics stored with the model."""
    return feature_importance(result.model, result.plan), dict(result.metrics)


def fit_coefficients(df: DataFrame, target: str, features: list[str], model: str = "lir", **params) -> DataFrame:
    """Fit a linear model on the whole table: ``(term, coefficient)`` incl. ``intercept``."""
    d = VectorAssembler(inputCols=features, outputCol=FEATURES).transform(
        df.select(*[col_of(c).cast("double").alias(c) for c in features], col_of(target).cast("double").alias(LABEL))
          .dropna())
    st = d.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("s")).first()
    n = st["n"]
    if model == "rr" and "label_std" not in params:
        params = {**params, "label_std": st["s"]}
    m = make_estimator(model, "regression", n, 0, FEATURES, **params).fit(d)
    rows = [(f, float(c)) for f, c in zip(features, m.coefficients.toArray())] + [("intercept", float(m.intercept))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def naive_bayes_stats(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Gaussian NB fitted on the whole table: ``(class, feature, mean, var)`` per class and feature."""
    labels = class_names(df, target)
    stages, fcol = feature_stages(df, FeaturePlan(target, features, [], list(features), {}, labels), False)
    d = with_label(Pipeline(stages=stages).fit(df).transform(df.where(col_of(target).isNotNull())), target, labels)
    m = NaiveBayes(modelType="gaussian", featuresCol=fcol, labelCol=LABEL).fit(d)
    theta, sigma = m.theta.toArray(), m.sigma.toArray()
    rows = [(cls, f, float(theta[i, j]), float(sigma[i, j])) for i, cls in enumerate(labels)
            for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "class string, feature string, mean double, var double")


# ------------------------------------------------------------------ extension hook, dry run, evaluation
_REGISTRY: dict[tuple[str, str], object] = {}


def register_estimator(name: str, task: str, factory) -> None:
    """Add a model key: ``factory(features_col, label_col, n_rows, n_classes, **params)`` → ``pyspark.ml`` Estimator."""
    _REGISTRY[(name, task)] = factory


def registered_models(task: str) -> list[str]:
    base = list(CLASSIFIERS if task == "classification" else REGRESSORS)
    return base + [n for (n, t) in _REGISTRY if t == task and n not in base]


def train_dry_run(df: DataFrame, target: str) -> DataFrame:
    """What training would use: feature columns and usable rows (nothing is fitted)."""
    feats = [c for c in df.columns if c != target]
    n = df.where(col_of(target).isNotNull()).count()
    return df.sparkSession.createDataFrame([(f, i, n) for i, f in enumerate(feats)],
                                           "feature string, position int, rows long")


def score_head(model: PipelineModel, df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """First ``n`` rows by ``key`` with prediction and class probabilities (4 dp)."""
    head = df.orderBy(col_of(key)).limit(n)
    out = score(model, head)
    if "probability" in out.columns:
        out = out.withColumn("probability", F.transform("probability", lambda x: F.round(x, 4)))
    return out


def evaluate_model(model: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    """Metrics of a fitted pipeline on a labelled table, with the class numbers of its training."""
    labels = classes_of(model)
    known = nan_to_null(df, [target]).where(col_of(target).isNotNull())
    pred = model.transform(with_label(known, target, labels))
    if labels is None:
        return M.regression_metrics(pred, LABEL, "prediction")
    out = M.classification_metrics(pred, LABEL, "prediction")
    auc = classification_scores(pred, len(labels)).get("auc")
    return out if auc is None else out.withColumn("auc", F.lit(auc))


def roc_by_class(model: PipelineModel, df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """One-vs-rest ROC: (``(class, threshold, fpr, tpr)``, ``(class, auc, n_pos, n_neg)``) for every class."""
    labels = classes_of(model)
    pred = model.transform(with_label(df.where(col_of(target).isNotNull()), target, labels))
    pred = pred.select(LABEL, vector_to_array("probability").alias("_p")).persist(StorageLevel.MEMORY_AND_DISK)

    def one(i: int) -> tuple[DataFrame, DataFrame]:
        # Points and area take several passes over a class's scores: they are counted once.
        own = pred.select(LABEL, F.col("_p")[i].alias("_s"))
        counts = M.score_counts(own, LABEL, "_s", f"{float(i)}").persist(StorageLevel.MEMORY_AND_DISK)
        return tuple(x.select(F.lit(labels[i]).alias("class"), "*") for x in (M.roc_points_of(counts), M.auc_of(counts, 4)))

    done = _parallel(df.sparkSession, one, list(range(len(labels))))
    points, areas = (reduce(DataFrame.unionByName, side) for side in zip(*done))
    return points, areas


def predictions_vs_actual(model: PipelineModel, df: DataFrame, target: str, key: str, sample: int | None = None,
                          seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Regression metrics and the (actual, predicted) points: all of them, or a hash sample of ``sample``."""
    from loomstat.operators.split import sample_n
    pred = model.transform(with_label(nan_to_null(df).where(col_of(target).isNotNull()), target, None))
    pts = pred.select(col_of(key), F.col(LABEL).alias("actual"), F.col("prediction").alias("predicted"))
    pts = pts if sample is None else sample_n(pts, key, sample, seed)
    return M.regression_metrics(pred, LABEL, "prediction"), pts
