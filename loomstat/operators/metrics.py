"""Evaluation metrics over a scored table (label, prediction, score columns).

Classification metrics come from the confusion counts ``groupBy(label,
prediction)`` — a table bounded by classes², so everything after it is
tiny.  Exact ROC-AUC is the Mann–Whitney statistic with tie-averaged ranks
and ROC points are cumulative positive/negative counts over distinct scores,
both computed with the range-bucket machinery (no single-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.exprs import col_of
from loomstat.functions.ordered import BUCKET, cumulative_sums, with_range_bucket


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, cnt)``; both as text so mixed types compare."""
    return df.groupBy(col_of(label).cast("string").alias("label"),
                      col_of(prediction).cast("string").alias("prediction")).agg(F.count(F.lit(1)).alias("cnt"))


def _per_class(df: DataFrame, label: str, prediction: str, dp: int = 4) -> DataFrame:
    cc = confusion_counts(df, label, prediction)
    a = cc.select(F.col("label").alias("class"), F.col("cnt").alias("support"),
                  F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0).alias("tp"),
                  F.lit(0).cast("long").alias("predicted"))
    b = cc.select(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                  F.lit(0).cast("long").alias("tp"), F.col("cnt").alias("predicted"))
    per = a.unionByName(b).groupBy("class").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                                F.sum("predicted").alias("predicted"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return per.select("class", F.round(p, dp).alias("precision"), F.round(r, dp).alias("recall"),
                      F.round(f1, dp).alias("f1"), F.col("support").cast("long").alias("support"),
                      F.col("tp").cast("long").alias("_tp"), F.col("predicted").cast("long").alias("_predicted"),
                      p.alias("_p"), r.alias("_r"), f1.alias("_f1"))


def per_class_report(df: DataFrame, label: str, prediction: str, dp: int = 4) -> DataFrame:
    """``(class, precision, recall, f1, support)``; zero-division gives 0."""
    return _per_class(df, label, prediction, dp).select("class", "precision", "recall", "f1", "support")


def classification_metrics(df: DataFrame, label: str, prediction: str, dp: int = 4) -> DataFrame:
    """One row: accuracy, weighted precision / recall / F1, n."""
    per = _per_class(df, label, prediction, dp)
    n = F.sum("support").cast("double")
    return per.agg(
        F.round(F.sum("_tp") / n, dp).alias("accuracy"),
        F.round(F.sum(F.col("_p") * F.col("support")) / n, dp).alias("precision_weighted"),
        F.round(F.sum(F.col("_r") * F.col("support")) / n, dp).alias("recall_weighted"),
        F.round(F.sum(F.col("_f1") * F.col("support")) / n, dp).alias("f1_weighted"),
        F.sum("support").cast("long").alias("n"))


def binary_confusion(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    """One row ``(tp, fp, fn, tn)`` for the given positive class."""
    y = col_of(label).cast("string") == F.lit(str(positive))
    p = col_of(prediction).cast("string") == F.lit(str(positive))
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                  F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """``(score, npos, nneg)``: positive and other rows of every distinct score."""
    pos = (col_of(label).cast("string") == F.lit(str(positive))).cast("long")
    return df.where(col_of(score).isNotNull() & col_of(label).isNotNull()) \
             .groupBy(col_of(score).cast("double").alias("score")) \
             .agg(F.sum(pos).alias("npos"), F.sum(1 - pos).alias("nneg"))


def auc_exact(df: DataFrame, label: str, score: str, positive=1, dp: int = 6) -> DataFrame:
    """Exact ROC-AUC = (Σ ranks of positives − P(P+1)/2) / (P·N), ties averaged."""
    return auc_of(score_counts(df, label, score, positive), dp)


def auc_of(counts: DataFrame, dp: int = 6) -> DataFrame:
    """``auc_exact`` of ``score_counts``."""
    sc = counts.withColumn("cnt", F.col("npos") + F.col("nneg"))
    c = cumulative_sums(sc, "score", ["cnt"])
    avg_rank = F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    agg = c.agg(F.sum(avg_rank * F.col("npos")).alias("rs"), F.sum("npos").cast("double").alias("P"),
                F.sum("nneg").cast("double").alias("N"))
    auc = F.try_divide(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * F.col("N"))
    return agg.select(F.round(auc, dp).alias("auc"), F.col("P").cast("long").alias("n_pos"),
                      F.col("N").cast("long").alias("n_neg"))


def roc_points(df: DataFrame, label: str, score: str, positive=1, dp: int = 6,
               drop_intermediate: bool = True) -> DataFrame:
    """``(threshold, fpr, tpr)`` over distinct scores (descending), plus the (0, 0)
    start point with a null threshold.

    ``drop_intermediate`` keeps only corners of the curve: the first and last
    thresholds and every threshold whose (positives, negatives) step differs
    from the next one.  The "next" step crosses range buckets through a
    one-row-per-bucket table of each bucket's first step (no global window)."""
    return roc_points_of(score_counts(df, label, score, positive), dp, drop_intermediate)


def roc_points_of(sc: DataFrame, dp: int = 6, drop_intermediate: bool = True) -> DataFrame:
    """``roc_points`` of ``score_counts``."""
    c = cumulative_sums(sc, "score", ["npos", "nneg"], descending=True)
    tot = sc.agg(F.sum("npos").cast("double").alias("P"), F.sum("nneg").cast("double").alias("N"))
    # totals as literals: a one-row aggregate (bounded), avoids a cross join
    t = tot.first()
    P, N = t["P"] or 0.0, t["N"] or 0.0
    if drop_intermediate:
        b = with_range_bucket(sc, "score", descending=True)
        firsts = sorted((r[BUCKET], r["f"]) for r in b.groupBy(BUCKET).agg(
            F.max_by(F.struct("npos", "nneg"), "score").alias("f")).collect())
        nxt = {firsts[i][0]: firsts[i + 1][1] for i in range(len(firsts) - 1)}  # bucket → next bucket's first step
        step = F.struct("npos", "nneg")
        nmap = F.create_map(*[x for bk, f in nxt.items() for x in
                              (F.lit(bk), F.struct(F.lit(f["npos"]).alias("npos"), F.lit(f["nneg"]).alias("nneg")))]) \
            if nxt else None
        w = Window.partitionBy(BUCKET).orderBy(F.desc("score"))
        lead = F.lead(step).over(w)
        following = F.coalesce(lead, nmap[F.col(BUCKET)]) if nmap is not None else lead
        top = sc.agg(F.max("score")).first()[0]
        keep = b.withColumn("_next", following).where(
            F.col("_next").isNull() | (F.col("_next") != step) | (F.col("score") == F.lit(top))).select("score")
        c = c.join(keep, "score", "left_semi")
    pts = c.select(F.col("score").alias("threshold"),
                   F.round(F.try_divide(F.col("cum_nneg").cast("double"), F.lit(N)), dp).alias("fpr"),
                   F.round(F.try_divide(F.col("cum_npos").cast("double"), F.lit(P)), dp).alias("tpr"))
    start = sc.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def regression_metrics(df: DataFrame, y: str, yhat: str, dp: int = 4) -> DataFrame:
    """One row: mse, rmse, mae, r2, n."""
    e = col_of(y).cast("double") - col_of(yhat).cast("double")
    d = df.where(col_of(y).isNotNull() & col_of(yhat).isNotNull())
    agg = d.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                F.var_pop(col_of(y).cast("double")).alias("vy"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.round("mse", dp).alias("mse"), F.round(F.sqrt("mse"), dp).alias("rmse"),
                      F.round("mae", dp).alias("mae"),
                      F.round(F.lit(1.0) - F.try_divide(F.col("mse"), F.col("vy")), dp).alias("r2"), "n")
