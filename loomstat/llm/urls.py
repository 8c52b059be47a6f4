"""URL filter: host/path rules, then logistic regression on hashed character n-grams.

Native: every step is a DataFrame expression or a ``pyspark.ml`` stage; no Python
runs on executors.  The model is fitted on a small labelled URL table (checked
against ``MAX_LABELLED``); scoring is one map over the pages, without a shuffle.

Edge cases: a null url, or one without ``://``, has an empty host and path and
gets the model's verdict on an empty string; repeated rows are judged row by
row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import ascii_lower, bounded_rows, table

MAX_LABELLED = 10_000
BUCKETS = 1 << 17
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# The default rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# A small labelled table, as host names and paths (block or allow); each name stands below several
# parent domains with several paths, so neither tells the classes apart.
BLOCK_NAMES = (
    "casino-royal online-casino casino-win poker-casino free-casino win-big jackpot-slots free-bets sports-bets "
    "best-bets betting-odds bet-now cheap-pills pills-shop diet-pills cheap-meds cheap-viagra buy-pills spam-farm "
    "link-farm seo-spam spam-links content-farm ads-track track-ads ads-server click-track adtrack ad-clicks adult-x "
    "xxx-adult adult-video hot-adult porn-xxx free-porn adult-cams fast-loans payday-loans crack-keygen "
    "warez-download replica-watch phishing-login").split()
ALLOW_NAMES = (
    "university library news kitchen project museum city-council weather forum gardening science station school "
    "encyclopedia traveller theatre bookshop hospital nation thunder theory therapy thing action other reason notion "
    "motion table rest mention edition north heather ocean singer stable athens tension bothered whether thousand "
    "entire ration ironing shelter healthy terrain erosion standing outline inherit mother-earth open-source "
    "daily-paper en-route self-help river-side the-times").split()
PARENTS = ["test", "example.com", "example.net", "example.org"]
FRONTS = ["", "www.", "m.", "blog."]
PATHS = ["/en/412", "/fr/18.html", "/de/402/", "/es/64", "/", "", "/index.html", "/en/7"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty when there is no ``://``."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, _PARTS, 1)), F.regexp_extract(u, _PARTS, 2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(host: Column, path: Column) -> Column:
    """Character 3- and 4-grams of host and path, each marked with its part (linear in the length)."""
    def grams(part: str, text: Column, n: int) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda g: F.concat(F.lit(part), g))
    letters = F.regexp_replace(ascii_lower(path), "[0-9]+", "0")
    return F.concat(grams("h", host, 3), grams("h", host, 4), grams("p", letters, 3))


def _with_grams(df: DataFrame, url: str) -> DataFrame:
    host, path = host_path(F.col(url))
    return df.withColumn("_host", host).withColumn("_path", path).withColumn("_grams", _grams(F.col("_host"),
                                                                                            F.col("_path")))


def seed_table(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label): label 1 is block."""
    rows = []
    for label, names in ((1.0, BLOCK_NAMES), (0.0, ALLOW_NAMES)):
        for i, name in enumerate(names):
            for j, parent in enumerate(PARENTS):
                rows.append((f"http://{FRONTS[(i + j) % 4]}{name}.{parent}{PATHS[(i + 3 * j) % len(PATHS)]}", label))
    return spark.createDataFrame(rows, "url string, label double")


def fit(labelled: DataFrame) -> PipelineModel:
    """Fit the classifier on a small table (url, label 0/1); at most ``MAX_LABELLED`` rows."""
    spark = labelled.sparkSession
    rows = bounded_rows(labelled.select("url", F.col("label").cast("double").alias("label")), MAX_LABELLED,
                        "labelled urls")
    small = _with_grams(spark.createDataFrame(rows, "url string, label double").coalesce(1), "url").cache()
    stages = [HashingTF(numFeatures=BUCKETS, inputCol="_grams", outputCol="_tf"),
              Normalizer(inputCol="_tf", outputCol="_x"),
              LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.002, maxIter=60,
                                 probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")]
    model = Pipeline(stages=stages).fit(small)
    small.unpersist()
    return model


def judge(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str, str]] = RULES, url: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, p_block and verdict to ``pages``."""
    keep = [F.col(f"_src.`{c}`").alias(c) for c in pages.columns]
    src = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_src"),
                       F.col(f"`{url}`").alias("_url"))
    scored = model.transform(_with_grams(src, "_url"))
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), rules)
    p = vector_to_array(F.col("_prob"))[1]
    new = {"host": F.col("_host"), "path": F.col("_path"), "rule": rule, "p_block": p,
           "verdict": F.coalesce(verdict, F.when(p >= threshold, "block").otherwise("allow"))}
    return scored.select(*[k for k, c in zip(keep, pages.columns) if c not in new],
                         *[c.alias(n) for n, c in new.items()])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(seed_table(spark))).select("page_id", "host", "path", "rule", "verdict", "p_block")
