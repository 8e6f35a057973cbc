"""URL filter: rules by host and path, and logistic regression for what no rule decides.

A url's host and path are cut into overlapping runs of ``SIZES`` characters, between marks
at their ends; host and path have runs of their own. The runs are hashed to ``FEATURES`` places, and a
logistic regression on those that occur gives the chance that the url is to be blocked.
It is trained from a small table of labelled urls: that of ``url_labels``, or another one with
the columns (url, blocked), of which ``MAX_LABELLED`` rows, by hash, are fitted at most.

Rules (verdict, host, path) fit their host, its subdomains and every path that begins with
theirs. The longest that fits decides; of equally long ones that with the longer host,
then the one that blocks.

Defined results: a null url or one without ``://`` has an empty host and path, which no
rule fits and which the regression judges like any other. Repeated rows fare alike; an
empty table gives an empty result. Other columns stay, but one with the name of a result
gives way to it. Runs are read off a list of characters: time grows with a url's length only
in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.url_labels import labelled_urls

SIZES = (3, 4, 5)
FEATURES = 1 << 15
MAX_LABELLED, MAX_RULES = 20_000, 1000
REGULARISATION, ITERATIONS = 3e-4, 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
#: (verdict, host, path) of the query.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = [F.lit(None).cast("struct<rule:string,verdict:string>")]
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.insert(-1, F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def _runs(chars: Column, size: int, prefix: str) -> Column:
    """All runs of ``size`` characters; one that would pass the end is null and goes."""
    return F.array_compact(F.transform(chars, lambda c, i: F.concat(F.lit(prefix), c, *[F.get(chars, i + k) for k in range(1, size)])))


def _with_runs(urls: DataFrame) -> DataFrame:
    """``__runs`` from ``__host`` and ``__path``. The lists of characters are columns of their own: the runs refer to them."""
    listed = urls
    for part in ("host", "path"):
        marked = F.concat(F.lit("<"), F.translate(f"__{part}", UPPER, LOWER), F.lit(">"))
        listed = listed.withColumn(f"__{part}_chars", F.split(marked, ""))
    runs = [_runs(F.col(f"__{part}_chars"), size, part[0]) for part in ("host", "path") for size in SIZES]
    return listed.withColumn("__runs", F.concat(*runs)).drop("__host_chars", "__path_chars")


@dataclass
class UrlModel:
    hashing: HashingTF
    regression: LogisticRegressionModel

    def chances(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``__blocked``, 0 or 1, from ``__host`` and ``__path``."""
        found = self.regression.transform(self.hashing.transform(_with_runs(urls)))
        return found.drop("__runs", "__places", "__odds", "__chance")


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> UrlModel:
    """The regression; both labels must occur."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, blocked boolean")
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("double").alias("__label")).distinct()
    # Few rows: in one partition and one order the sums, and so the weights, are the same each time.
    rows = rows.orderBy(F.xxhash64("url"), "url", "__label").limit(MAX_LABELLED).coalesce(1)
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__runs", outputCol="__places")
    regression = LogisticRegression(
        featuresCol="__places", labelCol="__label", predictionCol="__blocked", probabilityCol="__chance", rawPredictionCol="__odds",
        regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False,
    )
    features = hashing.transform(_with_runs(rows.select("__label", host.alias("__host"), path.alias("__path"))))
    return UrlModel(hashing, regression.fit(features))


def judge(pages: DataFrame, model: UrlModel, rules: tuple[Rule, ...] = (), url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    cut = pages.select(F.struct("*").alias("__row"), host.alias("__host"), path.alias("__path"))
    found = model.chances(cut.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules)))
    by_model = F.when(F.col("__blocked") > 0.5, "block").otherwise("allow")
    results = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), by_model)}
    kept = [F.col("__row")[c].alias(c) for c in pages.columns if c.lower() not in results]
    return found.select(*kept, *[column.alias(name) for name, column in results.items()])


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, fit(spark), RULES).select("page_id", "host", "path", "rule", "verdict")
