"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for what no rule fits.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest
wins. URLs without a rule are judged by boosted trees (pyspark.ml) over length, depth, digit ratio, entropy of
the host, numbers of parameters, labels and hyphens, and statistics of the host's last label (how often
labelled URLs with it are blocked, and how many there are; for a labelled URL itself, among those of the other
FOLDS - 1 parts of the sample only, so its own label is no part of what the trees see of it). The trees are trained on labelled URLs: in the
query those that a rule fits, by its verdict; elsewhere any table of (url, blocked).

Main path: DataFrame expressions and pyspark.ml only. Training sees a sample of at most TRAIN_ROWS rows,
picked by a hash, so the table of suffix statistics, which is broadcast, has no more rows than that either.
Judging is one scan without a shuffle.

Defined cases: a null URL or one without "://" has an empty host and path, and the trees judge the rest of it;
repeated rows are judged alike; an empty table gives an empty table; without labelled URLs of both kinds,
URLs without a rule are allowed; columns other than page_id and url are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import LOWER, UPPER, bounded_sample, text_of
from lodemill.shared import written

#: Labelled URLs that the trees are trained on, at most, and the parts in which they learn from the others' suffixes.
TRAIN_ROWS, FOLDS = 20_000, 5
TREES, DEPTH, SEED = 15, 4, 7
#: Labelled URLs that a suffix's block rate counts besides its own, at the overall rate.
PRIOR = 10.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
FEATURES = ["n_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_blocked", "suffix_count"]


def parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    u = text_of(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: str, path: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = lambda r: ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
    longest = sorted(rules, key=lambda r: -len(str(r)))
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars)).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, ...) with what its own characters say, and its suffix."""
    url, host = text_of("url"), F.col("host")
    letters = F.split(host, "")
    n = F.length(host).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double") / n
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return urls.withColumns({
        "n_chars": F.length(url).cast("double"), "host_chars": n, "path_chars": F.length("path").cast("double"), "depth": _count(F.col("path"), "/"),
        "digit_ratio": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "n_params": _count(url, "[?&][^=&#?]*="), "n_labels": _count(host, r"[^.]+"), "n_hyphens": _count(host, "-"), "suffix": F.substring_index(host, ".", -1),
    })


class UrlModel:
    """Trees and suffix statistics; classify() adds blocked (boolean) to lexical() rows."""

    def __init__(self, labelled: DataFrame):
        """labelled: lexical() rows with blocked (boolean); a bounded sample is written once."""
        sample = written(bounded_sample(labelled.where("blocked IS NOT NULL"), ["url", "page_id"], TRAIN_ROWS), "urls")
        n, blocked = sample.agg(F.count("*"), F.count_if("blocked")).first()
        self.model = self.suffixes = None
        if not 0 < blocked < n:
            return
        self.rate = blocked / n
        fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold")
        counts = written(sample.groupBy("suffix", fold).agg(F.count_if("blocked").alias("bad"), F.count("*").alias("n")), "suffixes")
        every = counts.groupBy("suffix").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all"))
        others = counts.join(every, "suffix").select("suffix", "fold", (F.col("all_bad") - F.col("bad")).alias("bad"), (F.col("all") - F.col("n")).alias("n"))
        self.suffixes = written(self._statistics(every.select("suffix", F.col("all_bad").alias("bad"), F.col("all").alias("n")), "suffix"), "suffixes")
        apart = self._vectors(sample.withColumn("fold", fold), self._statistics(others, "suffix", "fold"), ["suffix", "fold"])
        rows = apart.select("features", F.col("blocked").cast("double").alias("label"), "url", "page_id")
        rows = rows.coalesce(1).sortWithinPartitions("page_id", "url").select("features", "label")  # a bounded sample; in one order, so that reruns agree
        self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(rows)

    def _statistics(self, counts: DataFrame, *keys: str) -> DataFrame:
        rate = (F.col("bad") + PRIOR * self.rate) / (F.col("n") + PRIOR)
        return counts.select(*keys, rate.alias("suffix_blocked"), F.log1p("n").alias("suffix_count"))

    def _vectors(self, rows: DataFrame, suffixes: DataFrame, keys: list[str]) -> DataFrame:
        near = rows.join(F.broadcast(suffixes), keys, "left").fillna({"suffix_blocked": self.rate, "suffix_count": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(near)

    def classify(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("blocked", F.lit(False))
        out = self.model.transform(self._vectors(rows, self.suffixes, ["suffix"]))
        return out.withColumn("blocked", F.col("prediction") > 0.5).drop("features", "rawPrediction", "probability", "prediction", "suffix_blocked", "suffix_count")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; labelled (page_id, url, blocked) trains the trees, or else the rules' verdicts do."""
    host, path = parts("url")
    split = lambda rows, *more: rows.select("page_id", "url", host.alias("host"), path.alias("path"), *more)
    rows = split(pages).withColumn("ruled", ruled("host", "path", rules))
    known = rows.where(F.col("ruled").isNotNull()).withColumn("blocked", F.col("ruled.verdict") == "block") if labelled is None else split(labelled, "blocked")
    model = UrlModel(lexical(known.select("page_id", "url", "host", "path", "blocked")))
    told = model.classify(lexical(rows))
    verdict = F.coalesce("ruled.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
