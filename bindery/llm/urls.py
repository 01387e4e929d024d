"""URL filter: rules on host and path, and gradient-boosted trees on lexical features for urls without a rule.

Everything runs as DataFrame expressions and Spark ML; the trees learn from urls that a rule has labelled.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Labelled urls, about, that the trees learn from; the bound of the training sample.
SAMPLE_ROWS = 20_000
FEATURES = ("url_len", "host_len", "path_len", "depth", "host_labels", "digit_ratio", "punct_ratio", "entropy", "n_params", "query_len", "has_fragment", "is_https", "suffix_len", "suffix_vowels", "suffix_share", "suffix_blocked")
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tail(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)"))


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path: after the first ``://`` up to ``/ ? #``, A-Z lowered; then up to ``? #``. Else empty."""
    tail = F.col("__tail")
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (
        pages.withColumn("url", F.col(url_col).cast("string"))
        .withColumn("__tail", _tail(F.col("url")))
        .withColumn("host", F.coalesce(F.translate(host, *_LOWER), F.lit("")))
        .withColumn("path", F.coalesce(path, F.lit("")))
        .drop("__tail")
    )


def rule_of(rules: tuple = RULES) -> tuple[Column, Column]:
    """Columns: the longest fitting rule's text (host and path prefix; null if none fits) and its verdict."""
    text = verdict = F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with lexical features as doubles; a null url counts as an empty one."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    letters = F.split(url, "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    suffix = F.element_at(F.split("host", r"\."), -1)
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_len"),
        F.length("host").cast("double").alias("host_len"),
        F.length("path").cast("double").alias("path_len"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / length).alias("digit_ratio"),
        (F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / length).alias("punct_ratio"),
        F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0)).alias("entropy"),
        F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double").alias("n_params"),
        F.length(query).cast("double").alias("query_len"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(url, F.lit("https")).cast("double").alias("is_https"),
        F.length(suffix).cast("double").alias("suffix_len"),
        F.length(F.regexp_replace(suffix, "[^aeiou]", "")).cast("double").alias("suffix_vowels"),
        suffix.alias("suffix"),
    )


def judge(pages: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: ``id_col``, host, path, rule (null if none fits), verdict and score (chance of a block).

    The verdict is the rule's, else ``block`` if the trees' chance is over a half. The trees learn from about
    ``sample_rows`` urls with a rule, taken by a hash of url and id at a share that follows from the count of all; suffix
    statistics (share of the sample, smoothed block rate) come from the same sample, so their table is bounded by it. For
    training each half of the sample has the statistics of the other half, so that no row's label is among its features.
    Urls that are null, empty or without ``://`` have empty host and path and fit no rule. If no rule fits any url, or all
    fitting rules say the same, that verdict (allow if none) holds for the rest. Rows are never merged, so ties and
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    text, verdict = rule_of(rules)
    known = features(parts(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url"))).withColumn("rule", text).withColumn("said", verdict))
    seen = {r[0]: r[1] for r in known.where("said is not null").groupBy("said").count().collect()}
    out = [F.col("__id").alias(id_col), "host", "path", "rule"]
    if len(seen) < 2:
        only = next(iter(seen), "allow")
        return known.select(*out, F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    share = min(1.0, sample_rows / sum(seen.values()))
    dice = F.pmod(F.xxhash64("url", "__id", F.lit(5)), F.lit(1_000_000)) / 1e6
    sample = known.where(F.col("said").isNotNull() & (dice < share)).withColumn("label", (F.col("said") == "block").cast("double"))
    half = F.pmod(F.xxhash64("url", "__id", F.lit(6)), F.lit(2)).cast("int")
    sample = sample.withColumn("half", half)
    n = sample.agg(F.avg("label")).first()
    rate = n[0] if n[0] is not None else 0.5
    # two rows for each suffix of the sample, at most sample_rows of them
    stats = sample.groupBy("suffix", "half").agg(F.count("*"), F.sum("label")).collect()

    def with_stats(df: DataFrame, halves: tuple[int, ...] = (0, 1)) -> DataFrame:
        found: dict[str, tuple[int, float]] = {}
        for suffix, own, count, blocked in stats:
            if own in halves:
                c, b = found.get(suffix, (0, 0.0))
                found[suffix] = c + count, b + blocked
        total = max(1, sum(c for c, _ in found.values()))
        rows = [(k, c / total, (b + rate * 5) / (c + 5)) for k, (c, b) in found.items()]
        table = pages.sparkSession.createDataFrame(rows or [("", 0.0, rate)], "suffix string, suffix_share double, suffix_blocked double")
        return df.join(F.broadcast(table), "suffix", "left").fillna({"suffix_share": 0.0, "suffix_blocked": rate})

    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    apart = with_stats(sample.where("half = 0"), (1,)).unionByName(with_stats(sample.where("half = 1"), (0,)))
    train = assemble.transform(apart).select("features", "label").persist()
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(train)
    train.unpersist()
    scored = model.transform(assemble.transform(with_stats(known)))
    chance = vector_to_array(F.col("probability"))[1]
    return scored.select(*out, F.coalesce("said", F.when(chance > 0.5, "block").otherwise("allow")).alias("verdict"), chance.alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
