"""URL filter: rules first, then gradient-boosted trees on lexical features of the url.

Features: length, depth of the path, share of digits, entropy of the characters, number of parameters, number of
hyphens, labels of the host, and suffix statistics (share of blocked among labelled urls of the same last two host
labels, smoothed towards the overall share). A training url's suffix share leaves out the urls of its own part (of PARTS, by a
hash), so its own label isn't in it. Only DataFrame functions and Spark's own tree learner are used.

Rules are joined by host, so their number isn't bounded: each url is looked up under its host and all domains above it.
Labelled urls are given, or else those that a rule judges; at most MOST of them (by a hash of the url) fit the trees,
while the suffix statistics count them all. Null urls and those without ``://`` have empty host and path and fit no rule. With one
class or no labelled url, the method allows all. Rows that repeat, also by page_id, stay rows of their own; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, spread_join, table

#: Rules and their verdicts.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
MOST, TREES, DEPTH, PARTS, SMOOTH = 20_000, 10, 4, 5, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digits", "entropy", "params", "hyphens", "host_labels", "suffix_blocked"]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows (host, path, ...) with rule (the longest that fits, else null) and ruled (its verdict)."""
    spark = rows.sparkSession
    given = [(r, *r.partition("/")[::2], v) for r, v in rules.items()]
    listed = spark.createDataFrame([(r, host, "/" + path, v) for r, host, path, v in given], "rule string, domain string, start string, ruled string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(above).alias("domain"))
    fits = asked.join(F.broadcast(listed) if len(rules) <= 10_000 else listed, "domain").where(F.startswith("path", "start"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("r"))
    keyed = rows.withColumn("_at", F.struct("host", "path"))
    return spread_join(keyed, best.select(F.struct("host", "path").alias("_at"), "r.rule", "r.ruled"), "_at", "url").drop("_at")


def lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.split(url, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return rows.withColumns(
        {
            "length": F.length(url).cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
            "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "hyphens": (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
            "part": F.pmod(F.xxhash64(url), F.lit(PARTS)),
        }
    )


def parsed(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    host, path = host_path(F.col("url"))
    return lexical(with_rules(urls.withColumn("host", host).withColumn("path", path), rules))


class UrlModel:
    """Fitted trees and the suffix statistics they use; share alone where there is nothing to learn from."""

    def __init__(self, known: DataFrame):
        """known: parsed rows with blocked (0 or 1)."""
        total = known.agg(F.count("*").alias("n"), F.coalesce(F.avg("blocked"), F.lit(0.0)).alias("share")).first()
        self.share, self.trees = total.share, None
        if not 0 < total.share < 1:
            return
        parts = known.groupBy("suffix", "part").agg(F.sum("blocked").alias("b"), F.count("*").alias("n"))
        self.stats = cut(parts.groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("part", F.struct("b", "n")))).alias("parts")))
        own = F.try_element_at("parts", F.col("part"))
        without = (F.col("b") - own["b"] + SMOOTH * self.share) / (F.col("n") - own["n"] + SMOOTH)
        train = known.select("url", "suffix", "part", "blocked", *FEATURES[:-1]).orderBy(F.xxhash64("url"), "url", "blocked").limit(MOST)
        train = train.join(self.stats, "suffix").withColumn("suffix_blocked", without)
        learner = GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=7)
        self.trees = learner.fit(self._gathered(cut(train.select("blocked", *FEATURES).repartition(1))))

    def _gathered(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def score(self, rows: DataFrame) -> DataFrame:
        """Parsed rows with block_probability."""
        if self.trees is None:
            return rows.withColumn("block_probability", F.lit(self.share))
        value = F.coalesce((F.col("b") + SMOOTH * self.share) / (F.col("n") + SMOOTH), F.lit(self.share))
        known = spread_join(rows, self.stats.select("suffix", "b", "n"), "suffix", "url").withColumn("suffix_blocked", value)
        return self.trees.transform(self._gathered(known)).withColumn("block_probability", vector_to_array("probability")[1])


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where("ruled IS NOT NULL").withColumn("blocked", (F.col("ruled") == "block").cast("double"))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, block_probability (null where a rule judged).

    labelled: rows (url, blocked 0/1)."""
    rows = cut(parsed(pages.select("page_id", "url"), rules))
    if labelled is None:
        known = _labelled(rows)
    else:
        known = cut(parsed(labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("double").alias("blocked")), rules))
    model = UrlModel(known)
    scored = model.score(rows)
    p = F.col("block_probability")
    made = F.when(p >= 0.5, "block").otherwise("allow") if model.trees is not None else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", made).alias("verdict"), F.when(F.col("ruled").isNull(), p).alias("block_probability"))


def held_out_accuracy(pages: DataFrame, rules: dict[str, str] = RULES, parts: int = 4) -> DataFrame:
    """One row (n, blocked, right, block_right): how the trees, fitted without one part of the hosts, judge that part's urls
    that a rule judges too."""
    known = cut(_labelled(parsed(pages.select("page_id", "url"), rules)))
    held = F.pmod(F.xxhash64(F.lit("held"), "host"), F.lit(parts)) == 0
    got = UrlModel(known.where(~held)).score(known.where(held))
    right = (F.col("block_probability") >= 0.5) == (F.col("blocked") == 1)
    return got.agg(F.count("*").alias("n"), F.sum("blocked").cast("long").alias("blocked"), F.count_if(right).alias("right"), F.count_if(right & (F.col("blocked") == 1)).alias("block_right"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
