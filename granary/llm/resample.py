"""Importance resampling towards a target distribution, in DataFrame functions alone.

Each text's features are its runs of 1 to ``most`` consecutive words (ASCII letters lowered), hashed by crc32 into ``buckets``
buckets. The buckets of the source (the documents) and of the target (the benchmark) are counted, partial counts first, so a
bucket that holds a third of all features is a row a task. A bucket's gain, floor(1000 ln of the ratio of its smoothed shares),
is looked up in a broadcast table of exactly ``buckets`` rows, and a document's gains are added up. Gumbel noise from a hash of
the id makes the draw of the highest scores a sample without replacement by weight.

Ranks come from one distributed sort: rows are dealt by ranges of (score, id), sorted there, and a row's rank is its place in
its partition plus the rows of all partitions before; only one count a partition passes through the driver.

Defined cases: a null or empty text has no features and weight 0. A document with fewer than ``least`` words, or without an id,
is scored (null without an id) but never drawn, and doesn't count in the number drawn. Rows that repeat an id are scored each
by its own text; equal rows are counted as often as they come. Ties go to the smaller id. Empty tables give no rows; with an
empty benchmark all buckets have zero target counts. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import cut, table

#: What stands between words, which are runs of digits, ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, MOST, LEAST, TENTHS, SEED = 10_000, 1, 20, (10, 100), 2024
#: Rows that one task makes at a time of one repeated row.
COPIES = 1_000_000


def words(text: str = "text") -> Column:
    """The words, not lowered yet; none for null."""
    return F.coalesce(F.array_remove(F.split(F.col(text), BETWEEN), ""), F.array().cast("array<string>"))


def lowered(gram: Column) -> Column:
    """ASCII letters lowered. ``lower`` does just that in ASCII strings; others are translated."""
    return F.when(F.octet_length(gram) == F.length(gram), F.lower(gram)).otherwise(F.translate(gram, UPPER, LOWER))


def grams(own: Column, most: int = MOST) -> Column:
    """All runs of 1 to ``most`` consecutive words, joined by one space."""

    def runs(w, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    if most == 1:
        return own
    # The words are bound once as a lambda's argument, so the split isn't evaluated again for every run.
    return F.get(F.transform(F.array(own), lambda w: F.concat(w, *[runs(w, n) for n in range(2, most + 1)])), 0)


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(lowered(gram).cast("binary")) % buckets


def bucket_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all texts' features; at most ``buckets`` rows."""
    features = texts.select(F.explode(grams(words(), most)).alias("gram"))
    return features.groupBy(bucket_of(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, of which there are exactly ``buckets``."""
    s, t = (bucket_counts(x, most, buckets).withColumnRenamed("n", k) for x, k in ((source, "s"), (target, "t")))
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = cut(every.join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").fillna(0, ["s", "t"]))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    real = lambda c: c.cast("double")
    ratio = real(F.col("t") + 1) * (real(F.lit(all_s)) + buckets) / (real(F.col("s") + 1) * (real(F.lit(all_t)) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of the id; null without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, h, n_words, n_features, weight), one row for each of docs; h is a hash of its text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), words().alias("w"))
    rows = rows.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(grams(F.col("w"), most)).alias("at", "gram"))
    rows = rows.select("doc_id", "h", "n_words", "at", bucket_of(F.col("gram"), buckets).alias("bucket"))
    # Words are summed where they are read: what is shuffled is a row a document and task. Equal rows fall together here.
    summed = rows.join(F.broadcast(gain), "bucket", "left").groupBy("doc_id", "h", "n_words").agg(F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"), F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"))
    one = summed.select("doc_id", "h", "n_words", F.expr("n div copies").alias("n_features"), F.expr("g div copies").alias("weight"), "copies")
    parts = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    each = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES))))
    return each.drop("copies", "part", "copy")


def drawn(rows: DataFrame, tenths: tuple[int, int] = TENTHS) -> DataFrame:
    """Rows (able, score, doc_id, h, ...) with their rank (from 1) if they are among the ``tenths[0]`` of ``tenths[1]`` able ones
    of the highest scores, else null."""
    spark = rows.sparkSession
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("h").asc()]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # Partition number and place there in one number, fixed by the checkpoint.
    placed = cut(dealt.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count_if("able").alias("n")).collect())  # one a partition
    most = sum(n for _, n in counts) * tenths[0] // tenths[1]
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    known = placed.withColumn("part", part).join(F.broadcast(spark.createDataFrame(offsets, "part bigint, before bigint")), "part", "left")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return known.withColumn("rank", F.when(F.col("able") & (rank <= most), rank)).drop("place", "part", "before")


def resample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, least: int = LEAST, tenths: tuple[int, int] = TENTHS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score, rank (null if not drawn)."""
    rows = cut(weighed(docs, gains(docs.select("text"), target.select("text"), most, buckets), most, buckets))
    scored = rows.withColumns({"score": F.col("weight") + noise("doc_id", seed), "able": (F.col("n_words") >= least) & F.col("doc_id").isNotNull()})
    return drawn(scored, tenths).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: crc32 isn't there in this SQL: it is folded over the bytes of each different word, by a table of its 256 steps.
OP13_SQL = """
WITH steps AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
bw AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
every AS MATERIALIZED (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS MATERIALIZED (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS b FROM every, steps),
s AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY b),
gain AS MATERIALIZED (SELECT r.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw)::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
