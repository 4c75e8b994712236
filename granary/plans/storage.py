"""Queries over sources, sinks, collections and streams. They write to folders of their own below the shared one."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import blocks as B
from granary.operators.harness import dry_run as list_cases
from granary.operators.metrics import truth_names
from granary.operators.retrieval import search
from granary.plans.registry import query
from granary.sources import files as S
from granary.sources import store
from granary.sources.records import Rule, read_records, tally, write_records
from granary.sources.shared import new_folder
from granary.sources.tables import table
from granary.streaming.ingest import stream_into
from granary.streaming.traces import SPAN, read_traces, write_traces

POINT = "chunk_id string, doc_name string, section_path array<string>, page_num int, text string, token_count int"


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM documents")
def upsert_idempotent(spark, sf_dir):
    """A key that comes twice in one batch counts once, the last time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("ord"))
    new = docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))).withColumn("ord", F.lit(2))
    batch = new.unionByName(new.withColumns({"text": F.lit("older"), "ord": F.lit(1)}))
    return store.upsert(store.upsert(docs, batch, "doc_id", "ord"), batch, "doc_id", "ord").select("doc_id", "text")


def points(rows):
    """Rows (vec_id, embedding, label) as chunks of documents by label."""
    return rows.selectExpr("concat('c', vec_id) AS chunk_id", "concat('d', label) AS doc_name", "array('root') AS section_path", "1 AS page_num", "concat('t', vec_id) AS text", "1 AS token_count", "CAST(embedding AS array<float>) AS embedding")


def filled(spark, sf_dir, dimension=None):
    rows = table(spark, sf_dir, "embeddings")
    dimension = dimension or rows.selectExpr("max(size(embedding))").first()[0]
    made = store.Collection(spark, new_folder(spark, "collection"), buckets=8)
    made.ensure(dimension, POINT)
    return made, points(rows)


@query("SELECT 'c' || vec_id AS chunk_id, 'd' || label AS doc_name, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 't' || vec_id END AS text FROM embeddings WHERE label <> 2 OR vec_id % 2 = 0")
def collection_points(spark, sf_dir):
    """All points; then a third of them changed, twice; then one document replaced by half of its chunks."""
    made, rows = filled(spark, sf_dir)
    made.upsert(rows)
    for _ in range(2):
        made.upsert(rows.where("CAST(substr(chunk_id, 2) AS BIGINT) % 3 = 0").withColumn("text", F.lit("new")))
    half = rows.where("doc_name = 'd2' AND CAST(substr(chunk_id, 2) AS BIGINT) % 2 = 0")
    made.upsert(half.withColumn("text", F.expr("IF(CAST(substr(chunk_id, 2) AS BIGINT) % 3 = 0, 'new', text)")), replace_documents=True)
    return made.points().select("chunk_id", "doc_name", "text")


LOG = """WITH log AS (SELECT vec_id, 1 AS seq, 'd' || label AS doc, 't' AS text, false AS gone FROM embeddings
  UNION ALL SELECT vec_id, 2, 'd' || (label + 1), 'moved', false FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, 3, 'd2', 'kept', false FROM embeddings WHERE label = 2 AND vec_id % 2 = 0
  UNION ALL SELECT vec_id, 4, NULL, NULL, true FROM embeddings WHERE vec_id % 11 = 0
  UNION ALL SELECT vec_id, 5, 'd' || label, 'late', false FROM embeddings WHERE vec_id % 5 = 0),
dropped AS (SELECT * FROM (VALUES ('d2', 3), ('d4', 6)) v(doc, seq)),
newest AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) AS r FROM log)
SELECT 'c' || vec_id AS chunk_id, doc AS doc_name, text FROM newest n WHERE r = 1 AND NOT gone AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc = n.doc AND d.seq > n.seq)
"""


@query(LOG)
def collection_compacted(spark, sf_dir):
    """A log of upserts that move points to other documents, a replaced document, deletions, and both kinds of compaction among them."""
    made, rows = filled(spark, sf_dir)
    own = F.expr("CAST(substr(chunk_id, 2) AS BIGINT)")
    made.upsert(rows.withColumn("text", F.lit("t")))
    made.upsert(rows.where(own % 3 == 0).withColumns({"doc_name": F.expr("concat('d', CAST(substr(doc_name, 2) AS BIGINT) + 1)"), "text": F.lit("moved")}))
    made.upsert(rows.where((F.col("doc_name") == "d2") & (own % 2 == 0)).withColumn("text", F.lit("kept")), replace_documents=True)
    made.compact()
    made.remove(rows.where(own % 11 == 0))
    made.compact(full=True)
    made.upsert(rows.where(own % 5 == 0).withColumn("text", F.lit("late")))
    made.remove_documents(rows.where("doc_name = 'd4'").select("doc_name").limit(1))
    made.vacuum()
    return made.points().select("chunk_id", "doc_name", "text")


@query(
    """WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, CASE WHEN vec_id % 7 = 0 THEN 'moved' ELSE 'd' || label END AS doc FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.doc AS doc_name, list_cosine_similarity(q.e, c.e) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id % 100 <> 50 AND c.doc IN ('d' || q.label, 'moved')),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'c' || vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, 'c' || vec_id AS chunk_id, doc_name, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def collection_scoped(spark, sf_dir):
    """Each query searches its own document and another one; half of them one that isn't there. A seventh of the points have
    moved between documents since the base was made."""
    made, rows = filled(spark, sf_dir)
    made.upsert(rows)
    made.compact(full=True)
    made.upsert(rows.where("CAST(substr(chunk_id, 2) AS BIGINT) % 7 = 0").withColumn("doc_name", F.lit("moved")))
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    asked = asked.selectExpr("vec_id AS query_id", "CAST(embedding AS array<float>) AS embedding", "IF(vec_id % 100 = 50, array('nowhere'), array(concat('d', label), 'moved')) AS scope")
    got = search(asked, made, 10, scope="scope")
    return got.withColumn("score", F.round("score", 6)).join(made.points().select("chunk_id", "doc_name"), "chunk_id")


@query("SELECT count(*) AS points_count, CAST(max(len(embedding)) AS INTEGER) AS vector_size, 'cosine' AS distance FROM embeddings")
def collection_info(spark, sf_dir):
    made, rows = filled(spark, sf_dir)
    made.upsert(rows)
    return made.collection_info().drop("name")


@query("SELECT 'c' || vec_id AS chunk_id, 'd' || label AS doc_name FROM embeddings")
def stream_ingest(spark, sf_dir):
    """The table read as a stream into a collection that has a part of it already."""
    made, rows = filled(spark, sf_dir)
    made.upsert(rows.where("doc_name = 'd1'"))
    kind = table(spark, sf_dir, "embeddings").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/embeddings.parque[t]")
    stream_into(points(stream).withColumn("at", F.lit(1)), made, new_folder(spark, "stream"), "at").awaitTermination()
    return made.points().select("chunk_id", "doc_name")


@query(
    """SELECT count(*) FILTER (doc_id % 9 > 2) AS n, count(*) FILTER (doc_id % 9 > 2 AND doc_id % 3 = 2 AND quality = 1) AS n_correct, count(*) FILTER (doc_id % 9 <= 2) AS rejected, CAST(sum(doc_id % 101) FILTER (doc_id % 9 > 2) AS DOUBLE) AS sum_confidence FROM labels"""
)
def jsonl_results(spark, sf_dir):
    """Written as JSON lines with blank, broken and unscored ones among them, and read back."""
    path = new_folder(spark, "results")
    scored = table(spark, sf_dir, "labels").where("doc_id % 9 > 1").selectExpr("concat('q', doc_id) AS case_id", "CAST(doc_id % 101 AS INT) AS raw_confidence", "IF(doc_id % 9 = 2, NULL, CAST(doc_id % 3 AS INT)) AS judge_faithfulness", "CAST(quality AS INT) AS judge_relevance")
    S.write_jsonl(scored, path)
    broken = table(spark, sf_dir, "labels").where("doc_id % 9 <= 1")
    broken.selectExpr("IF(doc_id % 9 = 0, '{\"case_id\": \"x\", \"raw_conf', '[1]') AS value").unionByName(spark.createDataFrame([("  ",)], "value string")).write.mode("append").text(path)
    rows, rejected = S.read_results(spark, path)
    return rows.agg(F.count("*").alias("n"), F.sum("correct").alias("n_correct"), F.lit(rejected).cast("long").alias("rejected"), F.sum("raw_confidence").alias("sum_confidence"))


def _files(spark, sf_dir):
    """A folder with a text file a region (two pages, by a form feed), but for the first one; and their catalog."""
    import hashlib

    regions = sorted(table(spark, sf_dir, "region").collect())
    key, name = regions[0].__fields__[:2]
    top, entries = new_folder(spark, "corpus"), []
    for r in regions:
        text = f"1 {r[name]}\n\n about {r[name]} \f{'x' * 60} {r[key]}"
        sha = hashlib.sha256(text.encode()).hexdigest()
        entries.append({"name": f"n{r[key]}", "category": "manual" if r[key] % 2 else "structured", "url": f"{top}/{r[key]}", "filename": f"{r[name]}.txt", "description": "", "sha256": {0: None, 1: sha, 2: "0"}[r[key] % 3]})
        if r[key] > 0:
            S.write_text(spark, f"{top}/{entries[-1]['category']}/{r[name]}.txt", text)
    return top, entries


@query("SELECT 'n' || r_regionkey AS name, CASE WHEN r_regionkey = 0 THEN 'missing' WHEN r_regionkey % 3 = 2 THEN 'checksum' ELSE 'exists' END AS status, r_regionkey > 0 AND r_regionkey % 3 < 2 AS ok FROM region")
def manifest(spark, sf_dir):
    top, entries = _files(spark, sf_dir)
    return S.manifest(spark, S.catalog(spark, entries), top).select("name", "status", "ok")


@query("SELECT 'n' || r_regionkey AS name, r_name || '.txt' AS filename FROM region WHERE r_regionkey % 2 = 1")
def catalog_of_category(spark, sf_dir):
    _, entries = _files(spark, sf_dir)
    return S.catalog(spark, entries, "manual").select("name", "filename")


@query(
    """SELECT r_name AS doc_name, p AS page_num, o AS block_ord, CASE WHEN p = 2 THEN repeat('x', 60) || ' ' || r_regionkey WHEN o = 0 THEN '1 ' || r_name ELSE 'about ' || r_name END AS text FROM region, (VALUES (1, 0), (1, 1), (2, 0)) v(p, o) WHERE r_regionkey % 2 = 1"""
)
def parsed_files(spark, sf_dir):
    """The files of one category, their pages as blocks."""
    top, _ = _files(spark, sf_dir)
    pages = S.parse_files(S.files(spark, f"{top}/manual", "*.txt"), S.text_pages)
    return B.page_blocks(pages.where("error IS NULL")).select("doc_name", "page_num", "block_ord", "text")


@query("SELECT 'n' || r_regionkey AS name, r_name || ' ' || r_regionkey AS text FROM region WHERE r_regionkey > 0")
def long_pages(spark, sf_dir):
    """Pages of more than 50 characters once stripped."""
    rows = table(spark, sf_dir, "region").selectExpr("concat('n', r_regionkey) AS name", "IF(r_regionkey = 0, repeat(' ', 80), concat(repeat(' ', 9), r_name, ' ', r_regionkey, repeat('.', 60))) AS text")
    return B.content_pages(rows).withColumn("text", F.regexp_replace("text", r"\.+$", ""))


def _cases(spark, sf_dir):
    """A question set in YAML with a question a nation, read back: every third has no truth, and no notes."""
    import yaml

    rows = sorted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())
    each = []
    for key, name in rows:
        q = {"id": f"q{key}", "category": "ood" if key % 5 == 0 else "procedural", "difficulty": key % 3 + 1, "question": f"Where is {name}?"}
        q["ground_truth_chunks"] = None if key % 3 == 0 else [{"document": f"{name}.PDF", "section": "s"}, {"document": f"{name}.pdf", "section": "t"}]
        each.append(q | ({"notes": "n"} if key % 3 else {}))
    path = f"{new_folder(spark, 'questions')}/questions.yaml"
    S.write_text(spark, path, yaml.safe_dump({"version": "1", "questions": each}))
    return S.read_cases(spark, path)


@query(
    """SELECT 'q' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'ood' ELSE 'procedural' END AS category, CAST(n_nationkey % 3 + 1 AS INTEGER) AS difficulty, 'Where is ' || n_name || '?' AS question,
  CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS truth, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'n' END AS notes, n_nationkey % 5 = 0 AS is_ood FROM nation"""
)
def question_set(spark, sf_dir):
    """With the names of the true documents, once each and without their endings."""
    got = _cases(spark, sf_dir)
    return got.select("id", "category", "difficulty", "question", F.array_join(truth_names(F.col("ground_truth_chunks")), ",").alias("truth"), "notes", (F.col("category") == "ood").alias("is_ood"))


@query("SELECT 'q' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'ood' ELSE 'procedural' END AS category, CAST(n_nationkey % 3 + 1 AS INTEGER) AS difficulty, 'Where is ' || n_name || '?' AS question FROM nation")
def dry_run(spark, sf_dir):
    """The question set alone."""
    return list_cases(_cases(spark, sf_dir))


@query("SELECT 2.5::DOUBLE AS coef, -0.125::DOUBLE AS intercept, 0.5::DOUBLE AS feature_mean, 0.25::DOUBLE AS feature_std, count(*) AS n_train, 0.0625::DOUBLE AS train_ece, 0.1875::DOUBLE AS train_brier FROM nation")
def model_file(spark, sf_dir):
    """A calibration model written twice and read back."""
    path = f"{new_folder(spark, 'models')}/model.json"
    model = {"coef": 2.5, "intercept": -0.125, "feature_mean": 0.5, "feature_std": 0.25, "n_train": table(spark, sf_dir, "nation").count(), "train_ece": 0.0625, "train_brier": 0.1875}
    S.save_model(spark, model | {"coef": 0.0}, path)
    S.save_model(spark, model, path)
    got = S.load_model(spark, path)
    return spark.createDataFrame([tuple(got.values())], S.MODEL)


#: A layout of line items: packed, zoned and binary numbers, texts, and a day that is written as text.
ITEM = [Rule("orderkey", 1, 6, "packed"), Rule("line", 7, 2, "binary"), Rule("quantity", 9, 6, "zoned", 2), Rule("price", 15, 7, "packed", 2), Rule("flag", 22, 1, "text"), Rule("shipped", 23, 8, "date"), Rule("supplier", 31, 9, "zoned")]


def _items(spark, sf_dir):
    """Line items as EBCDIC records and back. Of each 97th order the day is none; each 13th supplier is unknown; and a file more
    ends within a record."""
    import dataclasses

    path = new_folder(spark, "items")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS orderkey", "l_linenumber AS line", "CAST(-l_quantity AS DECIMAL(18,2)) AS quantity", "CAST(l_extendedprice AS DECIMAL(18,2)) AS price", "l_returnflag AS flag", "IF(l_orderkey % 97 = 0, '20010230', date_format(l_shipdate, 'yyyyMMdd')) AS shipped", "IF(l_suppkey % 13 = 0, NULL, l_suppkey) AS supplier")
    write_records(rows, path, [dataclasses.replace(r, kind="text") if r.name == "shipped" else r for r in ITEM], 40)
    S.write_text(spark, f"{path}/short", "x" * 25)
    return read_records(spark, path, ITEM, 40, range=1 << 20)


@query("SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, -l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS shipped, CASE WHEN l_suppkey % 13 > 0 THEN l_suppkey END AS supplier FROM lineitem WHERE l_orderkey % 97 > 0")
def record_fields(spark, sf_dir):
    """The records that follow the layout."""
    got = _items(spark, sf_dir).where("_error IS NULL")
    return got.selectExpr("orderkey", "line", "CAST(quantity AS DOUBLE) AS quantity", "CAST(price AS DOUBLE) AS price", "flag", "CAST(shipped AS STRING) AS shipped", "supplier")


@query("SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'shipped' END AS field, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT '(cut off)', 1")
def record_rejects(spark, sf_dir):
    return tally(_items(spark, sf_dir))


@query(
    """WITH s AS (SELECT 'u' || user_id AS trace_id, user_id, event_id, event_type AS kind, ts, value FROM events),
k AS (SELECT trace_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT trace_id, kind, count(*) AS n FROM s GROUP BY ALL) GROUP BY trace_id)
SELECT trace_id, CASE WHEN any_value(user_id) % 2 = 0 THEN 'complete' ELSE 'incomplete' END AS status, count(*) AS n_spans, count(*) FILTER (event_id % 7 = 0) AS n_errors, datediff('microsecond', min(ts), max(ts)) AS micros, round(sum(value), 4) AS seconds, any_value(kinds) AS kinds
FROM s JOIN k USING (trace_id) GROUP BY trace_id"""
)
def trace_stream(spark, sf_dir):
    """A user's events are a trace. They come in four batches, in no order; of every second user the first span says how many
    there are, the others' traces end when two batches from another time have moved the watermark past them."""
    top = new_folder(spark, "spans")
    own = table(spark, sf_dir, "events").selectExpr("concat('u', user_id) AS trace_id", "CAST(event_id AS STRING) AS span_id", "event_type AS kind", "CAST(ts AS TIMESTAMP) AS ts", "CAST(value AS DOUBLE) AS seconds", "IF(event_id % 7 = 0, 'failed', NULL) AS error", "user_id")
    sizes = own.groupBy("trace_id").agg(F.count("*").cast("int").alias("spans"), F.min("span_id").alias("root"))
    spans = own.join(sizes, "trace_id").withColumn("spans", F.when((F.col("span_id") == F.col("root")) & (F.col("user_id") % 2 == 0), F.col("spans"))).drop("root", "user_id")
    spans.select(*[x.split()[0] for x in SPAN.split(", ")]).repartition(4, "span_id").write.parquet(top)
    for days in (1000, 2000):
        spark.createDataFrame([("later", str(days))], "trace_id string, span_id string").selectExpr("trace_id", "span_id", "'x' AS kind", f"timestampadd(DAY, {days}, TIMESTAMP '2024-01-01 00:00:00') AS ts", "0D AS seconds", "CAST(NULL AS STRING) AS error", "CAST(NULL AS INT) AS spans").coalesce(1).write.mode("append").parquet(top)
    stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).parquet(top)
    out = new_folder(spark, "traces")
    write_traces(stream, out, new_folder(spark, "stream"), gap_s=86_400, keep_s=86_400, delay="40 days").awaitTermination()
    kinds = F.array_join(F.transform("kinds", lambda k: F.concat(k["kind"], F.lit(":"), k["n"].cast("string"))), ",")
    got = read_traces(spark, out).where("trace_id <> 'later'")
    return got.select("trace_id", "status", "n_spans", "n_errors", (F.col("ended") - F.col("started")).alias("micros"), F.round("seconds", 4).alias("seconds"), kinds.alias("kinds"))
