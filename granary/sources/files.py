"""File sources and sinks: catalog, download, manifest, document files, JSON lines, question sets, prompts, models."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "name string, category string, url string, filename string, description string, sha256 string"
CASES = "id string, category string, difficulty int, question string, ground_truth_answer string, ground_truth_chunks array<struct<document:string,section:string>>, notes string"
RESULT = "case_id string, raw_confidence double, judge_faithfulness int, judge_relevance int, correct int"
MODEL = "coef double, intercept double, feature_mean double, feature_std double, n_train long, train_ece double, train_brier double"


def read_text(spark: SparkSession, path: str) -> str:
    """One small text file of any store, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file: written beside its place, then renamed into it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = place.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"cannot write {path}")


def catalog(spark: SparkSession, entries: list[dict], category: str | None = None) -> DataFrame:
    """Datasets (name, category, url, filename, description, sha256), all or of one category."""
    rows = [tuple(e[k] if k != "sha256" else e.get(k) for k in (x.split()[0] for x in CATALOG.split(", "))) for e in entries]
    df = spark.createDataFrame(rows, CATALOG)
    return df if category is None else df.where(F.col("category") == category)


def download(datasets: DataFrame, folder: str, force: bool = False, timeout: int = 120) -> DataFrame:
    """(name, ok, message) for each catalog row: the file is in folder/category/filename, a mount that all executors share.

    Present files are kept unless ``force``. Pieces of 64 KB go to a ``.tmp`` file, which is renamed when it is whole; any
    error makes a row of its own. Rows run in as many tasks as the table has partitions."""

    def one(category, url, filename):
        target = os.path.join(folder, category, filename)
        if os.path.exists(target) and not force:
            return True, f"exists ({os.path.getsize(target)} bytes)"
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            sha, size = hashlib.sha256(), 0
            with urllib.request.urlopen(url, timeout=timeout) as got, open(f"{target}.tmp", "wb") as out:
                while piece := got.read(64 * 1024):
                    out.write(piece)
                    sha.update(piece)
                    size += len(piece)
            os.replace(f"{target}.tmp", target)
            return True, f"downloaded {size} bytes (sha256 {sha.hexdigest()})"
        except Exception as e:  # a row's failure must not end the others
            return False, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            rows = [(n, *one(c, u, f)) for n, c, u, f in zip(*(x.to_pylist() for x in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.string()))], names=["name", "ok", "message"])

    return datasets.select("name", "category", "url", "filename").mapInArrow(run, "name string, ok boolean, message string")


def tally(results: DataFrame) -> DataFrame:
    """(ok, n) of download or manifest rows."""
    return results.groupBy("ok").agg(F.count("*").alias("n"))


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, doc_name, length, content) of a folder's files in the order of their paths; none raises."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if rows.select("path").isEmpty():
        raise ValueError(f"no {glob} in {folder}")
    return rows.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("doc_name"), "length", "content").orderBy("path")


def manifest(spark: SparkSession, datasets: DataFrame, folder: str) -> DataFrame:
    """(name, filename, bytes, sha256, ok, status) of a catalog against the files under a folder: exists, missing, or another
    checksum than the catalog's (which is compared where it has one)."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    there = there.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("_at"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("_sha"))
    joined = datasets.withColumn("_at", F.concat_ws("/", "category", "filename")).join(there, "_at", "left")
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("_sha")), "checksum").otherwise("exists")
    return joined.select("name", "filename", "bytes", F.col("_sha").alias("sha256"), (status == "exists").alias("ok"), status.alias("status"))


def pdf_pages(content: bytes):
    """(spans, plain, failed) of each page of a PDF, by the optional pypdf library."""
    import io

    import pypdf

    for page in pypdf.PdfReader(io.BytesIO(content)).pages:
        spans: list = []
        try:
            page.extract_text(visitor_text=lambda t, cm, tm, font, size: spans.append((t, float(size or 0))))
            yield spans, None, False
        except Exception:
            yield spans, page.extract_text() or "", True


def text_pages(content: bytes):
    """(spans, plain, failed) of each page of a plain text: form feeds part pages, lines are blocks of unknown size."""
    for page in content.decode("utf-8", "replace").split("\f"):
        yield [], page, True


def parse_files(found: DataFrame, pages_of=pdf_pages) -> DataFrame:
    """Files (doc_name, content) to pages (doc_name, page_num from 1, spans, plain, failed, error). A file that can't be read
    is one row with its error and no page."""
    schema = "doc_name string, page_num int, spans array<struct<text:string,font_size:double>>, plain string, failed boolean, error string"
    span = pa.list_(pa.struct([("text", pa.string()), ("font_size", pa.float64())]))
    kinds = [pa.string(), pa.int32(), span, pa.string(), pa.bool_(), pa.string()]

    def run(batches):
        for b in batches:
            for name, content in zip(b[0].to_pylist(), b[1].to_pylist()):
                try:
                    rows = [(name, i, [{"text": t, "font_size": s} for t, s in spans], plain, failed, None) for i, (spans, plain, failed) in enumerate(pages_of(content), 1)]
                except Exception as e:
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in ("doc_name", "page_num", "spans", "plain", "failed", "error")])

    return found.select("doc_name", "content").mapInArrow(run, schema)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A YAML question set as rows; id, category, difficulty and question must be there (a missing one raises KeyError)."""
    got = yaml.safe_load(read_text(spark, path))["questions"]
    truth = lambda q: [(c.get("document", ""), c.get("section")) for c in q.get("ground_truth_chunks") or []]
    rows = [(str(q["id"]), q["category"], int(q["difficulty"]), q["question"], q.get("ground_truth_answer", ""), truth(q), q.get("notes", "")) for q in got]
    return spark.createDataFrame(rows, CASES)


def read_prompt(spark: SparkSession, path: str, needs: tuple = ("version", "model", "max_tokens", "system", "user_template")) -> dict:
    """A YAML prompt or notice file; missing fields raise."""
    got = yaml.safe_load(read_text(spark, path))
    if missing := [k for k in needs if k not in got]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return got


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    rows.write.option("ignoreNullFields", False).json(path)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """JSON lines of scored answers as (case_id, raw_confidence, judge_faithfulness, judge_relevance, correct), and the number
    of lines that are no such object: broken JSON, or a score missing or of a wrong type. Blank lines don't count. The scores
    may be named without ``judge_`` too."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kinds = "case_id string, raw_confidence string, judge_faithfulness string, judge_relevance string, faithfulness string, relevance string"
    got = lines.select(F.from_json("value", kinds, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    whole = lambda *c: F.coalesce(*[F.col(x).try_cast("int") for x in c])
    rows = got.select("case_id", F.col("raw_confidence").try_cast("double").alias("raw_confidence"), whole("judge_faithfulness", "faithfulness").alias("judge_faithfulness"), whole("judge_relevance", "relevance").alias("judge_relevance"))
    scored = F.col("raw_confidence").isNotNull() & F.col("judge_faithfulness").isNotNull() & F.col("judge_relevance").isNotNull()
    rejected = rows.agg(F.count_if(~scored)).first()[0]
    right = ((F.col("judge_faithfulness") == 2) & (F.col("judge_relevance") >= 1)).cast("int")
    return rows.where(scored).withColumn("correct", right), rejected


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    write_text(spark, path, json.dumps({x.split()[0]: model[x.split()[0]] for x in MODEL.split(", ")}, indent=2))


def load_model(spark: SparkSession, path: str) -> dict:
    got = json.loads(read_text(spark, path))
    return {x.split()[0]: got[x.split()[0]] for x in MODEL.split(", ")}
