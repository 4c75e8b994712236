"""Vector collections: a log of Parquet segments of points, keyed by point id, with an inverted index over names.

A write appends a segment (the new points, and the names of documents whose older points go) and commits it by one new log
file; what isn't in the log isn't seen. Nothing older is read or rewritten, so a batch costs its own size. Reads merge: of a point id
the row of the highest sequence number counts, wherever its document lies, unless it's deleted or its document was replaced later. The
rows of a large, compacted base are only matched against the ids of the segments after it. ``compact`` folds the
segments into one, or everything into a new base; ``vacuum`` removes what no reader of the log needs.

Segments are sorted by document, and each has an index from document names and section path entries to files. A scoped read takes
the files that the index names, then Parquet's own statistics and Bloom filters. One writer commits at a time; the loser of a
race raises and can try again."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.serving import point_id
from granary.sources.files import read_text, write_text
from granary.sources.shared import delete

INDEXED = ("doc_name", "section_path")
INDEX = "field string, term string, segment string, file string, n bigint"
#: Rows of a file; ids of later segments that go to all tasks (some 40 bytes each), beyond which they are joined by sorting.
FILE_ROWS, SENT_IDS = 50_000, 500_000


def latest(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Of rows with an equal key, the one that comes last by ``order``."""
    last = Window.partitionBy(key).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The old rows that no new row replaces, and the new rows; a repeated run changes nothing. Of new rows with an equal key,
    the last by ``order`` counts (any one without it)."""
    new = latest(new, key, order) if order else new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class Conflict(RuntimeError):
    """Another writer has committed this number."""


class Collection:
    """Points (chunk fields, embedding, point_id) in a folder, or in the folder of a catalog table where ``place`` is a plain name.

    Vectors of another dimension than the collection's raise, as does a second dimension for an existing collection. ``buckets``:
    a base has that many files at least, so that a scope is a small part of it."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = 64):
        self.spark, self.place, self.buckets, self.is_path = spark, place.rstrip("/"), buckets, "/" in place

    # Places

    def _root(self) -> str | None:
        if self.is_path:
            return self.place
        if not self.spark.catalog.tableExists(self.place):
            return None
        return next(r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self.place}").collect() if r.col_name == "Location")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def info(self) -> dict | None:
        """name, dimension, distance, schema and indexed fields as created; None without a collection."""
        root = self._root()
        if root is None:
            return None
        fs, p = self._at(f"{root}/_log/collection.json")
        return json.loads(read_text(self.spark, f"{root}/_log/collection.json")) if fs.exists(p) else None

    def ensure(self, dimension: int, schema: str) -> None:
        """Create the collection if there is none. ``schema``: the points' fields, doc_name and chunk_id among them."""
        have = self.info()
        if have:
            if have["dimension"] != dimension:
                raise ValueError(f"the collection has vectors of {have['dimension']}, not {dimension}")
            return
        if not self.is_path:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.place} ({schema}, embedding array<float>, point_id string) USING parquet")
        names = self.spark.createDataFrame([], schema).columns
        made = {"name": self.place.rsplit("/", 1)[-1], "dimension": dimension, "distance": "cosine", "schema": f"{schema}, embedding array<float>, point_id string", "indexed": [f for f in INDEXED if f in names]}
        write_text(self.spark, f"{self._root()}/_log/collection.json", json.dumps(made))

    def _known(self) -> dict:
        have = self.info()
        if have is None:
            raise ValueError(f"no collection at {self.place}")
        return have

    # The log

    def log(self) -> list[dict]:
        """All commits in their order: number, kind (delta or base), segment, rows, dropped (names of documents), covers
        (numbers that it stands for), streams (each stream's last batch)."""
        fs, p = self._at(f"{self._root()}/_log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        paths = [f"{self._root()}/_log/{n}" for n in names if n[0].isdigit() and n.endswith(".json")]
        if not paths:
            return []
        return sorted((json.loads(r[0]) for r in self.spark.read.text(paths, wholetext=True).collect()), key=lambda e: e["number"])  # a line a commit

    def _live(self) -> tuple[list[dict], list[dict]]:
        """(the base, or none; the segments after it)."""
        entries = self.log()
        gone = {n for e in entries for n in e["covers"]}
        live = [e for e in entries if e["number"] not in gone]
        return [e for e in live if e["kind"] == "base"], [e for e in live if e["kind"] == "delta"]

    def _commit(self, entry: dict) -> None:
        """The entry's file is made only if its number is free."""
        fs, p = self._at(f"{self._root()}/_log/{entry['number']:012d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise Conflict(f"commit {entry['number']} of {self.place} was made by another writer") from e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    # Segments

    def _schema(self) -> str:
        return f"{self._known()['schema']}, seq bigint, gone boolean"

    def _rows(self, entries: list[dict], files: dict[str, list[str]] | None = None) -> DataFrame:
        """The rows of segments, or of those files of them."""
        root = self._root()
        if files is None:
            paths = [f"{root}/data/{e['segment']}" for e in entries if e["rows"]]
        else:
            paths = [f"{root}/data/{e['segment']}/{f}" for e in entries for f in files.get(e["segment"], [])]
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    def _dropped(self, entries: list[dict]) -> DataFrame | None:
        """(doc_name, dropped): the documents whose points below that sequence number are gone."""
        paths = [f"{self._root()}/dropped/{e['segment']}" for e in entries if e["dropped"]]
        return self.spark.read.schema("doc_name string, seq bigint").parquet(*paths).groupBy("doc_name").agg(F.max("seq").alias("dropped")) if paths else None

    def _write(self, rows: DataFrame, n: int, least: int = 1) -> str:
        """A segment of n rows, sorted by document, and its index."""
        root, segment = self._root(), uuid.uuid4().hex
        if not n:
            return segment
        parts = max(least, -(-n // FILE_ROWS))
        out = rows.repartitionByRange(parts, "doc_name", "point_id").sortWithinPartitions("doc_name", "point_id").write
        for field in ("doc_name", "point_id"):
            out = out.option(f"parquet.bloom.filter.enabled#{field}", "true").option(f"parquet.bloom.filter.expected.ndv#{field}", str(-(-n // parts)))
        out.parquet(f"{root}/data/{segment}")
        have = self._known()["indexed"]
        light = self.spark.read.schema(self._schema()).parquet(f"{root}/data/{segment}").select(*have, F.col("_metadata.file_name").alias("file"))
        kinds = dict(light.dtypes)
        terms = [light.select(F.lit(f).alias("field"), (F.explode(F.array_distinct(f)) if kinds[f].startswith("array") else F.col(f)).alias("term"), "file") for f in have]
        every = terms[0]
        for t in terms[1:]:
            every = every.unionByName(t)
        index = every.where("term IS NOT NULL").groupBy("field", "term", "file").agg(F.count("*").alias("n")).withColumn("segment", F.lit(segment)).select("field", "term", "segment", "file", "n")
        index.repartitionByRange(-(-parts // 16), "field", "term").sortWithinPartitions("field", "term").write.parquet(f"{root}/index/{segment}")
        return segment

    def files_of(self, terms: DataFrame, field: str = "doc_name") -> dict[str, list[str]]:
        """Segment -> files that have points with one of the terms (a column ``term``) in an indexed field."""
        if field not in self._known()["indexed"]:
            raise ValueError(f"{field} is not indexed")
        base, deltas = self._live()
        paths = [f"{self._root()}/index/{e['segment']}" for e in base + deltas if e["rows"]]
        if not paths:
            return {}
        index = self.spark.read.schema(INDEX).parquet(*paths).where(F.col("field") == field)
        out: dict[str, list[str]] = {}
        for r in index.join(terms.select("term").distinct(), "term", "left_semi").select("segment", "file").distinct().collect():  # names of files
            out.setdefault(r.segment, []).append(r.file)
        return out

    # Reading

    def _merged(self, files: dict[str, list[str]] | None = None) -> DataFrame:
        """The rows that count, with seq; those of ``files`` if given."""
        base, deltas = self._live()
        old, new = self._rows(base, files), self._rows(deltas, files)
        if not deltas:
            return old
        # Ids and numbers alone: vectors are read just where their rows are kept.
        newest = self._rows(deltas).groupBy("point_id").agg(F.max("seq").alias("seq"))
        if sum(e["rows"] for e in deltas) <= SENT_IDS:
            newest = F.broadcast(newest)
        every = old.join(newest.select("point_id"), "point_id", "left_anti").unionByName(new.join(newest, ["point_id", "seq"], "left_semi"))
        dropped = self._dropped(deltas)
        if dropped is not None:
            every = every.join(F.broadcast(dropped) if sum(e["dropped"] for e in deltas) <= SENT_IDS else dropped, "doc_name", "left").where("dropped IS NULL OR seq >= dropped").drop("dropped")
        return every.select(*old.columns)

    def points(self, scope: list[str] | DataFrame | None = None, field: str = "doc_name") -> DataFrame:
        """The points; with ``scope`` (names, or a column ``term`` of them) those with one of the names in an indexed field, read
        from the files that the index gives."""
        fields = self.spark.createDataFrame([], self._known()["schema"]).columns
        if scope is None:
            return self._merged().where("NOT gone").select(*fields)
        terms = scope if isinstance(scope, DataFrame) else self.spark.createDataFrame([(s,) for s in scope], "term string")
        rows = self._merged(self.files_of(terms, field)).where("NOT gone")
        if isinstance(scope, list):  # pushed down to the files' statistics and Bloom filters
            names = F.col(field).isin(scope) if dict(rows.dtypes)[field] == "string" else F.arrays_overlap(F.col(field), F.array(*[F.lit(s) for s in scope]).cast("array<string>"))
            return rows.where(names).select(*fields)
        terms = terms.select("term").distinct()
        if dict(rows.dtypes)[field] == "string":
            return rows.join(terms, F.col(field) == F.col("term"), "left_semi").select(*fields)
        matching = rows.select("point_id", F.explode(field).alias("term")).join(terms, "term", "left_semi").select("point_id").distinct()
        return rows.join(matching, "point_id", "left_semi").select(*fields)

    # Writing

    def _append(self, rows: DataFrame | None, n: int, dropped: DataFrame | None, stream: tuple[str, int] | None) -> None:
        """One delta. rows: fields and point_id, gone; their sequence number is the commit's."""
        entries = self.log()
        number = 1 + max((e["number"] for e in entries), default=0)
        seq = F.lit(number).cast("long").alias("seq")
        columns = self.spark.createDataFrame([], self._schema()).columns
        segment = self._write(rows.withColumn("seq", seq).select(*columns), n) if rows is not None else uuid.uuid4().hex
        if dropped is not None:
            dropped.select("doc_name", seq).write.parquet(f"{self._root()}/dropped/{segment}")
        names = self._dropped([{"segment": segment, "dropped": 1}]).count() if dropped is not None else 0
        self._commit({"number": number, "kind": "delta", "segment": segment, "rows": n, "dropped": names, "covers": [], "streams": dict([stream]) if stream else {}})

    def upsert(self, chunks: DataFrame, order: str | None = None, replace_documents: bool = False, stream: tuple[str, int] | None = None) -> int:
        """Append chunks (fields, embedding) by their point ids and return how many points were written. Of chunks with one id the
        last by ``order`` counts, then that of the largest hash, so that a run repeated gives the same.

        replace_documents: older points of the same documents go, so chunks whose ids changed with their boundaries leave none
        behind. stream: a stream's name and batch; a batch that is in the log already is not written again."""
        have = self._known()
        if stream and any(e["streams"].get(stream[0], -1) >= stream[1] for e in self.log()):
            return 0
        bad = chunks.where(F.col("embedding").isNull() | (F.size("embedding") != have["dimension"]))
        if not bad.isEmpty():
            raise ValueError(f"vectors without {have['dimension']} components")
        fields = self.spark.createDataFrame([], have["schema"]).columns
        new = chunks.withColumn("point_id", point_id(F.col("chunk_id")))
        new = latest(new, "point_id", *([order] if order else []), F.xxhash64(*fields)).select(*fields, F.lit(False).alias("gone")).persist()
        try:
            n = new.count()
            if n:
                self._append(new, n, new.select("doc_name").distinct() if replace_documents else None, stream)
            return n
        finally:
            new.unpersist()

    def remove(self, chunk_ids: DataFrame) -> None:
        """Delete points by their chunks' ids (a column chunk_id)."""
        gone = chunk_ids.select("chunk_id").distinct().withColumn("point_id", point_id(F.col("chunk_id")))
        empty = self.spark.createDataFrame([], self._schema()).drop("seq")
        self._append(empty.unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True), gone.count(), None, None)

    def remove_documents(self, names: DataFrame) -> None:
        """Delete all points of documents (a column doc_name)."""
        self._append(None, 0, names.select("doc_name").distinct(), None)

    def compact(self, full: bool = False) -> bool:
        """Fold the segments after the base into one, at their own size; with ``full`` everything into a new base. Returns whether there
        was anything to fold. Rows keep their sequence numbers, so segments committed meanwhile stay the newer ones."""
        base, deltas = self._live()
        if not deltas or not full and len(deltas) < 2:
            return False
        streams: dict[str, int] = {}
        for e in base + deltas:
            streams |= {k: max(v, streams.get(k, v)) for k, v in e["streams"].items()}
        if full:
            rows = self._merged().where("NOT gone")
            n = rows.count()
            entry = {"kind": "base", "segment": self._write(rows, n, self.buckets), "rows": n, "dropped": 0}
        else:
            rows = self._rows(deltas)
            rows = rows.join(rows.groupBy("point_id").agg(F.max("seq").alias("seq")), ["point_id", "seq"], "left_semi").select(*rows.columns)
            n, dropped = rows.count(), self._dropped(deltas)
            entry = {"kind": "delta", "segment": self._write(rows, n), "rows": n, "dropped": 0}
            if dropped is not None:
                dropped.select("doc_name", F.col("dropped").alias("seq")).write.parquet(f"{self._root()}/dropped/{entry['segment']}")
                entry["dropped"] = sum(e["dropped"] for e in deltas)
        covers = [e["number"] for e in (base if full else []) + deltas]
        while True:
            entries = self.log()
            if {n for e in entries for n in e["covers"]} & set(covers):
                raise Conflict("these segments have been folded by another writer")
            try:
                self._commit(entry | {"number": 1 + max(e["number"] for e in entries), "covers": covers, "streams": streams})
                return True
            except Conflict:
                continue

    def vacuum(self) -> int:
        """Remove segments and log entries that others stand for, and segments that were never committed; readers that began
        before may still need them. Returns how many segments went."""
        base, deltas = self._live()
        live, root, n = {e["segment"] for e in base + deltas}, self._root(), 0
        for part in ("data", "index", "dropped"):
            fs, p = self._at(f"{root}/{part}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in live:
                    delete(self.spark, s.getPath().toString())
                    n += part == "data"
        kept = {e["number"] for e in base + deltas}
        for e in self.log():
            if e["number"] not in kept:
                delete(self.spark, f"{root}/_log/{e['number']:012d}.json")
        return n

    def count(self) -> int:
        return self.points().count()

    def collection_info(self) -> DataFrame:
        """(name, points_count, vector_size, distance) in one row."""
        have = self._known()
        return self.points().agg(F.lit(have["name"]).alias("name"), F.count("*").alias("points_count"), F.lit(have["dimension"]).alias("vector_size"), F.lit(have["distance"]).alias("distance"))
