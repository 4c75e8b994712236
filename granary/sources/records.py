"""Fixed-width record files, ASCII or EBCDIC, as a Spark data source (``fixedwidth``).

A file is records of one length, each perhaps followed by a gap (a line end). Tasks read ranges of whole records, so a file of any size
is split; a range is a byte matrix, and a field is a slice of its columns, decoded for all records at once. Field rules are a
table: name, start (from 1), length, kind and scale. Kinds:

- text: characters of the code page, blanks at the end dropped, all blank is null
- zoned: a digit a byte, the sign in the last byte's upper half (overpunched in ASCII files; plain digits are positive too)
- packed: two digits a byte, the sign in the last half byte
- binary: a big-endian two's complement number
- date: eight digits, year first; zeros are null

Numbers of scale 0 are bigint, others decimals; a numeric field of blanks is null. A record with a field that doesn't follow its
rule, or that the file's end cuts off, is rejected: its fields are null and ``_error`` names the file, the record and the field.
Files are opened by pyarrow: local ones, or the stores that it knows by their URI."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RULES = "name string, start int, length int, kind string, scale int"
KINDS = ("text", "zoned", "packed", "binary", "date")
#: Half bytes and zones that mean a sign; digits of a number that fits 64 bits.
PLUS, MINUS, DIGITS = (0xA, 0xC, 0xE, 0xF), (0xB, 0xD), 18
#: Bytes of a task's range, and records decoded at a time.
RANGE, ROWS, BLANK = 64 << 20, 1 << 16, 0x40


@dataclass(frozen=True)
class Rule:
    name: str
    start: int
    length: int
    kind: str
    scale: int = 0

    def digits(self) -> int:
        return 2 * self.length - 1 if self.kind == "packed" else {1: 2, 2: 4, 4: 9, 8: 18}.get(self.length, 19) if self.kind == "binary" else self.length

    def sql(self) -> str:
        kind = {"text": "string", "date": "date"}.get(self.kind) or (f"decimal({DIGITS},{self.scale})" if self.scale else "bigint")
        return f"`{self.name}` {kind}"


def checked(rules: list[Rule], length: int) -> list[Rule]:
    for r in rules:
        if r.kind not in KINDS or r.start < 1 or r.length < 1 or r.start + r.length - 1 > length:
            raise ValueError(f"field {r.name}: no such kind or place")
        if r.kind == "date" and r.length != 8 or r.kind not in ("text", "date") and (r.digits() > DIGITS or not 0 <= r.scale <= DIGITS):
            raise ValueError(f"field {r.name}: {r.kind} of {r.length} bytes")
    if len({r.name for r in rules} | {"_error"}) != len(rules) + 1:
        raise ValueError("field names must differ, and from _error")
    return rules


def code_page(name: str) -> tuple[np.ndarray, str]:
    """The code page's 256 characters by code point, and for ASCII-like ones the page that their numbers are turned to first."""
    chars = [c if len(c) == 1 else "\N{REPLACEMENT CHARACTER}" for c in (bytes([i]).decode(name, "replace") for i in range(256))]
    return np.array([ord(c) for c in chars], np.uint32), "".join(chars)


def to_ebcdic(name: str) -> np.ndarray:
    """For each byte of the code page, that of the same character in page 037 (the page itself for EBCDIC ones)."""
    _, chars = code_page(name)
    return np.array([c.encode("cp037", "replace")[0] for c in chars], np.uint8)


def decimals(values: np.ndarray, right: np.ndarray, scale: int) -> pa.Array:
    """Unscaled 64-bit numbers as decimals, without a step a row."""
    wide = np.empty((len(values), 2), np.int64)
    wide[:, 0], wide[:, 1] = values, values >> 63
    valid = pa.array(right).cast(pa.bool_()).buffers()[1]
    return pa.Array.from_buffers(pa.decimal128(DIGITS, scale), len(values), [valid, pa.py_buffer(wide.tobytes())])


def _sum(digits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(digits), np.int64)
    for i in range(digits.shape[1]):
        out = out * 10 + digits[:, i]
    return out


def numbers(own: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, null, wrong) of a numeric field's bytes in page 037."""
    null = (own == BLANK).all(1)
    if kind == "binary":
        value = np.where(own[:, 0] >= 128, -1, 0).astype(np.int64)
        for i in range(own.shape[1]):
            value = (value << 8) | own[:, i]
        return value, np.zeros(len(own), bool), np.zeros(len(own), bool)
    if kind == "packed":
        halves = np.stack([own >> 4, own & 15], 2).reshape(len(own), -1)
        digits, sign = halves[:, :-1], halves[:, -1]
        fine = np.isin(sign, PLUS + MINUS)
    else:
        digits, sign = own & 15, own[:, -1] >> 4
        fine = (own[:, :-1] >> 4 == 0xF).all(1) & (np.isin(sign, PLUS + MINUS) if kind == "zoned" else sign == 0xF)
    wrong = ~null & ~(fine & (digits <= 9).all(1))
    value = _sum(np.where(digits <= 9, digits, 0).astype(np.int64))
    return np.where(np.isin(sign, MINUS), -value, value), null, wrong


def texts(own: np.ndarray, points: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(texts without blanks at the end, wrong)."""
    chars = points[own]
    wide = np.ascontiguousarray(chars).view(f"U{own.shape[1]}").reshape(-1)  # one string a record
    stripped = np.char.rstrip(wide, " ")
    return pa.array(stripped, pa.string(), mask=stripped == ""), (chars == 0xFFFD).any(1)


def dates(own: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    value, null, wrong = numbers(own, "date")
    null |= ~wrong & (value == 0)
    y, m, d = value // 10_000, value // 100 % 100, value % 100
    month = (y - 1970) * 12 + m - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]")
    day = first + (d - 1)
    wrong |= ~null & ~((y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (day.astype("datetime64[M]") == first.astype("datetime64[M]")))
    return pa.array(day.astype("datetime64[D]"), pa.date32(), mask=null | wrong), wrong


def decoded(matrix: np.ndarray, rules: list[Rule], page: str, place: str, first: int) -> pa.RecordBatch:
    """The records of a byte matrix; ``first`` is the number of its first record in the file ``place``."""
    points, ebcdic = code_page(page)[0], to_ebcdic(page)
    cols, bad = [], np.full(len(matrix), "", object)
    for r in rules:
        own = matrix[:, r.start - 1 : r.start - 1 + r.length]
        if r.kind == "text":
            col, wrong = texts(own, points)
        elif r.kind == "date":
            col, wrong = dates(ebcdic[own])
        else:
            value, null, wrong = numbers(own if r.kind in ("packed", "binary") else ebcdic[own], r.kind)
            col = decimals(value, ~(null | wrong), r.scale) if r.scale else pa.array(value, pa.int64(), mask=null | wrong)
        cols.append(col)
        bad[wrong & (bad == "")] = r.name
    reject = bad != ""
    if reject.any():
        cols = [pc.if_else(pa.array(reject), pa.scalar(None, c.type), c) for c in cols]
    errors = [f"{place}: record {first + i}: {bad[i]}" if reject[i] else None for i in range(len(matrix))] if reject.any() else [None] * len(matrix)
    return pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string())], names=[*[r.name for r in rules], "_error"])


def encoded(batch: pa.RecordBatch, rules: list[Rule], length: int, page: str, gap: bytes) -> bytes:
    """Records of a batch's columns; a value that doesn't fit its field raises."""
    n = batch.num_rows
    ebcdic = to_ebcdic(page)
    back = np.zeros(256, np.uint8)
    back[ebcdic[::-1]] = np.arange(255, -1, -1, dtype=np.uint8)
    out = np.full((n, length + len(gap)), " ".encode(page)[0], np.uint8)
    out[:, length:] = np.frombuffer(gap, np.uint8)
    for r in rules:
        col, own = batch.column(batch.schema.get_field_index(r.name)), out[:, r.start - 1 : r.start - 1 + r.length]
        none = np.asarray(col.is_null())
        if r.kind == "text":
            parts = [(v or "").encode(page) for v in col.to_pylist()]
            if any(len(p) > r.length for p in parts):
                raise ValueError(f"{r.name}: a text is longer than {r.length}")
            own[:] = np.frombuffer(b"".join(p.ljust(r.length, " ".encode(page)) for p in parts), np.uint8).reshape(n, r.length)
            continue
        if r.kind == "date":
            days = col.cast(pa.date32()).cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False).astype("datetime64[D]")
            y, m = days.astype("datetime64[Y]").astype(np.int64) + 1970, days.astype("datetime64[M]").astype(np.int64) % 12 + 1
            value = np.where(none, 0, y * 10_000 + m * 100 + (days - days.astype("datetime64[M]")).astype(np.int64) + 1)
        else:
            wide = pa.decimal128(38, r.scale)
            exact = col.cast(wide)  # raises if digits would be lost
            value = np.frombuffer(exact.buffers()[1], np.int64).reshape(-1, 2)[exact.offset : exact.offset + n, 0].copy()
            value[none] = 0
        if r.kind == "binary":
            if none.any():
                raise ValueError(f"{r.name}: binary fields have no null")
            if ((value >> (8 * r.length - 1)) != (value >> 63)).any():
                raise ValueError(f"{r.name}: a number is too large")
            own[:] = np.stack([(value >> (8 * (r.length - 1 - i))) & 255 for i in range(r.length)], 1).astype(np.uint8)
            continue
        size, rest = np.abs(value), r.digits()
        if (size >= 10**rest).any():
            raise ValueError(f"{r.name}: a number has more than {rest} digits")
        digits = np.stack([size // 10 ** (rest - 1 - i) % 10 for i in range(rest)], 1).astype(np.uint8)
        sign = np.where(value < 0, 0xD, 0xC).astype(np.uint8)
        if r.kind == "packed":
            halves = np.concatenate([digits, sign[:, None]], 1).reshape(n, -1, 2)
            own[:] = halves[:, :, 0] << 4 | halves[:, :, 1]
            own[none] = BLANK
            continue
        zoned = digits | 0xF0
        if r.kind == "zoned":
            zoned[:, -1] = digits[:, -1] | sign << 4
            zoned[none] = BLANK
        own[:] = back[zoned]
    return out.tobytes()


class Range(InputPartition):
    def __init__(self, path: str, first: int, records: int, cut: int):
        """``records`` records from number ``first`` on; cut: bytes of a last, incomplete record."""
        self.path, self.first, self.records, self.cut = path, first, records, cut


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Layout:
    def __init__(self, options: dict):
        self.path, self.length, self.page = options["path"], int(options["length"]), options.get("encoding", "cp037")
        self.gap, self.rules = bytes.fromhex(options.get("gap", "")), checked([Rule(**r) for r in json.loads(options["rules"])], int(options["length"]))
        self.range = int(options.get("range", RANGE))

    def opened(self):
        return pafs.FileSystem.from_uri(self.path if ":" in self.path.split("/")[0] else f"file://{self.path}")


class Reader(DataSourceReader):
    def __init__(self, layout: _Layout):
        self.layout = layout

    def partitions(self):
        """Ranges of whole records; only names and sizes are asked for here."""
        x = self.layout
        files, top = x.opened()
        found = files.get_file_info(top)
        listed = [found] if found.is_file else files.get_file_info(pafs.FileSelector(top, recursive=True))
        step, out = x.length + len(x.gap), []
        for f in sorted((f for f in listed if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            # The last record may lack the gap.
            whole, rest = divmod(f.size, step)
            if rest >= x.length:
                whole, rest = whole + 1, 0
            each = max(1, x.range // step)
            firsts = list(range(0, whole, each)) or ([0] if rest else [])
            out += [Range(f.path, i, min(each, whole - i), rest if i == firsts[-1] else 0) for i in firsts]
        return out

    def read(self, partition):
        if partition is None:  # no file with a record
            return
        x = self.layout
        files, _ = x.opened()
        step, done = x.length + len(x.gap), 0
        with files.open_input_file(partition.path) as f:
            while done < partition.records:
                n, at = min(ROWS, partition.records - done), partition.first + done
                data = f.read_at(n * step, at * step)
                data += b"\0" * (n * step - len(data))  # a last gap that isn't there
                yield decoded(np.frombuffer(data, np.uint8).reshape(n, step)[:, : x.length], x.rules, x.page, partition.path, at)
                done += n
        if partition.cut:
            like = decoded(np.zeros((1, x.length), np.uint8), x.rules, x.page, partition.path, 0).schema
            values = [None] * len(x.rules) + [f"{partition.path}: record {partition.first + partition.records}: cut off after {partition.cut} bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, like)], schema=like)


class Writer(DataSourceArrowWriter):
    """Each task writes a file beside the others under a name of its own; a job that fails removes what its tasks had made."""

    def __init__(self, layout: _Layout):
        self.layout, self.job = layout, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        x = self.layout
        files, top = x.opened()
        files.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"{top}/_{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}"
        with files.open_output_stream(name) as out:
            for b in iterator:
                for i in range(0, b.num_rows, ROWS):
                    out.write(encoded(b.slice(i, ROWS), x.rules, x.length, x.page, x.gap))
        return Written([name])

    def commit(self, messages):
        """Readers skip names that begin with an underscore: the files are seen from here on."""
        files, top = self.layout.opened()
        for m in messages:
            for name in m.names if m else ():
                files.move(name, f"{top}/part-{name.rsplit('/_', 1)[1]}")

    def abort(self, messages):
        files, _ = self.layout.opened()
        for m in messages:
            for name in m.names if m else ():
                files.delete_file(name)


class FixedWidth(DataSource):
    """Options: path, rules (JSON), length (of a record), encoding (a Python code page), gap (hex), range (bytes a task)."""

    @classmethod
    def name(cls):
        return "fixedwidth"

    def schema(self):
        return ", ".join([*(r.sql() for r in _Layout(self.options).rules), "_error string"])

    def reader(self, schema):
        return Reader(_Layout(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("fixedwidth files are only added to")
        return Writer(_Layout(self.options))


def rules_of(table: DataFrame) -> list[Rule]:
    """Field rules from a table of them, by their places. A layout has at most as many fields as its records have bytes."""
    return sorted((Rule(**r.asDict()) for r in table.select("name", "start", "length", "kind", "scale").collect()), key=lambda r: (r.start, r.name))


def _options(path: str, rules: list[Rule], length: int, encoding: str, gap: bytes, more: dict) -> dict:
    return {"path": path, "rules": json.dumps([asdict(r) for r in checked(rules, length)]), "length": str(length), "encoding": encoding, "gap": gap.hex(), **{k: str(v) for k, v in more.items()}}


def read_records(spark: SparkSession, path: str, rules: list[Rule], length: int, encoding: str = "cp037", gap: bytes = b"", **more) -> DataFrame:
    """All records of a file or folder, rejected ones too: the rules' fields and _error."""
    spark.dataSource.register(FixedWidth)
    return spark.read.format("fixedwidth").options(**_options(path, rules, length, encoding, gap, more)).load()


def write_records(rows: DataFrame, path: str, rules: list[Rule], length: int, encoding: str = "cp037", gap: bytes = b"") -> None:
    """Rows' fields as records, a file a task. A value that doesn't fit its field fails the job, and nothing is written."""
    rows.sparkSession.dataSource.register(FixedWidth)
    rows.select(*[r.name for r in rules]).write.format("fixedwidth").mode("append").options(**_options(path, rules, length, encoding, gap, {})).save()


def tally(records: DataFrame) -> DataFrame:
    """(field, n): how many records were rejected for each field or as cut off, and how many were fine (field null)."""
    field = F.regexp_extract("_error", r": record \d+: ([^:]*)$", 1)
    return records.groupBy(F.when(F.col("_error").isNotNull(), F.when(field.startswith("cut off"), "(cut off)").otherwise(field)).alias("field")).agg(F.count("*").alias("n"))
