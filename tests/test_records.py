import datetime
import decimal
import random

import pytest

from granary.sources import records as R
from granary.sources.shared import ship_package

RULES = [R.Rule("id", 1, 5, "packed"), R.Rule("name", 6, 9, "text"), R.Rule("due", 15, 8, "date"), R.Rule("price", 23, 7, "zoned", 2), R.Rule("rate", 30, 4, "packed", 3), R.Rule("n", 34, 2, "binary"), R.Rule("big", 36, 8, "binary")]
LENGTH = 44
KIND = "id bigint, name string, due date, price decimal(18,2), rate decimal(18,3), n bigint, big bigint"


def rows(n, seed=1):
    r = random.Random(seed)
    some = lambda v: None if r.random() < 0.15 else v
    return [(i, some(r.choice(["a", "Zé 9", " b", "{}", "nine char"])), some(datetime.date(1, 1, 1) + datetime.timedelta(r.randrange(3_000_000))), some(decimal.Decimal(r.randrange(-(10**7) + 1, 10**7)).scaleb(-2)), some(decimal.Decimal(r.randrange(-(10**7) + 1, 10**7)).scaleb(-3)), r.randrange(-(2**15), 2**15), r.randrange(-(2**63), 2**63)) for i in range(n)]


def values(df):
    return sorted((tuple(r) for r in df.select(*[x.name for x in RULES]).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("page, gap", [("cp037", b""), ("cp1140", b"\x15"), ("latin-1", b"\r\n")])
def test_round_trip_over_any_split(spark, tmp_path, page, gap):
    ship_package(spark)
    made = rows(41)
    R.write_records(spark.createDataFrame(made, KIND).repartition(3), f"file://{tmp_path}/r", RULES, LENGTH, page, gap)
    files = sorted((tmp_path / "r").iterdir())
    assert len(files) == 3 and sum(f.stat().st_size for f in files) == 41 * (LENGTH + len(gap))
    for size in (1, 3 * (LENGTH + len(gap)) + 5, 1 << 20):
        got = R.read_records(spark, f"file://{tmp_path}/r", RULES, LENGTH, page, gap, range=size)
        assert got.where("_error IS NOT NULL").count() == 0 and values(got) == made
        assert got.rdd.getNumPartitions() == (41 if size == 1 else got.rdd.getNumPartitions())
    # A file alone, whose last record lacks the gap.
    whole = files[0].read_bytes()
    (tmp_path / "one").write_bytes(whole[: len(whole) - len(gap)])
    assert R.read_records(spark, f"{tmp_path}/one", RULES, LENGTH, page, gap, range=100).count() == files[0].stat().st_size // (LENGTH + len(gap))


def test_known_bytes(spark, tmp_path):
    ship_package(spark)
    rules = [R.Rule("z", 1, 3, "zoned", 1), R.Rule("p", 4, 2, "packed"), R.Rule("t", 6, 2, "text"), R.Rule("d", 8, 8, "date")]
    day = "20240229".encode("cp037")
    lines = [
        b"\xf1\xf2\xc3" + b"\x12\x3c" + b"\xc8\x40" + day,  # +12.3, +123, H
        b"\xf1\xf2\xd3" + b"\x12\x3d" + b"\x40\x40" + b"\xf0" * 8,  # -12.3, -123, no text, no day
        b"\xf1\xf2\xf3" + b"\x12\x3f" + b"\x40\xc8" + day,  # unsigned
        b"\x40\x40\x40" + b"\x40\x40" + b"\xc8\xc9" + b"\x40" * 8,  # blanks
        b"\xf1\x02\xf3" + b"\x12\x3c" + b"\xc8\xc9" + day,  # no digit
        b"\xf1\xf2\xf3" + b"\x12\xac" + b"\xc8\xc9" + day,  # no digit in a half byte
        b"\xf1\xf2\xf3" + b"\x12\x34" + b"\xc8\xc9" + day,  # no sign
        b"\xf1\xf2\xf3" + b"\x12\x3c" + b"\xc8\xc9" + "20230229".encode("cp037"),  # no such day
        b"\xf1\xf2",
    ]
    (tmp_path / "k").write_bytes(b"".join(lines))
    got = R.read_records(spark, f"file://{tmp_path}/k", rules, 15, range=30)
    fine = sorted(((r.z, r.p, r.t, r.d) for r in got.where("_error IS NULL").collect()), key=str)
    leap = datetime.date(2024, 2, 29)
    assert fine == sorted([(decimal.Decimal("12.3"), 123, "H", leap), (decimal.Decimal("-12.3"), -123, None, None), (decimal.Decimal("12.3"), 123, " H", leap), (None, None, "HI", None)], key=str)
    errors = sorted(r._error.split("/k: ")[1] for r in got.where("_error IS NOT NULL").collect())
    assert errors == ["record 4: z", "record 5: p", "record 6: p", "record 7: d", "record 8: cut off after 2 bytes"]
    assert {r.field: r.n for r in R.tally(got).collect()} == {None: 4, "z": 1, "p": 2, "d": 1, "(cut off)": 1}
    assert got.where("_error IS NOT NULL AND z IS NOT NULL").count() == 0
    (tmp_path / "empty").write_bytes(b"")
    assert R.read_records(spark, f"file://{tmp_path}/empty", rules, 15).count() == 0


def test_rules_and_values_that_do_not_fit(spark, tmp_path):
    ship_package(spark)
    table = spark.createDataFrame([("b", 3, 2, "text", 0), ("a", 1, 2, "zoned", 1)], R.RULES)
    assert R.rules_of(table) == [R.Rule("a", 1, 2, "zoned", 1), R.Rule("b", 3, 2, "text", 0)]
    for bad in (R.Rule("x", 4, 2, "text"), R.Rule("x", 0, 2, "text"), R.Rule("x", 1, 2, "float"), R.Rule("x", 1, 4, "date"), R.Rule("_error", 1, 1, "text")):
        with pytest.raises(ValueError):
            R.checked([bad], 4)
    with pytest.raises(ValueError):
        R.checked([R.Rule("x", 1, 19, "zoned")], 40)
    for kind, value, sql in (("text", "abc", "string"), ("zoned", 1000, "bigint"), ("packed", 100_000, "bigint"), ("binary", 2**31, "bigint"), ("binary", None, "bigint")):
        with pytest.raises(Exception, match="longer|digits|large|null"):
            R.write_records(spark.createDataFrame([(value,)], f"v {sql}"), f"file://{tmp_path}/{kind}", [R.Rule("v", 1, 2 if kind != "packed" else 3, kind)], 4)
        assert not (tmp_path / kind).exists() or not [f for f in (tmp_path / kind).iterdir() if f.name.startswith("part")]
