import duckdb
import pytest

from granary.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = "region nation documents labels embeddings part pages benchmark conversations events lineitem orders".split()


def rows(df):
    df = df[sorted(df.columns)]
    same = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(same, r)) for r in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    want = rows(sql.execute(SQL[name]).df())
    assert want
    assert rows(QUERIES[name](spark, DATA).toPandas()) == want


def outcomes(spark, name, column):
    return {r[0] for r in QUERIES[name](spark, DATA).select(column).distinct().collect()}


def test_no_comparison_is_of_one_outcome_alone(spark):
    assert outcomes(spark, "headings_text", "heading") == outcomes(spark, "headings_font", "heading") == {True, False}
    assert outcomes(spark, "query_logs", "action") == {"error", "out_of_scope", "refuse", "notice", "answer"}
    assert outcomes(spark, "policy_actions", "action") == {"refuse", "verify", "caveat", "answer"}
    assert outcomes(spark, "manifest", "status") == {"missing", "checksum", "exists"}
    assert len(outcomes(spark, "failure_buckets", "bucket")) >= 5
    assert len({p.count(" > ") for p in outcomes(spark, "chunk_documents", "section_path")}) >= 3
    got = QUERIES["eval_results"](spark, DATA)
    assert got.where("recall_5 IS NULL").count() and got.where("recall_5 = 0").count() and got.where("recall_5 = 1").count()
    # A scope of an unknown name finds nothing.
    assert QUERIES["topk_scoped"](spark, DATA).select("query_id").distinct().count() < 10


def test_isotonic_fit_equals_pooled_neighbours(spark, sql):
    points = sql.execute("SELECT (n_chars % 101) AS raw, avg(quality), count(*) FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY 1").fetchall()
    pools = []
    for raw, mean, n in points:
        pools.append([mean, n, [raw]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (m, k, r), (a, b, c) = pools.pop(), pools.pop()
            pools.append([(m * k + a * b) / (k + b), k + b, c + r])
    want = {raw: m for m, _, rs in pools for raw in rs}
    got = {r.raw: r.isotonic for r in QUERIES["isotonic_fit"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)
