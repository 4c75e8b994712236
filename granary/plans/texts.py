"""Queries over texts: blocks, headings, sections, windows, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import blocks as B
from granary.operators import chunking as C
from granary.operators.longdocs import long_chunks as long_chunk_rows
from granary.operators.longdocs import long_sections as long_section_rows
from granary.plans.registry import query
from granary.sources.tables import table

LINES = "SELECT doc_id, CAST(o - 1 AS INTEGER) AS i, trim(t) AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(t, o)"
#: The fixture's headings, before every third line: numbered at three depths, capitals, with a colon, and one known by its size alone.
HEAD = "CASE (doc_id + i) % 6 WHEN 0 THEN concat(i % 4 + 1, ' Part of ', doc_id % 7) WHEN 1 THEN concat(i % 4 + 1, '.', i % 2 + 1, ' Scope') WHEN 2 THEN concat(i % 2 + 1, '.1.', i % 5, ' Deep') WHEN 3 THEN 'GENERAL RULES 3.70' WHEN 4 THEN 'Filing terms:' ELSE 'plain title' END"
LIKE_HEADING = "(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in T.HEADINGS) + ")"
BLOCKS = f"""l AS ({LINES}),
b AS (SELECT doc_id, 2 * i AS block_ord, i // 8 + 1 AS page_num, {HEAD} AS text, CASE WHEN doc_id % 2 = 0 THEN 14.0 ELSE 0.0 END::DOUBLE AS font_size FROM l WHERE i % 3 = 0
  UNION ALL SELECT doc_id, 2 * i + 1, i // 8 + 1, text, CASE WHEN doc_id % 2 = 0 THEN 10.0 ELSE 0.0 END::DOUBLE FROM l WHERE text <> ''),
med AS (SELECT doc_id, coalesce(median(font_size) FILTER (font_size > 0), 0.0) AS m FROM b GROUP BY doc_id),
h AS (SELECT b.*, length(text) BETWEEN 1 AND 120 AND ((font_size > 0 AND m > 0 AND font_size >= m * 1.15) OR {LIKE_HEADING}) AS heading, m FROM b JOIN med USING (doc_id))"""
PARTS = f"""{BLOCKS},
o AS (SELECT *, sum(CAST(heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY block_ord) AS section FROM h),
body AS (SELECT doc_id, section, trim(string_agg(text, ' ' ORDER BY block_ord) FILTER (NOT heading)) AS text, coalesce(max(page_num) FILTER (heading), 1) AS page_num FROM o GROUP BY ALL),
heads AS (SELECT doc_id, list([[text]] ORDER BY block_ord) FILTER (heading) AS hs FROM h GROUP BY doc_id),
paths AS (SELECT doc_id, unnest(ps) AS section_path, unnest(range(0, len(ps))) AS section FROM (SELECT doc_id, list_reduce(coalesce(hs, []), lambda a, x: list_concat(a, [list_concat(
  list_slice(a[-1], 1, CASE WHEN regexp_matches(x[1][1], '^\\d+(\\.\\d+)*\\s') THEN len(string_split(regexp_extract(x[1][1], '^(\\d+(\\.\\d+)*)\\s', 1), '.')) ELSE 1 END), x[1])]), [['root']]) AS ps FROM heads)),
s AS (SELECT doc_id, section, section_path, page_num, text FROM body JOIN paths USING (doc_id, section) WHERE text <> '')"""
CHUNKS = f"""{PARTS},
w AS (SELECT *, length(text) // 4 <= 512 AS short, string_split_regex(text, '\\s+') AS ws FROM s),
n AS (SELECT *, unnest(range(0, CASE WHEN short OR len(ws) <= 409 THEN 1 ELSE CAST(ceil((len(ws) - 409) / 358.0) AS BIGINT) + 1 END)) AS part FROM w),
p AS (SELECT doc_id, list([struct_pack(n := 0, path := section_path, page := page_num, text := CASE WHEN short THEN text ELSE array_to_string(ws[part * 358 + 1:part * 358 + 409], ' ') END)] ORDER BY section, part) AS ps FROM n GROUP BY doc_id),
t AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN greatest(1, length(x[1].text) // 4) < 100 AND a[-1].path = x[1].path
  THEN list_concat(list_slice(a, 1, len(a) - 1), [struct_pack(n := a[-1].n, path := a[-1].path, page := a[-1].page, text := a[-1].text || ' ' || x[1].text)])
  ELSE list_concat(a, [struct_pack(n := a[-1].n + 1, path := x[1].path, page := x[1].page, text := x[1].text)]) END) AS ts FROM p),
k AS (SELECT doc_id, list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN greatest(1, length(a[-1].text) // 4) < 100 AND length(a[-1].text || ' ' || x[1].text) // 4 <= 512
  THEN list_concat(list_slice(a, 1, len(a) - 1), [struct_pack(n := a[-1].n, path := a[-1].path, page := a[-1].page, text := a[-1].text || ' ' || x[1].text)]) ELSE list_concat(a, x) END) AS ks FROM t),
c AS (SELECT doc_id, unnest(ks) AS x, unnest(range(0, len(ks))) AS chunk FROM k),
chunks AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, substr(sha1(doc_id || '|' || array_to_string(x.path, '|') || '|' || x.n), 1, 16) AS chunk_id, x.path AS section_path, CAST(x.page AS INTEGER) AS page_num, x.text AS text, CAST(greatest(1, length(x.text) // 4) AS INTEGER) AS token_count FROM c)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def blocks_with_headings(spark, sf_dir, book=None):
    """The documents' lines as blocks, with the fixture's headings between them. book: documents are bound into books by it, whose
    pages may number more than an INT holds."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("text", T.strip(F.col("text")))
    if book:
        lines = lines.select(F.expr(book).alias("doc_id"), (F.col("doc_id") * 100_000 + F.col("i")).alias("i"), "text")
    page, even = F.expr(f"CAST(i DIV 8 + 1 AS {'BIGINT' if book else 'INT'})"), F.col("doc_id") % 2 == 0
    size = lambda x: F.when(even, x).otherwise(0.0).alias("font_size")
    heads = lines.where("i % 3 = 0").select("doc_id", (2 * F.col("i")).alias("block_ord"), page.alias("page_num"), F.expr(HEAD).alias("text"), size(14.0))
    return heads.unionByName(lines.where("text <> ''").select("doc_id", (2 * F.col("i") + 1).alias("block_ord"), page.alias("page_num"), "text", size(10.0)))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def token_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT doc_id, o - 1 AS block_ord, trim(t) AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(t, o) WHERE trim(t) <> ''")
def blocks(spark, sf_dir):
    return B.line_blocks(documents(spark, sf_dir))


TITLES = """CASE p_partkey % 14 WHEN 0 THEN concat(p_partkey % 9 + 1, '.', p_size, ' ', p_name) WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ':') WHEN 3 THEN 'RULE 3.70'
 WHEN 4 THEN 'A.B CODE' WHEN 5 THEN 'Some heading:' WHEN 6 THEN '1. Overview' WHEN 7 THEN '1.     Over' WHEN 8 THEN '1      Wide gap' WHEN 9 THEN 'FILING/REQ A&B' WHEN 10 THEN 'RULE' WHEN 11 THEN repeat('1 x', 50)
 WHEN 12 THEN concat('  ', upper(p_name), ' ') ELSE p_name END"""


@query(f"WITH t AS (SELECT p_partkey, {TITLES} AS raw, trim(raw) AS text FROM part) SELECT p_partkey, raw AS text, length(text) <= 120 AND {LIKE_HEADING} AS heading FROM t")
def headings_text(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(TITLES).alias("text"))
    return rows.withColumn("heading", T.is_heading(F.col("text"), F.lit(0.0), F.lit(0.0)))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ord, text, heading FROM h")
def headings_font(spark, sf_dir):
    """By size where the document's sizes are known, else by pattern."""
    return B.with_headings(blocks_with_headings(spark, sf_dir)).select("doc_id", "block_ord", "text", "heading")


@query(
    f"""WITH {BLOCKS}, c AS (SELECT *, CASE WHEN heading THEN length(text) END AS x, len(string_split_regex(text, '\\s+')) AS n FROM h)
SELECT doc_id, count(*) AS n_blocks, any_value(m) AS median_size, count(*) FILTER (heading) AS n_headings, count(*) FILTER (NOT heading) AS n_body, CAST(coalesce(min(x), 0) AS INTEGER) AS min_heading, CAST(coalesce(max(x), 0) AS INTEGER) AS max_heading,
  count(*) FILTER (n = 1) AS words_1, count(*) FILTER (n = 2) AS words_2, count(*) FILTER (n = 3) AS words_3, count(*) FILTER (n > 3) AS words_more FROM c GROUP BY doc_id"""
)
def block_profile(spark, sf_dir):
    return B.block_profile(blocks_with_headings(spark, sf_dir))


SPANS = "transform(split(text, '\\n'), (t, i) -> struct(concat(' ', t, '\\t') AS text, IF(i % 3 = 0, 14D, CAST(NULL AS DOUBLE)) AS font_size))"


@query(
    f"""WITH l AS ({LINES}), e AS (SELECT *, text <> '' AS ok FROM l), f AS (SELECT doc_id, 0 AS again, i, text, CASE WHEN i % 3 = 0 THEN 14.0 ELSE 0.0 END::DOUBLE AS font_size FROM e WHERE ok
 UNION ALL SELECT doc_id, 1, i, text, 0.0 FROM e WHERE ok AND doc_id % 3 = 0)
SELECT 'd' || doc_id AS doc_name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY again, i) - 1 AS INTEGER) AS block_ord, text, font_size FROM f"""
)
def page_blocks(spark, sf_dir):
    """Every third document's extraction fails after its spans: its lines follow."""
    pages = documents(spark, sf_dir).selectExpr("concat('d', doc_id) AS doc_name", "1 AS page_num", f"{SPANS} AS spans", "text AS plain", "doc_id % 3 = 0 AS failed")
    return B.page_blocks(pages).select("doc_name", "block_ord", "text", "font_size")


def _paged(spark, sf_dir):
    """Blocks of documents cut into pages of five lines."""
    lines = B.line_blocks(documents(spark, sf_dir))
    return lines.selectExpr("concat('d', doc_id) AS doc_name", "CAST(block_ord DIV 5 + 1 AS INT) AS page_num", "CAST(block_ord % 5 AS INT) AS block_ord", "text")


@query(f"WITH l AS ({LINES}) SELECT 'd' || doc_id AS doc_name, CAST(i // 5 + 1 AS INTEGER) AS page_num, string_agg(text, ' ' ORDER BY i) AS text FROM l WHERE text <> '' GROUP BY ALL")
def page_texts(spark, sf_dir):
    return B.page_texts(_paged(spark, sf_dir))


@query(f"WITH l AS ({LINES}) SELECT 'd' || doc_id AS doc_name, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, text FROM l WHERE text <> ''")
def flattened(spark, sf_dir):
    return B.flatten(_paged(spark, sf_dir)).select("doc_name", "ord", "text")


@query("SELECT p_brand, coalesce(CAST(median(p_size) FILTER (p_size > 20) AS DOUBLE), 0.0) AS median_size FROM part GROUP BY p_brand")
def median_size(spark, sf_dir):
    return B.median_size(table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") > 20, F.col("p_size").cast("double"))), "p_brand", "size")


@query(f"WITH {PARTS} SELECT doc_id, CAST(section AS BIGINT) AS section, array_to_string(section_path, ' > ') AS section_path, CAST(page_num AS INTEGER) AS page_num, text FROM s")
def sections(spark, sf_dir):
    got = C.sections(B.with_headings(blocks_with_headings(spark, sf_dir)))
    return got.withColumn("section_path", F.array_join("section_path", " > "))


@query(
    """WITH d AS (SELECT doc_id, text, length(text) // 4 <= 512 AS short, string_split_regex(trim(text), '\\s+') AS w FROM documents),
n AS (SELECT *, unnest(range(0, CASE WHEN short OR len(w) <= 409 THEN 1 ELSE CAST(ceil((len(w) - 409) / 358.0) AS BIGINT) + 1 END)) AS i FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS window_no, CASE WHEN short THEN text ELSE array_to_string(w[i * 358 + 1:i * 358 + 409], ' ') END AS text FROM n"""
)
def windows(spark, sf_dir):
    """All documents: those of at most 512 tokens are one window, unchanged."""
    return C.text_windows(documents(spark, sf_dir))


@query("SELECT doc_id, substr(sha1('d' || doc_id || '|root|' || n_chars), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.chunk_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.array(F.lit("root")), F.col("n_chars")).alias("chunk_id"))


@query(
    f"""WITH l AS ({LINES}), p AS (SELECT doc_id, list([text] ORDER BY i) AS ps FROM l WHERE text <> '' GROUP BY doc_id),
m AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN greatest(1, length(a[-1]) // 4) < 100 AND length(a[-1] || ' ' || x[1]) // 4 <= 512
  THEN list_concat(list_slice(a, 1, len(a) - 1), [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END) AS ks FROM p)
SELECT doc_id, CAST(unnest(range(0, len(ks))) AS INTEGER) AS chunk, unnest(ks) AS text FROM m"""
)
def merge_small(spark, sf_dir):
    return C.merge_small(B.line_blocks(documents(spark, sf_dir)).withColumnRenamed("block_ord", "ord"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk, chunk_id, array_to_string(section_path, ' > ') AS section_path, page_num, text, token_count FROM chunks")
def chunk_documents(spark, sf_dir):
    got = C.chunk_documents(blocks_with_headings(spark, sf_dir))
    return got.withColumn("section_path", F.array_join("section_path", " > "))


#: A book has a third of all documents, the others are small.
BOOK = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 40 END"
BOUND = f"SELECT {BOOK} AS doc_id, documents.doc_id * 100000 + o - 1 AS i, trim(t) AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(t, o)"


@query(f"WITH {PARTS.replace(LINES, BOUND)} SELECT doc_id, CAST(section AS BIGINT) AS section, array_to_string(section_path, ' > ') AS section_path, CAST(page_num AS INTEGER) AS page_num, text FROM s")
def long_sections(spark, sf_dir):
    """The sections of books, whose blocks lie in many tasks."""
    got = long_section_rows(blocks_with_headings(spark, sf_dir, BOOK))
    return got.withColumn("section_path", F.array_join("section_path", " > "))


@query(f"WITH {CHUNKS.replace(LINES, BOUND)} SELECT doc_id, chunk, chunk_id, array_to_string(section_path, ' > ') AS section_path, page_num, text, token_count FROM chunks")
def long_chunks(spark, sf_dir):
    got = long_chunk_rows(blocks_with_headings(spark, sf_dir, BOOK))
    return got.withColumn("section_path", F.array_join("section_path", " > "))


FIXED = """n AS (SELECT *, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 650.0) AS BIGINT) + 1 END)) AS i FROM {rows}),
w AS (SELECT * EXCLUDE (text), regexp_replace(substr(text, i * 650 + 1, 800), '^\\s+|\\s+$', '', 'g') AS text FROM n),
f AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS INTEGER) AS chunk, text FROM w WHERE length(text) > 80)"""


@query(f"WITH {FIXED.format(rows='documents', keys='doc_id')} SELECT * FROM f")
def fixed_windows(spark, sf_dir):
    return C.fixed_windows(documents(spark, sf_dir))


@query(
    f"""WITH l AS ({LINES}), g AS (SELECT 'd' || doc_id AS document, CAST(i // 5 + 1 AS INTEGER) AS page, string_agg(text, ' ' ORDER BY i) AS text FROM l WHERE text <> '' GROUP BY ALL),
q AS (SELECT * FROM g WHERE length(text) > 50), {FIXED.format(rows="q", keys="document, page")} SELECT * FROM f"""
)
def build_corpus(spark, sf_dir):
    pages = B.page_texts(_paged(spark, sf_dir))
    return C.build_corpus(pages.select(F.col("doc_name").alias("document"), F.col("page_num").alias("page"), "text"))


@query("SELECT doc_id, count(*) AS n, CAST(floor(sum(greatest(1, length(trim(t)) // 4)) / count(*)) AS BIGINT) AS mean_tokens FROM documents, unnest(string_split(text, chr(10))) AS u(t) WHERE trim(t) <> '' GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(B.line_blocks(documents(spark, sf_dir)))


@query(
    """WITH x AS (SELECT 'd' || doc_id AS doc_name, n_chars // 800 AS n, CASE WHEN doc_id % 50 = 7 THEN 'broken ' || doc_id END AS error FROM documents)
SELECT count(*) - count(error) AS processed, count(error) AS failed, CAST(sum(n) FILTER (error IS NULL) AS BIGINT) AS total_chunks, string_agg(doc_name || '=' || error, ';' ORDER BY doc_name) AS errors FROM x"""
)
def ingest_summary(spark, sf_dir):
    """Documents without a chunk count as processed."""
    rows = documents(spark, sf_dir).selectExpr("concat('d', doc_id) AS doc_name", "n_chars DIV 800 AS n_chunks", "IF(doc_id % 50 = 7, concat('broken ', doc_id), NULL) AS error")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return C.ingest_summary(rows).withColumn("errors", shown)


@query(
    f"""WITH {CHUNKS}, {FIXED.format(rows='documents', keys='doc_id').replace('n AS', 'n2 AS').replace('FROM n)', 'FROM n2)').replace('w AS', 'w2 AS').replace('FROM w ', 'FROM w2 ')},
a AS (SELECT 'semantic' AS strategy, token_count AS t FROM chunks UNION ALL SELECT 'fixed', greatest(1, length(text) // 4) FROM f)
SELECT strategy, count(*) AS n, round(avg(t), 6) AS mean_tokens, CAST(min(t) AS INTEGER) AS least_tokens, CAST(max(t) AS INTEGER) AS most_tokens FROM a GROUP BY strategy"""
)
def chunk_ablation(spark, sf_dir):
    got = C.chunk_ablation(C.chunk_documents(blocks_with_headings(spark, sf_dir)), C.fixed_windows(documents(spark, sf_dir)))
    return got.withColumn("mean_tokens", F.round("mean_tokens", 6))
