"""The registered queries of these operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import table

#: (verdict, rule) of the url query (fixed by its contract).
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_from, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeat_counts

    return repeat_counts(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes

    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Words of a text in DuckDB.
_N_WORDS = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"

OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST({_N_WORDS} AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS spot FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source
), run AS (
  SELECT *, row_number() OVER w AS place, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM per WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)
), level AS (
  SELECT * FROM run WHERE 3 * source_size * open_weight >= (total - held) * weight ORDER BY place LIMIT 1
), aimed AS (
  SELECT r.source, r.source_size, CASE WHEN l.place IS NULL OR r.place < l.place THEN CAST(3 * r.source_size AS DOUBLE)
    ELSE CAST(l.total - l.held AS DOUBLE) * r.weight / l.open_weight END AS target,
    md5('1|' || CASE WHEN r.source IS NULL THEN 'null' ELSE '=' || r.source END) AS digest
  FROM run r LEFT JOIN level l ON true
), first AS (
  SELECT source, source_size, target, (4096 * (instr('0123456789abcdef', substr(digest, 1, 1)) - 1) + 256 * (instr('0123456789abcdef', substr(digest, 2, 1)) - 1)
    + 16 * (instr('0123456789abcdef', substr(digest, 3, 1)) - 1) + instr('0123456789abcdef', substr(digest, 4, 1)) - 1 + CAST(0.5 AS DOUBLE)) / 65536 AS start
  FROM aimed
), ranked AS (
  SELECT s.doc_id, s.size, f.*, row_number() OVER (PARTITION BY s.source ORDER BY
    length(CAST(s.size AS VARCHAR)) * 100 + CAST(substr(CAST(s.size AS VARCHAR), 1, 2) AS INT), s.spot, s.doc_id NULLS FIRST, s.size) - 1 AS place
  FROM sized s JOIN first f ON s.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * least(3,
  CAST(floor(start + target / source_size * (place + 1)) - floor(start + target / source_size * place) AS BIGINT)) END AS taken
FROM ranked
"""


OP6_SQL = """
WITH n AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM n, unnest(range(1, len(ws) - 48)) t(i)
), first AS (
  SELECT h, min(doc_id) AS least FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT win.doc_id, j FROM win JOIN first ON first.h = win.h AND first.least < win.doc_id, unnest(range(i, i + 50)) t(j)
), words AS (
  SELECT doc_id, j, ws[j] AS w FROM n, unnest(range(1, len(ws) + 1)) t(j)
), kept AS (
  SELECT w.doc_id, count(*) AS left_words, string_agg(w.w, ' ' ORDER BY w.j) AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.j = w.j WHERE g.j IS NULL GROUP BY w.doc_id
)
SELECT n.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(left_words, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM n LEFT JOIN kept ON kept.doc_id = n.doc_id
"""

OP9_SQL = """
WITH RECURSIVE n AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM n, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 80 * (x.size + y.size - common)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, least) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT w.v, r.least FROM reach r JOIN ways w ON w.u = r.doc_id WHERE r.least < w.v
)
SELECT n.doc_id, coalesce(any_value(sizes.size), 0) AS n_shingles, min(r.least) AS component_id, n.doc_id = min(r.least) AS kept
FROM n JOIN reach r ON r.doc_id = n.doc_id LEFT JOIN sizes ON sizes.doc_id = n.doc_id GROUP BY n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6_SQL, "op8_url_filters": OP8_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_source_mixing": OP10_SQL}
