"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, extract, language, neardup, packing, pii, shards, substring, toolcalls
from .common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(table(spark, sf_dir, "conversations"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.written_digest(shards.ordered(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_harmonic_packing, op2_multi_index_hashing, op3_pii, op4_tool_call_linking, op5_html_extraction, op6_language_id, op7_benchmark_containment, op8_near_duplicates, op9_training_order, op10_substring_dedup, pipeline)}


#: Words as the operators take them: runs of bytes other than ASCII white space.
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_CONTAINED = f"""
WITH q AS (SELECT item_id, {_WORDS} AS a FROM benchmark),
n AS (SELECT DISTINCT least(5, len(a)) AS n FROM q WHERE len(a) > 0),
qs AS (SELECT DISTINCT item_id, least(5, len(a)) AS n, array_to_string(a[i:i + least(5, len(a)) - 1], ' ') AS s FROM q, unnest(range(1, len(a) - least(5, len(a)) + 2)) AS t(i) WHERE len(a) > 0),
d AS (SELECT doc_id, {_WORDS} AS a FROM documents),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(a[i:i + n - 1], ' ') AS s FROM d, n, unnest(range(1, len(a) - n + 2)) AS t(i)),
z AS (SELECT item_id, count(*) AS item_shingles FROM qs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN qs USING (n, s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment FROM m JOIN z USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9
"""

_SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS a FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(a) - 48)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM x) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 50)) AS t(p)),
k AS (SELECT w.doc_id, string_agg(a[p], ' ' ORDER BY p) AS kept, count(*) AS n FROM w, unnest(range(1, len(a) + 1)) AS t(p) ANTI JOIN c ON c.doc_id = w.doc_id AND c.p = t.p GROUP BY 1)
SELECT w.doc_id, len(a) AS n_words, len(a) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


#: The plain patterns of op3's kinds, and what confirms a match m.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_MOVED = "replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4]"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS BIGINT), 0) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, k: CASE WHEN k % 2 = 1 THEN try_cast(c AS INTEGER) ELSE try_cast(substr('0246813579', try_cast(c AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(string_split({_MOVED}, ''), lambda c: CAST(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS VARCHAR)), ''), ''), lambda c: CAST(c AS BIGINT)), lambda a, b: (a * 10 + b) % 97) = 1"),
}


def _pii_sql() -> str:
    parts = []
    for k, (kind, (pattern, test)) in enumerate(_KINDS.items()):
        ends = f"SELECT doc_id, text, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t), unnest(range(1, len(m) + 1)) AS u(i)"
        near = "lower(substr(text, CAST(greatest(s - 40, 0) + 1 AS BIGINT), CAST(least(s, 40) AS BIGINT)) || ' ' || substr(text, CAST(s + length(m) + 1 AS BIGINT), 40))"
        score = f"round({pii.PATTERN_SCORE[kind]} + CASE WHEN regexp_matches({near}, '(?:^|[^a-z0-9])(?:{pii.CONTEXT[kind]})') THEN {pii.CONTEXT_GAIN} ELSE 0 END, 3)"
        parts.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, CAST(s AS BIGINT) AS s, '{kind}:' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS span, CAST(CAST({score} AS DOUBLE) AS VARCHAR) AS score FROM ({ends}) WHERE {test}")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _KINDS)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({" UNION ALL ".join(parts)})
SELECT t.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY k, s) FILTER (k < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, s), '') AS spans, coalesce(string_agg(score, ',' ORDER BY k, s), '') AS scores FROM t LEFT JOIN a USING (doc_id) GROUP BY t.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL that counts every window, shingle and span plainly. The other queries need a tokenizer, a trained model or an
    approximate index; tests/llm compares those with brute force."""
    return {"op3_pii": _pii_sql(), "op7_benchmark_containment": _CONTAINED, "op10_substring_dedup": _SUBSTRING}
