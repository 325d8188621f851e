"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, cover_tree, decontaminate, forest, heavy_hitters, jaccard_join, language_id, license_scan, line_dedup, lm_score, mixing, quality, tool_calls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.report(_table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(_table(spark, sf_dir, "documents"))


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.report(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(_table(spark, sf_dir, "documents"))


def op11_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.report(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "sale_lines"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(_table(spark, sf_dir, "documents"))


def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.report(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_mixing, op4_tool_calls, op5_line_dedup, op6_language, op7_forest, op8_license_scan, op9_jaccard_join, op10_lm_score, op11_heavy_hitters, op12_collocations, op13_cover_tree, pipeline)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"list_filter(regexp_split_to_array({_LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_SPACED = f"list_filter(regexp_split_to_array({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_LEAKS = f"""WITH docs AS (SELECT row_number() OVER () AS row_, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS said FROM (SELECT item, n, w, unnest(generate_series(1, len(w) - n + 1)) AS k FROM sized) x),
places AS (SELECT row_, n, k, array_to_string(w[k:k + n - 1], ' ') AS said FROM (SELECT row_, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM docs JOIN (SELECT DISTINCT n FROM windows) z ON len(w) >= n) x),
hits AS (SELECT p.row_, p.n, p.k, i.item FROM places p JOIN windows i ON i.n = p.n AND i.said = p.said),
words AS (SELECT row_, count(DISTINCT place) AS n_hit FROM (SELECT row_, unnest(generate_series(k, k + n - 1)) AS place FROM hits) x GROUP BY row_),
found AS (SELECT row_, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_, item FROM hits) x GROUP BY row_)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, f.row_ IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words w ON w.row_ = d.row_ LEFT JOIN found f ON f.row_ = d.row_"""

_NEAR = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row_, doc_id, {_SPACED} AS w FROM documents),
grams AS (SELECT DISTINCT row_, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT row_, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS k FROM docs WHERE len(w) > 0) x),
sizes AS (SELECT row_, count(*) AS n FROM grams GROUP BY row_),
own AS (SELECT g.row_, g.g, s.n FROM grams g JOIN sizes s ON s.row_ = g.row_),
links AS (SELECT a.row_ AS x, b.row_ AS y FROM own a JOIN own b ON a.g = b.g AND a.row_ <> b.row_ AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.row_, b.row_ HAVING 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))),
reach AS (SELECT row_ AS x, row_ AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM docs d JOIN reach r ON r.x = d.row_ JOIN docs o ON o.row_ = r.y LEFT JOIN sizes s ON s.row_ = d.row_ GROUP BY d.row_, d.doc_id"""

_PHRASES = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
said AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM said GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM said JOIN (VALUES (1), (2), (3)) z(k) ON len(w) >= k) x) y GROUP BY lang, k, phrase),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
halves AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM parts) z),
left_ AS MATERIALIZED (SELECT h.*, f.a AS l FROM halves h JOIN f ON f.lang = h.lang AND f.phrase = h.x),
cuts AS (SELECT h.*, f.a AS r, (CAST(1000000 AS HUGEINT) * h.a * h.a) // (CAST(h.l AS HUGEINT) * f.a) AS score FROM left_ h JOIN f ON f.lang = h.lang AND f.phrase = h.y),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts) z WHERE place = 1),
inside AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM parts WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM parts WHERE k = 3) z GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE NOT coalesce(100 * i.b >= 50 * b.a, FALSE))
SELECT * FROM (SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score FROM kept k JOIN total t ON t.lang = k.lang) z WHERE rank <= 2000"""

#: DuckDB SQL of the queries that SQL can express: statements of the contracts, not of the methods.
ORACLE: dict[str, str] = {"op1_decontaminate": _LEAKS, "op9_jaccard_join": _NEAR, "op12_collocations": _PHRASES}
