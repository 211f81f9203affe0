"""Registered queries of this folder: name -> Spark callable, and DuckDB text where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import (
    cross_polytope,
    language_id,
    lattice_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    separator_scan,
    suffix_dedup,
    token_alignment,
    toxicity,
    url_filter,
    vp_clustering,
)
from vectorloom.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def _(spark, d):
    return language_id.language_id(table(spark, d, "documents"))


@query("op2_toxicity")
def _(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op3_bin_slack_packing")
def _(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


@query("op4_suffix_dedup")
def _(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query("op5_pareto_mix")
def _(spark, d):
    return mixing.pareto_mix(table(spark, d, "documents")).drop("copies")


@query("op6_cross_polytope")
def _(spark, d):
    return cross_polytope.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query("op7_ngram_join")
def _(spark, d):
    return ngram_join.link_components(table(spark, d, "documents"))


@query("op8_token_counts")
def _(spark, d):
    """Flat files of the whole corpus are written beside the checkpoints and scanned."""
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/tokens-{uuid.uuid4().hex}"
    separator_scan.write_token_files(table(spark, d, "documents"), folder)
    counts = separator_scan.token_counts(spark, folder)
    part = lambda group: F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)\.txt", group).cast("long")
    return counts.select(part(1).alias("part"), part(2).alias("file"), "doc", "n_tokens", "ended")


def _fence_sql() -> str:
    parts = []
    for f in quality.FENCES:
        reach = f"greatest({f.spread} * (hi - lo), {f.slack})"
        low = f"lo - {reach}" if f.side == "both" else "NULL"
        parts.append(
            f"SELECT g.lang, g.source, '{f.signal}' AS signal, {low} AS low, hi + {reach} AS high FROM (SELECT lang, source, "
            f"CASE WHEN n >= {quality.MIN_GROUP} THEN q25 WHEN ln >= {quality.MIN_GROUP} THEN l25 ELSE a25 END AS lo, "
            f"CASE WHEN n >= {quality.MIN_GROUP} THEN q75 WHEN ln >= {quality.MIN_GROUP} THEN l75 ELSE a75 END AS hi FROM "
            f"(SELECT lang, source, count(*) AS n, quantile_disc({f.signal}, 0.25) AS q25, quantile_disc({f.signal}, 0.75) AS q75 FROM ok "
            f"GROUP BY ALL) JOIN (SELECT lang AS ll, count(*) AS ln, quantile_disc({f.signal}, 0.25) AS l25, "
            f"quantile_disc({f.signal}, 0.75) AS l75 FROM ok GROUP BY ALL) ON lang IS NOT DISTINCT FROM ll, "
            f"(SELECT quantile_disc({f.signal}, 0.25) AS a25, quantile_disc({f.signal}, 0.75) AS a75 FROM ok)) AS g")
    return " UNION ALL ".join(parts)


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, i, words[i:i + 7] AS x FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM win)
          WHERE c > 1),
rep AS (SELECT k, CAST(sum(least(8, coalesce(j - i, 8))) AS BIGINT) AS r FROM twice GROUP BY k),
s AS (SELECT k, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      coalesce(r, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars * 1000 // greatest(n_words, 1) AS mean_length,
      n_symbols * 1000 // greatest(n_words, 1) AS symbol_share, n_dup_lines * 1000 // greatest(n_lines, 1) AS line_share,
      n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_share FROM s),
ok AS (SELECT * FROM b WHERE NOT base_failed),
fences AS (__FENCES__),
out_of AS (SELECT DISTINCT k FROM (SELECT k, lang, source, unnest([mean_length, symbol_share, line_share, repeat_share]) AS v,
      unnest(['mean_length', 'symbol_share', 'line_share', 'repeat_share']) AS signal FROM ok) AS v JOIN fences AS f
      ON v.signal = f.signal AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
      WHERE v > high OR v < low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND k NOT IN (SELECT k FROM out_of) AS kept FROM b
""".replace("__FENCES__", _fence_sql())


@query("op9_quality_rules", QUALITY_SQL)
def _(spark, d):
    return quality.quality_filter(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules of the query: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES __RULES__) AS t(action, h, pre)),
m AS (SELECT page_id, h || pre AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS k
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)
""".replace("__RULES__", ", ".join(str(r) for r in URL_RULES))


@query("op10_url_cascade", URL_SQL)
def _(spark, d):
    return url_filter.judge_urls(table(spark, d, "pages"), URL_RULES)


@query("op11_token_alignment")
def _(spark, d):
    return token_alignment.align_documents(table(spark, d, "documents"))


@query("op12_lattice_dedup")
def _(spark, d):
    return lattice_dedup.near_duplicates(table(spark, d, "embeddings"))


def _cluster_sql() -> str:
    """Lloyd rounds as one statement: (vector, component) rows, exact whole numbers, ties to the smaller number."""
    k, dims = vp_clustering.CENTROIDS, vp_clustering.DIMS
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({vp_clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
 FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{vp_clustering.SEED}' || vec_id)) - 1 AS c, w AS m FROM v
 QUALIFY row_number() OVER (ORDER BY sha256('{vp_clustering.SEED}' || vec_id)) <= {k})"""]
    for r in range(vp_clustering.ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(w) AS w, min(struct_pack(d := d, c := c)) AS b FROM
 (SELECT vec_id, w, c, list_sum(list_transform(list_zip(w, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r}) GROUP BY vec_id)""")
        if r < vp_clustering.ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} AS o LEFT JOIN (SELECT c, list(q ORDER BY i) AS m FROM
 (SELECT b.c AS c, i, CAST(floor(sum(w[i]) / count(*)) AS BIGINT) AS q FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY ALL) GROUP BY c) AS n USING (c))""")
    last = vp_clustering.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON b.c = c"""


@query("op13_vp_clustering", _cluster_sql())
def _(spark, d):
    return vp_clustering.cluster_report(table(spark, d, "embeddings"))
