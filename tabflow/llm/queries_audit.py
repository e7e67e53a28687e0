"""Queries of the url filter, the source audit and the alignment of tokenizers, with the SQL of the first two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabflow.llm.alignment import align
from tabflow.llm.divergence import divergence
from tabflow.llm.registry import register, table
from tabflow.llm.tokens import tokenizer_path
from tabflow.llm.url_templates import DEPTH, Rule, judge_urls

URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _url_template_sql() -> str:
    """The tree of path templates, one group of views a level."""
    segments = "CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(regexp_replace(replace(replace(path, '*', '%2A'), '{', '%7B'), '^/', ''), '[0-9]+', '#', 'g'), '/') END"
    sql = f"""
WITH rules (verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
read AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (
  SELECT r, max_by(u.host || u.path, length(u.host || u.path)) AS rule, max_by(u.verdict, length(u.host || u.path)) AS verdict
  FROM read d JOIN rules u ON (d.host = u.host OR ends_with(d.host, '.' || u.host)) AND starts_with(d.path, u.path) GROUP BY r),
judged AS (SELECT page_id, host, path, rule, verdict FROM read LEFT JOIN fits USING (r)),
rows0 AS (
  SELECT DISTINCT host, path, (rule IS NOT NULL)::INT AS judged, coalesce((verdict = 'block')::INT, 0) AS blocked, {segments} AS segments, '' AS template FROM judged),"""
    shares = ("judged", "blocked", "ends")
    differs = " OR ".join(f"abs({s} / n::DOUBLE - lag({s}) OVER o / (lag(n) OVER o)::DOUBLE) > 1.36::DOUBLE * (1 / sqrt(n::DOUBLE) + 1 / sqrt((lag(n) OVER o)::DOUBLE))" for s in shares)
    for k in range(DEPTH):
        sql += f"""
nodes{k} AS (
  SELECT host, template, segments[{k + 1}] AS token, count(*) AS n, sum(judged)::BIGINT AS judged, sum(blocked)::BIGINT AS blocked, sum((len(segments) = {k + 1})::INT)::BIGINT AS ends
  FROM rows{k} WHERE len(segments) > {k} GROUP BY ALL HAVING count(*) >= 8),
eighths{k} AS (SELECT *, 8 * judged // n AS j8, 8 * blocked // n AS b8, 8 * ends // n AS e8 FROM nodes{k}),
cells{k} AS (
  SELECT host, template, b8, j8, e8, sum(n)::BIGINT AS n, {", ".join(f"sum({s})::BIGINT AS {s}" for s in shares)}, min(token) AS token, count(*) AS tokens
  FROM eighths{k} GROUP BY host, template, b8, j8, e8),
cut{k} AS (SELECT *, coalesce({differs}, true)::INT AS fresh FROM cells{k} WINDOW o AS (PARTITION BY host, template ORDER BY b8, j8, e8)),
branches{k} AS (SELECT *, sum(fresh) OVER (PARTITION BY host, template ORDER BY b8, j8, e8) AS branch FROM cut{k}),
named{k} AS (
  SELECT *, CASE WHEN sum(tokens) OVER p = 1 THEN min(token) OVER p ELSE '{{' || min(token) OVER p || '}}' END AS label
  FROM branches{k} WINDOW p AS (PARTITION BY host, template, branch)),
labels{k} AS (SELECT e.host, e.template, e.token, c.label FROM eighths{k} e JOIN named{k} c USING (host, template, b8, j8, e8)),
rows{k + 1} AS (
  SELECT r.* REPLACE (CASE WHEN len(segments) > {k} THEN r.template || '/' || coalesce(l.label, '*') ELSE r.template END AS template)
  FROM rows{k} r LEFT JOIN labels{k} l ON r.host = l.host AND r.template = l.template AND r.segments[{k + 1}] = l.token),"""
    return sql + f"""
done AS (SELECT * REPLACE (CASE WHEN len(segments) > {DEPTH} THEN template || '/**' ELSE template END AS template) FROM rows{DEPTH}),
purity AS (SELECT host, template, (sum(blocked) + 4.0::DOUBLE * 0.25::DOUBLE) / (sum(judged) + 4.0::DOUBLE) AS purity FROM done GROUP BY host, template)
SELECT page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN purity > 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, d.template, p.purity
FROM judged j JOIN done d ON j.host = d.host AND j.path = d.path JOIN purity p ON d.host = p.host AND d.template = p.template"""


@register(_url_template_sql())
def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register(
    """
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, d.n, 1 + (1000000000 * (d.n + 1)) // (t.total + s.v) AS p FROM dense d JOIN totals t USING (lang, source) JOIN sizes s USING (lang)),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM dense GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, ((s.p - w.q) * (s.p - w.q) // w.q)::BIGINT
  FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200"""
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


@register()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
