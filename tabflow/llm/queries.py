"""One query per operator: it applies the operator to its whole table and derives the contract's columns from what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import queries_audit  # noqa: F401  registers its queries
from tabflow.llm.imatch import fingerprint_documents
from tabflow.llm.jaccard import jaccard_classes
from tabflow.llm.language import fit, predict_languages
from tabflow.llm.line_templates import line_report
from tabflow.llm.mixing import mix
from tabflow.llm.multi_index import nearest
from tabflow.llm.packing import pack_documents
from tabflow.llm.registry import QUERIES, SQL, register, table  # noqa: F401
from tabflow.llm.secret_scan import scan, written
from tabflow.llm.superkmer import remove_repeated
from tabflow.llm.token_store import token_digests, write_tokens
from tabflow.llm.tokens import tokenizer_path
from tabflow.session import scratch_path


@register()
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_digests(spark, path)


@register()
def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@register()
def op3_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict_languages(documents, fit(documents))


@register()
def op4_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


@register()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long")
    base = written(F.filter("spans", lambda s: s["order"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@register()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register()
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@register()
def op8_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    """
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows_ AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
           / CASE WHEN b.quality >= 1 THEN 2.0::DOUBLE WHEN b.quality < 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
capped AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS n FROM targets),
placed AS (
  SELECT r.doc_id, r.size, e.source_size, e.target, e.n, e.target - e.n * e.source_size AS rest,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_ r JOIN epochs e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (n + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""
)
def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register(
    """
WITH docs AS (SELECT doc_id, text, md5(coalesce(text, '')) AS th, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, th, unnest(range(len(ls))) AS line, unnest(ls) AS written FROM docs),
cut AS (
  SELECT doc_id, th, line, list_filter(regexp_split_to_array(written, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS words FROM every),
full_ AS (SELECT *, list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM cut WHERE len(words) > 0),
whole AS (
  SELECT doc_id, th, line, CASE WHEN len(list_filter(tokens, lambda t: t <> '<*>')) >= 0.6::DOUBLE * len(tokens) THEN tokens ELSE words END AS template FROM full_),
whole_first AS (SELECT template, min((doc_id, line)) AS first FROM whole GROUP BY template HAVING count(DISTINCT th) >= 2),
long_ AS (SELECT *, (len(tokens), tokens[1], tokens[2], tokens[3]) AS leaf FROM full_ WHERE len(tokens) >= 4),
leaves AS (SELECT leaf, count(DISTINCT th) AS texts FROM long_ GROUP BY leaf HAVING count(DISTINCT th) >= 8),
rows_ AS (SELECT l.*, v.texts FROM long_ l JOIN leaves v USING (leaf)),
places AS (SELECT leaf, texts, doc_id, th, line, unnest(range(len(tokens))) AS place, unnest(tokens) AS token FROM rows_),
fixed AS (
  SELECT leaf, place, token, count(DISTINCT th) >= 0.1::DOUBLE * texts AS usual FROM places WHERE token <> '<*>' GROUP BY leaf, texts, place, token
  HAVING count(DISTINCT th) >= 8),
parsed AS (
  SELECT 'fixed' AS rule, p.leaf, doc_id, th, line, list(CASE WHEN f.token IS NULL THEN '<*>' ELSE p.token END ORDER BY p.place) AS template
  FROM places p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.place = f.place AND p.token = f.token GROUP BY p.leaf, doc_id, th, line
  HAVING count(f.token) >= 0.6::DOUBLE * count(*)
  UNION
  SELECT 'usual', p.leaf, doc_id, th, line, list(CASE WHEN f.token IS NULL THEN '<*>' ELSE p.token END ORDER BY p.place)
  FROM places p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.place = f.place AND p.token = f.token AND f.usual GROUP BY p.leaf, doc_id, th, line
  HAVING count(f.token) >= 0.6::DOUBLE * count(*)),
either_ AS (SELECT DISTINCT leaf, template, doc_id, th, line FROM parsed),
recurring AS (SELECT leaf, template, min((doc_id, line)) AS first FROM either_ GROUP BY leaf, template HAVING count(DISTINCT th) >= 8),
dropped AS (
  SELECT doc_id, line FROM either_ JOIN recurring USING (leaf, template) WHERE (doc_id, line) <> first
  UNION
  SELECT doc_id, line FROM whole JOIN whole_first USING (template) WHERE (doc_id, line) <> first),
gone AS (SELECT doc_id, list(line) AS lines FROM dropped GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF lines IS NULL OR NOT list_contains(lines, i)], chr(10)), '')) AS kept_sha256
FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id"""
)
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_report(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
