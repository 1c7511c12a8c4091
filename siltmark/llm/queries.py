"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.alignment import aligned
from siltmark.llm.bpe import encoded
from siltmark.llm.decontaminate import contamination
from siltmark.llm.html_extract import main_text
from siltmark.llm.lsh_forest import near_duplicates
from siltmark.llm.mixing import SEED, mixing_plan
from siltmark.llm.mtree import top_inner_products
from siltmark.llm.paragraph_dedup import without_repeats
from siltmark.llm.quality_rules import quality_verdicts
from siltmark.llm.sharding import assign_shards
from siltmark.llm.suffix_dedup import without_repeated_strings
from siltmark.llm.term_pipeline import ranked_search
from siltmark.llm.token_counts import token_counts
from siltmark.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_verdicts(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@register
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_source_mix"] = f"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
stats AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]
              [((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS cap
  FROM stats),
filled AS (
  SELECT *, cap / weight AS fill_at, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM named),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM filled
  WINDOW before AS (ORDER BY fill_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN fill_at > level
              THEN least(cap, weight * (SELECT arg_min(level, (fill_at, level)) FROM levels WHERE fill_at > level))
              ELSE cap END AS target
  FROM levels),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
           / {1 << 52}::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM drawn"""


@register
def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@register
def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register
def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLES["op4_mtree_top_k"] = """
WITH unnested AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS k, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS (SELECT vec_id, list(x::DOUBLE ORDER BY k) AS v FROM unnested GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@register
def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


@register
def op8_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@register
def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


@register
def op2_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@register
def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op12_window_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text", "spans")


def _item_words(name: str, id_col: str) -> str:
    """Positions and words of a table's texts, with the windows that start at each."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    leads = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, 10))
    return f"""
{name}_words AS (SELECT {id_col} AS id, rowid AS r, {words} AS words FROM (SELECT *, row_number() OVER () AS rowid FROM {name})),
{name}_at AS (
  SELECT id, r, n, p, word AS w0, {leads}
  FROM (SELECT id, r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM {name}_words)
  WINDOW w AS (PARTITION BY r ORDER BY p))"""


ORACLES["op12_window_set"] = f"""
WITH {_item_words("documents", "doc_id")}, {_item_words("benchmark", "item_id")},
windows AS (
  SELECT id::VARCHAR AS item, least(n, 10) AS size, concat_ws(' ', {", ".join(f"w{k}" for k in range(10))}) AS gram
  FROM benchmark_at WHERE p <= greatest(n - 9, 1)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT r, p, size, CASE size {" ".join(f"WHEN {s} THEN concat_ws(' ', {', '.join(f'w{k}' for k in range(s))})" for s in range(1, 11))} END AS gram
  FROM documents_at JOIN sizes ON p + size - 1 <= n),
hits AS (SELECT DISTINCT r, p, grams.size, item FROM grams JOIN windows ON grams.gram = windows.gram AND grams.size = windows.size),
covered AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r),
listed AS (SELECT r, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT id AS doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM documents_words LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""


@register
def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _term_rows(name: str, source: str, id_col: str) -> str:
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
{name} AS (
  SELECT r, id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n
  FROM (SELECT r, id, len(words) AS n, unnest(words) AS term
        FROM (SELECT row_number() OVER () AS r, {id_col} AS id, {words} AS words FROM {source}))
  GROUP BY r, id, term)"""


ORACLES["op13_term_pipeline"] = f"""
WITH {_term_rows("documents_terms", "documents", "doc_id")}, {_term_rows("asked", "(SELECT DISTINCT item_id, text FROM benchmark)", "item_id")},
sizes AS (SELECT count(*)::BIGINT AS total_docs, sum(n)::BIGINT AS total_terms FROM (SELECT DISTINCT r, n FROM documents_terms)),
weighed AS (
  SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM documents_terms GROUP BY term), sizes),
scored AS (
  SELECT a.r AS asked, a.id AS item_id, d.r, d.id AS doc_id,
         sum(a.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * d.n * total_docs) // total_terms))))::BIGINT AS score
  FROM asked a JOIN weighed USING (term) JOIN documents_terms d USING (term), sizes
  GROUP BY a.r, a.id, d.r, d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
