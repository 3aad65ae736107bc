"""The opN queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the packing query; FRESHET_TOKENIZER names another."""
    if "FRESHET_TOKENIZER" in os.environ:
        return os.environ["FRESHET_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.substring_dedup import find_factors

    out = find_factors(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.packing import Capacities, pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), Capacities(tokens=4096))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.warc_zip import archive_folder, read_index, read_records, spread_index, write_archives

    packages = write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), archive_folder(spark), min_bytes=1000)
    records = read_records(spread_index(read_index(packages), packages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.mixing import mix_sources

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix_sources(docs, F.array("source"), weights=(5, 2, 1), max_epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.chosen_path import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.html_layout import extract_text

    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "html"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document: page_id or doc_id, the other null."""
    from freshet.llm.language_id import fit_text_model, identify_pages, identify_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = fit_text_model(docs)
    pages = identify_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    texts = identify_texts(docs, model)
    columns = ["page_id", "doc_id", "lang", "confidence", "text_lang", "declared", "host"]
    pages = pages.withColumn("doc_id", F.lit(None).cast("long")).select(columns)
    return pages.unionByName(texts.withColumn("page_id", F.lit(None).cast("long")).select(columns))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.decision_list import STATISTICS, judge

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", *STATISTICS, "base_failed", "kept", "rule")


def op10_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.ball_tree import quantise, top_k

    vectors = quantise(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64.0)
    return top_k(vectors, F.pmod("id", F.lit(20)) == 0, k=20)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.url_rules import URL_RULES, judge_urls

    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.whitening import whiten

    out = whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=256.0, components=4)
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.source_audit import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=10, top=10)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), copied AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM copied, (SELECT unnest(range(0, 20)) AS k)
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), kept AS (
  SELECT flat.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY flat.pos) FILTER (gone.pos IS NULL) AS kept
  FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.pos = gone.pos GROUP BY flat.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), r AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS response FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(encode(h)) AS payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM r
"""

OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.doc_id, pos, line, (f.k IS NOT NULL AND keyed.doc_id <> f.keeper) AS gone
  FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), per_doc AS (
  SELECT r, lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM per_doc GROUP BY lang, term HAVING count(*) >= 10
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, sum(n) AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (t.total + 2 * s.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)::HUGEINT) // (s.total + 2 * s.v)::HUGEINT AS q
  FROM totals t JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_best_fit_packing, op3_warc_zip, op4_line_dedup, op5_source_mixing, op6_minhash_near_dedup, op7_html_extraction, op8_quality_rules, op9_language_id, op10_ball_tree_topk, op11_url_filters, op12_embedding_whitening, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_warc_zip": OP3_SQL, "op4_line_dedup": OP4_SQL, "op10_ball_tree_topk": OP10_SQL, "op13_source_audit": OP13_SQL}
