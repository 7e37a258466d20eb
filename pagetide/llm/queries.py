"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import op1_knn, op2_orc, op3_mix, op4_jaccard, op5_brown, op6_pii, op7_urls, op8_bpe, op9_quality, op10_langid
from pagetide.llm.shared import documents, scratch

TOKENIZER = "word_bpe_49k.json"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return op1_knn.knn(e, e.where("vec_id % 100 = 0"), k=10)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    op2_orc.write_tokens(documents(spark, sf_dir), out, tokenizer_path(), end_id=2)
    return op2_orc.token_table(spark, out)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix.mix(documents(spark, sf_dir)).drop("source")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard.jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op5_brown.brown_scores(documents(spark, sf_dir), ~op5_brown.held_out())
    return scored.select("doc_id", op5_brown.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = op6_pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    count = [F.size(F.expr(f"filter(pii, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in op6_pii.BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*op6_pii.BASE))
    return x.select("doc_id", *count, F.sha2(op6_pii.span_text(base).cast("binary"), 256).alias("base_sha256"), op6_pii.span_text(F.col("pii")).alias("spans"), op6_pii.score_text(F.col("pii")).alias("scores"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return op7_urls.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), listed).drop("url")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_bpe.encode(documents(spark, sf_dir), tokenizer_path(), keep_ids=False)


def op9_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op9_quality.quality(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tree = op10_langid.fit(docs.where(~op10_langid.held_out()))
    return op10_langid.predict(docs, tree).select("doc_id", op10_langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_voronoi_knn, op2_token_orc, op3_source_mix, op4_ngram_jaccard, op5_brown_lm, op6_pii_spans, op7_url_filter, op8_bpe_codec, op9_quality_mcd, op10_language_id)}

ORACLE = {
    "op1_voronoi_knn": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_url_filter": """
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, v)),
m AS (SELECT page_id, host, path, (SELECT rh || rp || ' ' || v FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS hit FROM h)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(split_part(hit, ' ', 2), 'allow') AS verdict FROM m""",
    "op4_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS k FROM documents UNION SELECT e.a, r.k FROM r JOIN e ON e.b = r.doc_id),
m AS (SELECT doc_id, min(k) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
}
