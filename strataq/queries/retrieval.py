"""Retrieval queries. Every document is a chunk of its municipality; its vector is the one numbered by its id modulo the number of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.text import join_keywords, token_len, zscore
from strataq.operators import retrieve as R
from strataq.operators.pairs import all_pairs
from strataq.operators.requests import keywords
from strataq.session import table

BUDGET, K = 4000, 50
KEYWORDS = ["parking lot", "building permit"]


def with_vector(spark: SparkSession, sf_dir: str, rows: DataFrame, number: Column) -> DataFrame:
    """Append ``vec``: the vector numbered by ``number`` modulo the number of vectors, null if that one is missing."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vec"))
    return rows.withColumn("_v", F.pmod(number.cast("long"), F.lit(max(1, vectors.count())))).join(vectors, "_v", "left").drop("_v")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND muni IS NOT NULL")
    docs = docs.select(F.col("doc_id").alias("chunk_id"), "muni", "text", token_len(F.col("text")).alias("tokens"))
    return with_vector(spark, sf_dir, docs, F.col("chunk_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "question").select(F.col("id").alias("question_id"), F.col("question_detail").alias("detail"), F.col("question_rephrase").alias("rephrase"), F.col("double_check_context").alias("rerank_type"))
    return with_vector(spark, sf_dir, q, F.length("detail"))


def keyword_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of keywords as it is kept by hand: one column per question, rows in order of priority, blanks below the last.

    Here a question's keywords are its words of five letters or more, in their order.
    """
    words = F.filter(F.split(F.lower("question_detail"), " "), lambda w: F.length(w) >= 5)
    long = table(spark, sf_dir, "question").where("id IS NOT NULL").select("id", F.posexplode(words).alias("_p", "keyword"))
    return long.groupBy((F.col("_p") + 1).cast("int").alias("priority")).pivot("id").agg(F.first("keyword"))


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = keyword_sheet(spark, sf_dir)
    return keywords(sheet, [c for c in sheet.columns if c != "priority"])


def _keywords(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in keyword_table(spark, sf_dir).orderBy("question_id", "priority").collect():  # a fixed table
        out.setdefault(r["question_id"], []).append(r["keyword"])
    return out


def _scored(spark: SparkSession, sf_dir: str, keywords: bool = False) -> DataFrame:
    return R.score_chunks(chunks(spark, sf_dir), questions(spark, sf_dir), _keywords(spark, sf_dir) if keywords else None)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K best of every pair by cosine, with the statistics of the pair: one pass."""
    return R.best_chunks(chunks(spark, sf_dir), questions(spark, sf_dir).drop("rerank_type"), k=K)


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_relevance(_best(spark, sf_dir), questions(spark, sf_dir), chunks(spark, sf_dir))


def cosine_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("question_id", "muni", "chunk_id", "cosine")


def cosine_sort(spark, sf_dir):
    """The scan in order: a range-partitioned sort, whatever the size of a municipality."""
    return cosine_scores(spark, sf_dir).orderBy("question_id", "muni", F.desc("cosine"), "chunk_id")


def cosine_topk50(spark, sf_dir):
    return _best(spark, sf_dir).select("question_id", "muni", "chunk_id", "cosine", F.col("pos").cast("long").alias("pos"))


def cosine_stats(spark, sf_dir):
    best = _best(spark, sf_dir).where("pos = 1")
    return best.select("question_id", "muni", "chunks", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def zscore_cos_all(spark, sf_dir):
    z = zscore(F.col("cosine"), F.col("mean"), F.when(F.col("sd") > 1e-9, F.col("sd")))
    return _best(spark, sf_dir).select("question_id", "muni", "chunk_id", F.round(z, 5).alias("z"))


def lexical_rerank(spark, sf_dir):
    return _relevant(spark, sf_dir).select("question_id", "muni", "chunk_id", F.round("relevance", 6).alias("relevance"))


def semantic_rerank(spark, sf_dir):
    rows = R.semantic_rerank(_relevant(spark, sf_dir))
    return rows.select("question_id", "muni", "chunk_id", F.col("place").cast("long").alias("place"))


def keyword_rerank(spark, sf_dir):
    """The whole order by keyword of every question."""
    rows = R.whole_order(_scored(spark, sf_dir, True), by_keyword=True)
    return rows.select("question_id", "muni", "chunk_id", "priority", "place")


def rerank_dispatch(spark, sf_dir):
    """The whole order by keyword and by plain cosine; the K best where the question asks for the semantic way."""
    rows = R.rerank(chunks(spark, sf_dir), questions(spark, sf_dir), _keywords(spark, sf_dir), k=K)
    return rows.select("question_id", "muni", "chunk_id", F.col("place").cast("long").alias("place"))


def budget_prefix(spark, sf_dir):
    rows = R.within_budget(_best(spark, sf_dir).withColumnRenamed("pos", "place"), BUDGET)
    return rows.select("question_id", "muni", "chunk_id", "tokens", "running")


def _contexts(spark, sf_dir, placed):
    c = chunks(spark, sf_dir)
    pairs = all_pairs(c.select("muni").distinct(), questions(spark, sf_dir))
    out = R.contexts(R.within_budget(placed, BUDGET), pairs, c)
    return out.select("question_id", "muni", "chunks", F.md5("context").alias("context_md5"))


def context_concat(spark, sf_dir):
    return _contexts(spark, sf_dir, _best(spark, sf_dir).withColumnRenamed("pos", "place"))


def ctx_build(spark, sf_dir):
    """The whole retrieval of a first answer: cosine, semantic rerank, budget, context."""
    return _contexts(spark, sf_dir, R.semantic_rerank(_relevant(spark, sf_dir)))


def ctx_double_check(spark, sf_dir):
    """The whole retrieval of a double check: each question by its own way of ranking."""
    return _contexts(spark, sf_dir, R.rerank_best(chunks(spark, sf_dir), questions(spark, sf_dir), _keywords(spark, sf_dir), K, BUDGET))


def keyword_unpivot(spark, sf_dir):
    return keyword_table(spark, sf_dir)


def keyword_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", join_keywords(F.col("text"), KEYWORDS).alias("text"))


def question_vector_lookup(spark, sf_dir):
    """Each question's vector from the store, which lacks every question that isn't Binary, else from the embedder. Of equal texts in the store the last by id counts."""
    kinds = table(spark, sf_dir, "question").select(F.col("id").alias("question_id"), F.col("question_type").alias("kind"))
    asked = questions(spark, sf_dir).join(kinds, "question_id")
    store = R.last_vector(asked.where("kind = 'Binary'"), "detail", "question_id", "vec")
    out = R.look_up_vectors(asked.select("question_id", "detail"), store)
    return out.select("question_id", "from_store", F.when(F.col("from_store"), F.round(F.col("vec")[0], 6)).alias("first"), F.size("vec").alias("width"))


FUNCTIONS = [
    cosine_scores, cosine_sort, cosine_topk50, cosine_stats, zscore_cos_all, lexical_rerank, semantic_rerank, keyword_rerank, rerank_dispatch,
    budget_prefix, context_concat, ctx_build, ctx_double_check, keyword_unpivot, keyword_normalise, question_vector_lookup,
]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_BASE = r"""WITH chunks AS (SELECT d.doc_id AS chunk_id, d.muni, d.text, CAST(len(regexp_extract_all(d.text, '[^ \n]+')) AS BIGINT) AS tokens, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) WHERE d.text IS NOT NULL AND d.muni IS NOT NULL),
q AS (SELECT id AS question_id, question_detail AS detail, question_rephrase AS rephrase, double_check_context AS rerank_type, CAST(e.embedding AS DOUBLE[]) AS vec FROM question JOIN embeddings e ON e.vec_id = length(question_detail) % (SELECT count(*) FROM embeddings)),
kw AS (SELECT question_id, unnest(ws) AS keyword, CAST(generate_subscripts(ws, 1) AS INTEGER) AS priority FROM (SELECT question_id, list_filter(string_split(lower(detail), ' '), lambda w: length(w) >= 5) AS ws FROM q)),
scored AS (SELECT q.question_id, c.muni, c.chunk_id, c.tokens, round(list_cosine_similarity(c.vec, q.vec), 9) AS cosine FROM chunks c, q),
stats AS (SELECT question_id, muni, count(*) AS chunks, avg(cosine) AS mean, stddev_pop(cosine) AS sd FROM scored GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, muni ORDER BY cosine DESC, chunk_id) AS pos FROM scored) WHERE pos <= 50),
rel AS (SELECT t.*, round(len(list_intersect(qs, list_distinct(regexp_extract_all(lower(c.text), '[^ \n]+')))) / CAST(len(qs) AS DOUBLE), 9) AS relevance FROM top t JOIN chunks c USING (chunk_id)
  JOIN (SELECT question_id, list_distinct(regexp_extract_all(lower(rephrase), '[^ \n]+')) AS qs FROM q) USING (question_id)),
relz AS (SELECT *, avg(relevance) OVER w AS rm, stddev_pop(relevance) OVER w AS rs FROM rel WINDOW w AS (PARTITION BY question_id, muni)),
comb AS (SELECT r.question_id, r.muni, chunk_id, tokens, pos, round(CASE WHEN rs > 1e-9 THEN (relevance - rm) / rs ELSE 0 END + CASE WHEN sd > 1e-9 THEN (cosine - mean) / sd ELSE 0 END, 6) AS combined
  FROM relz r JOIN stats s ON s.question_id = r.question_id AND s.muni = r.muni),
sem AS (SELECT *, row_number() OVER (PARTITION BY question_id, muni ORDER BY combined DESC, pos) AS place FROM comb),
prio AS (SELECT kw.question_id, c.chunk_id, min(priority) AS priority FROM chunks c JOIN kw ON contains(lower(c.text), keyword) GROUP BY ALL),
keyed AS (SELECT s.*, p.priority, row_number() OVER (PARTITION BY s.question_id, muni ORDER BY p.priority NULLS LAST, cosine DESC, s.chunk_id) AS place
  FROM scored s LEFT JOIN prio p ON p.question_id = s.question_id AND p.chunk_id = s.chunk_id)
"""
_DISPATCH = """, plain AS (SELECT *, row_number() OVER (PARTITION BY question_id, muni ORDER BY cosine DESC, chunk_id) AS place FROM scored),
dispatched AS (SELECT p.question_id, p.muni, chunk_id, tokens, place FROM plain p JOIN q USING (question_id) WHERE rerank_type IS NULL OR lower(rerank_type) NOT IN ('semantic', 'keyword')
  UNION ALL SELECT k.question_id, k.muni, chunk_id, tokens, place FROM keyed k JOIN q USING (question_id) WHERE lower(rerank_type) = 'keyword'
  UNION ALL SELECT s.question_id, s.muni, chunk_id, tokens, place FROM sem s JOIN q USING (question_id) WHERE lower(rerank_type) = 'semantic')
"""
_CONTEXT = """, run AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id, muni ORDER BY place ROWS UNBOUNDED PRECEDING) AS running FROM {placed}),
sel AS (SELECT r.question_id, r.muni, count(*) AS chunks, string_agg('##' || c.text, chr(10) || chr(10) ORDER BY place) AS context FROM run r JOIN chunks c USING (chunk_id) WHERE running <= 4000 GROUP BY ALL)
SELECT p.question_id, p.muni, CAST(coalesce(s.chunks, 0) AS BIGINT) AS chunks, md5(coalesce(context, '')) AS context_md5 FROM (SELECT DISTINCT question_id, muni FROM scored) p LEFT JOIN sel s ON s.question_id = p.question_id AND s.muni = p.muni"""
_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
ORACLES = {
    "cosine_scores": _BASE + "SELECT question_id, muni, chunk_id, cosine FROM scored",
    "cosine_sort": _BASE + "SELECT question_id, muni, chunk_id, cosine FROM scored ORDER BY question_id, muni, cosine DESC, chunk_id",
    "cosine_topk50": _BASE + "SELECT question_id, muni, chunk_id, cosine, pos FROM top",
    "cosine_stats": _BASE + "SELECT question_id, muni, chunks, round(mean, 6) AS mean, round(sd, 6) AS sd FROM stats",
    "zscore_cos_all": _BASE + "SELECT t.question_id, t.muni, chunk_id, round(CASE WHEN sd > 1e-9 THEN (cosine - mean) / sd ELSE 0 END, 5) AS z FROM top t JOIN stats s ON s.question_id = t.question_id AND s.muni = t.muni",
    "lexical_rerank": _BASE + "SELECT question_id, muni, chunk_id, round(relevance, 6) AS relevance FROM rel",
    "semantic_rerank": _BASE + "SELECT question_id, muni, chunk_id, place FROM sem",
    "keyword_rerank": _BASE + "SELECT question_id, muni, chunk_id, priority, place FROM keyed",
    "rerank_dispatch": _BASE + _DISPATCH + "SELECT question_id, muni, chunk_id, place FROM dispatched",
    "budget_prefix": _BASE + ", run AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY question_id, muni ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM top) SELECT question_id, muni, chunk_id, tokens, running FROM run WHERE running <= 4000",
    "context_concat": _BASE + _CONTEXT.format(placed="(SELECT *, pos AS place FROM top)"),
    "ctx_build": _BASE + _CONTEXT.format(placed="sem"),
    "ctx_double_check": _BASE + _DISPATCH + _CONTEXT.format(placed="dispatched"),
    "keyword_unpivot": _BASE + "SELECT question_id, priority, keyword FROM kw",
    "keyword_normalise": f"SELECT doc_id, replace(lower(replace(lower(translate(text, '{_PUNCTUATION}', '{' ' * 32}')), 'parking lot', 'parking_lot')), 'building permit', 'building_permit') AS text FROM documents",
    "question_vector_lookup": """SELECT id AS question_id, s.detail IS NOT NULL AS from_store, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first, CAST(64 AS INTEGER) AS width FROM question
      LEFT JOIN (SELECT DISTINCT question_detail AS detail FROM question WHERE question_type = 'Binary' AND question_detail IS NOT NULL) s ON s.detail = question_detail
      LEFT JOIN embeddings e ON s.detail IS NOT NULL AND e.vec_id = length(question_detail) % (SELECT count(*) FROM embeddings)""",
}
