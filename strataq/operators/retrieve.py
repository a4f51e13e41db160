"""Retrieval: cosine scan, reranking, budgeted selection and context building for (question, municipality) pairs.

One scoring pass over the chunks (``best_chunks``) gives the statistics of every pair and, of each task, only the chunks that can
still be among the best: the top k, or the prefix that a token budget can reach. So what moves is bounded by tasks and pairs, not by
chunks, and a municipality that holds a third of all chunks costs no more than its candidates. Texts are joined to what was
selected, once per chunk. Whole orders, where they are asked for, are sorted over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strataq.functions.text import tokens, zscore
from strataq.providers import Embedder, Reranker, embed_texts
from strataq.session import cut, let

SCORED = "question_id string, muni string, chunk_id bigint, tokens bigint, cosine double, priority int"
PARTS = SCORED + ", n bigint, mean double, m2 double"
PAIR = ["question_id", "muni"]
#: Questions whose vectors go to a worker at a time.
BLOCK = 2000
#: Rows of one municipality that a task holds before it drops those that can't be selected any more.
HELD = 4096
#: Ways of ranking; any other name means PLAIN.
SEMANTIC, KEYWORD, PLAIN = "semantic", "keyword", "plain"


def last_vector(vectors: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Question vector store: of equal texts the last one counts."""
    return vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(vector, order).alias(vector))


def look_up_vectors(questions: DataFrame, store: DataFrame, text: str = "detail", embedder: Embedder | None = None) -> DataFrame:
    """Append ``vec`` and ``from_store``: the stored vector of the text, else one by the embedder.

    ``store`` is (text, vec), each text once. A missing text is embedded once however many questions ask it; append
    ``missing_vectors`` to the store to keep it.
    """
    known = questions.join(store.select(F.col(text), F.col("vec").alias("_known")), text, "left")
    made = missing_vectors(questions, store, text, embedder).withColumnRenamed("vec", "_made")
    out = known.join(made, text, "left")
    return out.withColumns({"vec": F.coalesce(F.col("_known").cast("array<double>"), F.col("_made")), "from_store": F.col("_known").isNotNull()}).drop("_known", "_made")


def missing_vectors(questions: DataFrame, store: DataFrame, text: str = "detail", embedder: Embedder | None = None) -> DataFrame:
    """(text, vec) of the texts that the store lacks; null texts have none."""
    lacking = questions.where(F.col(text).isNotNull()).select(text).distinct().join(store.select(text), text, "left_anti")
    return embed_texts(lacking, text, text, embedder)


def query_words(query: str | None) -> frozenset[str]:
    return frozenset(w for w in (query or "").lower().replace("\n", " ").split(" ") if w)


@dataclass
class Scorer:
    """The stated questions: their vectors, ways of ranking, and the places of their keywords among the distinct ones."""

    ids: list[str]
    ways: list[str]
    matrix: np.ndarray
    keywords: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.norm = np.linalg.norm(self.matrix, axis=1)

    def cosines(self, vectors: pd.Series, many: bool) -> np.ndarray:
        """(chunks, questions), -1 without a vector, rounded so that equal vectors tie; of several vectors the greatest counts."""
        n, width = len(vectors), self.matrix.shape[1]
        every = vectors
        if many:  # vectors one below the other, each with the row it is of
            of = [i for i, vs in enumerate(vectors) if vs is not None for _ in vs]
            every = pd.Series([v for vs in vectors if vs is not None for v in vs], dtype=object)
        ok = np.array([v is not None and len(v) == width for v in every], dtype=bool)
        vecs = np.zeros((len(every), width))
        if ok.any():
            vecs[ok] = np.stack(every[ok].to_numpy()).astype(np.float64)
        size = np.linalg.norm(vecs, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(np.einsum("nd,qd->nq", vecs, self.matrix) / size[:, None] / self.norm[None, :], 9)
        score[~np.isfinite(score)] = -1.0
        if not many:
            return score
        best = np.full((n, len(self.ids)), -1.0)
        np.maximum.at(best, np.array(of, dtype=int), score)
        return best

    def priorities(self, hits: pd.Series | None, n: int) -> np.ndarray:
        """(chunks, questions): the place, from 1, of the first keyword that a chunk holds; NONE if it holds none."""
        out = np.full((n, len(self.ids)), NONE, dtype=np.int32)
        if hits is None or not any(self.keywords):
            return out
        held = np.zeros((n, 1 + max(max(ks, default=0) for ks in self.keywords)), dtype=bool)
        for i, hit in enumerate(hits):
            if hit is not None and len(hit):
                held[i, [h for h in hit if h < held.shape[1]]] = True
        for q, ks in enumerate(self.keywords):
            if ks:
                mine = held[:, ks]
                out[:, q] = np.where(mine.any(axis=1), mine.argmax(axis=1) + 1, NONE)
        return out


NONE = 2**31 - 1


def distinct_keywords(keywords: dict[str, list[str]] | None) -> list[str]:
    return sorted({k.lower() for ks in (keywords or {}).values() for k in ks})


def keyword_hits(text: Column, distinct: list[str]) -> Column:
    """Which of the distinct keywords a text contains, case aside: each is looked for once, whatever the number of questions."""
    places = F.array(*[F.lit(i) for i in range(len(distinct))])
    names = F.array(*[F.lit(k) for k in distinct])
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(places, lambda i: low.contains(F.get(names, i))))


def scorers(questions: DataFrame, keywords: dict[str, list[str]] | None = None) -> list[Scorer]:
    """The stated question set in blocks of BLOCK. Ways are lower-cased ``rerank_type``, semantic without that column."""
    way = F.coalesce(F.lower("rerank_type"), F.lit(PLAIN)) if "rerank_type" in questions.columns else F.lit(SEMANTIC)
    rows = [(r["question_id"], r["vec"], r["way"]) for r in questions.select("question_id", "vec", way.alias("way")).orderBy("question_id").toLocalIterator()]
    place = {k: i for i, k in enumerate(distinct_keywords(keywords))}
    out = []
    for start in range(0, len(rows), BLOCK):
        part = rows[start : start + BLOCK]
        width = max((len(v) for _, v, _ in part if v is not None), default=0)
        matrix = np.array([v if v is not None and len(v) == width else [0.0] * width for _, v, _ in part], dtype=np.float64).reshape(len(part), width)
        ways = [w if w in (SEMANTIC, KEYWORD) else PLAIN for _, _, w in part]
        out.append(Scorer([q for q, *_ in part], ways, matrix, [[place[k.lower()] for k in (keywords or {}).get(q, [])] for q, *_ in part]))
    return out


def _prepared(chunks: DataFrame, keywords: dict[str, list[str]] | None) -> tuple[DataFrame, bool]:
    distinct = distinct_keywords(keywords)
    hits = [keyword_hits(F.col("text"), distinct).alias("_hits")] if distinct else []
    kind = chunks.schema["vec"].dataType
    return chunks.select("muni", "chunk_id", "tokens", "vec", *hits), isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)


def score_chunks(chunks: DataFrame, questions: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Cosine of every question with every chunk, and the place of the first keyword that the chunk contains: the whole matrix.

    ``chunks`` is (muni, chunk_id, tokens, vec[, text]), where vec may also be an array of vectors, of which the greatest cosine
    counts; ``questions`` (question_id, vec). Questions are the stated query set: they are taken in blocks of BLOCK vectors, each
    multiplied with Arrow batches of chunks in one pass. Without a vector the score is -1. Where only the best are wanted,
    ``best_chunks`` moves far less.
    """
    have, many = _prepared(chunks, keywords)
    out = None
    for scorer in scorers(questions, keywords):

        def run(batches: Iterator[pd.DataFrame], scorer=scorer) -> Iterator[pd.DataFrame]:
            k = len(scorer.ids)
            for pdf in batches:
                n = len(pdf)
                if not n:
                    continue
                priority = scorer.priorities(pdf.get("_hits"), n).ravel()
                yield pd.DataFrame(
                    {
                        "question_id": np.tile(np.array(scorer.ids, dtype=object), n),
                        "muni": np.repeat(pdf["muni"].to_numpy(), k),
                        "chunk_id": np.repeat(pdf["chunk_id"].to_numpy(), k),
                        "tokens": np.repeat(pdf["tokens"].to_numpy(), k),
                        "cosine": scorer.cosines(pdf["vec"], many).ravel(),
                        "priority": priority,
                    }
                )

        block = have.mapInPandas(run, SCORED).withColumn("priority", F.when(F.col("priority") < NONE, F.col("priority")))
        out = block if out is None else out.unionByName(block)
    return chunks.sparkSession.createDataFrame([], SCORED) if out is None else out


class Held:
    """What a task holds of one municipality: rows that may still be selected by some question, and statistics of all rows."""

    def __init__(self, scorer: Scorer, k: int, budget: int | None) -> None:
        self.scorer, self.k, self.budget = scorer, k, budget
        q = len(scorer.ids)
        self.n, self.mean, self.m2 = 0, np.zeros(q), np.zeros(q)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, tokens_: np.ndarray, cosine: np.ndarray, priority: np.ndarray) -> None:
        m, mean = len(ids), cosine.mean(axis=0)
        gap = mean - self.mean
        total = self.n + m
        self.m2 += ((cosine - mean) ** 2).sum(axis=0) + gap**2 * self.n * m / total
        self.mean += gap * m / total
        self.n = total
        self.rows.append((ids, tokens_, cosine, priority))
        self.size += m
        if self.size > HELD:
            self.prune()

    def chosen(self) -> list[np.ndarray]:
        """For each question the rows, in order, that may be selected: the first k, or all up to the first that overflows the budget."""
        ids, tokens_, cosine, priority = (np.concatenate([r[i] for r in self.rows]) for i in range(4))
        self.rows = [(ids, tokens_, cosine, priority)]
        out = []
        for q, way in enumerate(self.scorer.ways):
            order = np.lexsort((ids, -cosine[:, q], priority[:, q])) if way == KEYWORD else np.lexsort((ids, -cosine[:, q]))
            if way == SEMANTIC or self.budget is None:
                out.append(order[: self.k])
            else:
                over = np.cumsum(np.maximum(tokens_[order], 0)) > self.budget
                out.append(order[: int(over.argmax()) + 1 if over.any() else len(order)])
        return out

    def prune(self) -> None:
        keep = np.unique(np.concatenate(self.chosen()))
        self.rows = [tuple(x[keep] for x in self.rows[0])]
        self.size = len(keep)


def best_chunks(chunks: DataFrame, questions: DataFrame, keywords: dict[str, list[str]] | None = None, k: int = 50, budget: int | None = None) -> DataFrame:
    """(question_id, muni, chunk_id, tokens, cosine, priority, pos, chunks, mean, sd) of the best chunks of each pair, in one pass.

    pos is the place by the question's way: cosine for semantic and plain ones, the first keyword and then cosine for keyword
    ones; ties go by chunk id. Each keeps its first k. With a ``budget``, semantic questions keep at least those, and the others
    every chunk that a prefix within so many tokens can hold, and the one that overflows it. chunks, mean and sd (population) are over all
    chunks of the pair. Municipality null forms no pair.
    """
    have, many = _prepared(chunks.where("muni IS NOT NULL"), keywords)
    out = None
    for scorer in scorers(questions, keywords):

        def run(batches: Iterator[pd.DataFrame], scorer=scorer) -> Iterator[pd.DataFrame]:
            held: dict[str, Held] = {}
            size = 0
            for pdf in batches:
                if not len(pdf):
                    continue
                cosine, priority = scorer.cosines(pdf["vec"], many), scorer.priorities(pdf.get("_hits"), len(pdf))
                codes, munis = pd.factorize(pdf["muni"])
                ids, counts = pdf["chunk_id"].to_numpy(), pdf["tokens"].fillna(0).to_numpy()
                order = np.argsort(codes, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                    muni = munis[codes[part[0]]]
                    mine = held.get(muni)
                    if mine is None:
                        held[muni] = mine = Held(scorer, k, budget)
                    size -= mine.size
                    mine.add(ids[part], counts[part], cosine[part], priority[part])
                    size += mine.size
                if size > 64 * HELD:  # bounded memory, whatever the number of municipalities
                    yield from _emitted(held, scorer)
                    held, size = {}, 0
            yield from _emitted(held, scorer)

        block = have.mapInPandas(run, PARTS)
        out = block if out is None else out.unionByName(block)
    if out is None:
        out = chunks.sparkSession.createDataFrame([], PARTS)
    # Statistics are rows without a chunk. One exchange brings both kinds of a pair together; there are few of either per task.
    pair = W.partitionBy(*PAIR)
    out = out.withColumns({c: F.when(F.col("n").isNotNull(), F.col(c)) for c in ("mean", "m2")})
    out = out.withColumn("chunks", F.sum("n").over(pair)).withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(pair) / F.col("chunks"))
    out = out.withColumn("sd", F.sqrt(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).over(pair) / F.col("chunks")))
    place = F.row_number().over(pair.orderBy(F.col("chunk_id").isNull(), F.col("priority").asc_nulls_last(), F.col("cosine").desc(), F.col("chunk_id")))
    out = out.withColumn("pos", place).where("chunk_id IS NOT NULL")
    if budget is None:
        out = out.where(F.col("pos") <= k)
    return out.select(*PAIR, "chunk_id", "tokens", "cosine", "priority", "pos", "chunks", F.col("_mean").alias("mean"), "sd")


def _emitted(held: dict[str, Held], scorer: Scorer) -> Iterator[pd.DataFrame]:
    """A row per candidate, and one per question with the statistics of all rows."""
    names = np.array(scorer.ids, dtype=object)
    keyed = np.array([w == KEYWORD for w in scorer.ways])
    every = np.arange(len(names))
    found: list[tuple[np.ndarray, ...]] = []
    stats: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for muni, h in held.items():
        chosen = h.chosen()
        ids, tokens_, cosine, priority = h.rows[0]
        q = np.repeat(every, [len(c) for c in chosen])
        at = np.concatenate(chosen)
        place = priority[at, q]
        found.append((q, np.full(len(q), muni, dtype=object), ids[at], tokens_[at], cosine[at, q], np.where(keyed[q] & (place < NONE), place, -1)))
        stats.append((every, np.full(len(names), muni, dtype=object), np.full(len(names), h.n), h.mean, h.m2))
        rows += len(at)
        if rows > 50_000:
            yield _framed(names, found, stats)
            found, stats, rows = [], [], 0
    if found:
        yield _framed(names, found, stats)


def _framed(names: np.ndarray, found: list[tuple[np.ndarray, ...]], stats: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """One frame of both kinds of rows; what a kind doesn't have is null."""
    q, muni, ids, tokens_, cosine, priority = (np.concatenate([x[i] for x in found]) for i in range(6))
    q2, muni2, n, mean, m2 = (np.concatenate([x[i] for x in stats]) for i in range(5))
    first, last = len(q), len(q2)

    def whole(values: np.ndarray, before: int, after: int, kind: str) -> pd.arrays.IntegerArray:
        data = np.concatenate([np.zeros(before), values, np.zeros(after)]).astype(np.int64)
        missing = np.concatenate([np.ones(before, bool), np.zeros(len(values), bool), np.ones(after, bool)])
        return pd.arrays.IntegerArray(data.astype(kind), missing)

    place = pd.arrays.IntegerArray(np.concatenate([priority, np.full(last, -1)]).astype(np.int32), np.concatenate([priority < 0, np.ones(last, bool)]))
    gap = np.full(first, np.nan)
    return pd.DataFrame(
        {
            "question_id": names[np.concatenate([q, q2])], "muni": np.concatenate([muni, muni2]), "chunk_id": pd.arrays.IntegerArray(np.concatenate([ids, np.zeros(last, np.int64)]).astype(np.int64), np.concatenate([np.zeros(first, bool), np.ones(last, bool)])),
            "tokens": whole(tokens_, 0, last, "int64"), "cosine": np.concatenate([cosine, np.full(last, np.nan)]), "priority": place, "n": whole(n, first, 0, "int64"), "mean": np.concatenate([gap, mean]), "m2": np.concatenate([gap, m2]),
        }
    )


def ranked(scored: DataFrame, k: int, by_keyword: bool = False) -> DataFrame:
    """The first k chunks of each pair with their place, of scores that are already at hand; k is at most Spark's group limit (1000)."""
    order = [F.col("cosine").desc(), F.col("chunk_id")]
    order = [F.col("priority").asc_nulls_last(), *order] if by_keyword else order
    return scored.withColumn("pos", F.row_number().over(W.partitionBy(*PAIR).orderBy(*order))).where(F.col("pos") <= k)


def whole_order(scored: DataFrame, by_keyword: bool = False) -> DataFrame:
    """All chunks of each pair with their place, in the order of ``ranked``.

    Rows are sorted over ranges of pair and order, so that no task gathers a municipality: the place is the row's number among
    those of its pair in its range, plus the rows of the pair in the ranges before. Ranges are drawn by sampling, so they and the
    numbers within are cut off by a checkpoint before they are used twice.
    """
    order = [*PAIR, *([F.col("priority").asc_nulls_last()] if by_keyword else []), F.col("cosine").desc(), F.col("chunk_id")]
    rows = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))  # the upper bits number the ranges
    parts = rows.groupBy(*PAIR, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*PAIR).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    start = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    parts = parts.select(F.col("question_id").alias("_q"), F.col("muni").alias("_m"), F.col("_range").alias("_r"), start.alias("_start"))
    same = F.col("question_id").eqNullSafe(F.col("_q")) & F.col("muni").eqNullSafe(F.col("_m")) & (F.col("_range") == F.col("_r"))
    return rows.join(parts, same).withColumn("place", F.col("_at") + F.col("_start")).drop("_at", "_range", "_q", "_m", "_r", "_start")


def with_relevance(top: DataFrame, questions: DataFrame, texts: DataFrame, reranker: Reranker | None = None) -> DataFrame:
    """Append ``relevance`` to the selected chunks. Each text is joined once, to all questions that selected it.

    By default it is the share of the distinct words of the question's ``rephrase`` that the text holds, case aside, rounded to 9
    places, 0 for a missing text or question; a ``Reranker`` may take its place.
    """
    keep = [c for c in top.columns if c != "chunk_id"]
    asked = questions.select("question_id", F.col("rephrase").alias("_asked")).dropDuplicates(["question_id"])
    grouped = top.join(asked, "question_id", "left").groupBy("chunk_id").agg(F.collect_list(F.struct(*keep, "_asked")).alias("_of"))  # at most one per question
    found = grouped.join(texts.select("chunk_id", F.col("text").alias("_text")), "chunk_id", "left")
    if reranker is not None:
        return _by_reranker(found, keep, reranker)

    def word_set(text: Column) -> Column:
        return F.array_distinct(tokens(F.lower(F.coalesce(text, F.lit("")))))

    def share(s: Column, words: Column) -> Column:
        def of(q: Column) -> Column:
            return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, words)) / F.size(q), 9)).otherwise(F.lit(0.0))

        return F.struct(*[s[c].alias(c) for c in keep], let(word_set(s["_asked"]), of).alias("relevance"))

    scored = let(word_set(F.col("_text")), lambda words: F.transform("_of", lambda s: share(s, words)))
    return found.select("chunk_id", F.inline(scored))


def _by_reranker(found: DataFrame, keep: list[str], reranker: Reranker) -> DataFrame:
    rows = found.select("chunk_id", "_text", F.inline("_of"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shown = ["chunk_id", *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = reranker.relevance(list(zip(pdf["_asked"], pdf["_text"], strict=True)))
            yield pdf[shown].assign(relevance=[round(float(s), 9) for s in scores])

    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in shown) + ", relevance double")


def semantic_rerank(best: DataFrame) -> DataFrame:
    """``best`` (of ``best_chunks``, with relevance) ordered by z-score of relevance, over the selected, plus z-score of cosine, over all chunks of the pair."""
    over = W.partitionBy(*PAIR)  # at most k rows
    top = best.withColumn("relevance", F.coalesce(F.nanvl("relevance", F.lit(0.0)), F.lit(0.0)))
    top = top.withColumns({"_m": F.avg("relevance").over(over), "_s": F.stddev_pop("relevance").over(over)})
    z = F.round(zscore(F.col("relevance"), F.col("_m"), F.when(F.col("_s") > 1e-9, F.col("_s"))) + zscore(F.col("cosine"), F.col("mean"), F.when(F.col("sd") > 1e-9, F.col("sd"))), 6)
    top = top.withColumn("combined", z)
    return top.withColumn("place", F.row_number().over(over.orderBy(F.desc("combined"), "pos"))).select(*PAIR, "chunk_id", "tokens", "cosine", "relevance", "combined", "place")


def rerank_best(chunks: DataFrame, questions: DataFrame, keywords: dict[str, list[str]] | None = None, k: int = 50, budget: int = 4000, reranker: Reranker | None = None) -> DataFrame:
    """Each question's way of ranking in one scoring pass, as far as ``budget`` tokens can reach: the k best for semantic ones."""
    best = best_chunks(chunks, questions, keywords, k, budget)
    way = F.coalesce(F.lower("rerank_type"), F.lit("")) if "rerank_type" in questions.columns else F.lit(SEMANTIC)
    kinds = questions.select("question_id", way.alias("_way")).dropDuplicates(["question_id"])
    best = best.join(kinds, "question_id")
    cols = [*PAIR, "chunk_id", "tokens", "place"]
    top = with_relevance(best.where((F.col("_way") == SEMANTIC) & (F.col("pos") <= k)).drop("_way"), questions, chunks, reranker)
    rest = best.where(F.col("_way") != SEMANTIC).withColumn("place", F.col("pos"))
    return semantic_rerank(top).select(cols).unionByName(rest.select(cols))


def rerank(chunks: DataFrame, questions: DataFrame, keywords: dict[str, list[str]], k: int = 50) -> DataFrame:
    """Each question's way of ranking, whole: ``semantic`` (k best), ``keyword``, or plain cosine for anything else, which give every chunk its place."""
    kind = F.coalesce(F.lower("rerank_type"), F.lit(""))
    cols = [*PAIR, "chunk_id", "tokens", "place"]
    plain = score_chunks(chunks, questions.where(~kind.isin(SEMANTIC, KEYWORD)))  # without priorities: the order is that of cosine
    keyed = score_chunks(chunks, questions.where(kind == KEYWORD), keywords)
    whole = whole_order(plain.unionByName(keyed), by_keyword=True).select(cols)
    semantic = questions.where(kind == SEMANTIC)
    top = with_relevance(best_chunks(chunks, semantic, k=k), semantic, chunks)
    return whole.unionByName(semantic_rerank(top).select(cols))


def within_budget(placed: DataFrame, budget: int = 4000) -> DataFrame:
    """The longest prefix whose tokens stay within the budget: it stops at the first overflow and skips nothing."""
    over = W.partitionBy(*PAIR).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("running", F.sum("tokens").over(over)).where(F.col("running") <= budget)


def contexts(selected: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """One text per pair, its chunks in order after ``##`` and a blank line between; empty for a pair without any."""
    parts = selected.join(texts.select("chunk_id", "text"), "chunk_id").groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda p: F.concat(F.lit("##"), p["text"])), "\n\n")
    return pairs.join(parts.select(*PAIR, joined.alias("context"), F.size("_p").cast("long").alias("chunks")), PAIR, "left").fillna({"context": "", "chunks": 0})
