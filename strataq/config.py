"""Settings of a run, and the operators with those settings applied."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from strataq.operators import pairs, retrieve, tree


@dataclass(frozen=True)
class EngineConfig:
    """Token counts are in units of the tokenizer that counts them."""

    max_context_tokens: int = 4000
    max_batch_tokens: int = 250_000_000
    max_batch_requests: int = 50_000
    nodes: int = 1
    sample_size: int | None = None
    seed: str = "42"
    model: str = "offline"
    chunk_tokens: int = 1000
    chunk_overlap: int = 200
    merge_below_chars: int = 200
    top_k: int = 50
    retention_days: int = 7

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConfig:
        """Settings named strataq.<name> of the session, defaults for the others; an empty or ``all`` sample size is none."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"strataq.{f.name}", None)
            if value is not None:
                found[f.name] = value if f.name in ("seed", "model") else None if value in ("", "all") else int(value)
        return cls(**found)

    def rank(self, chunks: DataFrame, questions: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
        best = retrieve.rerank_best(chunks, questions, keywords, self.top_k, self.max_context_tokens)
        return retrieve.within_budget(best, self.max_context_tokens)

    def select(self, sample: DataFrame, embedded: DataFrame) -> DataFrame:
        return pairs.select_municipalities(sample, embedded, self.sample_size, self.nodes, self.seed)

    def pack(self, queue: DataFrame, order: str, tokens: str) -> DataFrame:
        """Each node takes its part of both caps."""
        return pairs.pack_batch(queue, order, tokens, self.max_batch_tokens // self.nodes, self.max_batch_requests // self.nodes)

    def merge(self, sections: DataFrame, reference: bool = False) -> DataFrame:
        return tree.merge_tree(sections, self.merge_below_chars, reference)

    def split(self, leaves: DataFrame) -> DataFrame:
        return tree.split_recursively(leaves, self.chunk_tokens, self.chunk_overlap)

    def expired(self, rows: DataFrame, at: str, now: str) -> DataFrame:
        return pairs.expired(rows, at, now, self.retention_days)
