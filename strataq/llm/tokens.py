"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.session import cut

# Fixed value: the pattern that splits text before the merges of the rank files, as their README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class TokenizerSpec:
    """A rank file of a byte-level BPE. ``folder`` must be readable on every executor."""

    folder: str = "/opt/tokenizers"
    file: str = "byte_bpe_50k.tiktoken"
    pattern: str = PATTERN


@lru_cache(maxsize=4)
def encoder(spec: TokenizerSpec):
    """Loaded once per Python worker."""
    import tiktoken

    with open(os.path.join(spec.folder, spec.file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(spec.file, pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """Sources match apart from case and marks; a missing one is ``unknown``."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(key, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def token_sizes(documents: DataFrame, spec: TokenizerSpec = TokenizerSpec()) -> DataFrame:
    """(doc_id, source, tokens) per document, checkpointed: narrow rows, so that no later step reads a text again.

    Whole texts are encoded in Arrow batches. Null and empty texts have 0 tokens. A row that occurs twice counts once (of
    rows with one doc_id the longest); rows with a null id are left out. Other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(spec).encode_ordinary
        for pdf in batches:
            pdf["tokens"] = [len(encode(t)) if t else 0 for t in pdf["text"]]
            yield pdf[["doc_id", "source", "tokens"]]

    rows = documents.where("doc_id IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    sized = rows.mapInPandas(run, "doc_id bigint, source string, tokens bigint")
    one = sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("_r")).select("doc_id", "_r.source", "_r.tokens")
    return cut(one)
