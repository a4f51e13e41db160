"""What may be replaced: embedder, reranker, completer and tokenizer, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import token_len


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, request: dict) -> dict: ...


class Reranker(Protocol):
    def relevance(self, pairs: list[tuple[str | None, str | None]]) -> list[float]:
        """How relevant each text is to its query, in (query, text) order."""
        ...


class Tokenizer(Protocol):
    def count(self, texts: list[str]) -> list[int]: ...


class LexicalReranker:
    """The share of a query's distinct words that a text holds, case aside."""

    def relevance(self, pairs: list[tuple[str | None, str | None]]) -> list[float]:
        words = lambda t: {w for w in re.split("[ \n]", (t or "").lower()) if w}
        return [len(q & words(t)) / len(q) if (q := words(a)) else 0.0 for a, t in pairs]


def count_tokens(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    """Tokens of a text, 0 for null: runs of other characters than space and line feed, counted in the JVM, or what a Tokenizer counts, in Arrow batches."""
    if tokenizer is None:
        return token_len(text)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer.count([t or "" for t in texts]), dtype="int64")

    return count(text)


class HashingEmbedder:
    """Unit vectors of signed feature hashes of a text's words; a text without words has a zero vector."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for w in re.findall(r"[^ \n]+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.width] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class EchoCompleter:
    """Answers by a hash of the request: YES, NO or don't know for free text; tool calls get arguments."""

    def complete(self, request: dict) -> dict:
        body = request["body"]
        h = int(hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest(), 16)
        value = ["YES", "NO", "I DON'T KNOW"][h % 3]
        if body.get("tools"):
            args = json.dumps({"Dont_Know": value == "I DON'T KNOW", "Answer": None if value == "I DON'T KNOW" else value.title()})
            message = {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "answer", "arguments": args}}]}
        else:
            message = {"role": "assistant", "content": f"The sections were read.\n\nANSWER: {value}"}
        usage = {"prompt_tokens": sum(len((m.get("content") or "").split()) for m in body["messages"]), "completion_tokens": 5}
        return {"custom_id": request["custom_id"], "response": {"status_code": 200, "body": {"model": body.get("model"), "choices": [{"index": 0, "message": message, "finish_reason": "stop"}], "usage": usage}}, "error": None}


def embed_texts(rows: DataFrame, key: str, text: str, embedder: Embedder | None = None) -> DataFrame:
    """(key, vec); one call per Arrow batch."""
    embedder = embedder or HashingEmbedder()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vec": embedder.embed([t or "" for t in pdf[text]])})

    return rows.select(*dict.fromkeys([key, text])).mapInPandas(run, f"`{key}` {kind}, vec array<double>")


def complete_requests(requests: DataFrame, completer: Completer | None = None, column: str = "request") -> DataFrame:
    """(request JSON) to (response JSON, error): what a completer raises becomes the error of its row alone."""
    call: Callable[[dict], dict] = (completer or EchoCompleter()).complete

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps(call(json.loads(text or ""))), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(t) for t in pdf[column]], columns=["response", "error"])

    return requests.select(column).mapInPandas(run, "response string, error string")
