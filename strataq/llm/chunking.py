"""Oversized texts cut into overlapping parts at natural boundaries (problem 2), by content-defined chunking.

A rolling hash over a window of tokens gives every place between two tokens a value that depends on the text around it
alone. The next landmark is the place of the least value within the allowed sizes, snapped to the nearest natural boundary;
so an edit moves only the cuts near it, and further on the same landmarks are found again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a longest run of characters other than space and line feed.
TOKEN = re.compile(r"[^ \n]+")
SPARK_TOKEN = r"([^ \n]+)"
ABBREVIATIONS = re.compile(r"(?i)^[\"'(\[]*(?:sec|art|ord|no|nos|e\.g|i\.e|sq|ft|st|ave|rd|dr|mr|mrs|ms|fig|ch|vol|cf|approx|dept|para|subd)\.$")


@dataclass(frozen=True)
class ChunkSpec:
    """limit: most tokens of a part, its overlap included. least, most: new tokens of a part. overlap: most shared tokens.

    window: tokens under the rolling hash. reach: how far a landmark may be moved to a natural boundary.
    """

    limit: int = 1000
    overlap: int = 200
    least: int = 350
    most: int = 800
    window: int = 12
    reach: int = 120

    def __post_init__(self) -> None:
        if not (0 < self.least <= self.most and self.most + self.overlap <= self.limit):
            raise ValueError("least <= most and most + overlap <= limit must hold")


def boundary_ranks(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place before token i: 4 before a paragraph, 3 a line, 2 a sentence, 1 a clause, 0 a word."""
    ranks = np.zeros(len(starts), dtype=np.int8)
    for i in range(1, len(starts)):
        gap, last = text[ends[i - 1] : starts[i]], text[ends[i - 1] - 1]
        before = text[max(ends[i - 1] - 24, starts[i - 1]) : ends[i - 1]].rstrip("\r")
        if gap.count("\n") > 1 or (last == "\r" and "\n" in gap and ends[i - 1] - starts[i - 1] == 1) or before.lower().endswith(("</p>", "<br>", "<br/>", "</li>", "</div>", "</tr>", "</h1>", "</h2>", "</h3>")):
            ranks[i] = 4
        elif "\n" in gap:
            ranks[i] = 3
        elif before.rstrip("\"')”’]")[-1:] in {".", "!", "?"} and not ABBREVIATIONS.match(before) and not text[starts[i]].islower():
            ranks[i] = 2
        elif before[-1:] in {";", ":", ",", "|", "\t"}:
            ranks[i] = 1
    return ranks


def landmark_values(tokens: list[str], window: int) -> np.ndarray:
    """The value of each place: a polynomial rolling hash of the tokens in the window around it, mixed to 64 bits."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))
    half = window // 2
    padded = np.concatenate([np.zeros(half, np.uint64), h, np.zeros(window - half, np.uint64)])
    value = np.zeros(len(tokens), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            value = value * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(tokens)]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
    return value


def cut_places(values: np.ndarray, ranks: np.ndarray, spec: ChunkSpec) -> list[int]:
    """Where new parts begin, as token indices; the first is 0. The last part may be shorter than ``least``."""
    n, at, cuts = len(values), 0, [0]
    first_limit = spec.limit  # the first part has no overlap before it
    while n - at > (first_limit if at == 0 else spec.most):
        low, high = at + spec.least, min(at + spec.most, n - 1)
        mark = low + int(np.argmin(values[low : high + 1]))
        near_low, near_high = max(low, mark - spec.reach), min(high, mark + spec.reach)
        place = mark
        for rank in (4, 3, 2, 1):
            found = np.flatnonzero(ranks[near_low : near_high + 1] >= rank) + near_low
            if rank == 4:  # a paragraph is worth half the reach only
                found = found[np.abs(found - mark) <= spec.reach // 2]
            if len(found):
                place = int(found[np.argmin(np.abs(found - mark))])
                break
        else:  # no boundary in reach: any within the sizes
            found = np.flatnonzero(ranks[low : high + 1] >= 1) + low
            if len(found):
                place = int(found[np.argmin(np.abs(found - mark))])
        cuts.append(place)
        at = place
    return cuts


def overlap_start(cut: int, previous: int, ranks: np.ndarray, overlap: int) -> int:
    """Where the part that begins at ``cut`` starts with its overlap: at the earliest boundary of the best kind in reach."""
    low = max(previous + 1, cut - overlap)
    if overlap <= 0 or low >= cut:
        return cut
    for rank in (2, 1, 0):
        found = np.flatnonzero(ranks[low:cut] >= rank)
        if len(found):
            return low + int(found[0])
    return cut


def split_text(text: str, spec: ChunkSpec = ChunkSpec()) -> list[tuple[int, int, int, int, str]]:
    """(part, tokens, shared, start, text) of each part, numbered from 1; one part 0 if the text fits. Empty for no tokens.

    ``shared`` is how many tokens of the part stand at the end of the part before; ``start`` is its first character.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return []
    if len(spans) <= spec.limit:
        return [(0, len(spans), 0, spans[0][0], text[spans[0][0] : spans[-1][1]])]
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    ranks = boundary_ranks(text, starts, ends)
    cuts = cut_places(landmark_values([text[a:b] for a, b in spans], spec.window), ranks, spec)
    out = []
    for k, cut in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else len(spans)
        begin = overlap_start(cut, cuts[k - 1], ranks, spec.overlap) if k else 0
        out.append((k + 1, end - begin, cut - begin, int(starts[begin]), text[starts[begin] : ends[end - 1]]))
    return out


def token_count(text: Column) -> Column:
    """Counted in the JVM: the pieces between runs of space and line feed, without the empty ones at the ends."""
    return F.size(F.regexp_extract_all(text, F.lit(SPARK_TOKEN), 1))


PARTS = "chunk_id bigint, part int, tokens int, shared int, start int, leaf_text string"


def split_oversized(leaves: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """The parts of every leaf whose text holds more than ``limit`` tokens; one row per part.

    Of several readings of a leaf the latest counts (ties: the greatest text). Leaves that fit, null and blank texts and null
    ids give no rows; the column ``tokens`` isn't trusted. Token counts are taken in the JVM, so only long texts are shuffled
    and only they go to Python; each is cut on its own, so no group gathers. Other columns are not looked at.
    """
    rows = leaves.where("chunk_id IS NOT NULL").select("chunk_id", "ingested_at", F.col("leaf_text").alias("_text"))
    long = F.when((F.length("_text") > 2 * spec.limit) & (token_count(F.col("_text")) > spec.limit), F.col("_text"))
    rows = rows.select("chunk_id", "ingested_at", F.xxhash64("_text").alias("_h"), long.alias("_text"))
    newest = rows.groupBy("chunk_id").agg(F.max(F.struct("ingested_at", "_h", "_text")).alias("_r"))
    newest = newest.select("chunk_id", F.col("_r._text").alias("_text")).where("_text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *p) for i, t in zip(pdf["chunk_id"], pdf["_text"], strict=True) for p in split_text(t, spec)]
            yield pd.DataFrame(rows, columns=["chunk_id", "part", "tokens", "shared", "start", "leaf_text"])

    return newest.mapInPandas(run, PARTS)
