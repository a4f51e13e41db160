"""Whole documents packed into containers of fixed capacity (problem 5).

Deficit round-robin over one queue per source fills every window to the target token proportions. Documents are spread over
buckets of bounded size by a hash, so no source or copy can make a bucket large; what earlier buckets gave each source beyond
or below its target is carried into a bucket as its first deficit.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.operators.prefix import prefix_sums

ITEMS = "spec_name string, capacity bigint, container_id string, position int, doc_id bigint, source string, piece int, token_start bigint, tokens bigint"


#: How much of its quantum a source is paid at most, in one window, of what it is owed from others.
PAID = 0.1
#: Items above so much of their source's quantum are large.
LARGE = 1.0
#: Large items are drawn so much faster than their share.
AHEAD = 1.25


class Queue:
    """A source's items by size, and in the order in which they are drawn: large ones apart, as they come at a pace of their own."""

    def __init__(self, large: float) -> None:
        self.large = large
        self.drawn: dict[bool, list[tuple[int, int]]] = {True: [], False: []}
        self.place = {True: 0, False: 0}
        self.at: dict[int, list[int]] = {}
        self.left: dict[int, int] = {}
        self.sizes: list[int] = []
        self.taken: set[int] = set()
        self.tokens = {True: 0, False: 0}

    def add(self, size: int, item: int) -> None:
        self.drawn[size > self.large].append((size, item))
        self.tokens[size > self.large] += size
        self.at.setdefault(size, []).append(item)
        self.left[size] = self.left.get(size, 0) + 1

    def ready(self) -> None:
        self.sizes = sorted(self.at)

    def part(self) -> float:
        """The large items' part of the tokens that are left, and somewhat more, so that small ones are left to fill the last windows."""
        return min(1.0, AHEAD * self.tokens[True] / max(1, self.tokens[True] + self.tokens[False]))

    def head(self, large: bool) -> tuple[int, int]:
        """The next item to be drawn, as (size, item); (0, -1) if there is none."""
        order, k = self.drawn[large], self.place[large]
        while k < len(order) and order[k][1] in self.taken:
            k += 1
        self.place[large] = k
        return order[k] if k < len(order) else (0, -1)

    def fitting(self, room: float) -> int:
        """The largest size of at most ``room``, 0 if there is none."""
        k = bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int, item: int | None = None) -> int:
        """One item of a size, the given one if it is named."""
        items = self.at[size]
        while item is None:
            last = items.pop()
            item = None if last in self.taken else last
        self.taken.add(item)
        self.tokens[size > self.large] -= size
        self.left[size] -= 1
        if not self.left[size]:
            del self.at[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return item


#: Windows that hold so many items on average follow the proportions one by one; fewer can't, and are filled largest first.
MANY = 16


def fill_windows(sizes: list[int], sources: list[str], capacity: int, shares: dict[str, float], carried: dict[str, float]) -> list[list[int]]:
    """Windows of item numbers. Each item is at most ``capacity`` and comes once.

    Each window pays every source its quantum; whatever a source gets beyond its deficit it owes to later windows.
    """
    queues: dict[str, Queue] = {}
    for i, (size, source) in enumerate(zip(sizes, sources, strict=True)):
        if source not in queues:
            queues[source] = Queue(shares.get(source, 0.0) * capacity * LARGE)
        queues[source].add(size, i)
    for q in queues.values():
        q.ready()
    owed = {s: carried.get(s, 0.0) for s in queues}
    quantum = {s: shares.get(s, 0.0) * capacity for s in queues}
    fill = by_quota if sum(sizes) * MANY <= capacity * len(sizes) else largest_first
    return fill(queues, len(sizes), capacity, quantum, owed)


def largest_first(queues: dict[str, Queue], left: int, capacity: int, quantum: dict[str, float], deficit: dict[str, float]) -> list[list[int]]:
    """The source with the greatest deficit that has an item that fits gives its largest.

    Where the room left is filled exactly, or better than by half, by an item of another source, that one is taken.
    """
    windows = []
    while left:
        for s in queues:
            deficit[s] += quantum[s]
        room, window = capacity, []
        while room and left:
            offers = [(deficit[s], q.fitting(room), s) for s, q in queues.items()]
            offers = [o for o in offers if o[1]]
            if not offers:
                break
            _, size, source = max(offers)
            best = max(offers, key=lambda o: (o[1], o[0]))
            if best[1] > size and 2 * best[1] > room and (room - best[1]) * 2 < room - size:
                _, size, source = best
            chosen = [(size, source)]
            if window and room > size and room <= capacity // 2:  # a pair of smaller items may fill the room exactly
                chosen = exact_pair(queues, room, deficit) or chosen
            for size, source in chosen:
                window.append(queues[source].take(size))
                deficit[source] -= size
                room -= size
                left -= 1
        windows.append(window)
    return windows


def by_quota(queues: dict[str, Queue], left: int, capacity: int, quantum: dict[str, float], owed: dict[str, float]) -> list[list[int]]:
    """Every source fills its quota of each window, its quantum and a part of what earlier windows owe it.

    First come large items (above a quantum), as soon as their part of what is owed has grown to half of them, in hash order. Then
    the source with the greatest deficit gives, again and again: the small item whose turn it is if its deficit covers it, else the
    largest small one that it covers. What room is left when no deficit covers anything is closed with the item, or pair of items,
    that fills it exactly, else with the largest that fits.
    """
    large = {s: owed[s] * q.part() for s, q in queues.items()}
    windows = []
    while left:
        # What earlier buckets owe is paid at once. Of what is owed later a window pays a part of the quantum, so that debts of many
        # windows cancel out before they are paid.
        paid = {s: PAID * quantum[s] if windows else abs(owed[s]) for s in queues}
        deficit = {s: quantum[s] + min(paid[s], max(-paid[s], owed[s])) for s in queues}
        for s in queues:
            owed[s] += quantum[s]
            large[s] += quantum[s] * queues[s].part()
        room, window = capacity, []

        def give(s: str, size: int, item: int | None = None) -> None:
            nonlocal room, left
            window.append(queues[s].take(size, item))  # noqa: B023
            deficit[s] -= size
            owed[s] -= size
            if size > queues[s].large:
                large[s] -= size
            room -= size
            left -= 1

        for s in sorted(queues, key=lambda s: (-large[s], s)):
            size, item = queues[s].head(True)
            while item >= 0 and size <= room and size <= 2 * large[s]:
                give(s, size, item)
                size, item = queues[s].head(True)
        served: set[str] = set()
        while room and left:
            live = [s for s, q in queues.items() if q.sizes and q.sizes[0] <= room]
            if not live:
                break
            owing = [s for s in live if s not in served]
            if owing:
                s = max(owing, key=lambda s: (deficit[s], s))
                q = queues[s]
                size, item = q.head(False)
                covered = q.fitting(min(room, deficit[s], q.large)) if deficit[s] > 0 else 0
                if item >= 0 and size <= min(room, deficit[s]) and room not in q.at:
                    give(s, size, item)
                elif covered:
                    give(s, covered)
                else:
                    served.add(s)
            elif any(room in queues[o].at for o in live):
                give(max((o for o in live if room in queues[o].at), key=lambda o: (owed[o], o)), room)
            elif pair := exact_pair(queues, room, owed):
                for size, o in pair:
                    give(o, size)
            else:
                o = max(live, key=lambda o: (queues[o].fitting(room), owed[o], o))
                give(o, queues[o].fitting(room))
        windows.append(window)
    return windows


def exact_pair(queues: dict[str, Queue], room: int, deficit: dict[str, float], tries: int = 12) -> list[tuple[int, str]] | None:
    """Two items that fill the room exactly, among the ``tries`` largest sizes of each queue that fit; None if there are none.

    Sources with greater deficits come first, for the second item after the first has been paid.
    """
    order = sorted(queues, key=lambda s: -deficit[s])
    for s in order:
        q = queues[s]
        k = bisect_right(q.sizes, room)
        for size in reversed(q.sizes[max(0, k - tries) : k]):
            need = room - size
            fits = [o for o in order if need in queues[o].at and (need != size or o != s or queues[o].left[need] > 1)]
            if fits:
                return [(size, s), (need, max(fits, key=lambda o: deficit[o] - (size if o == s else 0)))]
    return None


def pack_documents(sizes: DataFrame, specs: list[tuple[str, int]], shares: dict[str, float] | None = None, bucket_tokens: int = 4_000_000, seed: int = 42) -> DataFrame:
    """One row per piece and spec: its container, its place in it, and the token range of its document.

    ``sizes`` is (doc_id, source, tokens), best checkpointed. A document comes whole, but for one above the capacity: it is cut
    into full pieces, each of which fills a container, and a rest, which is packed like a document. Documents without tokens
    need no room and give no rows, nor do null ids. Other columns are not looked at. ``shares`` are the target proportions; by default those of the corpus, as every document
    has to be placed. No table is broadcast, and buckets hold about ``bucket_tokens`` each, whatever the corpus.
    """
    if any(c < 1 for _, c in specs):
        raise ValueError("capacities must be positive")
    sizes = sizes.where("tokens > 0 AND doc_id IS NOT NULL").select("doc_id", "source", "tokens")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_tokens))
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).cast("long").alias("capacity")) for n, c in specs]))
    each = sizes.withColumn("_s", spec).select("doc_id", "source", "tokens", "_s.spec_name", "_s.capacity")
    each = each.withColumn("_full", (F.col("tokens") / F.col("capacity")).cast("long"))
    each = each.withColumn("_full", F.when(F.col("tokens") > F.col("capacity"), F.col("_full")).otherwise(0))
    each = each.withColumn("_rest", F.col("tokens") - F.col("_full") * F.col("capacity")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_buckets)))

    full = each.where("_full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_full").cast("int") - 1)))
    full = full.select(
        "spec_name", "capacity", F.concat_ws(":", F.lit("full"), "doc_id", "piece").alias("container_id"), F.lit(0).alias("position"), "doc_id", "source", "piece",
        (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"),
    )

    by = each.groupBy("spec_name", "capacity", "source", "bucket").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("_full") * F.col("capacity")).alias("placed"))
    before = prefix_sums(by, ["spec_name", "capacity", "source"], "bucket", "tokens")
    if shares is None:
        target = sizes.groupBy("source").agg((F.sum("tokens") / F.lit(max(1, total))).alias("share"))
    else:
        target = sizes.sparkSession.createDataFrame(sorted(shares.items()), "source string, share double")
    before = before.join(target, "source", "left").fillna({"share": 0.0})
    before = before.toDF(*[f"c_{c}" for c in before.columns])  # names of its own, as both sides stem from one table
    items = each.where("_rest > 0").select("spec_name", "capacity", "bucket", "doc_id", "source", F.col("_rest").alias("tokens"), F.col("_full").cast("int").alias("piece"), (F.col("_full") * F.col("capacity")).alias("token_start"))

    def run(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        names = ["spec_name", "capacity", "container_id", "position", "doc_id", "source", "piece", "token_start", "tokens"]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        # Hash order: what is drawn next has nothing to do with its size.
        pdf = pdf.assign(_turn=[xxhash.xxh64_intdigest(int(i).to_bytes(8, "big", signed=True), seed) for i in pdf["doc_id"]]).sort_values(["_turn", "doc_id"], ignore_index=True)
        capacity, bucket = int(pdf["capacity"][0]), int(pdf["bucket"][0])
        seen = float(carry["c_before"].sum() + carry["c_placed"].sum())
        share = dict(zip(carry["c_source"], carry["c_share"], strict=True))
        owed = {r.c_source: r.c_share * seen - r.c_before - r.c_placed for r in carry.itertuples()}
        windows = fill_windows(pdf["tokens"].tolist(), pdf["source"].tolist(), capacity, share, owed)
        order = np.array([i for w in windows for i in w])
        out = pdf.iloc[order].copy()
        out["container_id"] = [f"{bucket}:{k}" for k, w in enumerate(windows) for _ in w]
        out["position"] = [p for w in windows for p in range(len(w))]
        return out[names]

    keys = ["spec_name", "bucket"]
    packed = items.groupBy(*keys).cogroup(before.groupBy(*[f"c_{k}" for k in keys])).applyInPandas(run, ITEMS)
    return packed.unionByName(full)


def container_fill(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the share of room unused, how many documents were cut, and how far windows are from the proportions.

    The distance of a window is half the sum of differences between its sources' shares and those of all tokens of its spec (0:
    alike, 1: nothing in common); its mean and 90th percentile are over windows, without the full pieces of documents that were cut.
    """
    boxes = packed.groupBy("spec_name", "capacity", "container_id").agg(F.sum("tokens").alias("tokens"))
    fill = boxes.groupBy("spec_name", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    cut_up = packed.where("piece > 0").groupBy("spec_name").agg(F.countDistinct("doc_id").alias("documents_cut"))
    share = packed.groupBy("spec_name", "source").agg(F.sum("tokens").alias("_t"))
    share = share.withColumn("target", F.col("_t") / F.sum("_t").over(W.partitionBy("spec_name"))).drop("_t")  # a row per source
    own = packed.where(~F.col("container_id").startswith("full:")).groupBy("spec_name", "container_id", "source").agg(F.sum("tokens").alias("_t"))
    own = own.withColumn("_own", F.col("_t") / F.sum("_t").over(W.partitionBy("spec_name", "container_id"))).join(share, ["spec_name", "source"])
    apart = own.groupBy("spec_name", "container_id").agg(((F.sum(F.abs(F.col("_own") - F.col("target"))) + 1 - F.sum("target")) / 2).alias("_d"))
    apart = apart.groupBy("spec_name").agg(F.round(F.avg("_d"), 4).alias("distance"), F.round(F.percentile_approx("_d", 0.9, 10_000), 4).alias("distance_90"))
    fill = fill.join(apart, "spec_name", "left")
    out = fill.join(cut_up, "spec_name", "left").withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    return out.select("spec_name", "capacity", "containers", "tokens", "fullest", "unused", F.coalesce("documents_cut", F.lit(0)).alias("documents_cut"), "distance", "distance_90")
