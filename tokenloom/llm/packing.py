"""Problem 7: filling fixed-capacity containers with texts."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.splitting import hard_pieces
from tokenloom.llm.tokens import n_tokens, ship_vocabulary
from tokenloom.session import materialize, spread

#: Items that are packed together; containers never mix two such groups.
GROUP = 2048
#: How full a window must be to stay as it is when others are repaired, in turn.
KEEP = (1.0, 0.99, 0.97, 0.95, 0.9)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: items into k windows of near-equal sums.

    A partial partition is an ascending list of (sum, number, tree of items), its empty
    windows left out. The two partitions with the largest spread are merged again and
    again, large windows of one with small windows of the other."""
    fresh = iter(range(len(sizes), 1 << 62))
    heap = [(-s, i, [(s, i, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:
            for window in b:
                insort(a, window)
        elif len(b) == 1:
            low = a.pop(0)
            insort(a, (low[0] + b[0][0], low[1], (low[2], b[0][2])))
        else:
            # the largest windows of b take the empty windows, the others meet the smallest of a
            merged = b[len(b) - free :] if free else []
            rest = b[: len(b) - free]
            for (s, i, tree), (t, _, other) in zip(a[: len(rest)], reversed(rest)):
                merged.append((s + t, i, (tree, other)))
            a = sorted(merged + a[len(rest) :])
        spread = a[-1][0] - (a[0][0] if len(a) == k else 0)
        heapq.heappush(heap, (-spread, next(fresh), a))
    windows = []
    for _, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            for part in node:
                if isinstance(part, tuple):
                    stack.append(part)
                else:
                    items.append(part)
        windows.append(items)
    return windows


def best_fit(items: list[int], sizes: list[int], capacity: int, k: int) -> list[list[int]] | None:
    """Items, largest first, each into the fullest of k windows that has room for it; None
    if one fits nowhere."""
    rooms, windows = [(capacity, w) for w in range(k)], [[] for _ in range(k)]
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            return None
        room, w = rooms.pop(at)
        windows[w].append(i)
        insort(rooms, (room - sizes[i], w))
    return windows


def repair(windows: list[list[int]], sizes: list[int], capacity: int, k: int) -> list[list[int]] | None:
    """At most k windows within the capacity, or None. Windows that exceed it are taken
    apart, with them, if need be, the less well filled ones, and their items are spread
    over the free windows by best fit; the others stay as they are."""
    used = [sum(sizes[i] for i in w) for w in windows]
    if max(used, default=0) <= capacity:
        return windows
    for filled in KEEP:
        kept = [w for w, u in zip(windows, used) if filled * capacity <= u <= capacity]
        loose = [i for w, u in zip(windows, used) if not filled * capacity <= u <= capacity for i in w]
        if (placed := best_fit(loose, sizes, capacity, k - len(kept))) is not None:
            return kept + placed
    return None


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity; their number rises while the windows of differencing
    exceed it and repair does not help. An item above the capacity stands alone."""
    alone = [[i] for i, s in enumerate(sizes) if s > capacity]
    if alone:
        rest = [i for i, s in enumerate(sizes) if s <= capacity]
        return [*([rest[i] for i in w] for w in pack([sizes[i] for i in rest], capacity)), *alone]
    if not sizes:
        return []

    def fits(k: int) -> list[list[int]] | None:
        windows = repair(difference(sizes, k), sizes, capacity, k)
        return windows and [w for w in windows if w]

    low = max(1, -(-sum(sizes) // capacity)) - 1
    step, k = 1, low + 1
    while (best := fits(k)) is None:
        low, k, step = k, min(len(sizes), k + step), step * 2
    high = k
    while high - low > 1:
        middle = (low + high) // 2
        if (found := fits(middle)) is None:
            low = middle
        else:
            best, high = found, middle
    return best


def pack_documents(
    documents: DataFrame,
    size_limits: DataFrame,
    *,
    vocabulary: str,
    group: int = GROUP,
) -> DataFrame:
    """Group texts into containers of the capacities of size_limits (purpose 'pack').

    Method: Karmarkar-Karp multiway differencing inside even groups of about `group`
    items, chosen by a hash of the item, so that no task holds more; a group's window
    count starts at its total size over the capacity; the items of windows that exceed
    it are spread anew by best fit, and the count rises where that does not help. Against one
    packing of all items each group loses at least the unfilled share of its last window.

    vocabulary: rank file of the public tokenizer, readable on the driver; it is shipped
    to the executors.

    Columns: limit_name, capacity, container (string, unique), doc_id, piece (0 for a
    whole text), n_tokens. A text above the capacity, and only such, is divided into
    pieces of at most capacity. Null texts and null ids are left out; an empty text has
    size 0 and is placed. Repeated (doc_id, text) rows are each placed once per row.
    Limits with null or non-positive max_tokens are ignored; empty tables give an empty
    result."""
    limits = [
        (r["limit_name"], r["max_tokens"])
        for r in size_limits.where((F.col("purpose") == "pack") & (F.col("max_tokens") > 0)).select("limit_name", "max_tokens").distinct().collect()
    ]
    schema = "limit_name string, capacity int, container string, doc_id bigint, piece int, n_tokens bigint"
    spark = documents.sparkSession
    ship_vocabulary(spark, vocabulary)
    if not limits:
        return spark.createDataFrame([], schema)
    smallest = min(c for _, c in limits)
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # the text is kept only where some capacity may be exceeded
    sized = materialize(
        spread(texts.select("doc_id", "text")).select("doc_id", n_tokens(F.col("text"), vocabulary).alias("n_tokens"), "text").withColumn(
            "text", F.when(F.col("n_tokens") > smallest, F.col("text"))
        ),
        "pack-sizes",
    )
    parts = []
    for name, capacity in limits:
        whole = sized.where(F.col("n_tokens") <= capacity).select("doc_id", F.lit(0).alias("piece"), "n_tokens")
        cut = hard_pieces(sized.where(F.col("n_tokens") > capacity), capacity, vocabulary)
        parts.append(whole.unionByName(cut).select(F.lit(name).alias("limit_name"), F.lit(capacity).alias("capacity"), "*"))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = materialize(items, "pack-items")
    n_items = items.count()
    n_groups = max(1, -(-n_items // (group * len(limits))))
    numbered = items.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        windows = pack(pdf["n_tokens"].astype(int).tolist(), int(pdf["capacity"].iloc[0]))
        place = [""] * len(pdf)
        for w, members in enumerate(windows):
            label = f"{pdf['limit_name'].iloc[0]}-{int(pdf['_group'].iloc[0])}-{w}"
            for i in members:
                place[i] = label
        return pdf.assign(container=place)[["limit_name", "capacity", "container", "doc_id", "piece", "n_tokens"]]

    return numbered.groupBy("limit_name", "_group").applyInPandas(one, schema)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per limit: containers, items, tokens, share of the room that is used, fullest container."""
    each = packed.groupBy("limit_name", "capacity", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.groupBy("limit_name", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.first("capacity")), 6).alias("fill"),
    )
