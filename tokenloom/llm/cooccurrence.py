"""Problem 3: items that appear together in the same record."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.dense import dense_number
from tokenloom.session import materialize

#: Items of a record that one row of pair work pairs with each other or with as many others.
SLICE = 1024
#: Pair codes in one sorted run of a map task.
RUN = 2_000_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed codes (low id << 32 | high id) as sorted run-length-coded runs: of all pairs
    in items, or where others is not null of each in items with each in others."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])

    def parts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        lists, others = batch.column("items"), batch.column("others")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))])
        lengths = np.diff(offsets)
        single = np.asarray(others.is_null())
        # records of equal length make one rectangular numpy step
        for length in np.unique(lengths[single]):
            if length < 2:
                continue
            rows = np.flatnonzero(single & (lengths == length))
            step = max(1, RUN // int(length * (length - 1) // 2))
            left, right = np.triu_indices(int(length), 1)
            for at in range(0, len(rows), step):
                block = flat[offsets[rows[at : at + step], None] + np.arange(length)]
                block.sort(axis=1)
                yield ((block[:, left] << 32) | block[:, right]).ravel()
        for row in np.flatnonzero(~single):
            a = flat[offsets[row] : offsets[row + 1], None]
            b = others[int(row)].values.to_numpy().astype(np.int64)[None, :]
            yield ((np.minimum(a, b) << 32) | np.maximum(a, b)).ravel()

    for batch in batches:
        for codes in parts(batch):
            held.append(codes)
            size += len(codes)
            if size >= RUN:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _chunked(rows: DataFrame, keys: list[str], slice_size: int) -> DataFrame:
    """items, others: the records of more than slice_size items, cut into chunks of about
    slice_size; each chunk once alone and once with every other chunk of its record. No
    row holds more than two chunks, whatever the record."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_size)
    chunks = (
        rows.join(sizes, keys)
        .withColumn("_k", F.ceil(F.col("_n") / slice_size).cast("int"))
        .withColumn("_c", F.pmod(F.xxhash64("item_id"), F.col("_k")).cast("int"))
        .groupBy(*keys, "_k", "_c")
        .agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    met = chunks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        *keys, F.least("_c", "_o").alias("_low"), F.greatest("_c", "_o").alias("_high"), "items"
    )
    return met.groupBy(*keys, "_low", "_high").agg(F.collect_list("items").alias("_met")).where((F.size("_met") > 1) | (F.col("_low") == F.col("_high"))).select(
        F.col("_met")[0].alias("items"), F.try_element_at("_met", F.lit(2)).alias("others")
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sum over a stream of (code, n) sorted by code."""
    last_code, last_n = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, n = codes[starts], np.add.reduceat(n, starts)
        if last_code is not None:
            if codes[0] == last_code:
                n[0] += last_n
            else:
                codes, n = np.concatenate([[last_code], codes]), np.concatenate([[last_n], n])
        last_code, last_n = codes[-1], n[-1]
        if len(codes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(n[:-1])], ["code", "n"])
    if last_code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last_code], pa.int64()), pa.array([last_n], pa.int64())], ["code", "n"])


def pair_counts(
    rows: DataFrame,
    keys: list[str],
    item: str,
    *,
    min_count: int = 1,
    min_lift: float = 0.0,
    slice_size: int = SLICE,
) -> DataFrame:
    """How often each pair of items stands in the same record, against chance.

    Method: external sort of packed 64-bit pair codes. Items get dense ids in code-point
    order; each map task writes sorted, run-length-coded runs of codes; the exchange's
    external sorter spills and merges the runs; equal codes are summed in one streaming
    pass. The odds ratio has 0.5 added to each of the four cells.

    keys name the record, item the value; an item counts once per record, so repeated
    rows change nothing. Rows with a null key or item are left out. Columns: item_a <
    item_b (code points), n_ab, n_a, n_b, n_records, lift = n_ab*N/(n_a*n_b), odds_ratio.

    min_count and min_lift select results, and exactly those items are left out before
    pairing that no selected pair can hold: n_ab <= min(n_a, n_b), so an item with fewer
    than min_count records, or with n_a*min_lift > N, is in none. Results are whole.

    Skew: a record is gathered as distinct item ids, and only if it has at most
    slice_size of them; a larger one is cut into chunks that are paired chunk with chunk
    by as many tasks as there are such pairs. An empty table gives an empty result."""
    name = "_item"
    clean = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, rows).where(F.col(item).isNotNull())
    held = materialize(clean.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(item).alias(name)).distinct(), "pairs-rows")
    ks = [f"_k{i}" for i in range(len(keys))]
    each = held.groupBy(*ks).agg(F.count("*").alias("_n")).agg(F.count("*").alias("records"), F.max("_n").alias("largest")).first()
    n_records, largest = each["records"], each["largest"] or 0
    counts = held.groupBy(name).agg(F.count("*").alias("n_item"))
    counts = counts.where((F.col("n_item") >= min_count) & (F.col("n_item") * min_lift <= F.lit(n_records)))
    terms = materialize(dense_number(counts, [name], "item_id", label="pairs-order"), "pairs-items")
    sized = held.join(terms.select(name, "item_id"), name).drop(name)
    records = sized.groupBy(*ks).agg(F.collect_list("item_id").alias("items")).where(F.size("items") > 1)
    if largest > slice_size:
        large = sized.groupBy(*ks).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_size).select(*ks)
        records = sized.join(large, ks, "left_anti").groupBy(*ks).agg(F.collect_list("item_id").alias("items")).where(F.size("items") > 1)
    work = records.select("items", F.lit(None).cast("array<bigint>").alias("others"))
    if largest > slice_size:
        work = work.unionByName(_chunked(sized, ks, slice_size))
    runs = work.mapInArrow(_runs, "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code bigint, n bigint")
    pairs = merged.where(F.col("n") >= min_count).select(
        F.shiftright("code", 32).alias("id_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("id_b"), F.col("n").alias("n_ab")
    )
    a = terms.select(F.col("item_id").alias("id_a"), F.col(name).alias("item_a"), F.col("n_item").alias("n_a"))
    b = terms.select(F.col("item_id").alias("id_b"), F.col(name).alias("item_b"), F.col("n_item").alias("n_b"))
    n = F.lit(n_records)
    joined = pairs.join(a, "id_a").join(b, "id_b").where(F.col("n_ab") * n >= F.col("n_a") * F.col("n_b") * F.lit(min_lift))
    half = F.lit(0.5)
    return joined.select(
        "item_a",
        "item_b",
        "n_ab",
        "n_a",
        "n_b",
        n.cast("bigint").alias("n_records"),
        (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        (
            (F.col("n_ab") + half)
            * (n - F.col("n_a") - F.col("n_b") + F.col("n_ab") + half)
            / ((F.col("n_a") - F.col("n_ab") + half) * (F.col("n_b") - F.col("n_ab") + half))
        ).alias("odds_ratio"),
    )


def sentence_pairs(corpus: DataFrame, *, lang: str = "en", min_count: int = 5, min_lift: float = 10.0) -> DataFrame:
    """pair_counts over the sentences (filename, sent_id) of one language: lower-cased
    tokens with at least one of a-z, sentences with sent_id > 0.

    N counts all such sentences, also those without any usable token."""
    rows = corpus.where((F.col("lang") == lang) & (F.col("sent_id") > 0) & F.col("filename").isNotNull())
    usable = F.when(F.col("_token_low").rlike("[a-z]"), F.col("_token_low"))
    # a record without a usable token still counts in N: it keeps one empty item, which is dropped by its own count
    return pair_counts(rows.select("filename", "sent_id", F.coalesce(usable, F.lit("")).alias("item")), ["filename", "sent_id"], "item", min_count=min_count, min_lift=min_lift).where(
        (F.col("item_a") != "") & (F.col("item_b") != "")
    )
