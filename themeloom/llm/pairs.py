"""Items that appear together: a blocked Gram matrix of binary record-by-item blocks, normalised by the counts expected by chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


def gram_block(rows: np.ndarray, cols: np.ndarray, products: int = 4_000_000, across: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The upper triangle without diagonal of X'X, X being the binary matrix with ones at (rows, cols), as ``(i, j, count)`` parts, i < j.

    Entries must be sorted by row, then column, each once. The products are formed in slices of at most about `products`, so a record with very
    many items is split by its items and memory stays bounded; counts of equal (i, j) within a slice are summed. With `across`, 0 or 1 for each entry, a row that
    has both pairs only its zeros with its ones; zeros must stand first, with the smaller columns.
    """
    if not len(rows):
        return
    end = np.searchsorted(rows, rows, side="right")  # of the row each entry is in
    first = np.arange(len(rows)) + 1
    if across is not None:
        ones = np.cumsum(across)
        upto = np.concatenate([[0], ones])
        last, begin = end, np.searchsorted(rows, rows, side="left")
        zeros = (last - begin) - (upto[last] - upto[begin])
        both = (zeros > 0) & (upto[last] > upto[begin])
        first = np.where(both, begin + zeros, first)
        end = np.where(both & (across == 1), first, end)
    partners = np.maximum(end - first, 0)
    width = int(cols.max()) + 1
    total = np.cumsum(partners)
    start = 0
    while start < len(rows):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + products, side="right")))
        k = partners[start:stop]
        left = np.repeat(np.arange(start, stop), k)
        right = np.repeat(first[start:stop], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        keys, counts = np.unique(cols[left].astype(np.int64) * width + cols[right], return_counts=True)
        yield keys // width, keys % width, counts
        start = stop


def pair_counts(records: DataFrame, items: str, min_shared: int = 1, min_lift: float | None = None, block_entries: int = 400_000, long: int = 4096) -> DataFrame:
    """``(a, b, shared, m_a, m_b, n_records, lift)`` of the pairs a < b of different items that share at least `min_shared` records.

    `items` is an array of bigint; repeated and null items of a record count once and not at all, records without an item don't count. lift is shared *
    N / (m_a * m_b), how many times more often than chance; with `min_lift` pairs below it are left out. Two bounds follow from these limits and
    prune items exactly before pairs are formed: a pair shares no more records than its rarer item has, so items in fewer than `min_shared` records
    can't be in one, and shared * N >= lift * m_a * m_b needs max(m_a, m_b) <= N / lift. No item that is in a large part of all records is left then.

    Each task turns blocks of its records into binary sparse blocks and adds up their transpose-products; the partial sums are combined by pair. A record of
    more than `long` items is divided into blocks of `long` items, and every pair of its blocks goes to a task of its own, so no single record is one task's work.
    """
    from ..session import materialise

    given = materialise(records.select(F.array_distinct(F.filter(F.col(items).cast("array<bigint>"), lambda x: x.isNotNull())).alias("items")).where("size(items) > 0"))
    n = given.count()
    m = materialise(given.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("m")))
    kept = m.where((F.col("m") >= min_shared) & (F.lit(True) if min_lift is None else F.col("m") * F.lit(min_lift) <= F.lit(n)))
    numbered = given.select(F.monotonically_increasing_id().alias("rec"), "items")
    entries = numbered.select("rec", F.size("items").alias("n"), F.explode("items").alias("item")).join(kept.select("item"), "item")
    none = F.lit(0)
    short = entries.where(F.col("n") <= long).select("rec", none.alias("low"), none.alias("high"), none.alias("part"), "item")
    ranked = entries.where(F.col("n") > long).select("rec", "item", ((F.row_number().over(Window.partitionBy("rec").orderBy("item")) - 1) / long).cast("int").alias("block"), F.ceil(F.col("n") / long).cast("int").alias("blocks"))
    other = ranked.select("rec", "item", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    parted = other.select("rec", low.alias("low"), high.alias("high"), (F.col("block") > low).cast("int").alias("part"), "item")
    entries = short.unionByName(parted).withColumn("route", F.xxhash64("rec", "low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            recs, items_, parts = (np.concatenate(x) for x in zip(*held, strict=True))
            values, cols = np.unique(items_, return_inverse=True)
            order = np.lexsort((cols, recs))
            for i, j, count in gram_block(recs[order], cols[order], across=parts[order]):
                yield pa.RecordBatch.from_arrays([pa.array(values[i]), pa.array(values[j]), pa.array(count.astype(np.int64))], schema=_ARROW)

        rest: tuple[np.ndarray, ...] | None = None  # the last record of a full block goes on in the next batch
        for batch in batches:
            now = tuple(c.to_numpy() for c in batch.columns)
            if not batch.num_rows:
                continue
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            rest = tuple(x[cut:] for x in now)
            if cut:
                held.append(tuple(x[:cut] for x in now))
                size += cut
            if size >= block_entries:
                yield from block()
                held, size = [], 0
        if rest is not None:
            held.append(rest)
        if held:
            yield from block()

    blocks = entries.repartition("route").sortWithinPartitions("route").select("route", "item", "part").mapInArrow(run, "a bigint, b bigint, c bigint")
    shared = blocks.groupBy("a", "b").agg(F.sum("c").alias("shared")).where(F.col("shared") >= min_shared)
    of = lambda side: kept.select(F.col("item").alias(side), F.col("m").alias(f"m_{side}"))
    out = shared.join(of("a"), "a").join(of("b"), "b").withColumn("n_records", F.lit(n))
    if min_lift is not None:
        out = out.where(F.col("shared") * F.col("n_records") >= F.lit(min_lift) * F.col("m_a") * F.col("m_b"))
    return out.select("a", "b", "shared", "m_a", "m_b", "n_records", (F.col("shared") * F.col("n_records") / (F.col("m_a") * F.col("m_b"))).alias("lift"))
