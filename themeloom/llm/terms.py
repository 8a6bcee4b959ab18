"""Frequency of every distinct term or n-gram: suffix-sorted counting.

Each position of a record gives its suffix, truncated to `longest` terms. All prefixes of a suffix are n-grams that start there, so
counting suffixes and adding them up along common prefixes counts every n-gram while only one row per position is ever shuffled. Suffixes are routed
by their first term, sorted in reverse lexicographic order and aggregated with a stack that holds the prefixes of the current suffix.

Records are told apart without carrying their sets: within a record, suffixes are sorted, and a prefix that a suffix shares with the
one before it has been counted for this record already. The length of that shared prefix travels with the suffix (`seen`), prefixes beyond it
count the record once. Equal (suffix, seen) rows are therefore combined before the shuffle, and a term that is in every record is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _suffixes(given: DataFrame, longest: int) -> DataFrame:
    """``(suffix, seen, n)``, equal rows combined."""
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size("terms"), F.lit(1))), lambda i: F.slice("terms", i, F.lit(longest)))
    ordered = given.select(F.array_sort(tails).alias("tails"))
    before = F.when(F.col("i") > 0, F.element_at("tails", F.col("i"))).otherwise(F.slice("suffix", 1, 0))
    # the shared prefix: the number of leading positions at which both are equal
    shared = F.aggregate(F.zip_with("suffix", "before", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, e: F.struct((a["n"] + (a["on"] & e).cast("int")).alias("n"), (a["on"] & e).alias("on")), lambda a: a["n"])
    exploded = ordered.select("tails", F.posexplode("tails").alias("i", "suffix")).select("suffix", before.alias("before"))
    return exploded.select("suffix", shared.alias("seen")).groupBy("suffix", "seen").agg(F.count(F.lit(1)).alias("n"))


def prefix_counts(rows: Iterable[tuple[Sequence, int, int]]) -> Iterator[tuple[tuple, int, int]]:
    """``(n-gram, occurrences, records)`` from ``(suffix, seen, n)`` rows in reverse lexicographic order, with a stack."""
    terms: list = []
    occurrences: list[int] = []
    records: list[int] = []
    for suffix, seen, n in rows:
        same = 0
        while same < len(terms) and same < len(suffix) and terms[same] == suffix[same]:
            same += 1
        while len(terms) > same:
            yield tuple(terms), occurrences[-1], records[-1]
            terms.pop()
            up, of = occurrences.pop(), records.pop()
            if terms:
                occurrences[-1] += up
                records[-1] += of
        for term in suffix[same:]:
            terms.append(term)
            occurrences.append(0)
            records.append(0)
        occurrences[-1] += n
        # the record counts for the prefixes longer than `seen`: added at the top, taken back at the last prefix it has counted for before
        records[-1] += n
        if seen:
            records[seen - 1] -= n
    while terms:
        yield tuple(terms), occurrences[-1], records[-1]
        terms.pop()
        up, of = occurrences.pop(), records.pop()
        if terms:
            occurrences[-1] += up
            records[-1] += of


def ngram_counts(records: DataFrame, terms: str, longest: int = 1, term_type: str = "bigint", hot_share: float = 0.02) -> DataFrame:
    """``(ngram, length, occurrences, records)`` of every run of 1 to `longest` terms in the array column `terms`.

    `occurrences` counts every place, `records` every row once. Null terms are left out before runs are formed, null or empty arrays count for nothing, equal
    rows are different records. A prefix that begins more than `hot_share` of the distinct suffixes (there are at most 1 / hot_share of each length) is
    routed by its next term as well, whatever its length; the parts of its count are added up at the end.
    """
    given = records.select(F.filter(F.col(terms).cast(f"array<{term_type}>"), lambda x: x.isNotNull()).alias("terms")).where("size(terms) > 0")
    routed = _suffixes(given, longest).withColumn("depth", F.lit(1))
    if longest > 1:
        routed = materialise(routed)
        bound = F.lit((routed.count() or 1) * hot_share)
        for depth in range(1, longest):  # prefixes too frequent at this length are parted by the next term
            prefix = F.slice("suffix", F.lit(1), F.lit(depth))
            hot = routed.where((F.col("depth") == depth) & (F.size("suffix") > depth)).groupBy(prefix.alias("hot")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bound).select("hot")
            routed = routed.join(F.broadcast(hot), prefix == F.col("hot"), "left").select("suffix", "seen", "n", F.when(F.col("hot").isNotNull(), depth + 1).otherwise(F.col("depth")).alias("depth"))
    routed = routed.select("suffix", "seen", "n", F.xxhash64(F.slice("suffix", F.lit(1), F.col("depth"))).alias("route"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def rows() -> Iterator[tuple[list, int, int]]:
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            grams, lengths, occurrences, of = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(grams, kind[0]), pa.array(lengths, pa.int32()), pa.array(occurrences, pa.int64()), pa.array(of, pa.int64())], names=["ngram", "length", "occurrences", "records"])

        for gram, occurrences, of in prefix_counts(rows()):
            out.append((gram, len(gram), occurrences, of))
            if len(out) == 10_000:
                yield made()
                out.clear()
        if out:
            yield made()

    partial = routed.repartition("route").sortWithinPartitions(F.col("suffix").desc()).select("suffix", "seen", "n").mapInArrow(run, f"ngram array<{term_type}>, length int, occurrences bigint, records bigint")
    if longest == 1:
        return partial
    return partial.groupBy("ngram", "length").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(counts: DataFrame, n_records: int, rare_below: int, common_above: float) -> DataFrame:
    """Adds `mark`: ``rare`` below `rare_below` occurrences, else ``common`` in more than the share `common_above` of the records, else null."""
    return counts.withColumn("mark", F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * n_records, "common"))
