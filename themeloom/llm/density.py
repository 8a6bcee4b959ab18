"""Grouping records into similarity clusters: density peaks over blocked neighbour joins.

Records are unit vectors; neighbours have a cosine of at least `threshold`. In a pass, a record's density is the weight of the neighbours it meets, its pointer leads to the nearest denser
neighbour, a record without one is a peak, and following the pointers gives every record the peak of its cluster (Rodriguez and Laio).

No pass compares all pairs. Records are blocked by their nearest pivots, a bounded sample of the records themselves: each goes to the cells of its `probes` nearest
pivots, and neighbours meet in a cell unless they share none. Within a cell, similarities are one matrix product. A cell above `cell_rows` is blocked again by itself, as often as
it takes: its records go by the largest coordinates of what sets them apart from the cell's mean, under a random rotation (cross-polytope hashing), so close records stay together however full the
cell was. A pass is followed by others with other pivots and rotations over the peaks alone, each standing for the weight it has gathered; peaks that are neighbours join there, so
what one blocking parts the next puts together. Passes go on until `quiet` of them in a row, the first aside, have joined nothing; their number has no bound. Where all records fit one cell a
single pass is exact. `exact` ends with all remaining peaks compared block by block, a cost that grows with the square of their number.
Records with equal vectors are one record with a weight from the start, so copies cost nothing.

The densities that come out are counted afterwards and are exact: all pairs within each cluster are compared, a large cluster as blocks against blocks whose sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import connected_components
from ..session import materialise

_MAX_PIVOTS = 4096  # the bound on the sample that the driver holds, 1 MB of 64 numbers each; fuller cells are blocked again


def unit_vectors(records: DataFrame, rec: str, vector: str, dims: int) -> DataFrame:
    """``(rec, vec)``, vec being array<float> of length 1. Vectors that are null, of another size, not finite throughout or all zero are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            x = sized.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)  # null becomes NaN
            top = np.abs(x).max(axis=1, initial=0)
            fit = np.isfinite(x).all(axis=1) & (top > 0)
            x = x[fit] / top[fit][:, None]
            x = (x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([sized.column(0).filter(pa.array(fit)), lists], names=["rec", "vec"])

    given = records.select(F.col(rec).cast("bigint").alias("rec"), F.col(vector).cast("array<double>").alias("v")).where("rec is not null")
    return given.mapInArrow(run, "rec bigint, vec array<float>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.float32)


def _assigned(points: DataFrame, pivots: np.ndarray, probes: int) -> DataFrame:
    """``(id, weight, vec, cells)``: the `probes` nearest pivots of each point."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value.T
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                near = _matrix(part.column(2)) @ centre
                k = min(probes, near.shape[1])
                cells = np.argpartition(-near, k - 1, axis=1)[:, :k].astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, k, dtype=np.int32)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), lists], names=["id", "weight", "vec", "cells"])

    return points.select("id", "weight", "vec").mapInArrow(run, "id bigint, weight bigint, vec array<float>, cells array<bigint>")


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def polytope_cells(cell: np.ndarray, apart: np.ndarray, turn: np.ndarray, probes: int) -> np.ndarray:
    """The names of the `probes` cells, one row each, that a cell's records go to by what sets them apart from its mean."""
    turned = apart @ turn
    size = np.abs(turned)
    axis = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    side = 2 * axis + (np.take_along_axis(turned, axis, axis=1) < 0) + 1
    mixed = (cell.astype(np.uint64)[:, None] ^ (side.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))).astype(np.int64)


def _split(cells: DataFrame, means: DataFrame, dims: int, probes: int, seed: int) -> DataFrame:
    """The rows ``(cell, id, weight, vec)`` of the cells in ``means(cell, mean)``, in the cells within them."""
    turn = rotation(dims, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                apart = _matrix(part.column(3)) - _matrix(part.column(4)).astype(np.float32)
                to = polytope_cells(part.column(0).to_numpy(), apart, turn, probes)
                taken = part.take(pa.array(np.repeat(np.arange(part.num_rows), probes)))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), *(taken.column(i) for i in (1, 2, 3))], names=["cell", "id", "weight", "vec"])

    rows = cells.join(means, "cell").select("cell", "id", "weight", "vec", "mean")
    return rows.mapInArrow(run, "cell bigint, id bigint, weight bigint, vec array<float>")


def _blocked(points: DataFrame, dims: int, cell_rows: int, probes: int, seed: int) -> DataFrame:
    """``(cell, id, weight, vec)`` from points with their `cells`; a cell above `cell_rows` is divided, and its parts as long as they are."""
    cells = points.select(F.explode("cells").alias("cell"), "id", "weight", "vec")
    done, level = None, 0
    while True:
        level += 1
        over = materialise(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select("cell"))
        small = cells if level == 1 and over.isEmpty() else cells.join(over, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        if over.isEmpty():
            return done
        mean = F.array(*[F.avg(F.col("vec")[i]) for i in range(dims)])
        means = materialise(cells.join(over, "cell", "left_semi").groupBy("cell").agg(mean.alias("mean")))
        # more than one cell a record at the first division only: a record is in probes ** 2 cells at most
        cells = materialise(_split(cells, means, dims, max(1, min(probes, dims // 4)) if level == 1 else 1, seed + level))


def cell_density(x: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Weight of the neighbours of each row of `x`, itself included."""
    return ((x @ x.T) >= threshold) @ weight


def cell_pointers(ids: np.ndarray, x: np.ndarray, rho: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, nearest denser neighbour, cosine)`` of the rows that have one; of equally dense ones the smaller id is denser."""
    order = np.lexsort((ids, -rho))
    ids, x = ids[order], x[order]
    near = x @ x.T
    near[np.triu_indices(len(ids))] = -2  # only rows before: denser
    best = near.argmax(axis=1)
    cosine = near[np.arange(len(ids)), best]
    has = cosine >= threshold
    return ids[has], ids[best[has]], cosine[has].astype(np.float64)


def block_density(x: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the neighbours of each row of `x` among the rows of `y`, and the other way round; `v` and `w` are the rows' weights. Cosines close to the threshold are taken again in doubles."""
    of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    many_v, many_w = np.nonzero(v > 1)[0], np.nonzero(w > 1)[0]
    for start in range(0, len(x), 512):
        part, k = slice(start, start + 512), many_v[(many_v >= start) & (many_v < start + 512)]
        near = x[part] @ y.T
        hit = near >= threshold
        i, j = np.nonzero(np.abs(near - np.float32(threshold)) < 1e-5)
        if len(i):
            hit[i, j] = np.einsum("ij,ij->i", x[part][i].astype(np.float64), y[j].astype(np.float64)) >= threshold
        of_x[part] = np.count_nonzero(hit, axis=1) + hit[:, many_w] @ (w[many_w] - 1)
        of_y += np.count_nonzero(hit, axis=0) + (v[k] - 1) @ hit[k - start]
    return of_x, of_y


def cluster_density(points: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``(id, rho)`` of ``(id, peak, vec, weight)``: the weight of all neighbours that each point has in its own cluster, itself included.

    A cluster above `block_rows` is dealt out to blocks, and every pair of its blocks is a group; smaller ones share groups, and are compared one by one there.
    """
    sizes = materialise(points.groupBy("peak").agg(F.count(F.lit(1)).alias("n")))
    large = {r.peak: -(-r.n // block_rows) for r in sizes.where(F.col("n") > block_rows).collect()}  # at most a row per block
    groups = max(1, -(-(sizes.where(F.col("n") <= block_rows).agg(F.sum("n")).first()[0] or 0) // block_rows))
    blocks = F.lit(None).cast("int")
    if large:
        blocks = F.element_at(F.create_map(*[F.lit(v) for kv in large.items() for v in kv]), F.col("peak")).cast("int")
    dealt = points.withColumn("blocks", blocks).withColumn("block", F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("shared", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("peak"), F.lit(groups))).otherwise(-1)).withColumn("whole", F.when(F.col("blocks").isNotNull(), F.col("peak")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    pairs = pairs.select("shared", "whole", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "peak", "weight", "vec")

    def run(t: pa.Table) -> pa.Table:
        ids, x, w = t.column("id").to_numpy(), _matrix(t.column("vec")), t.column("weight").to_numpy()
        rho = np.zeros(len(ids), np.int64)
        if t.column("low")[0].as_py() != t.column("high")[0].as_py():
            first = t.column("block").to_numpy() == t.column("low")[0].as_py()
            rho[first], rho[~first] = block_density(x[first], w[first], x[~first], w[~first], threshold)
        else:
            peak = t.column("peak").to_numpy()
            order = np.argsort(peak, kind="stable")
            for own in np.split(order, np.nonzero(np.diff(peak[order]))[0] + 1):
                rho[own] = block_density(x[own], w[own], x[own], w[own], threshold)[0]
        return pa.table({"id": t.column("id"), "rho": pa.array(rho)})

    parts = pairs.groupBy("shared", "whole", "low", "high").applyInArrow(run, "id bigint, rho bigint")
    return parts.groupBy("id").agg(F.sum("rho").cast("double").alias("rho"))


def follow(pointers: DataFrame) -> DataFrame:
    """``(id, peak)`` from ``(id, to)``, `to` null for peaks, by pointer doubling; resolved rows leave the joins' larger side."""
    at = materialise(pointers.select("id", F.coalesce("to", "id").alias("at"), F.col("to").isNull().alias("done")))
    while not at.where("not done").isEmpty():
        ahead = at.select(F.col("id").alias("k"), F.col("at").alias("peak"), F.col("done").alias("ended"))
        moved = at.where("not done").select("id", "at").join(ahead, F.col("at") == F.col("k")).select("id", F.col("peak").alias("at"), F.col("ended").alias("done"))
        at = materialise(at.where("done").unionByName(moved))
    return at.select("id", F.col("at").alias("peak"))


def _pass(points: DataFrame, n: int, dims: int, threshold: float, probes: int, cell_rows: int, seed: int) -> DataFrame:
    """One pass over ``(id, weight, vec)``: ``(id, peak)`` of all."""
    want = 1 if n <= cell_rows else int(min(_MAX_PIVOTS, max(1, -(-2 * probes * n // cell_rows))))
    sample = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(want).select("vec").collect()
    points = materialise(_assigned(points, np.array([r.vec for r in sample], np.float32), probes))
    cells = _blocked(points, dims, cell_rows, probes, seed)

    def density(t: pa.Table) -> pa.Table:
        x, w = _matrix(t.column("vec")), t.column("weight").to_numpy().astype(np.float64)
        rho = cell_density(x, w, threshold)
        met = pa.array(rho > w)  # who meets nobody in a cell has no pointer there
        return pa.table({"id": t.column("id"), "cell": t.column("cell"), "rho": pa.array(rho)}).filter(met)

    def pointers(t: pa.Table) -> pa.Table:
        i, to, cosine = cell_pointers(t.column("id").to_numpy(), _matrix(t.column("vec")), t.column("rho").to_numpy(), threshold)
        return pa.table({"id": pa.array(i, pa.int64()), "to": pa.array(to, pa.int64()), "cosine": pa.array(cosine)})

    met = materialise(cells.groupBy("cell").applyInArrow(density, "id bigint, cell bigint, rho double"))
    rho = met.groupBy(F.col("id").alias("i")).agg(F.max("rho").alias("rho"), F.collect_set("cell").alias("met"))  # a record is in a bounded number of cells
    dense = points.select("id", "vec").join(rho, F.col("id") == F.col("i")).select(F.explode("met").alias("cell"), "id", "rho", "vec")
    best = dense.groupBy("cell").applyInArrow(pointers, "id bigint, to bigint, cosine double").groupBy("id").agg(F.max(F.struct("cosine", (-F.col("to")).alias("to"))).alias("best"))
    links = points.select("id").join(best.select(F.col("id").alias("i"), (-F.col("best.to")).alias("to")), F.col("id") == F.col("i"), "left").select("id", "to")
    return follow(links)


def _joined_exactly(points: DataFrame, n: int, threshold: float, block_rows: int) -> DataFrame:
    """``(id, peak)``: all pairs of ``(id, vec)`` compared, a block of at most about `block_rows` against another at a time; neighbours join."""
    blocks = max(1, -(-n // block_rows))
    dealt = points.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("id", "vec", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(t: pa.Table) -> pa.Table:
        ids, x, first = t.column("id").to_numpy(), _matrix(t.column("vec")), t.column("block").to_numpy() == t.column("low")[0].as_py()
        one = t.column("low")[0].as_py() == t.column("high")[0].as_py()
        a, b = (ids, ids) if one else (ids[first], ids[~first])
        i, j = np.nonzero((x @ x.T if one else x[first] @ x[~first].T) >= threshold)
        return pa.table({"a": pa.array(a[i], pa.int64()), "b": pa.array(b[j], pa.int64())}).filter(pa.array(a[i] != b[j]))

    links = materialise(dealt.groupBy("low", "high").applyInArrow(run, "a bigint, b bigint"))
    of = connected_components(links).select(F.col("node").alias("i"), "component")
    return materialise(points.select("id").join(of, F.col("id") == F.col("i"), "left").select("id", F.coalesce("component", "id").alias("peak")))


def density_peaks(records: DataFrame, rec: str, vector: str, dims: int, threshold: float = 0.8, probes: int = 3, cell_rows: int = 2048, quiet: int = 2, densities: bool = True, block_rows: int = 8192, exact: bool = False) -> DataFrame:
    """``(rec, cluster, density, size)`` of every record with a usable vector (see `unit_vectors`).

    cluster is the lowest `rec` of the cluster, size its number of records, density the number of the record's neighbours in its cluster
    (itself included), null without `densities`. Repeated `rec` values count as records each; without any usable vector there are no rows.
    """
    hashed = unit_vectors(records, rec, vector, dims).select("rec", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    given = materialise(hashed.withColumn("row", F.monotonically_increasing_id()))
    alike = given.groupBy("h1", "h2").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("weight"))  # equal vectors by 128 bits
    of = materialise(given.select("rec", "row", "h1", "h2").join(alike, ["h1", "h2"]).select("rec", "row", "id", "weight"))
    first = of.where("row = id").select("id", "weight")
    copies = materialise(given.select("row", "vec").join(first, F.col("row") == F.col("id")).select("id", "weight", "vec"))
    points, labels = copies, None
    n, still, seed = points.count(), 0, 0
    while n and still < quiet:
        seed += 1000
        whole = n <= cell_rows
        peaks = _pass(points, n, dims, threshold, probes, cell_rows, seed)
        labels, points, before = _passed_on(labels, peaks), _gathered(points, peaks), n
        n = points.count()
        still = quiet if whole else 0 if n < before or seed == 1000 else still + 1
    if labels is None:
        return of.select("rec", F.col("rec").alias("cluster"), F.lit(0.0).alias("density"), F.lit(0).cast("bigint").alias("size"))
    if exact and not whole:
        labels = _passed_on(labels, _joined_exactly(points, n, threshold, block_rows))
    if densities:
        labels = materialise(labels.join(copies, "id").select("id", "peak", "vec", "weight"))
        labels = labels.join(cluster_density(labels, threshold, block_rows), "id").select("id", "peak", "rho")
    else:
        labels = labels.select("id", "peak", F.lit(None).cast("double").alias("rho"))
    rows = materialise(of.select("rec", "id").join(labels, "id").select("rec", "peak", "rho"))
    named = rows.groupBy("peak").agg(F.min("rec").alias("cluster"), F.count(F.lit(1)).alias("size"))
    return rows.join(named, "peak").select("rec", "cluster", F.col("rho").alias("density"), "size")


def _passed_on(labels: DataFrame | None, peaks: DataFrame) -> DataFrame:
    """The labels of all records after a pass over their peaks."""
    if labels is None:
        return peaks.select("id", "peak")
    return materialise(labels.join(peaks.select(F.col("id").alias("p"), F.col("peak").alias("up")), F.col("peak") == F.col("p")).select("id", F.col("up").alias("peak")))


def _gathered(points: DataFrame, peaks: DataFrame) -> DataFrame:
    """The peaks as points, with the weight they have gathered."""
    gathered = points.select("id", "weight").join(peaks, "id").groupBy("peak").agg(F.sum("weight").alias("weight"))
    return materialise(points.select("id", "vec").join(gathered, F.col("id") == F.col("peak")).select("id", "weight", "vec"))


def typical(clusters: DataFrame, members: int = 3) -> DataFrame:
    """``(cluster, size, member, place)``: the `members` densest records of each cluster, ties by the lower number."""
    top = clusters.select("cluster", "size", F.struct((-F.col("density")).alias("d"), F.col("rec").alias("rec")).alias("m"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("m"))  # limited before the shuffle, so no cluster is gathered
    return top.withColumn("place", place).where(F.col("place") <= members).select("cluster", "size", F.col("m.rec").alias("member"), "place")
