"""Near-duplicate vectors by spherical k-means and blocked cosine products.

Vectors are compared only under one label and with one length. Equal vectors go in once, with
their number. A group of more vectors than a task takes is split by spherical k-means, fitted in a task on
a bounded sample of each group: a vector is asked about in the cell of its nearest centroid, its home, and is
met there by all vectors that any vector of that cell can be linked with. For vectors u, v of length 1 and centroids c
(nearest to u) and d, (v - u)(d - c) <= |v - u| |d - c| and u(d - c) <= 0, so v is a guest of c's cell unless
v(d - c) > reach |d - c| for some d, where reach is the distance at the threshold. Cells are split again while they are too large. Where that
would not save half of the products, as in one dense group or among directions without clusters,
the cell is dealt into blocks of bounded size instead, and all pairs of blocks are compared: every link is found, whatever the vectors.

A task compares its two sides by cells of spherical k-means too. Two cells whose centroids are further apart than the
threshold and their radii allow are passed over; two that lie within it as a whole are linked as a whole; others are compared by a
product of blocks in double precision. A task emits a count for each vector and a spanning tree of the links
it saw, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and all
under null labels, have no links and are their own component. Repeated rows and ids are vectors of their own, and equal vectors are linked. A null
vec_id takes part and names no component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, remove, text_batches, tidy
from .minhash import components

THRESHOLD = 0.93
#: Vectors on one side of a task.
CELL_VECTORS = 1 << 13
#: Cells that a group is split into, and rows of it that the centroids are fitted on (about).
BRANCHES = 16
SAMPLE = 2048
ROUNDS = 8
#: What rounding may add to an angle.
SLACK = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1 of rows of length 1, at most k; fitted on the rows as they are ordered, without chance."""
    # Each start is the row that is furthest from all starts before it.
    starts = [0]
    near = x @ x[0]
    while len(starts) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        starts.append(far)
        near = np.maximum(near, x @ x[far])
    centroids = x[starts]
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


@tidy
def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, label, size, raw, unit): vectors that can be linked, as bytes of their components and of their direction."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row, label, vector in zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            if vector and None not in vector:
                # -0.0 and 0.0 are equal.
                x = np.array(vector, np.float64) + 0.0
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    unit = x / top
                    for o, v in zip(out, (row, label, len(x), x.tobytes(), (unit / np.linalg.norm(unit)).tobytes()), strict=True):
                        o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "label", "size", "raw", "unit"])


def _fit(key: tuple, table: pa.Table) -> pa.Table:
    x = _matrix(table.sort_by("row").column("unit").combine_chunks())
    return pa.table({"cell": pa.array([key[0].as_py()]), "centroids": pa.array([spherical_kmeans(x, BRANCHES).tobytes()], pa.binary())})


def _deal(reach: float):
    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row of a cell to the cell of its nearest centroid (asked) and to those where it may be met."""
        for batch in batches:
            by_model: dict[bytes, list[int]] = {}
            for i, data in enumerate(batch.column("centroids").to_pylist()):
                by_model.setdefault(data, []).append(i)
            for data, rows in by_model.items():
                part = batch.take(pa.array(rows, pa.int32()))
                x = _matrix(part.column("unit"))
                c = np.frombuffer(data, np.float64).reshape(-1, x.shape[1])
                dots, apart = x @ c.T, np.linalg.norm(c[:, None] - c[None], axis=2)
                i, k = np.nonzero((dots[:, None, :] - dots[:, :, None] <= reach * apart + SLACK).all(2))
                home = dots.argmax(1)[i] == k
                kept = part.take(pa.array(i, pa.int64()))
                cells = [f"{cell}/{n}" for cell, n in zip(kept.column("cell").to_pylist(), k.tolist(), strict=True)]
                asked = pa.array(kept.column("asked").to_numpy(zero_copy_only=False) & home, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), asked, *(kept.column(x) for x in ("row", "n", "unit"))], ["cell", "asked", "row", "n", "unit"])

    return deal


def _trees(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _merge(parent: list[int], hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Unites the nodes left[i] and right[j] wherever hits[i, j]."""
    i, j = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
    hits, left, right = hits[np.ix_(i, j)], left[i], right[j]
    while hits.any():
        # Each row with its first hit and each column with its first one; then only hits between different trees count.
        pairs = zip(np.r_[left, left[hits.argmax(0)]].tolist(), np.r_[right[hits.argmax(1)], right].tolist(), strict=True)
        some = np.r_[hits.any(1), hits.any(0)]
        for (a, b), met in zip(pairs, some.tolist(), strict=True):
            if met:
                a, b = _trees(parent, a), _trees(parent, b)
                parent[max(a, b)] = min(a, b)
        a, b = (np.array([_trees(parent, x) for x in side.tolist()]) for side in (left, right))
        hits = hits & (a[:, None] != b[None, :])


def compare(asked: np.ndarray, met: np.ndarray, weights: np.ndarray, own: np.ndarray, other: np.ndarray, threshold: float) -> tuple[np.ndarray, list[int]]:
    """For each asked row the weights of the met rows within the threshold, added up; and a forest over nodes that holds the links.

    own and other number the nodes of both sides.
    """
    found = np.zeros(len(asked), np.int64)
    parent = list(range(int(max(own.max(initial=-1), other.max(initial=-1))) + 1))
    if not len(asked) or not len(met):
        return found, parent
    step = max(1, len(met) // SAMPLE)
    centroids = spherical_kmeans(met[::step], max(1, round(len(met) ** 0.5 / 2)))
    limit = np.arccos(threshold)

    def cells(x: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
        dots = x @ centroids.T
        home = dots.argmax(1)
        order = np.argsort(home, kind="stable")
        ids, first = np.unique(home[order], return_index=True)
        parts = np.split(order, first[1:])
        return [(int(c), p, float(np.arccos(np.clip(dots[p, c].min(), -1, 1)))) for c, p in zip(ids, parts, strict=True)]

    between = np.arccos(np.clip(centroids @ centroids.T, -1, 1))
    ours, theirs = cells(asked), cells(met)
    for c, rows, radius in ours:
        for d, others, wide in theirs:
            # No bound is trusted at the very edge.
            if between[c, d] - radius - wide > limit + SLACK:
                continue
            if between[c, d] + radius + wide < limit - SLACK:
                found[rows] += weights[others].sum()
                near = np.r_[own[rows], other[others]].tolist()
                for b in near[1:]:
                    x, y = _trees(parent, near[0]), _trees(parent, b)
                    parent[max(x, y)] = min(x, y)
                continue
            hits = asked[rows] @ met[others].T >= threshold
            if hits.any():
                found[rows] += hits @ weights[others]
                _merge(parent, hits, own[rows], other[others])
    return found, parent


def _links(threshold: float):
    def links(key: tuple, table: pa.Table) -> pa.Table:
        """(row, n, to) of one task: n to be added to a row's links, to a row that it is in one tree with."""
        table = table.sort_by("row")
        x, rows = _matrix(table.column("unit").combine_chunks()), table.column("row").to_numpy()
        ask, meet = table.column("asked").to_numpy(), table.column("met").to_numpy()
        node = np.unique(rows, return_inverse=True)[1]
        n, parent = compare(x[ask], x[meet], table.column("n").to_numpy()[meet], node[ask], node[meet], threshold)
        names = np.unique(rows)
        root = names[[_trees(parent, i) for i in node[ask].tolist()]] if ask.any() else rows[ask]
        # Met rows that hang on a tree say so too.
        hung = np.array([_trees(parent, i) for i in node[meet].tolist()], np.int64) if meet.any() else np.zeros(0, np.int64)
        moved = hung != node[meet]
        own = np.r_[rows[ask], rows[meet][moved]]
        return pa.table({"row": own, "n": np.r_[n, np.zeros(int(moved.sum()), np.int64)], "to": np.r_[root, names[hung[moved]]]}).cast(LINKS)

    return links


LINKS = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])


def _split(vectors: DataFrame, reach: float, most: int, scratch: list[str]) -> DataFrame:
    """(cell, asked, row, n, unit, blocks): vectors in cells; those of a cell of several blocks are too many for a task."""
    todo = vectors.withColumn("asked", F.lit(True))
    parts = []
    while True:
        size = F.count(F.lit(1)).alias("size")
        big = todo.groupBy("cell").agg(size, F.sum(F.col("asked").cast("long")).alias("asking")).filter(F.col("size") > most)
        big = cut(big, scratch)
        sized = join_hot(todo, big, ["cell"], "row", "left", 8)
        if big.isEmpty():
            parts.append(todo.withColumn("blocks", F.lit(1)))
            break
        sized = cut(sized, scratch)
        parts.append(sized.filter("size is null").select(*todo.columns, F.lit(1).alias("blocks")))
        # A cell in which nobody is asked needs nobody to be met.
        large = sized.filter("asking > 0")
        # About SAMPLE rows of each cell, drawn by a hash.
        draw = F.pmod(F.xxhash64("row", F.lit(7)), F.col("size")) < SAMPLE
        fitted = cut(large.filter(draw).select("cell", "row", "unit").groupBy("cell").applyInArrow(_fit, "cell string, centroids binary"), scratch)
        dealt = cut(join_hot(large, fitted, ["cell"], "row", "inner", 8).mapInArrow(_deal(reach), "cell string, asked boolean, row long, n long, unit binary"), scratch)
        # Products of the parts against those of the whole.
        cells = dealt.groupBy("cell").agg(size, F.sum(F.col("asked").cast("long")).alias("asking"))
        parent = F.expr("substring(cell, 1, length(cell) - length(substring_index(cell, '/', -1)) - 1)").alias("cell")
        saved = cells.groupBy(parent).agg(F.sum(F.col("size").cast("double") * F.col("asking")).alias("cost"), F.sum("size").alias("rows"))
        saved = big.join(saved, "cell").select("cell", (F.col("cost") <= 0.5 * F.col("size").cast("double") * F.col("asking")).alias("worth"))
        saved = cut(saved, scratch)
        kept = join_hot(large.select(*todo.columns, "size"), saved.filter("not worth").select("cell"), ["cell"], "row", "inner", 8)
        parts.append(kept.select(*todo.columns, F.ceil(F.col("size") / most).cast("int").alias("blocks")))
        worth = saved.filter("worth").select(F.col("cell").alias("parent"))
        todo = cut(join_hot(dealt.withColumn("parent", parent), worth, ["parent"], "row", "inner", 8).select(*todo.columns), scratch)
        if todo.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tasks(cells: DataFrame) -> DataFrame:
    """(cell, i, j, row, n, unit, asked, met): each task asks about block i of a cell and meets block j of it."""
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    others = F.expr("explode(sequence(0, blocks - 1))")
    asks = cells.filter("asked").select("cell", "row", "n", "unit", block.alias("i"), others.alias("j"), block.alias("own"))
    asks = asks.select("cell", "i", "j", "row", "n", "unit", F.lit(True).alias("asked"), (F.col("own") == F.col("j")).alias("met"))
    # A row that is asked about in a task meets others in it by the same row there.
    meets = cells.select("cell", "row", "n", "unit", "asked", block.alias("j"), others.alias("i")).filter("not (asked and i = j)")
    return asks.unionByName(meets.select("cell", "i", "j", "row", "n", "unit", F.lit(False).alias("asked"), F.lit(True).alias("met")))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    Rows with equal labels are linked where their cosine is threshold or more. n_links counts the other rows that
    one is linked with, component_id is the smallest key reachable, and kept tells whether that is the row's own.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    scratch: list[str] = []
    rows = cut(vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector")).withColumn("row", F.monotonically_increasing_id()))
    unit = cut(rows.filter("label is not null").select("row", "label", "vector").mapInArrow(_unit, "row long, label string, size int, raw binary, unit binary"), scratch)
    # Equal vectors go by their first row.
    classes = cut(unit.groupBy("label", "size", "raw").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), scratch)
    several = classes.filter("n > 1").select("label", "size", "raw", "first", "n")
    copies = cut(join_hot(unit.select("row", "label", "size", "raw"), several, ["label", "size", "raw"], "row", "inner", 8).select("row", "first", "n"))
    reps = unit.join(copies.select("row", "first", "n"), "row", "left").filter("first is null or first = row")
    # What is behind the last colon is a number and the cells below it, so no two groups have cells of one name.
    cell = F.concat_ws(":", "label", "size").alias("cell")
    reps = cut(reps.select(cell, "row", F.coalesce("n", F.lit(1).cast("long")).alias("n"), "unit"), scratch)
    cells = _split(reps, float(np.sqrt(2 - 2 * threshold)), cell_vectors, scratch)
    found = cut(_tasks(cells).groupBy("cell", "i", "j").applyInArrow(_links(threshold), "row long, n long, to long"))
    remove(spark, scratch)
    # What a row meets holds the row itself.
    counts = found.groupBy("row").agg((F.sum("n") - 1).alias("links")).filter("links > 0")
    trees = found.filter("row <> to").select(F.col("row").alias("u"), F.col("to").alias("v")).distinct()
    comp = components(trees)
    first = F.coalesce("first", "row")
    own = rows.select("id", "row").join(copies.select("row", "first"), "row", "left").withColumn("rep", first)
    own = join_hot(own, comp, ["rep"], "row", "left", 8)
    own = cut(join_hot(own, counts.withColumnRenamed("row", "rep"), ["rep"], "row", "left", 8).withColumn("comp", F.coalesce("comp", "rep")))
    smallest = own.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    out = join_hot(own, cut(smallest.select("comp", "component_id", F.lit(True).alias("several"))), ["comp"], "row", "left", 8)
    component = F.when(F.col("several"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
