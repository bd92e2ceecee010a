"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .store import input_partitions, written

#: Vectors in a tile, at most and by the bytes that they take in double precision, and
#: vectors that the axes are fitted on. A tile is copied once for each tile it meets,
#: so few large ones move less.
TILE, TILE_BYTES, FIT = 16_384, 32_000_000, 4096
#: Dimensions summed up before a pair is first judged, as a share of all.
LEADING = 0.375
#: Pairs of a tile pair that are held at once, and values of their vectors.
PAIRS, VALUES = 1_000_000, 2_000_000
#: Bounds are widened by this much against rounding.
SLACK = 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal axes, the one with the most energy first.

    Any orthonormal axes leave cosines as they are; these only make the leading
    sums tell more, so a bounded sample does for fitting them.
    """
    return np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]


def similar_pairs(a: np.ndarray, b: np.ndarray, threshold: float, leading: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b``, unit vectors along the axes, with cosine >= threshold, some rows of ``a`` at a time.

    The leading dimensions are multiplied for all pairs. The rest of a pair can
    add no more than the product of its suffix norms; where the sum can't reach
    the threshold the pair is done. Twice as many dimensions judge the pairs
    left, and all dimensions, in double precision, those left then. Where an
    eighth of all pairs are left, the rest is multiplied for all of them.

    Never more than about PAIRS pairs are held, however many are linked.
    """
    dims = a.shape[1]
    rest_a = np.sqrt(np.maximum(1 - (a[:, :leading] ** 2).sum(1), 0))
    rest_b = np.sqrt(np.maximum(1 - (b[:, :leading] ** 2).sum(1), 0))
    more = min(2 * leading, dims)
    some, few = max(1, min(512, PAIRS // max(1, len(b)))), max(256, VALUES // dims)
    for at in range(0, len(a), some):
        block = a[at : at + some]
        sums = block[:, :leading] @ b[:, :leading].T
        i, j = np.nonzero(sums + rest_a[at : at + some, None] * rest_b[None, :] >= threshold - SLACK)
        if 8 * len(i) > sums.size:
            sums += block[:, leading:] @ b[:, leading:].T
            i, j = np.nonzero(sums >= threshold)
            yield i + at, j
            continue
        del sums
        for upto in (more, dims):
            keep = [np.zeros(0, bool)]
            for k in range(0, len(i), few):
                x, y = block[i[k : k + few]], b[j[k : k + few]]
                bound = np.einsum("ij,ij->i", x[:, :upto], y[:, :upto])
                if upto < dims:
                    bound = bound + np.sqrt(np.maximum((x[:, upto:] ** 2).sum(1) * (y[:, upto:] ** 2).sum(1), 0)) + SLACK
                keep.append(bound >= threshold)
            kept = np.concatenate(keep)
            i, j = i[kept], j[kept]
        yield i + at, j


class Forest:
    """Groups of joined positions."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Join positions pair by pair; which of the pairs joined two groups not joined before."""
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        parent, x, y = self.parent, self.parent[i], self.parent[j]
        apart = np.flatnonzero(x != y)
        _, first = np.unique(x[apart] * len(parent) + y[apart], return_index=True)
        chosen, apart = [], apart[first]

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for k, p, q in zip(apart.tolist(), x[apart].tolist(), y[apart].tolist(), strict=True):
            p, q = top(p), top(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
                chosen.append(k)
        return np.array(chosen, dtype=np.int64)


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    tile: int | None = None,
) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every vector, by cosine >= ``threshold``.

    Equal vectors are compared once, as one with a count. Vectors are laid
    along principal axes, sorted by the first and cut into tiles of up to about
    ``tile`` (a quarter more at most); two tiles meet only if their ranges on that axis are near enough for unit vectors at
    the threshold. A tile pair is one bounded task: it returns the links of
    each vector as a sum and a spanning forest of its links, and holds about
    PAIRS of them at once, so a group in which all are linked takes no more memory.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. Vectors of another length than the commonest one are
    compared with those of their own length. A null id is kept as a row without
    links whose component is null. Rows with equal ids are linked as the
    vectors they are. An empty table gives an empty one.
    """
    vector = F.col(vector_col)
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(vector, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col(id_col).isNotNull()
    # Two 64-bit hashes name a distinct vector.
    key = F.when(sound, F.struct(F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(1), vector).alias("k2"), F.size(vector).alias("dims")))
    keyed = df.select(F.col(id_col).alias("id"), key.alias("key"), vector.alias("vector"))
    distinct = written(
        keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "vectors",
    )
    edges, degrees = [], []
    for row in distinct.groupBy("key.dims").count().collect():  # lengths of vectors: one, as a rule
        found = _compare(distinct.where(F.col("key.dims") == row["dims"]), row["dims"], threshold, tile)
        edges.append(found.where("b is not null").select("a", "b"))
        degrees.append(found.where("b is null").select(F.col("a").alias("rep"), "links"))
    spark = df.sparkSession
    if edges:
        pairs, links = edges[0], degrees[0]
        for e, d in zip(edges[1:], degrees[1:], strict=True):
            pairs, links = pairs.union(e), links.union(d)
    else:
        pairs = spark.createDataFrame([], "a long, b long")
        links = spark.createDataFrame([], "rep long, links long")
    roots = connected(pairs).toDF("rep", "root")
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        distinct.select("key", "rep", "copies")
        .join(links, "rep", "left")
        .join(roots, "rep", "left")
        .select(
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("root", "rep").alias("root"),
        )
    )
    component = F.coalesce("root", "id")
    return keyed.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _compare(distinct: DataFrame, dims: int, threshold: float, tile: int | None) -> DataFrame:
    """Spanning edges (a, b) of linked representatives, and rows (a, null, links)."""
    tile = tile or max(256, min(TILE, TILE_BYTES // (8 * dims)))
    # Single precision moves as such; what is computed is in double.
    kind = "<f4" if isinstance(distinct.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    sample = distinct.orderBy(F.col("key.k1")).select("vector").limit(FIT).collect()
    fit = np.array([r["vector"] for r in sample], dtype=np.float64)
    fit /= np.abs(fit).max(axis=1, keepdims=True, initial=0)
    fit /= np.linalg.norm(fit, axis=1, keepdims=True)
    axes = principal_axes(fit)
    leading = max(1, min(dims, int(dims * LEADING)))
    first = F.array(*[F.lit(float(x)) for x in axes[:, 0]])
    top = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    as_double = F.transform("vector", lambda x: x.cast("double") / top)  # no overflow or underflow in the squares
    dot = F.aggregate(F.zip_with(as_double, first, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda s, x: s + x * x))
    placed = distinct.select("rep", "copies", "vector", (dot / norm).alias("first"))
    parts = input_partitions(distinct)
    placed = placed.repartitionByRange(parts, "first").sortWithinPartitions("first")
    runs_schema = "run long, n long, low double, high double, reps binary, copies binary, vectors binary"
    most = max(1, tile // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pending = TaskContext.get().partitionId() << 32, []

        def closed(rows: list[tuple]) -> pa.RecordBatch:
            reps, copies, vectors, at = zip(*rows, strict=True)
            block = np.array(vectors, dtype=kind)
            values = [number, len(rows), min(at), max(at), np.array(reps, "<i8").tobytes(), np.array(copies, "<i8").tobytes(), block.tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["run", "n", "low", "high", "reps", "copies", "vectors"])

        for batch in batches:
            flat = batch.column(2)
            block = np.array(flat.flatten(), dtype=kind).reshape(-1, dims)
            pending += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), block, batch.column(3).to_pylist(), strict=True)
            while len(pending) >= most:
                yield closed(pending[:most])
                number, pending = number + 1, pending[most:]
        if pending:
            yield closed(pending)

    # Few large tiles: a tile costs its bytes once for each tile it meets. So runs
    # of the sorted vectors, however many partitions cut them, are joined in order
    # to tiles of about ``tile``; each has the true range of what it holds.
    runs = written(placed.mapInArrow(cut, runs_schema), "runs")
    before = F.sum("n").over(Window.orderBy("low", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    numbered = runs.select("run", "n", "low").select("run", F.floor(before / F.lit(tile)).alias("tile"))
    # Binaries of equal order: each list is sorted by the run.
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("run", c))), lambda x: x[c]).alias(c)
    tiles = runs.join(numbered, "run").groupBy("tile").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), joined("reps"), joined("copies"), joined("vectors")
    )
    tiles = written(tiles, "tiles")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))).alias("cell")
    spans = tiles.select("tile", "low", "high")
    left = spans.select(F.col("tile").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), cells(F.col("low") - reach, F.col("high") + reach))
    right = spans.select(F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), cells(F.col("low"), F.col("high")))
    meet = (F.col("i") <= F.col("j")) & (F.col("low_j") - reach <= F.col("high_i")) & (F.col("low_i") - reach <= F.col("high_j"))
    pairs = left.join(right, "cell").where(meet).select("i", "j").distinct()
    one = tiles.select(F.col("tile").alias("i"), F.col("reps").alias("reps_i"), F.col("copies").alias("copies_i"), F.col("vectors").alias("vectors_i"))
    two = tiles.select(F.col("tile").alias("j"), F.col("reps").alias("reps_j"), F.col("copies").alias("copies_j"), F.col("vectors").alias("vectors_j"))
    met = pairs.join(one, "i").join(two, "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rotated(raw: list[bytes]) -> np.ndarray:
            block = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(-1, dims)
            block = block / np.abs(block).max(1, keepdims=True)  # no overflow in the squares
            return (block / np.linalg.norm(block, axis=1, keepdims=True)) @ axes

        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                get = lambda c: batch.column(names.index(c))[row].as_py()  # noqa: E731, B023
                numbers = lambda c: np.frombuffer(b"".join(get(c)), "<i8")  # noqa: E731, B023
                same = get("i") == get("j")
                reps_a, reps_b = numbers("reps_i"), numbers("reps_j")
                count_a, count_b = numbers("copies_i"), numbers("copies_j")
                a = rotated(get("vectors_i"))
                links_a, links_b = np.zeros(len(reps_a)), np.zeros(len(reps_b))
                forest, starts, ends = Forest(len(reps_a) + len(reps_b)), [np.zeros(0, "<i8")], [np.zeros(0, "<i8")]
                for i, j in similar_pairs(a, a if same else rotated(get("vectors_j")), threshold, leading):
                    if same:
                        i, j = i[i < j], j[i < j]
                    links_a += np.bincount(i, weights=count_b[j], minlength=len(reps_a))
                    links_b += np.bincount(j, weights=count_a[i], minlength=len(reps_b))
                    chosen = forest.add(i, j if same else j + len(reps_a))
                    starts.append(reps_a[i[chosen]])
                    ends.append(reps_b[j[chosen]])
                reps, links = np.concatenate([reps_a, reps_b]), np.concatenate([links_a, links_b]).astype("i8")
                reps, links = reps[links > 0], links[links > 0]
                start, end = np.concatenate(starts), np.concatenate(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([start, reps]), pa.int64()),
                        pa.array([*end.tolist(), *[None] * len(reps)], pa.int64()),
                        pa.array([*[None] * len(start), *links.tolist()], pa.int64()),
                    ],
                    names=["a", "b", "links"],
                )

    return written(met.mapInArrow(compare, "a long, b long, links long"), "vector-links")
