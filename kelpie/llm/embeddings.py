"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the basis of their principal components, which leaves every cosine as
it is but puts most of it into the first coordinates.  Tiles of vectors are compared pair by pair: the products over
the leading coordinates are accumulated first, and by Cauchy-Schwarz the rest of a product is at most the product of
the two suffix norms; only pairs whose bound reaches the threshold go on to the next coordinates.  Those left, found
with a margin for rounding, are decided by the cosine of the vectors as given, in double precision.  Tiles are ranges
along the direction of greatest variance; a vector meets only tiles that reach within the distance that linked vectors
can lie apart.

Equal vectors are one vector with a count.  Vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, and so do vectors of different lengths with each other.  Repeated ids are separate vectors of one
id.  A row whose vec_id is null links like any other and counts among the links of others; it names no component and
is never kept, and a component of such rows only has a null component_id.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bounded, settle
from .components import connected_components

THRESHOLD = 0.95
#: Rounding allowance of the bounds; decisions themselves are made without it.
SLACK = 1e-9
#: Distinct vectors of a tile, about, and the fewest tiles.
TILE = 8192
LEAST_TILES = 16
#: Rows of a block within a tile pair; a block's products are BLOCK * BLOCK doubles.
BLOCK = 1024
#: Leading coordinates of each step, as shares of all.
STEPS = (0.125, 0.375)


def usable(column: str = "embedding"):
    """Whether a vector can link at all."""
    v = F.col(column)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two, so that squares neither overflow nor vanish, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def principal_axes(vectors: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes by falling square sums and the direction of greatest variance, over all unit vectors.

    Only sums, (size + 1) * size numbers, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        n = 0
        for batch in batches:
            if batch.num_rows:
                x, length = unit(_matrix(batch.column("v"), size))
                x /= length[:, None]
                total[:size] += x.T @ x
                total[size] += x.sum(axis=0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array([n] * (size + 1), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "n", "row"])

    rows = vectors.select("v").mapInArrow(run, "i int, n long, row array<double>")
    sums = rows.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    matrix = np.zeros((size + 1, size))
    for r in sums:
        matrix[r.i, r.j] = r.x
    n, mean = max(1, sums[0].n), matrix[size] / max(1, sums[0].n)
    second = (matrix[:size] + matrix[:size].T) / 2 / n
    return np.linalg.eigh(second)[1][:, ::-1].copy(), np.linalg.eigh(second - np.outer(mean, mean))[1][:, -1].copy()


def coordinates(rows: DataFrame, size: int, direction: np.ndarray) -> DataFrame:
    """(x): where each unit vector lies along the direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, length = unit(_matrix(batch.column("v"), size))
                yield pa.RecordBatch.from_arrays([pa.array(x @ direction / length)], ["x"])

    return rows.select("v").mapInArrow(run, "x double")


def deal(rows: DataFrame, size: int, direction: np.ndarray, splits: list[float], reach: float, exact: str) -> DataFrame:
    """(one, two, side, node, copies, vector): each vector in every pair of tiles that can hold a link of it.

    ``one`` <= ``two`` name the tiles, ``side`` tells which of them is the vector's own.
    """
    edges = np.array(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), size)
            x, length = unit(v)
            x = x @ direction / length
            own, low, high = (np.searchsorted(edges, x + d, side="right") for d in (0.0, -reach, reach))
            each = high - low + 1
            row = np.repeat(np.arange(len(x)), each)
            other = np.arange(len(row)) - np.repeat(np.cumsum(each) - each - low, each)
            mine = own[row]
            packed = pa.array([r.tobytes() for r in v.astype(exact)], pa.binary())
            for a in range(0, len(row), 8192):
                k, o, m = row[a : a + 8192], other[a : a + 8192], mine[a : a + 8192]
                where = pa.array(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(o, m)), pa.array(np.maximum(o, m)), pa.array((m > o).astype(np.int32)), batch.column("node").take(where), batch.column("copies").take(where), packed.take(where)],
                    ["one", "two", "side", "node", "copies", "vector"],
                )

    return rows.select("node", "copies", "v").mapInArrow(run, "one long, two long, side int, node long, copies long, vector binary")


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose product reaches the threshold; leading coordinates are accumulated first."""
    size = a.shape[1]
    cuts = sorted({min(size, max(1, math.ceil(size * s))) for s in STEPS} | {size})
    rest_a, rest_b = (np.sqrt(np.maximum(0.0, np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1])) for x in (a, b))
    k = cuts[0]
    if k == size:
        i, j = np.nonzero(a @ b.T >= threshold - SLACK)
    else:
        # The bound is one more coordinate: suffix norm times suffix norm.
        i, j = np.nonzero(np.hstack([a[:, :k], rest_a[:, k : k + 1]]) @ np.hstack([b[:, :k], rest_b[:, k : k + 1]]).T >= threshold - SLACK)
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        total = np.einsum("ij,ij->i", a[p, :k], b[q, :k])
        for low, high in zip(cuts, cuts[1:]):
            bound = total + rest_a[p, low] * rest_b[q, low]
            p, q, total = (x[bound >= threshold - SLACK] for x in (p, q, total))
            total = total + np.einsum("ij,ij->i", a[p, low:high], b[q, low:high])
        hit = total >= threshold - SLACK
        out_i.append(p[hit])
        out_j.append(q[hit])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n-1 edges (member, root) with the connectivity of the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def compare_tiles(tiled: DataFrame, axes: np.ndarray, threshold: float, exact: str) -> DataFrame:
    """Per tile pair: links of each vector as counts of rows (node, n) and forest edges (node, other)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "side"))
        given = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=exact).astype(np.float64).reshape(len(node), -1)
        given, length = unit(given)
        x = given / length[:, None] @ axes
        alone = key[0].as_py() == key[1].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
        count = np.zeros(len(node), dtype=np.int64)
        members, roots = [], []
        for p in range(0, len(left), BLOCK):
            for q in range(p if alone else 0, len(right), BLOCK):
                one, two = left[p : p + BLOCK], right[q : q + BLOCK]
                i, j = close_pairs(x[one], x[two], threshold)
                if alone and p == q:
                    i, j = i[i < j], j[i < j]
                i, j = one[i], two[j]
                # The last word: the cosine of the vectors as given, in double precision.
                sure = np.einsum("ij,ij->i", given[i], given[j]) / (length[i] * length[j]) >= threshold
                i, j = i[sure], j[sure]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                if len(i):
                    members.append(i)
                    roots.append(j)
                    if sum(map(len, members)) > 8 * len(node):
                        m, r = _forest(len(node), np.concatenate(members), np.concatenate(roots))
                        members, roots = [m], [r]
        m, r = _forest(len(node), np.concatenate(members), np.concatenate(roots)) if members else (np.zeros(0, int), np.zeros(0, int))
        some = np.flatnonzero(count)
        return pa.table(
            {
                "node": pa.array(np.concatenate([node[some], node[m]]), pa.int64()),
                "n": pa.array([*count[some].tolist(), *[None] * len(m)], pa.int64()),
                "other": pa.array([*[None] * len(some), *node[r].tolist()], pa.int64()),
            }
        )

    return tiled.groupBy("one", "two").applyInArrow(run, "node long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module's text.  ``threshold`` lies above 0."""
    bounded(vectors.sparkSession)
    # Components that are single floats travel as such.
    kind = vectors.schema["embedding"].dataType
    exact = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    marked = settle(rows.select("vec_id", F.when(usable(), F.col("embedding")).alias("v")))
    unique = marked.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    unique = settle(unique.withColumn("node", F.monotonically_increasing_id()))
    counts, edges = None, None
    for size, n in sorted((r[0], r[1]) for r in unique.groupBy(F.size("v")).count().collect()):
        part = unique.where(F.size("v") == size)
        axes, direction = principal_axes(part, size)
        tiles = max(LEAST_TILES, math.ceil(n / tile))
        found = coordinates(part, size, direction).agg(F.percentile_approx("x", [i / tiles for i in range(1, tiles)], max(10_000, 10 * tiles))).first()[0]
        # Unit vectors whose cosine reaches the threshold are at most so far apart, in any direction.
        reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        tiled = deal(part, size, direction, sorted(set(found)), reach, exact)
        found = settle(compare_tiles(tiled, axes, threshold, exact))
        some = found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
        links = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
        counts, edges = (some, links) if counts is None else (counts.unionByName(some), edges.unionByName(links))
    if counts is None:
        return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    named = unique.join(connected_components(edges), "node", "left")
    # A component's smallest id; settled, so that a component of a third of all rows can be split in the join.
    least = settle(named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least")))
    member = (
        named.join(least, "component", "left").join(counts, "node", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("found"))
    )
    joined = marked.join(member, "v", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
    WITH RECURSIVE v AS (
        SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS MATERIALIZED (SELECT r, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {THRESHOLD}::DOUBLE),
    c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT c.a, min(v.vec_id) AS least FROM c JOIN v ON v.r = c.b GROUP BY c.a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, coalesce(vec_id = least, false) AS kept FROM v JOIN m ON m.a = v.r LEFT JOIN n ON n.a = v.r"""
