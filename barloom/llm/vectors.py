"""Near-duplicate vectors with randomised-rotation binary codes.

A unit vector x is rotated at random and kept as the signs of its coordinates
with one correction factor f, the inner product of x with its own code. For
another vector y, (code of x . y) / f estimates x . y without bias, and its
error stays within spread * sqrt((1 - f^2) / f^2) / sqrt(d - 1). Only pairs
whose upper bound reaches the threshold are computed again from the vectors in
double precision, and only those count as links.

Candidates meet in buckets of equal sign bits, in as many tables as the wanted
recall at the threshold asks for: every vector is indexed in all of them. A
pair is judged in the first table it meets in, so links are counted once and
never listed pair by pair.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and are components of their own. Equal vectors are one class; rows
that repeat an id are vectors of their own. Vectors of different length do not
link. Other columns are not read.
"""

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, group_bounds, sorted_groups, stored, tiled
from .components import components


@functools.cache
def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """n random orthogonal matrices side by side: dim x (n * dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.hstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(n)])


def plan_tables(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits per key, tables): buckets of about 32 of n spread-out vectors, and the recall at the threshold."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, n) / 32))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per class: code, correction factor, and its key in every table."""
    for batch in batches:
        sizes = batch.column("dim").to_numpy()
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            for at in range(0, part.num_rows, 2048):
                rows = part.slice(at, 2048)
                unit = _unit(_matrix(rows.column("vec")))
                turned = unit @ rotations(dim, math.ceil(bits * tables / dim), seed)
                sign = turned > 0
                factor = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
                weights = 1 << np.arange(bits, dtype=np.int64)
                keys = sign[:, : bits * tables].reshape(len(unit), tables, bits) @ weights
                keys = keys.astype(np.int64) | (dim << 32)
                code = np.packbits(sign[:, :dim], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("cls"), rows.column("n"), rows.column("vec"), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(factor, pa.float64()), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                    ["cls", "n", "vec", "code", "factor", "keys"])


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least row reachable from each row over the links (p, q)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, least)
        np.minimum.at(new, q, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(unit, code, factor, keys, own, table: int, cross: bool, cosine: float, spread: float, seed: int):
    """(p, q): linked rows of one bucket that meet in no earlier table."""
    n, dim = unit.shape
    turned = (unit @ rotations(dim, 1, seed)).astype(np.float32)
    signs = (code.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    bound = spread * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    found_p, found_q = [], []
    for at in range(0, n, 256):
        estimate = signs[at:at + 256] @ turned.T / factor[at:at + 256, None]
        near = estimate + bound[at:at + 256, None] >= cosine
        near &= np.arange(n)[None, :] > np.arange(at, min(n, at + 256))[:, None]
        p, q = np.nonzero(near)
        p += at
        if cross:
            apart = own[p] != own[q]
            p, q = p[apart], q[apart]
        for a in range(0, len(p), 1 << 16):
            pp, qq = p[a:a + (1 << 16)], q[a:a + (1 << 16)]
            fresh = ~(keys[pp, :table] == keys[qq, :table]).any(axis=1)
            pp, qq = pp[fresh], qq[fresh]
            linked = np.einsum("ij,ij->i", unit[pp], unit[qq]) >= cosine
            found_p.append(pp[linked])
            found_q.append(qq[linked])
    return (np.concatenate(found_p), np.concatenate(found_q)) if found_p else (np.empty(0, int), np.empty(0, int))


def _linked(batches: Iterator[pa.RecordBatch], cosine: float, spread: float, seed: int) -> Iterator[pa.RecordBatch]:
    order = ["table", "key", "_i", "_j"]
    for rows in sorted_groups(batches, order):
        out = []
        for a, b in group_bounds(rows, order):
            group = rows.slice(a, b - a).combine_chunks()
            unit = _unit(_matrix(group.column("vec").combine_chunks()))
            code = np.unpackbits(np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(b - a, -1), axis=1, count=unit.shape[1])
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(b - a, -1)
            cross = group.column("_i")[0].as_py() != group.column("_j")[0].as_py()
            p, q = bucket_links(unit, code, group.column("factor").to_numpy(), keys, group.column("_own").to_numpy(),
                                group.column("table")[0].as_py(), cross, cosine, spread, seed)
            if not len(p):
                continue
            n, cls = group.column("n").to_numpy(), group.column("cls").to_numpy()
            links = np.zeros(b - a, np.int64)
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            root = _roots(b - a, p, q)
            some = np.flatnonzero(links)
            out.append((cls[some], links[some], cls[root[some]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col="vec_id", vec_col="embedding", cosine=0.95, recall=0.995, spread=3.0, seed=5, tile=1024) -> DataFrame:
    """vec_id, n_links, component_id, kept per row.

    spread: width of the error bound; 1.9 already holds for nearly all pairs.
    """
    id_, vec = F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec")
    rows = vectors.select(id_, vec)
    usable = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    classes = rows.filter(usable).groupBy("vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "classes")
    bits, tables = plan_tables(classes.count(), cosine, recall)
    kind = classes.schema["vec"].dataType.simpleString()
    coded = arrow_map(classes.select("cls", "n", "vec", "dim"), lambda it: _codes(it, bits, tables, seed),
                      f"cls long, n long, vec {kind}, code binary, factor double, keys array<long>")
    dealt = coded.select("cls", "n", "vec", "code", "factor", "keys", F.posexplode("keys").alias("table", "key"))
    cells = tiled(dealt, ["table", "key"], F.xxhash64("cls"), tile)
    order = ["table", "key", "_i", "_j"]
    cells = cells.repartition(*order).sortWithinPartitions(*order)
    linked = stored(arrow_map(cells, lambda it: _linked(it, cosine, spread, seed), "cls long, links long, root long"), "links")
    roots = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    found = classes.join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    found = found.withColumn("root", F.coalesce("root", "cls")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    named = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = found.join(named, "root").select("vec", "links", "component_id")
    linkable = rows.filter(usable).join(labels, "vec").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
