"""Hard negatives through an inverted multi-index.

A vector's integers are cut into two halves, and each half gets the nearest of
the codewords of its half-space codebook: the two codewords name the vector's
cell. For an anchor, a codeword's bound is the codeword's inner product with
the anchor's half plus the half's length times the codeword's radius, the
largest distance of a row from it. The sum of two bounds limits every score in
a cell. A heap walks the cells by falling sums (multi-sequence algorithm); the
walk ends once what was found is certified: the last place of the wanted list,
or of each wanted score window, lies above the sum of the next cell, or the
window lies above it. All results are exact, whatever the codebooks are.

The codebooks of the 16 most frequent vector lengths are learned from about
`sample` rows each, chosen by hash; other lengths have one cell. Every row is
indexed. Rows of one length (and, for positives, one label) are
dealt over slices of about `slice_rows` rows, anchors over blocks of about
`block_anchors`, and each block meets each slice in one task-sized group that
returns a few rows an anchor; so a hot label or vector is spread like others.

Rows with a null label or vector, or with a null or non-finite component, take
no part; neither do rows whose integers' squares add up to 2^53 or more, since
their scores would not be exact. Vectors of different length do not meet.
Empty vectors score 0 with each other. Rows that repeat an id are rows of
their own; between two of one score and id either may stand. Rows with a null
id are candidates, last among ties, but no anchors. Labels keep their sign in
`%`. Other columns are not read. Empty tables give no rows.
"""

import functools
import heapq
import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_cogroup, arrow_map, stored

HALF_CODES = 16
LENGTHS = 16
LIMIT = 2.0**53
#: Order of null ids: behind all others.
LAST = 2**63 - 1


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def codebook(x: np.ndarray, k: int, seed: int, rounds=12) -> np.ndarray:
    """Lloyd codewords of the rows; rows far from all codewords start new ones."""
    rng = np.random.default_rng(seed)
    words = x[rng.permutation(len(x))[:k]].astype(float)
    for _ in range(rounds):
        near = nearest(x, words)
        for i in range(len(words)):
            own = x[near == i]
            if len(own):
                words[i] = own.mean(axis=0)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * (x @ words.T), axis=1)


class Cells:
    """The rows of one slice, by cell."""

    def __init__(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.radii, self.used = books, [], []
        for part, code, words in zip(halves(x), (first, second), books, strict=True):
            far = np.sqrt(((part - words[code]) ** 2).sum(axis=1))
            radius = np.zeros(len(words))
            np.maximum.at(radius, code, far)
            self.radii.append(radius)
            self.used.append(np.unique(code))
        cell = first * len(books[1]) + second
        self.order = np.argsort(cell, kind="stable")
        name, start = np.unique(cell[self.order], return_index=True)
        self.spans = dict(zip(name.tolist(), zip(start.tolist(), [*start.tolist()[1:], len(cell)]), strict=True))

    def visits(self, anchor: np.ndarray, batch=512):
        """(row numbers, bound of all scores not seen yet) until every row was seen."""
        bounds, codes = [], []
        for part, words, radius, used in zip(halves(anchor[None, :]), self.books, self.radii, self.used, strict=True):
            length = math.sqrt(float((part * part).sum()))
            reach = (words[used] @ part[0]) + length * radius[used]
            # Room for rounding, far above what sums of a few thousand doubles lose.
            reach += 1e-9 * (1 + length * (np.sqrt((words[used] ** 2).sum(axis=1)) + radius[used]))
            order = np.argsort(-reach, kind="stable")
            bounds.append(reach[order].tolist())
            codes.append(used[order].tolist())
        width, rows, heap = len(self.books[1]), [], [(-(bounds[0][0] + bounds[1][0]), 0, 0)]
        size = 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(bounds[1]):
                heapq.heappush(heap, (-(bounds[0][i] + bounds[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(bounds[0]):
                heapq.heappush(heap, (-(bounds[0][i + 1] + bounds[1][0]), i + 1, 0))
            span = self.spans.get(codes[0][i] * width + codes[1][j])
            if span:
                rows.append(self.order[span[0]:span[1]])
                size += span[1] - span[0]
            if rows and (size >= batch or not heap):
                yield np.concatenate(rows), (-heap[0][0] if heap else -math.inf)
                rows, size = [], 0


def _best(score: np.ndarray, name: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The first k of `rows` by falling score, then rising id."""
    if len(rows) > 4 * k:
        least = np.partition(score[rows], len(rows) - k)[len(rows) - k]
        rows = rows[score[rows] >= least]
    return rows[np.lexsort((name[rows], -score[rows]))[:k]]


def top_scores(cells: Cells, x: np.ndarray, name: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, k: int):
    """(rows, scores) of the anchor's first k allowed rows."""
    score = np.full(len(x), -math.inf)
    kept = np.empty(0, np.int64)
    for rows, rest in cells.visits(anchor):
        rows = rows[allowed[rows]]
        score[rows] = x[rows] @ anchor
        kept = _best(score, name, np.concatenate((kept, rows)), k)
        if len(kept) == k and score[kept[-1]] > rest:
            break
    return kept, score[kept]


def window_scores(cells: Cells, x: np.ndarray, name: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, windows: list[tuple[int, int]], k: int):
    """Per window (least, most) the first k allowed rows whose 100-fold score lies in it, with their scores."""
    score = np.full(len(x), -math.inf)
    kept = [np.empty(0, np.int64)] * len(windows)
    open_ = [i for i, (least, most) in enumerate(windows) if least <= most]
    for rows, rest in cells.visits(anchor):
        rows = rows[allowed[rows]]
        score[rows] = x[rows] @ anchor
        hundred = score[rows] * 100
        for i in open_:
            inside = rows[(hundred >= windows[i][0]) & (hundred <= windows[i][1])]
            kept[i] = _best(score, name, np.concatenate((kept[i], inside)), k)
        open_ = [i for i in open_ if rest * 100 >= windows[i][0] and not (len(kept[i]) == k and score[kept[i][-1]] > rest)]
        if not open_:
            break
    return [(rows, score[rows]) for rows in kept]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, -1)


def _slice(table: pa.Table, books) -> tuple:
    x = _matrix(table.column("vec"), table.num_rows)
    names = table.column("name").to_numpy()
    cells = Cells(x, table.column("first").to_numpy(), table.column("second").to_numpy(), book_of(books, x.shape[1]))
    return cells, x, names


def _found(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    arrays = [pa.array(np.concatenate(v) if v else [], t.type) for v, t in zip(columns.values(), schema, strict=True)]
    return pa.Table.from_arrays(arrays, schema=schema)


POSITIVES = pa.schema([("anchor", pa.int64()), ("name", pa.int64()), ("score", pa.int64())])
NEGATIVES = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("name", pa.int64()), ("score", pa.int64())])


def _positives(anchors: pa.Table, rows: pa.Table, books, k: int) -> pa.Table:
    out = {c: [] for c in POSITIVES.names}
    if anchors.num_rows and rows.num_rows:
        cells, x, names = _slice(rows, books)
        numbers = rows.column("row").to_numpy()
        for number, anchor in zip(anchors.column("row").to_pylist(), _matrix(anchors.column("vec"), anchors.num_rows), strict=True):
            found, score = top_scores(cells, x, names, numbers != number, anchor, k)
            out["anchor"].append(np.full(len(found), number))
            out["name"].append(names[found])
            out["score"].append(score.astype(np.int64))
    return _found(out, POSITIVES)


def _negatives(anchors: pa.Table, rows: pa.Table, books, k: int, low: int, high: int) -> pa.Table:
    out = {c: [] for c in NEGATIVES.names}
    if anchors.num_rows and rows.num_rows:
        cells, x, names = _slice(rows, books)
        labels = rows.column("label").to_numpy()
        columns = (anchors.column(c).to_pylist() for c in ("row", "label", "scores"))
        for number, label, scores, anchor in zip(*columns, _matrix(anchors.column("vec"), anchors.num_rows), strict=True):
            windows = [(low * s, high * s) for s in scores]
            for place, (found, score) in enumerate(window_scores(cells, x, names, labels != label, anchor, windows, k)):
                out["anchor"].append(np.full(len(found), number))
                out["place"].append(np.full(len(found), place))
                out["name"].append(names[found])
                out["score"].append(score.astype(np.int64))
    return _found(out, NEGATIVES)


def _coded(batches, books):
    for batch in batches:
        sizes = batch.column("dim").to_numpy()
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            x = part.column("vec").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, dim)
            codes = [pa.array(nearest(h, w), pa.int32()) for h, w in zip(halves(x), book_of(books, dim), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *codes], [*part.schema.names, "first", "second"])


def learned_codebooks(rows: DataFrame, sample: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks for each of the `LENGTHS` most frequent vector lengths, from about `sample` hashed rows each."""
    counts = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    share = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 20))
    wanted = [(F.col("dim") == r["dim"]) & (share < math.ceil((1 << 20) * sample / r["count"])) for r in counts]
    if not wanted:
        return {}
    picked = rows.filter(functools.reduce(operator.or_, wanted)).select("dim", "vec").toArrow()
    books = {}
    for dim in picked.column("dim").unique().to_pylist():
        part = picked.filter(pa.compute.equal(picked.column("dim"), dim))
        x = _matrix(part.column("vec"), part.num_rows)
        books[dim] = tuple(codebook(h, HALF_CODES, seed + i) for i, h in enumerate(halves(x)))
    return books


def book_of(books: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The length's codebooks; a rare length has one cell, around the origin."""
    return books.get(dim) or halves(np.zeros((1, dim)))


def _grid(anchors: DataFrame, rows: DataFrame, keys: list[str], slice_rows: int, block_anchors: int):
    """Both sides with (keys, _s, _b): each block of anchors meets each slice of its keys' rows once."""
    n_rows = rows.groupBy(*keys).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_slices"))
    n_anchors = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / block_anchors).cast("int").alias("_blocks"))
    plan = n_rows.join(n_anchors, keys)
    dealt = rows.join(plan, keys).withColumn("_s", F.pmod(F.xxhash64("row"), F.col("_slices")).cast("int"))
    dealt = dealt.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_slices", "_blocks")
    asked = anchors.join(plan, keys).withColumn("_b", F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int"))
    asked = asked.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices", "_blocks")
    return asked, dealt, [*keys, "_s", "_b"]


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "name"))
    return rows.withColumn("place_", place).filter(F.col("place_") <= k)


def indexed(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", scale=256, sample=4096, seed=3):
    """(rows, books): every usable row with its integers and cell, stored once."""
    wide = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), wide.alias("wide"))
    finite = F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("wide").isNotNull() & finite)
    square = F.aggregate("wide", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, F.lit(2)))
    rows = rows.filter(square < LIMIT)
    floor = F.transform("wide", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    rows = rows.select("vec_id", "label", floor.alias("vec"), F.size("wide").alias("dim"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows = rows.withColumn("name", F.coalesce("vec_id", F.lit(LAST)))
    books = learned_codebooks(rows, sample, seed)
    held = vectors.sparkSession.sparkContext.broadcast(books)  # 16 codewords a half for each vector length
    schema = "vec_id long, label long, vec array<int>, dim int, row long, name long, first int, second int"
    return stored(arrow_map(rows, lambda it: _coded(it, held.value), schema), "cells"), held


def mined(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", every=50, positives=5, negatives=3, low=50, high=95,
          scale=256, sample=4096, slice_rows=8192, block_anchors=4096, seed=3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides; a negative's score lies
    between `low` and `high` hundredths of the positive's.
    """
    rows, held = indexed(vectors, id_col, vec_col, label_col, scale, sample, seed)
    anchors = rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "dim", "vec")
    asked, dealt, keys = _grid(anchors.drop("vec_id"), rows, ["dim", "label"], slice_rows, block_anchors)
    found = arrow_cogroup(asked, dealt, keys, lambda a, r: _positives(a, r, held.value, positives), "anchor long, name long, score long")
    best = stored(_first(found, ["anchor"], positives), "positives")
    # At most `positives` entries a list.
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place_", "score"))).alias("_p"))
    wanted = anchors.join(windows.withColumnRenamed("anchor", "row"), "row").select("row", "label", "dim", "vec", F.col("_p.score").alias("scores"))
    asked, dealt, keys = _grid(wanted, rows, ["dim"], slice_rows, block_anchors)
    found = arrow_cogroup(asked, dealt, keys, lambda a, r: _negatives(a, r, held.value, negatives, low, high), "anchor long, place int, name long, score long")
    found = _first(found, ["anchor", "place"], negatives)
    named = best.select("anchor", (F.col("place_") - 1).alias("place"), F.col("name").alias("positive"), F.col("score").alias("positive_score"))
    out = found.join(named, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select("anchor_id", real("positive").alias("positive_id"), F.col("place_").cast("int").alias("rank"), real("name").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Labels of the mining task: where 7 divides the id, the next of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same rows in DuckDB: every anchor scored against all rows.
MINED_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3"""
