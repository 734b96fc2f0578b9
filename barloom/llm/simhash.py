"""SimHash near-duplicates with pivot distance tables.

A fingerprint's row of the table holds its Hamming distances to reference
fingerprints. Two fingerprints within `distance` differ by at most `distance`
in every coordinate, so the largest coordinate difference discards most pairs
before their bits are compared. One pivot splits random fingerprints only in
half, which cannot cut the work into parts; parts are made from equal bits:
fingerprints within 3 bits share one of four 16-bit blocks, and in the rest
one of four 12-bit blocks.

Null and empty texts, and texts of blanks, have fingerprint zero and link like
any other. Equal fingerprints, of repeated rows too, are one vertex. A class
whose ids are all null has a null component. Other columns are not read.

`one_per_group` judges texts by the Jaccard similarity of their five-word
shingles instead. Such pairs differ in up to about 20 bits, which no equal
blocks can index, so its candidates share a band of least hash values; pivots
discard among them and whole shingle sets decide.
"""

import dataclasses
import functools
import itertools
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import work_dir
from .common import arrow_map, bodies, free_name, group_bounds, sorted_groups, stored, texts, tiled
from .components import components

BITS, DISTANCE = 64, 3


def fingerprint(text: bytes, shingle=3) -> int:
    """Majority bits of the shingles' hashes, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = (ends - size + 1)[: 1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle=3) -> DataFrame:
    """doc_id, fp (signed 64 bits) per row."""
    rows = texts(docs, id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fp = pa.array([fingerprint(t, shingle) for t in bodies(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    return arrow_map(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n=16, seed=7) -> list[int]:
    """Reference fingerprints, drawn from a seed."""
    return np.random.default_rng(seed).integers(-(1 << 63), 1 << 63, n, dtype=np.int64).tolist()


def pivot_table(fp: Column, references: list[int]) -> Column:
    """Hamming distances to the references, one byte each."""
    each = [F.unhex(F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(p)))), 2, "0")) for p in references]
    return F.concat(*each)


def _block_keys(fp: Column) -> Column:
    """16 keys: a 16-bit block, then one quarter of the other 48 bits."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low) if i else high
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(block, 12).bitwiseOR(part).bitwiseOR(F.lit((4 * i + j) << 28)))
    return F.array(*keys)


def spanning(fps: np.ndarray, table: np.ndarray, distance: int, alike: Callable | None = None) -> list[tuple[int, int]]:
    """(position, root's position) for fingerprints of a group that are linked to others, one per member that is no root.

    A search takes linked rows out of the waiting ones, so a dense group is
    soon empty and links are never listed pair by pair. `alike` judges the
    positions that the pivots and the bits leave.
    """
    order = np.argsort(table[:, 0], kind="stable")
    signed, table = fps[order], table[order].astype(np.int16)
    fps = signed.view(np.uint64)  # numpy counts a negative number's bits by its absolute value
    waiting = np.ones(len(fps), bool)
    first, out = table[:, 0], []
    for root in range(len(fps)):
        if not waiting[root]:
            continue
        waiting[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            a, b = np.searchsorted(first, (first[x] - distance, first[x] + distance + 1))
            near = a + np.flatnonzero(waiting[a:b])
            if not len(near):
                continue
            near = near[np.abs(table[near] - table[x]).max(axis=1) <= distance]  # the pivots' verdict
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= distance]
            if alike is not None and len(near):
                near = near[alike(order[x], order[near])]
            waiting[near] = False
            todo.extend(near.tolist())
            out += [(int(order[v]), int(order[root])) for v in near]
    return out


def forest(fps: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(node, root) for a group's fingerprints that are linked to others, one per node that is no root."""
    return [(int(fps[x]), int(fps[root])) for x, root in spanning(fps, table, distance)]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    keys = ["key", "_i", "_j"]
    for table in sorted_groups(batches, keys):
        fps = table.column("fp").to_numpy()
        distances = np.frombuffer(b"".join(table.column("distances").to_pylist()), np.uint8).reshape(len(fps), -1)
        out = []
        for a, b in group_bounds(table, keys):
            out += forest(fps[a:b], distances[a:b], distance)
        nodes, roots = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def fingerprint_links(fps: DataFrame, references: list[int], tile=4096) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect the same components as all links do."""
    rows = fps.select("fp", pivot_table(F.col("fp"), references).alias("distances"), F.explode(_block_keys(F.col("fp"))).alias("key"))
    cells = tiled(rows, ["key"], F.xxhash64("fp"), tile)
    dealt = cells.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    return arrow_map(dealt.select("key", "_i", "_j", "fp", "distances"), lambda it: _links(it, DISTANCE), "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=3, n_pivots=16, seed=7, tile=4096) -> DataFrame:
    """doc_id, fp, component_id per row: the least doc_id reachable over links of 3 differing bits or fewer."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(fingerprint_links(classes, pivots(n_pivots, seed), tile))
    whole = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = whole.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = whole.join(named, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes, shingle=5) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; of a text with fewer words, its whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    last = max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1, initial=-1))[1:]
    starts = [0, *[e + 1 for e in ends[:last - 1]]]
    digest = xxhash.xxh64_intdigest
    whole = ends[shingle - 1:] or ends[-1:]
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, whole, strict=True)), np.uint64, last))


def _majority(hashes: np.ndarray) -> int:
    """Majority bits of distinct hashes, as a signed 64-bit number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


@dataclasses.dataclass(frozen=True)
class Near:
    """What counts as near, and how it is sought.

    `recall` is the wanted chance that a pair at exactly `similarity` shares a
    band; `distance` is a discard bound of the fingerprints: at a similarity of
    0.8 they differ in 9.7 bits on average, with a deviation of 2.9.
    """

    shingle: int = 5
    similarity: float = 0.8
    rows: int = 5
    recall: float = 0.999
    distance: int = 22
    n_pivots: int = 16
    seed: int = 7
    tile: int = 4096
    tile_bytes: int = 8_000_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity ** self.rows))


@functools.cache
def _functions(near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that make `bands * rows` hash functions of one."""
    draw = np.random.default_rng(near.seed)
    flips, odd = draw.integers(0, 1 << 64, (2, near.bands * near.rows, 1), dtype=np.uint64)
    return flips, odd | np.uint64(1)


def band_keys(hashes: np.ndarray, near: Near) -> list[int]:
    """Keys that texts share where the least values of `rows` hash functions agree."""
    if not len(hashes):
        return []
    flips, odd = _functions(near)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, at:at + 1024] ^ flips) * odd).min(axis=1))
    cut = least.reshape(near.bands, near.rows)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(cut)]


def _distances(fps: np.ndarray, near: Near) -> np.ndarray:
    references = np.array(pivots(near.n_pivots, near.seed), np.int64).view(np.uint64)
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ references[None, :])


def sketches(docs: DataFrame, row_col: str, id_col: str, text_col: str, near: Near) -> DataFrame:
    """row, id, digest of the lower-cased word sequence, fp of the distinct shingles and band keys, per row."""
    rows = docs.select(
        F.col(f"`{row_col}`").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("body"))

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            digests, fps, keys = [], [], []
            for body in bodies(batch):
                hashes = shingle_hashes(body, near.shingle)
                digests.append(xxhash.xxh3_128_digest(b" ".join(body.lower().split())))
                fps.append(_majority(hashes) if len(hashes) else 0)
                keys.append(band_keys(hashes, near))
            made = [pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *made], ["row", "id", "digest", "fp", "bands"])

    return arrow_map(rows, task, f"row long, id {rows.schema['id'].dataType.simpleString()}, digest binary, fp long, bands array<long>")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    nodes, roots = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def _band_links(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    keys = ["key", "_i", "_j"]
    for table in sorted_groups(batches, keys):
        node, fps = table.column("node").to_numpy(), table.column("fp").to_numpy()
        out = []
        for a, b in group_bounds(table, keys):
            found = spanning(fps[a:b], _distances(fps[a:b], near), near.distance)
            out += [(int(node[a + x]), int(node[a + root])) for x, root in found]
        yield _pairs(out)


def _text_links(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    keys = ["root", "_i", "_j"]
    for table in sorted_groups(batches, keys):
        node, body, out = table.column("node").to_numpy(), table.column("body"), []
        for a, b in group_bounds(table, keys):
            sets = [shingle_hashes(v.as_py() or b"", near.shingle) for v in body[a:b]]
            fps = np.array([_majority(s) for s in sets], np.int64)

            def alike(x, others):
                return np.array([jaccard(sets[x], sets[y]) >= near.similarity for y in others], bool)

            out += [(int(node[a + x]), int(node[a + root])) for x, root in spanning(fps, _distances(fps, near), near.distance, alike)]
        yield _pairs(out)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Shared part of two sets of hashes (distinct, in order)."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(x) + len(y) - both)


def _block(row: str) -> Column:
    """The block of 1,024 neighbouring rows that a row lies in."""
    return F.shiftright(F.col(f"`{row}`"), 10)


def _kept_in_blocks(docs: DataFrame, row_col: str, block_col: str, text_col: str, bucket_bytes=16 << 20) -> DataFrame:
    """`docs` with a number per row and its block's, in a table bucketed by block, so that rows are looked up without a shuffle of texts."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes)))
    table = f"barloom_keyed_{os.urandom(6).hex()}"
    rows = docs.withColumn(row_col, F.monotonically_increasing_id())  # consecutive inside a partition, whose number is in the upper bits
    rows.withColumn(block_col, _block(row_col)).write.bucketBy(buckets, block_col).option("path", work_dir(spark, "keyed")).saveAsTable(table)
    return spark.table(table)


def _looked_up(keyed: DataFrame, chosen: DataFrame, row_col: str, block_col: str, value: str) -> DataFrame:
    """The rows of `keyed` that `chosen` (row, `value`) names, with the value, which is never null."""
    each = free_name(keyed, "_found")
    entries = F.collect_list(F.struct("row", value))
    lists = chosen.groupBy(_block("row").alias(block_col)).agg(F.map_from_entries(entries).alias(each))
    found = keyed.join(lists, block_col).withColumn(value, F.try_element_at(each, F.col(f"`{row_col}`")))
    return found.filter(F.col(value).isNotNull()).drop(each)


def similar_texts(keyed: DataFrame, classes: DataFrame, row_col: str, block_col: str, text_col: str, near: Near) -> DataFrame:
    """(node, root) of texts linked by a Jaccard similarity of `near.similarity` or more.

    keyed: rows in a table bucketed by block; classes: node (a row of the text), fp, bands. Texts that share a band and
    whose fingerprints the pivots do not discard form coarse groups; inside a
    group, cut into pairs of tiles of bounded bytes, the pivots discard again
    and the whole sets of shingles decide.
    """
    cells = tiled(classes.select("node", "fp", F.explode("bands").alias("key")), ["key"], F.xxhash64("node"), near.tile)
    dealt = cells.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").select("key", "_i", "_j", "node", "fp")
    coarse = components(arrow_map(dealt, lambda it: _band_links(it, near), "a long, b long"))
    body = F.col(f"`{text_col}`").cast("string").cast("binary").alias("body")
    grouped = coarse.withColumnRenamed("node", "row")
    rows = _looked_up(keyed.select(row_col, block_col, body), grouped, row_col, block_col, "root").withColumnRenamed(row_col, "node")
    size = _looked_up(keyed.select(row_col, block_col, F.octet_length(body).alias("size")), grouped, row_col, block_col, "root")
    size = size.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / near.tile_bytes), F.ceil(F.count("*") / near.tile)).cast("int").alias("_m"))
    own = rows.join(size.filter("_m > 1"), "root", "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    own = own.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_m")).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    own = own.select("root", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "node", "body")
    dealt = own.repartition("root", "_i", "_j").sortWithinPartitions("root", "_i", "_j")
    return components(arrow_map(dealt, lambda it: _text_links(it, near), "a long, b long"))


def one_per_group(docs: DataFrame, id_col="doc_id", text_col="text", near: Near = Near()) -> DataFrame:
    """One row of `docs` for each group of near duplicates: the one with the least id.

    Texts are near at a Jaccard similarity of 0.8 or more of their lower-cased
    five-word shingles. Rows are grouped, not ids: every row gets a key of its
    own, so rows that share an id or have none are told apart. Rows without an
    id come last in a group; of rows that repeat its least id, the one with the
    least digest stays, and of those the first. Null and empty texts and texts
    of blanks are equal; texts of fewer than five words are near only if equal.
    """
    mark, block = free_name(docs, "_row"), free_name(docs, "_block")
    keyed = _kept_in_blocks(docs, mark, block, text_col)
    rows = stored(sketches(keyed, mark, id_col, text_col, near), "sketches")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "row")
    whole = stored(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min(first).alias("head")), "texts")
    classes = rows.select(F.col("row").alias("node"), "fp", "bands").join(whole.select("node"), "node", "left_semi")
    roots = similar_texts(keyed, classes, mark, block, text_col, near)
    grouped = whole.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("head").alias("head"))
    least = free_name(docs, "_least")
    chosen = grouped.select(F.col("head.row").alias("row"), F.lit(True).alias(least))
    return _looked_up(keyed, chosen, mark, block, least).select(*[F.col(f"`{c}`") for c in docs.columns])
