"""Shared helpers: stored tables, word bytes, word-level caches, Arrow columns."""

import functools
import os
import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import work_dir

#: A word is a run of bytes outside 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: lineage ends there."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def settled(df: DataFrame) -> DataFrame:
    """Same rows, every column computed exactly once before what follows reads it."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


@functools.cache
def _shipped(application: str) -> str:
    """A zip of this package's source, for the executors' Python."""
    top = pathlib.Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="barloom-"), f"{top.name}-source.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    return path


def arrow_map(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """mapInArrow by a function of this package, whose source Spark hands to the executors."""
    context = df.sparkSession.sparkContext
    context.addPyFile(_shipped(context.applicationId))
    return df.mapInArrow(task, schema)


def arrow_cogroup(left: DataFrame, right: DataFrame, keys: list[str], task: Callable, schema: str) -> DataFrame:
    """cogroup(...).applyInArrow by a function of this package; `keys` must bound both groups."""
    context = left.sparkSession.sparkContext
    context.addPyFile(_shipped(context.applicationId))
    left = left.select(*[F.col(f"`{c}`").alias(c) for c in left.columns])  # columns of its own, where both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


def texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, body): the id and the text's UTF-8 bytes, null text as null."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("body"))


def bodies(batch: pa.RecordBatch, name="body") -> Iterator[bytes]:
    """A binary column's values one by one, null as empty."""
    for value in batch.column(name):
        yield value.as_py() or b""


def runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) index ranges of about `most` summed size, at least one item each."""
    start = total = i = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, i
            start, total = i, 0
    if start < i:
        yield start, i


class WordCache:
    """Values by word, computed in one call for the unseen words of a run.

    Beyond `limit` entries the cache keeps those that the latest run used, so
    memory is bounded and frequent words stay.
    """

    def __init__(self, compute: Callable[[list], Iterable], limit: int):
        self.compute, self.limit, self.known = compute, limit, {}

    def of(self, word_lists: list[list]) -> dict:
        wanted = set().union(*word_lists)
        if len(self.known) > self.limit:
            self.known = {w: v for w in wanted if (v := self.known.get(w)) is not None}
        fresh = list(wanted.difference(self.known))
        if fresh:
            self.known.update(zip(fresh, self.compute(fresh), strict=True))
        return self.known


_latest: dict = {}


def latest_cache(key, make: Callable[[], WordCache]) -> WordCache:
    """This process' cache for `key`; the one of any other key is let go, so a worker holds one."""
    if key not in _latest:
        _latest.clear()
        _latest[key] = make()
    return _latest[key]


@functools.lru_cache(1)
def tokenizer(path: str):
    """A tokenizer file, loaded once per process; Spark's tasks are the parallelism."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def crc_mod(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % modulus


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`; a group never spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        last = table.num_rows - 1
        cut = 0
        change = _changes(table, keys)
        if len(change):
            cut = int(change[-1]) + 1
        if cut and cut <= last:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
        else:
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers after which a key changes."""
    changed = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        values = table.column(key).to_numpy()
        changed |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def group_bounds(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of every group with two rows or more."""
    edge = np.concatenate(([0], _changes(table, keys) + 1, [table.num_rows]))
    big = np.flatnonzero(np.diff(edge) > 1)
    return list(zip(edge[big].tolist(), edge[big + 1].tolist(), strict=True))


def tiled(rows: DataFrame, keys: list[str], spread: Column, tile: int) -> DataFrame:
    """Rows with `_i`, `_j`: groups of over `tile` rows are cut into pairs of tiles.

    A group of n rows has m = ceil(n / tile) tiles; each row goes to the m
    tile pairs that hold its own tile (`_own`), so every pair of a group's
    rows meets in one task-sized cell, whatever the group's size.
    """
    large = rows.groupBy(*keys).count().filter(F.col("count") > tile)
    large = large.select(*keys, F.ceil(F.col("count") / tile).cast("int").alias("_m"))
    joined = rows.join(large, keys, "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    own = joined.withColumn("_own", F.pmod(spread, F.col("_m")).cast("int"))
    paired = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return paired.select(
        *[c for c in rows.columns], "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
