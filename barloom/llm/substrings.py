"""Substring deduplication with fixed-block anchors.

Words are cut into non-overlapping blocks per document, the index. Every
rolling window of a block's length probes it. A repeat of `window` words holds
a whole block wherever it lies, as two blocks less one word fit into it, so
each of its places is hit. Hits are then extended word by word: of the
`window`-word sequences around a hit, those are kept that are found at a
second place, and adjoining ones make up the maximal repeat. Hits are extended
against the set of all sequences rather than pair by pair, so thousands of
copies of a passage cost no more than as many different ones.

Documents travel once, into a table of slices bucketed by slice. A slice sends
each distinct hash once to the part of the hash space it belongs to, as sorted
differences, and gets back one bit for each. The index uses 32 bits within a
part; what it finds is only a candidate. Sequences are told apart by 64 bits
and their part.

Null and empty texts have no words. Rows that repeat a text or an id are
documents of their own. Other columns are passed on.
"""

import math
import os
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import work_dir
from .common import arrow_map, free_name, stored

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers stirred (multiply and fold)."""
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([_U64(1)], np.full(n - 1, base, _U64))))


class _Tables:
    """Powers of an odd base and of its inverse, made once per process."""

    up = down = None
    base = 0x9E3779B97F4A7C15

    @classmethod
    def get(cls, n: int):
        if cls.up is None or len(cls.up) < n:
            cls.up, cls.down = _powers(cls.base, n), _powers(pow(cls.base, -1, 1 << 64), n)
        return cls.up, cls.down


def word_hashes(body: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in order."""
    out = []
    at = 0
    while at < len(body):
        end = min(len(body), at + _CHUNK)
        while end < len(body) and not _BLANK[body[end]]:
            end += 1  # to the end of the word
        part = np.frombuffer(body, np.uint8, end - at, at)
        blank = np.concatenate(([True], _BLANK[part], [True]))
        starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        ends = np.flatnonzero(~blank[:-1] & blank[1:])
        up, down = _Tables.get(max(_CHUNK, len(part)) + 1)
        total = np.zeros(len(part) + 1, _U64)
        np.cumsum((part.astype(_U64) + _U64(1)) * up[: len(part)], out=total[1:])
        out.append(_mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, _U64)


def gram_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n words that start at each word."""
    if len(words) < n:
        return np.empty(0, _U64)
    size, factor = len(words) - n + 1, _U64(1)
    total = np.zeros(size, _U64)
    step = _U64(base)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += words[k:k + size] * factor
            factor = factor * step
    return _mixed(total)


def _encoded(sorted_values: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: what Spark's shuffle compresses well."""
    size = sorted_values.dtype.itemsize
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0)).view(np.uint8).reshape(-1, size).T.tobytes()


def _decoded(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class Slice:
    """One slice's documents as word hashes, and what passes one and two send about them."""

    def __init__(self, texts: list[bytes], parts: int, block: int, window: int):
        self.parts, self.block, self.window = parts, block, window
        each = [word_hashes(t) for t in texts]
        self.counts = np.array([len(x) for x in each], np.int64)
        self.words = np.concatenate(each) if each else np.empty(0, _U64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def _inside(self, n: int) -> np.ndarray:
        """Whether the n words from each place on lie in one document."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.words))
        return room[: max(0, len(self.words) - n + 1)] >= n

    def probes(self):
        """(part, 32-bit value) of the block-length window at each place, its place, and whether a block starts there."""
        grams = gram_hashes(self.words, self.block, 0xC2B2AE3D27D4EB4F)
        place = np.flatnonzero(self._inside(self.block))
        g = grams[place]
        inside = place - np.repeat(self.first[:-1], self.counts)[place]
        return (g >> _U64(32)) % _U64(self.parts), (g & _U64(0xFFFFFFFF)).astype(np.uint32), place, inside % self.block == 0

    def candidates(self, hit: np.ndarray):
        """(part, 64-bit value, place) of the sequences that hold a hit early enough."""
        near = np.concatenate(([0], np.cumsum(hit)))
        grams = gram_hashes(self.words, self.window, 0x165667B19E3779F9)
        size = len(grams)
        reach = self.window - self.block + 1
        found = (near[reach:reach + size] - near[:size] > 0) & self._inside(self.window)
        place = np.flatnonzero(found)
        g = grams[place]
        return (_mixed(g + _U64(0x632BE59BD9B4E019)) >> _U64(16)) % _U64(self.parts), g, place


def _by_part(part: np.ndarray, value: np.ndarray):
    """For each part: (part, distinct values ascending, whether repeated, order and inverse for the way back)."""
    order = np.lexsort((value, part))
    if not len(order):
        return
    edges = np.flatnonzero(np.concatenate(([True], np.diff(part[order].astype(np.int64)) != 0)))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        places = order[a:b]
        v = value[places]
        fresh = np.concatenate(([True], v[1:] != v[:-1]))
        yield int(part[places[0]]), v[fresh], np.diff(np.append(np.flatnonzero(fresh), len(v))) > 1, places, np.cumsum(fresh) - 1


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


_SENT = "part int, slice long, n long, vals binary, again binary, anchors binary"
_SENT_ARROW = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("n", pa.int64()), ("vals", pa.binary()), ("again", pa.binary()), ("anchors", pa.binary())])


def _probe_rows(s: Slice, key: int) -> list[tuple]:
    part, value, _, aligned = s.probes()
    rows = []
    for p, distinct, again, places, inverse in _by_part(part, value):
        anchors = np.zeros(len(distinct), bool)
        anchors[inverse[aligned[places]]] = True
        rows.append((p, key, len(distinct), _encoded(distinct), _bits(again), _bits(anchors)))
    return rows


def _hits(s: Slice, answers: dict[int, bytes]) -> np.ndarray:
    """Whether each word starts a block-length window that the index knows from elsewhere."""
    part, value, place, _ = s.probes()
    hit = np.zeros(len(s.words) + s.window, bool)
    for p, distinct, _again, places, inverse in _by_part(part, value):
        if p in answers:
            hit[place[places]] = _unbits(answers[p], len(distinct))[inverse]
    return hit


def _candidate_rows(s: Slice, key: int, answers: dict[int, bytes]) -> list[tuple]:
    part, value, _ = s.candidates(_hits(s, answers))
    return [(p, key, len(d), _encoded(d), _bits(again), b"") for p, d, again, _, _ in _by_part(part, value)]


def _removed(s: Slice, answers: dict[int, bytes], confirmed: dict[int, bytes]) -> np.ndarray:
    """Whether each word is covered by a repeated sequence."""
    part, value, place = s.candidates(_hits(s, answers))
    edge = np.zeros(len(s.words) + s.window + 1, np.int64)
    for p, distinct, _again, places, inverse in _by_part(part, value):
        if p in confirmed:
            starts = place[places][_unbits(confirmed[p], len(distinct))[inverse]]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + s.window, -1)
    return np.cumsum(edge)[: len(s.words)] > 0


def _judge(table: pa.Table, kind, anchored: bool, chunk=1 << 22) -> pa.Table:
    """For one part: a bit per sent value, whether it is found at two places (and an anchor is among them)."""
    slices, again = table.column("slice").to_pylist(), []
    values = [_decoded(v.as_py(), kind) for v in table.column("vals")]
    again = [_unbits(b.as_py(), len(v)) for b, v in zip(table.column("again"), values, strict=True)]
    anchors = [_unbits(b.as_py(), len(v)) for b, v in zip(table.column("anchors"), values, strict=True)] if anchored else None
    masks = [np.zeros(len(v), bool) for v in values]
    steps = max(1, sum(map(len, values)) // chunk)
    cuts = [[np.searchsorted(v, np.array(i * (2 ** (8 * np.dtype(kind).itemsize) // steps), kind)) for i in range(steps)] + [len(v)] for v in values]
    for i in range(steps):  # range by range of values, so that memory follows the part's raw size only
        spans = [(c[i], c[i + 1]) for c in cuts]
        joined = np.concatenate([v[a:b] for v, (a, b) in zip(values, spans, strict=True)])
        distinct, inverse, count = np.unique(joined, return_inverse=True, return_counts=True)
        twice = count > 1
        twice[inverse[np.concatenate([x[a:b] for x, (a, b) in zip(again, spans, strict=True)])]] = True
        if anchored:
            known = np.zeros(len(distinct), bool)
            known[inverse[np.concatenate([x[a:b] for x, (a, b) in zip(anchors, spans, strict=True)])]] = True
            twice &= known
        answer, at = twice[inverse], 0
        for m, (a, b) in zip(masks, spans, strict=True):
            m[a:b] = answer[at:at + b - a]
            at += b - a
    rows = [(s, _bits(m)) for s, m in zip(slices, masks, strict=True) if m.any()]
    part = table.column("part")[0].as_py()
    return pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()),
                     "bits": pa.array([r[1] for r in rows], pa.binary())})


def _sliced(batches: Iterator[pa.RecordBatch], text_col: str, slice_bytes: int, names: list[str], key: str) -> Iterator[pa.RecordBatch]:
    """Rows with a slice number: consecutive rows of about `slice_bytes`."""
    number, filled = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lengths, out = pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.binary())), 0).to_pylist(), []
        for n in lengths:
            if filled >= slice_bytes:
                number, filled = number + 1, 0
            filled += n + 64
            out.append(number)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, key])


def _texts(table: pa.Table, text_col: str) -> list[bytes]:
    return [v or b"" for v in table.column(text_col).cast(pa.binary()).to_pylist()]


def _answers(table: pa.Table) -> list[dict[int, bytes]]:
    """The bits by part, for each of the two passes."""
    out: list[dict[int, bytes]] = [{}, {}]
    for p, step, bits in zip(table.column("part").to_pylist(), table.column("step").to_pylist(), table.column("bits").to_pylist(), strict=True):
        out[step][p] = bits
    return out


def without_repeats(docs: DataFrame, text_col="text", window=35, slice_bytes=2 << 20, part_bytes=8 << 20, bucket_bytes=16 << 20) -> DataFrame:
    """All columns with the text reduced to its kept words, one space apart, and `_n_words`, `_n_removed`.

    Where `docs` has columns of these names, the counts get underscores before
    theirs; they are the last two columns.

    A word goes if a window of `window` words that covers it starts anywhere
    else too, in the same document or another; windows are judged on the
    input. Slices and parts grow in number with the text, up to 100,000 parts
    and buckets, and in size beyond.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    parts, buckets = (min(100_000, max(1, math.ceil(total / size))) for size in (part_bytes, bucket_bytes))
    slice_bytes = max(slice_bytes, total // 1_000_000)
    names, number = docs.columns, free_name(docs, "_slice")
    rows = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    cut = arrow_map(rows, lambda it: _sliced(it, text_col, slice_bytes, names, number), T.StructType([*rows.schema.fields, T.StructField(number, T.LongType())]))
    table = f"barloom_slices_{os.urandom(6).hex()}"
    cut.write.bucketBy(buckets, number).option("path", work_dir(spark, "slices")).saveAsTable(table)
    slices = spark.table(table)

    def sent(table: pa.Table, rows: list[tuple]) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(_SENT_ARROW.names, r, strict=True)) for r in rows], _SENT_ARROW)

    def probe(key, table):
        return sent(table, _probe_rows(Slice(_texts(table, text_col), parts, block, window), key[0].as_py()))

    def extend(key, left, right):
        if not left.num_rows or not right.num_rows:
            return sent(left, [])
        return sent(left, _candidate_rows(Slice(_texts(left, text_col), parts, block, window), key[0].as_py(), _answers(right)[0]))

    counts = [free_name(docs, c) for c in ("_n_words", "_n_removed")]
    kept_schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    at = names.index(text_col)

    def finish(key, left, right):
        texts = _texts(left, text_col)
        s = Slice(texts, parts, block, window)
        first, confirmed = _answers(right)
        gone = _removed(s, first, confirmed) if confirmed else np.zeros(len(s.words), bool)
        kept, lost = [], []
        for body, a, b in zip(texts, s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
            words = body.split()
            lost.append(int(gone[a:b].sum()))
            kept.append(b" ".join(compress(words, (~gone[a:b]).tolist()) if lost[-1] else words))
        columns = [left.column(c) for c in names]
        columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([*columns, pa.array(s.counts, pa.int64()), pa.array(lost, pa.int64())], [*names, *counts])

    answer = "slice long, part int, bits binary"
    probes = slices.select(number, text_col).groupBy(number).applyInArrow(probe, _SENT)
    hits = stored(probes.groupBy("part").applyInArrow(lambda t: _judge(t, np.uint32, True), answer), "hits").withColumn("step", F.lit(0))
    grouped = slices.select(number, text_col).groupBy(number)
    sequences = grouped.cogroup(hits.groupBy("slice")).applyInArrow(extend, _SENT)
    found = stored(sequences.groupBy("part").applyInArrow(lambda t: _judge(t, np.uint64, False), answer), "repeats").withColumn("step", F.lit(1))
    both = hits.unionByName(found)
    return slices.groupBy(number).cogroup(both.groupBy("slice")).applyInArrow(finish, kept_schema)
