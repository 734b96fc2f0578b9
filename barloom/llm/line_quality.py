"""Document quality from a linear-chain conditional random field over lines.

A line is a \\n-separated piece of a text with something in it besides blanks.
Its evidence comes from its own features and those of the lines before and
after it; the chain's two states are good and bad, and one weight for each
pair of neighbouring states links the lines. A document's score is the mean of
its lines' marginal probabilities of being good, weighted by their lengths in
bytes; the marginals come from forward-backward. Forward and backward products
are scanned: the 2 x 2 factors of all lines of a batch are multiplied in
doubling steps that stop at document ends, so a text of very many lines needs
no more steps than the logarithm of their number.

Training takes a bounded sample of labelled rows (see Settings), whole texts
only. Every line starts with its document's label. Then lines of bad documents
that the evidence alone finds good (a clean heading above junk) are relabelled
and the field is trained once more, which teaches it where states change.

Null, empty and blank texts have no lines; their score is the share of good
rows among those learned from. Labels that are null or repeated with another
value are left out; where an id stands for several texts, the text with the
least hash is learned from. With labels of one kind only, every score is that
kind, without any 0.5. Every row is scored by itself, repeated ones too, and
all rows are returned. Other columns are not inputs of a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_map, bodies, crc_mod, free_name, runs


@dataclass(frozen=True)
class Settings:
    """sample: most rows of each label that are learned from; their texts have at most `lines` lines each."""

    sample: int = 1500
    lines: int = 1024
    steps: int = 120
    rate: float = 0.1
    decay: float = 1e-3
    surely: float = 0.9


_U64 = np.uint64
#: Byte classes: 0 other, 1 blank, 2 lower case, 3 upper case, 4 digit, 5 sentence mark, 6 symbol, 7 start of a wide character, 8 rest of one.
_CLASS = np.zeros(256, np.uint8)
for _kind, _chars in ((1, b" \t\r\x0b\x0c"), (2, bytes(range(97, 123))), (3, bytes(range(65, 91))), (4, b"0123456789"), (5, b".,;:?'\"()-"), (6, b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASS[list(_chars)] = _kind
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 7, 8
_STEP = _U64(0x9E3779B97F4A7C15)
FEATURES = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(29))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, up to 16 bytes from either end and its length: enough to tell repeated words and lines."""
    size = (ends - starts).astype(np.int64)
    out = size.astype(_U64) * _STEP
    for k in range(16):
        near = np.minimum(starts + k, ends - 1)
        far = np.maximum(ends - 1 - k, starts)
        out = _mixed(out * _STEP + data[near].astype(_U64) + (data[far].astype(_U64) << _U64(8)))
    return out


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its length, its features) for all lines that are not blank."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_end, start, "right")
    kind = _CLASS[data]
    solid = (kind != 1) & (data != 10)
    filled = np.add.reduceat(solid, start) > 0 if len(start) else np.empty(0, bool)
    if not filled.any():
        return np.empty(0, np.int64), np.empty(0), np.empty((0, FEATURES))
    # Words: runs of solid bytes. A line break is not solid, so a word lies in one line.
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    word_start, word_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line_of = np.searchsorted(stop, word_start)
    n = len(start)
    words = np.bincount(line_of, minlength=n).astype(float)
    word_hash = _hashes(data, word_start, word_end)
    again = np.zeros(len(word_start))
    again[1:] = (word_hash[1:] == word_hash[:-1]) & (line_of[1:] == line_of[:-1])
    last = data[word_end - 1]
    marked = _CLASS[last] == 6
    alone = marked & (word_end - word_start == 1)
    counts = np.stack([np.add.reduceat(kind == c, start) for c in range(2, 8)], 1).astype(float)
    length = (stop - start).astype(float)
    letters = np.maximum(1, counts[:, 0] + counts[:, 1] + counts[:, 5])
    chars = np.maximum(1, counts.sum(axis=1))
    per_word = lambda x: np.bincount(line_of, x, n) / np.maximum(1, words)
    whole = _hashes(data, start, np.maximum(stop, start + 1))
    mixed = _mixed(whole ^ _mixed(doc.astype(_U64) * _STEP + _U64(1)))
    _, first = np.unique(mixed, return_index=True)
    repeated = np.ones(n)
    repeated[first] = 0
    x = np.stack([
        np.ones(n), counts[:, 1] / letters, counts[:, 2] / chars, counts[:, 3] / chars, counts[:, 4] / chars, np.minimum(1, 10 * counts[:, 4] / chars),
        per_word(marked.astype(float)), per_word(alone.astype(float)), per_word(again), np.minimum(1, per_word((word_end - word_start).astype(float)) / 20),
        np.minimum(1, words / 50), (words < 3).astype(float), repeated, np.minimum(1, np.log1p(length) / 10),
        counts[:, 5] / letters, (np.add.reduceat(kind == 0, start) / np.maximum(1, length)),
    ], 1)
    return doc[filled], length[filled], x[filled]


def first_lines(doc: np.ndarray) -> np.ndarray:
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    return first


def evidence(x: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of good for every line from its features and its neighbours'; weights: (3, features)."""
    mine, before, after = (x @ w for w in weights)
    out = mine
    out[1:] += np.where(first[1:], 0, before[:-1])
    out[:-1] += np.where(first[1:], 0, after[1:])
    return out


def _scan(factor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running products of 2 x 2 factors from each document's first line on, scaled to a largest entry of 1."""
    a, b, c, d = (factor[:, i, j].copy() for i in (0, 1) for j in (0, 1))
    left, step = np.flatnonzero(~first), 1  # lines whose product does not reach their document's first line yet
    start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    while len(left):
        p = left - step
        w, x, y, z = a[p] * a[left] + b[p] * c[left], a[p] * b[left] + b[p] * d[left], c[p] * a[left] + d[p] * c[left], c[p] * b[left] + d[p] * d[left]
        top = np.maximum(np.maximum(w, x), np.maximum(y, z))
        a[left], b[left], c[left], d[left] = w / top, x / top, y / top, z / top
        step *= 2
        left = left[left - step >= start[left]]
    return np.stack((a, b, c, d), 1).reshape(-1, 2, 2)


def marginals(log_odds: np.ndarray, first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, P(states of a line and the one before it), log of all partition sums).

    States: 0 bad, 1 good. pair[a, b] is the weight of state b after state a.
    """
    u = np.clip(log_odds, -40, 40)
    top = np.maximum(u, 0)
    local = np.exp(np.stack([-top, u - top], 1))
    link = np.exp(pair - pair.max())
    factor = link[None] * local[:, None, :]
    factor[first] = 0
    factor[first, 0, :] = local[first]  # a first line has none before it
    ahead = _scan(factor, first)[:, 0, :]
    ahead = ahead / ahead.sum(axis=1, keepdims=True)
    last = np.ones(len(u), bool)
    last[:-1] = first[1:]
    # Backward: the same scan from the other end, over transposed factors of the following lines.
    follow = np.zeros_like(factor)
    follow[:-1] = link[None] * local[1:, None, :]
    follow[last] = 0
    follow[last, :, 0] = 1
    behind = _scan(follow[::-1].transpose(0, 2, 1), last[::-1])[:, 0, :][::-1]
    behind = behind / behind.sum(axis=1, keepdims=True)
    both = ahead * behind
    good = both[:, 1] / both.sum(axis=1)
    joint = np.zeros((len(u), 2, 2))
    joint[1:] = ahead[:-1, :, None] * link[None] * (local * behind)[1:, None, :]
    joint[first] = 0
    total = joint.sum(axis=(1, 2), keepdims=True)
    joint = np.divide(joint, total, out=joint, where=total > 0)
    # The share each line adds to its document's partition sum.
    entry = np.empty((len(u), 2))
    entry[1:] = ahead[:-1] @ link
    entry[first] = 1
    norm = np.log((entry * local).sum(axis=1)) + top + np.where(first, 0, pair.max())
    return good, joint, norm


def train(docs: list[tuple[int, np.ndarray]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights (3, features), pair weights) by Adam on the weighted conditional log-likelihood.

    Classes weigh the same, and so do the documents of a class, whatever their number of lines.
    """
    label = np.concatenate([np.full(len(x), y) for y, x in docs]).astype(float)
    x = np.concatenate([x for _, x in docs])
    doc = np.repeat(np.arange(len(docs)), [len(x) for _, x in docs])
    first = first_lines(doc)
    kinds = np.array([y for y, _ in docs])
    share = np.where(kinds == 1, 0.5 / max(1, (kinds == 1).sum()), 0.5 / max(1, (kinds == 0).sum()))
    weight = (share / np.array([len(x) for _, x in docs]))[doc]
    weights, pair = np.zeros((3, x.shape[1])), np.zeros((2, 2))
    for turn in range(2):
        if turn:
            surely = evidence(x, first, weights) > np.log(s.surely / (1 - s.surely))
            label = np.where((label == 0) & surely, 1.0, label)
        params = np.concatenate((weights.ravel(), pair.ravel()))
        m, q = np.zeros_like(params), np.zeros_like(params)
        stay = np.zeros((len(label), 2, 2))
        stay[np.arange(1, len(label)), label[:-1].astype(int), label[1:].astype(int)] = 1
        stay[first] = 0
        for step in range(1, s.steps + 1):
            weights, pair = params[:-4].reshape(3, -1), params[-4:].reshape(2, 2)
            good, joint, _ = marginals(evidence(x, first, weights), first, pair)
            off = weight * (label - good)
            own = off @ x
            before = np.where(first[1:], 0, off[1:]) @ x[:-1]
            after = np.where(first[1:], 0, off[:-1]) @ x[1:]
            link = np.tensordot(weight, stay - joint, 1)
            gradient = np.concatenate((own, before, after, link.ravel())) - s.decay * params
            m += 0.1 * (gradient - m)
            q += 0.01 * (gradient * gradient - q)
            params = params + s.rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
        weights, pair = params[:-4].reshape(3, -1), params[-4:].reshape(2, 2)
    return weights, pair


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None
    pair: np.ndarray | None
    prior: float


def quality_scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, by text."""
    out = np.full(len(texts), model.prior)
    doc, length, x = line_features(texts)
    if model.weights is not None and len(doc):
        first = first_lines(doc)
        good, _, _ = marginals(evidence(x, first, model.weights), first, model.pair)
        total = np.bincount(doc, length, len(texts))
        mean = np.bincount(doc, good * length, len(texts))
        out = np.where(total > 0, mean / np.maximum(total, 1e-300), out)
    return np.clip(out, 0, 1)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body in bodies(batch):
            _, _, x = line_features([body])
            rows.append(x.astype(np.float32).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.list_(pa.float32()))], ["quality", "x"])


def learned(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col="doc_id", text_col="text", fold=5) -> Model:
    """The field, learned from at most `s.sample` rows of each label: those with the least id hashes.

    Only rows whose crc32(id as text) mod `fold` is not 0 are learned from.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).filter("id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    known = known.filter(crc_mod(F.col("id"), fold) != 0)
    seen = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = seen.get(1, 0) / sum(seen.values()) if seen else 0.5
    if len(seen) < 2:
        return Model(None, None, prior)
    picked = None
    for kind in (0, 1):
        part = known.filter(F.col("quality") == kind).orderBy(F.xxhash64("id"), "id").limit(s.sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("body"))
    # At most 2 * sample ids: a proven bound for the broadcast.
    rows = rows.join(F.broadcast(picked), "id").filter(F.length(F.regexp_replace(F.col("body").cast("string"), "[^\n]+", "")) < s.lines)
    one = rows.groupBy("id", "quality").agg(F.min_by("body", F.struct(F.xxhash64("body"), F.col("body"))).alias("body"))
    found = arrow_map(one.select("quality", "body"), _train_rows, "quality int, x array<float>").toArrow()
    texts_ = [(y, np.array(x, np.float64).reshape(-1, FEATURES)) for y, x in zip(found.column("quality").to_pylist(), (v.values.to_numpy() for v in found.column("x")), strict=True) if len(x)]
    if len({y for y, _ in texts_}) < 2:
        return Model(None, None, prior)
    texts_.sort(key=lambda t: (t[0], len(t[1]), t[1].tobytes()))  # row order does not depend on partitions
    return Model(*train(texts_, s), prior)


def scored(docs: DataFrame, model: Model, text_col="text", score_col="score") -> DataFrame:
    """All columns of `docs` and the score. No shuffle."""
    names, body = docs.columns, free_name(docs, "_body")
    rows = docs.withColumn(body, F.col(f"`{text_col}`").cast("string").cast("binary"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    def task(batches):
        for batch in batches:
            texts_, parts = list(bodies(batch, body)), []
            for a, b in runs(map(len, texts_), 1 << 20):
                parts.append(quality_scores(texts_[a:b], held.value))
            score = pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], score], [*names, score_col])

    return arrow_map(rows, task, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def line_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", fold=5, good=0.3, settings=Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    model = learned(docs, labels, settings, id_col, text_col, fold)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(crc_mod(F.col("doc_id"), fold) == 0, F.lit(False))
    return scored(rows, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))
