"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the average of the embeddings of its words' character n-grams and
whole words (hashed), a word that stands n times counting sqrt(n) times, so
that a word repeated on and on does not make up the average; embeddings and
softmax are trained jointly in numpy.
A misspelling that was never seen shares most of its n-grams with words that
were. Null and empty texts have no subwords; their score comes from the bias
alone. Every row is scored by itself, repeated ones too. Other columns are not
inputs of the score. Labels that are null, or repeated with another value, are
left out; with labels of one kind only, or none, every score is 0.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordCache, arrow_map, bodies, crc_mod, free_name, latest_cache, runs, texts


@dataclass(frozen=True)
class Settings:
    """buckets: subword table size. sample: most labelled rows of each class that are learned from."""

    buckets: int = 1 << 17
    shortest: int = 3
    longest: int = 5
    dim: int = 4
    gain: float = 32.0
    least_share: float = 0.005
    epochs: int = 10
    steps: int = 150
    batch: int = 128
    rate: float = 0.02
    damping: float = 1e-5
    decay: float = 0.02
    toxic_weight: float = 0.3
    sample: int = 1500
    seed: int = 11


def subwords(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every character n-gram of words with their ends marked, and of the words."""
    texts_ = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    size = np.fromiter(map(len, texts_), np.int64, len(texts_))
    chars = np.frombuffer("".join(texts_).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the word's end
    factor, step = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    grams = np.zeros(len(chars), np.uint64)
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        for k in range(1, s.longest + 1):
            grams[: len(chars) - k + 1] += chars[k - 1:] * factor
            factor = factor * step
            if k >= s.shortest:
                at = np.flatnonzero(room >= k)
                mixed = (grams[at] ^ (grams[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                owners.append(owner[at])
                buckets.append((mixed >> np.uint64(33)).astype(np.int64) % s.buckets)
    owners.append(np.arange(len(words)))
    buckets.append(np.fromiter((xxhash.xxh32_intdigest(w) % s.buckets for w in words), np.int64, len(words)))
    return np.concatenate(owners), np.concatenate(buckets)


def _lowered(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def _bags(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """toxic, buckets (ascending), share of each in the bag."""
    for batch in batches:
        out = []
        for body in bodies(batch):
            words = Counter(_lowered(body))
            if words:
                owner, at = subwords(list(words), s)
                total = np.bincount(at, np.sqrt(np.fromiter(words.values(), float, len(words)))[owner], s.buckets)
                found = np.flatnonzero(total)
                out.append((found.astype(np.int32), (total[found] / total.sum()).astype(np.float32)))
            else:
                out.append((np.empty(0, np.int32), np.empty(0, np.float32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32()))],
            ["toxic", "buckets", "shares"])


@dataclass
class Bags:
    """Labels and subword bags, one after another: bag i is at[start[i]:start[i + 1]] with its shares."""

    kind: np.ndarray
    start: np.ndarray
    at: np.ndarray
    share: np.ndarray

    def ordered(self) -> np.ndarray:
        """Bag numbers in an order that does not depend on partitions."""
        mark = [xxhash.xxh64_intdigest(self.at[a:b]) for a, b in zip(self.start[:-1], self.start[1:], strict=True)]
        return np.lexsort((np.array(mark, np.uint64), np.diff(self.start), self.kind))


def train(bags: Bags, s: Settings) -> tuple[np.ndarray, float]:
    """(evidence per bucket, bias): the trained embeddings applied to the softmax's difference.

    Adam steps over small batches drawn from a seed. Buckets found in few of
    the texts stay zero, else the rare subwords of single texts would be
    learned by heart. The softmax is linear in the average, so a bucket's
    whole effect is its embedding times the difference of the two classes'
    weights.
    """
    rng = np.random.default_rng(s.seed)
    order, y = bags.ordered(), bags.kind
    used = np.flatnonzero(np.bincount(bags.at, minlength=s.buckets) >= max(2, s.least_share * len(y)))
    place = np.full(s.buckets, len(used), np.int32)  # one more subword for what is not used, never counted
    place[used] = np.arange(len(used))
    share = min(0.9, max(0.1, float(np.mean(y))))
    importance = np.array([1 / (1 - share), s.toxic_weight / share]) / 2  # a clean text taken for toxic costs more than the reverse
    params = [rng.normal(0, 0.01, (len(used) + 1, s.dim)).astype(np.float32), rng.normal(0, 1, (s.dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in params]
    for step in range(1, max(s.steps, s.epochs * len(y) // s.batch) + 1):
        emb, soft, bias = params
        picked = order[rng.integers(0, len(y), s.batch)] if len(y) > s.batch else order
        goal, length = y[picked], bags.start[picked + 1] - bags.start[picked]
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        flat = np.repeat(bags.start[picked] - first, length) + np.arange(length.sum())
        cols = place[bags.at[flat]]
        value = np.where(cols < len(used), bags.share[flat], np.float32(0))[:, None] * np.float32(s.gain)
        mean = np.add.reduceat(emb[cols] * value, first, axis=0)
        logits = mean @ soft + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = ((p - np.stack((1 - goal, goal), 1)) * importance[goal][:, None] / len(picked)).astype(np.float32)
        flow = np.repeat(d @ soft.T, length, axis=0) * value
        g_emb = np.stack([np.bincount(cols, flow[:, k], len(used) + 1) for k in range(s.dim)], 1).astype(np.float32)
        for v, (m, q), g in zip(params, moments, (g_emb, mean.T @ d, d.sum(axis=0)), strict=True):
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v -= s.rate * ((m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + s.damping) + s.decay * v)
    evidence = np.zeros(s.buckets, np.float32)
    evidence[used] = s.gain * (params[0][:-1] @ (params[1][:, 1] - params[1][:, 0]))
    return evidence, float(params[2][1] - params[2][0])


def learned(docs: DataFrame, labels: DataFrame, s: Settings, id_col="doc_id", text_col="text", fold=5) -> tuple[np.ndarray, float] | None:
    """Evidence and bias from at most `s.sample` labelled rows of each class, those with the least id hashes.

    Only rows whose crc32(id as text) mod `fold` is not 0 are learned from.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    known = known.filter(crc_mod(F.col("doc_id"), fold) != 0)
    picked = None
    for kind in (0, 1):
        part = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * sample ids: a proven bound for the broadcast. Of several texts under one id, the one with the least hash counts.
    sample = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min_by("body", F.struct(F.xxhash64("body"), F.col("body"))).alias("body")).select("toxic", "body")
    found = arrow_map(sample, lambda it: _bags(it, s), "toxic int, buckets array<int>, shares array<float>").toArrow().combine_chunks()
    if not found.num_rows:
        return None
    lists = [found.column(c).chunk(0) for c in ("buckets", "shares")]
    kind, sizes = found.column("toxic").to_numpy(), np.diff(lists[0].offsets.to_numpy())
    start = np.concatenate(([0], np.cumsum(sizes[sizes > 0])))
    bags = Bags(kind[sizes > 0], start, *[x.flatten().to_numpy() for x in lists])  # views of the Arrow values
    return train(bags, s) if len(set(bags.kind.tolist())) == 2 else None


def _scores(batches, model, s: Settings, limit: int, names: list[str], body: str) -> Iterator[pa.RecordBatch]:
    evidence, bias, token = model
    cache = latest_cache(("evidence", token, limit), lambda: WordCache(None, limit))

    def compute(words):
        for a in range(0, len(words), 1 << 15):
            part = words[a:a + (1 << 15)]
            owner, at = subwords(part, s)
            found = np.bincount(owner, evidence[at], len(part)) + 1j * np.bincount(owner, minlength=len(part))
            yield from found.tolist()

    cache.compute = compute
    for batch in batches:
        texts_, out = list(bodies(batch, body)), []
        for a, b in runs(map(len, texts_), 1 << 20):
            words = [_lowered(t) for t in texts_[a:b]]
            known = cache.of(words).__getitem__
            for w in words:
                bag = Counter(w)
                total = sum(map(mul, map(known, bag), map(sqrt, bag.values())))  # evidence in the real part, subwords in the imaginary
                out.append(total.real / total.imag + bias if w else bias)
        score = pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -60, 60))), pa.float64())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], score], [*names, "score"])


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None, s: Settings, text_col="text", score_col="score", cached=200_000) -> DataFrame:
    """All columns of `docs` and the score. No shuffle."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    names, body = docs.columns, free_name(docs, "_body")
    rows = docs.withColumn(body, F.col(f"`{text_col}`").cast("string").cast("binary"))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    packed = (*model, xxhash.xxh64_intdigest(model[0].tobytes()))
    held = docs.sparkSession.sparkContext.broadcast(packed)  # the model: settings.buckets numbers
    return arrow_map(rows, lambda it: _scores(it, held.value, s, cached, names, body), schema)


def below(docs: DataFrame, model, s: Settings, limit: float, text_col="text") -> DataFrame:
    """Rows of `docs`, as they are, that score below `limit`."""
    score = free_name(docs, "_score")
    return scored(docs, model, s, text_col, score).filter(F.col(score) < limit).drop(score)


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", fold=5, settings=Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    model = learned(docs, labels, settings, id_col, text_col, fold)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = scored(rows, model, settings)
    held = F.coalesce(crc_mod(F.col("doc_id"), fold) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
