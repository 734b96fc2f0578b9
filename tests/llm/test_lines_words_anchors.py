"""Line quality, spelling forms and hard negatives against plain versions."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import line_quality as lines, negatives, spelling
from barloom.session import local_session

from .helpers import awkward_docs, frame, rows_of, sentence


@pytest.fixture(scope="module")
def spark():
    return local_session(4, shuffle_partitions=4, app="barloom-tests")


# Line quality


def test_marginals_equal_enumerated_chains():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    odds, pair, first = rng.normal(0, 2, len(doc)), rng.normal(0, 1, (2, 2)), lines.first_lines(doc)
    good, joint, norm = lines.marginals(odds, first, pair)
    for d in range(40):
        at = np.flatnonzero(doc == d)
        total, g, j = 0.0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for states in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(odds[at[k]] * states[k] for k in range(len(at))) + sum(pair[states[k - 1], states[k]] for k in range(1, len(at))))
            total += w
            g += w * np.array(states)
            for k in range(1, len(at)):
                j[k, states[k - 1], states[k]] += w
        assert np.allclose(good[at], g / total) and np.allclose(joint[at], j / total)
        assert norm[at].sum() == pytest.approx(math.log(total))


def test_long_chains_do_not_under_or_overflow():
    odds = np.tile([30.0, -30.0], 50_000)
    good, _, norm = lines.marginals(odds, lines.first_lines(np.zeros(100_000, int)), np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert np.isfinite(good).all() and np.isfinite(norm).all()


def test_training_gradient_is_the_likelihoods_slope():
    rng = np.random.default_rng(1)
    docs = [(int(k % 2), rng.normal(k % 2, 1, (rng.integers(1, 7), 4))) for k in range(30)]
    s = lines.Settings(steps=60, decay=0.0, surely=1 - 1e-12)
    label = np.concatenate([np.full(len(x), y) for y, x in docs])
    x = np.concatenate([x for _, x in docs])
    doc = np.repeat(np.arange(len(docs)), [len(x) for _, x in docs])
    first = lines.first_lines(doc)

    def likelihood(weights, pair):
        u = lines.evidence(x, first, weights)
        _, _, norm = lines.marginals(u, first, pair)
        path = u * label
        path[1:] += np.where(first[1:], 0, pair[label[:-1], label[1:]])
        size = np.bincount(doc)[doc]
        return float((path / size).sum() - (np.bincount(doc, norm) / np.bincount(doc)).sum())

    weights, pair = lines.train(docs, s)
    assert likelihood(weights, pair) > likelihood(np.zeros((3, 4)), np.zeros((2, 2))) + 5
    good, joint, _ = lines.marginals(lines.evidence(x, first, weights), first, pair)
    size = np.bincount(doc)[doc]
    for k in range(4):
        step = np.zeros_like(weights)
        step[0, k] = 1e-5
        slope = (likelihood(weights + step, pair) - likelihood(weights - step, pair)) / 2e-5
        assert slope == pytest.approx(float(((label - good) / size) @ x[:, k]), abs=1e-4)


def quality_docs():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(160):
        text = [sentence(rng, 12) for _ in range(rng.randint(1, 8))]
        good = i % 4 != 0
        if not good:
            text = [" ".join(w + rng.choice(["###", "$$$", "!!"]) for w in t.split()) for t in text]
            if i % 8 == 0:
                text.insert(0, "a clean heading line")
        rows.append((i, "\n".join(text)))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_line_quality_on_held_out_rows(spark):
    rows, labels = quality_docs()
    out = {r.doc_id: r for r in lines.line_quality(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == 160 and {i for i in out if out[i].held_out} == set(held)
    assert all(out[i].predicted == labels[i][1] and 0 <= out[i].score <= 1 for i in held)
    again = {r.doc_id: r.score for r in lines.line_quality(frame(spark, rows).repartition(7), spark.createDataFrame(labels, LABELS).repartition(3)).collect()}
    assert all(again[i] == pytest.approx(out[i].score, abs=1e-9) for i in out)


def test_line_quality_of_awkward_rows(spark):
    rows, labels = quality_docs()
    awkward = [(None if d is None else d + 1000, t) for d, t in awkward_docs()]
    labels = [*labels, (None, 1, 0), (3, 0, 0), (5, None, 0), (7, 2, 0)]
    docs = frame(spark, [*rows, *awkward])
    out = lines.line_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows) + len(awkward) and all(0 <= r.score <= 1 for r in out)
    texts = collections.defaultdict(set)
    model = lines.learned(docs, spark.createDataFrame(labels, LABELS))
    for r in lines.scored(docs, model).collect():
        texts[r.text].add(round(r.score, 12))
        if not (r.text or "").strip():
            assert r.score == pytest.approx(model.prior)
    assert all(len(v) == 1 for v in texts.values())


def test_line_quality_without_rows_or_with_one_label(spark):
    rows, labels = quality_docs()
    docs = frame(spark, rows[:9])
    assert lines.line_quality(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
    none = lines.line_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    only = lines.line_quality(docs, spark.createDataFrame([x for x in labels if x[1] == 0], LABELS)).collect()
    assert {(r.score, r.predicted) for r in only} == {(0.0, 0)}


# Spelling forms


def plain_forms(rows, shortest=6, least=5, times=5):
    low = {i: i + 32 for i in range(65, 91)}
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    v = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w in v:
        if around[w]:
            best = min(around[w], key=lambda x: (-v[x], x))
            if v[best] >= times * v[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), v[w], len(around[w]), v[form[w]] if w in form else None) for w in v)


def variant_docs():
    """Chains of variants, runs of equal letters at the middle, letters beyond ASCII, one very long word."""
    rng = random.Random(7)
    words = collections.Counter({"aaabbb": 400, "aabbbb": 80, "aabbbbb": 90, "aaabbbb": 16, "aaaabbbb": 10, "aaaaaa": 40, "aaaaaaa": 7, "aaaaaaaa": 200,
                                 "straße": 0, "größere": 60, "grossere": 5, "größeren": 12, "größer": 300, "Ærlige": 6, "ærlige": 30, "x" * 2500: 30, "x" * 2501: 6, "qwerty": 6, "qwertz": 40, "qwektz": 300})
    for _ in range(60):
        base = "".join(rng.choice("abc") for _ in range(rng.randint(6, 9)))
        words[base] += rng.choice((5, 6, 30, 31, 160))
    for a, b in itertools.product("abcde", repeat=2):
        words[f"prefix{a}{b}"] += rng.randint(5, 60)
        words[f"{a}{b}suffix"] += rng.randint(5, 60)
    flow = [w for w, k in words.items() for _ in range(k)]
    rng.shuffle(flow)
    return [(i, " ".join(flow[k::97])) for i, k in enumerate(range(97))]


@pytest.mark.parametrize("tile", [4096, 3])
def test_spelling_forms_equal_compared_pairs(spark, tile):
    rows = [*variant_docs(), *awkward_docs(), (None, "größere größere PREFIXAA"), (3, None)]
    got = rows_of(spelling.spelling_forms(frame(spark, rows), tile=tile), "word", "form", "root", "n", "n_near", "form_n")
    want = plain_forms(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)


def test_spelling_forms_of_random_short_alphabets(spark):
    rng = random.Random(11)
    for k in range(3):
        rows = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(300))) for i in range(10)]
        got = rows_of(spelling.spelling_forms(frame(spark, rows), tile=(5, 50, 4096)[k]), "word", "form", "root", "n", "n_near", "form_n")
        assert sorted(got, key=str) == sorted(plain_forms(rows), key=str)


def test_spelling_forms_without_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "tiny tiny words only once")]):
        assert spelling.spelling_forms(frame(spark, rows)).count() == 0


# Hard negatives


def plain_negatives(rows, every=50, positives=5, negatives_=3):
    kept = []
    for number, (i, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        kept.append((number, i, [math.floor(256 * x) for x in vec], label))
    last = lambda i: (i is None, i)
    out = []
    for number, i, vec, label in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(vec, v, strict=True)), last(j), same == label) for n, j, v, same in kept if n != number and len(v) == len(vec)]
        scored.sort()
        for p, (_, j), _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives_]
            out += [(i, j, r, k, -p, -s) for r, (s, (_, k), _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def vector_rows(n=420, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    rows = [(int(i), (base[i % 12] / 4 + rng.normal(0, 0.1, 8)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    hot = rows[50][1]
    rows += [(1000 + i, hot, i % 3) for i in range(200)]  # ties
    rows += [(None, hot, 1), (None, rows[3][1], None), (2000, None, 1), (2050, [], 1), (2001, [], 2), (2003, [], 1), (2100, [math.nan] * 8, 1), (2150, [0.1, None], 1),
             (2200, [0.5, 0.25, 1.0], 1), (2201, [0.5, 0.5, 1.0], 1), (2202, [0.4, 0.3, 0.6], 2), (2203, [0.2, 0.2, 0.3], 3), (2250, [math.inf] + [0.0] * 7, 1),
             (2300, [1e30] * 8, 1), (2350, [0.0] * 8, 2), (2400, [-x for x in hot], -3), (2401, [-x for x in hot], -3), rows[100], rows[100]]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sizes", [(8192, 4096), (40, 3)])
def test_negatives_equal_all_scores(spark, sizes):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS row", "'x' AS vec", "'x' AS name", "1 AS dim", "0 AS first", "'y' AS score")
    out = negatives.mined(negatives.relabelled(df), slice_rows=sizes[0], block_anchors=sizes[1])
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    finite = [r for r in rows if r[0] != 2300]  # its scores would not be exact
    assert sorted(got, key=str) == plain_negatives(finite)


def test_certified_walk_ends_early_on_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 200
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 2, (2000, 16)))
    books = tuple(negatives.codebook(h, 20, 1) for h in negatives.halves(x))
    cells = negatives.Cells(x, *(negatives.nearest(h, b) for h, b in zip(negatives.halves(x), books, strict=True)), books)
    seen = []
    plain = cells.visits
    cells.visits = lambda anchor: ((seen.append(len(rows)), (rows, rest))[1] for rows, rest in plain(anchor, 64))
    found, score = negatives.top_scores(cells, x, np.arange(2000), np.arange(2000) != 7, x[7], 5)
    want = np.lexsort((np.arange(2000), -(x @ x[7])))
    assert found.tolist() == [k for k in want if k != 7][:5] and sum(seen) < 600
    assert (np.diff(score) <= 0).all()


def test_negatives_of_empty_and_tiny_tables(spark):
    for rows in ([], [(50, [0.1, 0.2], 1)], [(50, [0.1, 0.2], 1), (51, [0.1, 0.2], 1)], [(None, None, None)]):
        assert negatives.mined(negatives.relabelled(spark.createDataFrame(rows, VECTORS))).count() == 0
