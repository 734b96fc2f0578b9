"""Mixing, archives, quality, licenses, toxicity, vectors and the pipeline."""

import base64
import collections
import hashlib
import pathlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from barloom.llm import licenses, mixing, quality, toxicity, vectors, warc

from .helpers import WORD, awkward_docs, classes, frame, rows_of, sentence

LEVELS = {"domain": "CASE WHEN source IN ('src0', 'src1') THEN 'web' ELSE 'books' END", "lang": "lang", "source": "source"}


@pytest.fixture(scope="module")
def docs():
    return awkward_docs()


# Mixing.

@pytest.mark.parametrize("share,epochs,weights", [
    (0.5, 1, {}), (0.8, 2, {("web",): 5, ("web", "en"): 3, ("books", "en", "src2"): 9}), (3.0, 2, {("web",): 0}), (0.0, 1, {})])
def test_mixing_matches_its_sql(spark, docs, share, epochs, weights):
    rows = [r for r in docs if r[0] is not None]
    df = frame(spark, rows, extra=False)
    got = mixing.mixed(df, {n: F.expr(e) for n, e in LEVELS.items()}, weights, share=share, epochs=epochs, seed=4, group=4)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(mixing.mixing_sql(LEVELS, weights, share, epochs, 4)).fetchall()
    names = [c[0] for c in con.description]
    order = sorted(names)
    plain = sorted(tuple(r[names.index(c)] for c in order) for r in want)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == plain


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10, 1), ("a", "y", 1000, 1), ("b", "z", 1000, 1)], "domain string, source string, tokens long, docs long")
    out = mixing.leaf_budgets(leaves, ["domain", "source"], {}, 400, 1.0, 1)
    assert {r.source: r.budget for r in out.collect()} == {"x": 10, "y": 190, "z": 200}
    out = mixing.leaf_budgets(leaves, ["domain", "source"], {}, 2005, 1.0, 1)
    assert {r.source: r.budget for r in out.collect()} == {"x": 10, "y": 995, "z": 1000}


def test_selected_documents_follow_the_copies(spark, docs):
    df = frame(spark, docs)
    levels = {n: F.expr(e) for n, e in LEVELS.items()}
    copies = collections.Counter()
    for r in mixing.mixed(df, levels, {("web",): 4}, share=1.2, epochs=3).collect():
        copies[r.doc_id] += r.copies
    out = mixing.selected(df, levels, {("web",): 4}, share=1.2, epochs=3)
    assert out.columns == df.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == +copies


def test_mixing_an_empty_table(spark):
    assert mixing.mixed(frame(spark, []), {n: F.expr(e) for n, e in LEVELS.items()}, {}).collect() == []


# Archives.

PAGES = [(4, "http://a", "same"), (2, "http://b", "same"), (7, None, None), (9, "", ""), (9, "", ""), (1, "u", "é\r\n\r\nx" * 4000), (None, "n", "same"), (3, "x\r\nEvil: y", "other")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    out = warc.round_trip(df)
    rows = out.select(warc.page_number("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type",
                      warc.page_number("refers_to").alias("to"), "payload", "fault").collect()
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    want = []
    for page_id, _, html in PAGES:
        body, to = (html or "").encode(), first[html or ""]
        again = to != page_id
        want.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", to if again else None))
    key = lambda r: [(v is not None, v) for v in r]
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert all(r.fault is None for r in rows)
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}


def test_archives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).collect() == []


def archive(records, dictionary=b""):
    pack = zstandard.ZstdCompressor(write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(warc.LINE_END + pack.compress(r) for r in records)


def test_reader_uses_the_leading_dictionary_and_checks_records():
    rng = random.Random(1)
    payloads = [f"<html>{sentence(rng, 80)}</html>".encode() for _ in range(60)]
    good = [warc.record(i, "u", p, warc.digest32(hashlib.sha1(p).digest()), None, "2024-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    dictionary = warc.train_dictionary(payloads, 2048)
    assert dictionary
    data = archive(good, dictionary)
    read = list(warc.read_archive(data))
    assert [fault for *_, fault in read] == [None] * 60
    assert [warc.payload_of(h, b)[1] for _, h, b, _ in read] == payloads
    raw = struct.pack("<II", warc.DICTIONARY, len(dictionary)) + dictionary  # a dictionary may also stand uncompressed
    assert [f for *_, f in warc.read_archive(raw + data[len(warc.dictionary_frame(dictionary)):])] == [None] * 60
    bad = [good[0].replace(b"WARC/1.1", b"WARC/9"), good[0].replace(b"Content-Length: ", b"Content-Length: 1", 1), good[0][:-1], good[0].replace(b"WARC-Date", b"Date"),
           good[0].replace(b"</html>", b"</HTML>"), good[1]]
    faults = [f for *_, f in warc.read_archive(archive(bad))]
    assert all(faults[:5]) and faults[5] is None
    assert [f for *_, f in warc.read_archive(data[:-3])][-1] == "truncated frame"
    assert [f for *_, f in warc.read_archive(b"junk junk")] == ["no frame"]


# Quality.

def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered, seen, repeated = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update((i, i + 1, i + 2))
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_features_and_ratio(spark, docs):
    import xxhash

    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)] + [(None,)], "doc_id long")
    buckets = 256
    got = quality.judged(frame(spark, docs), trusted, buckets=buckets).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(plain_features(t) for _, t in docs)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def grams(text):
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in WORD.findall(text or "")]
        raw = [struct.pack("<Q", h) for h in one]
        two = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(raw, raw[1:], strict=False)]
        return [signed(h) % buckets for h in one + two]

    raw, good = collections.Counter(), collections.Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d is not None and d < 30 and d % 2 == 0:
            good.update(grams(t))
    n_raw, n_good = sum(raw.values()), sum(good.values())
    ratio = [round(float(np.log((good[b] + 1) / (n_good + buckets)) - np.log((raw[b] + 1) / (n_raw + buckets))) * quality.UNIT) for b in range(buckets)]
    want = sorted((len(g), sum(ratio[b] for b in g) / (len(g) * quality.UNIT)) for _, t in docs if (g := grams(t)))
    found = sorted((2 * r.n_words - 1, r.ratio) for r in got if r.n_words)
    assert np.allclose(np.array(found), np.array(want), rtol=0, atol=1e-6)
    assert all(r.kept == (not r.base_failed and r.ratio is not None and r.ratio >= -0.045) for r in got)


def test_quality_without_labels_or_rows(spark, docs):
    nobody = spark.createDataFrame([], "doc_id long")
    assert all(r.kept == (not r.base_failed) for r in quality.judged(frame(spark, docs), nobody, buckets=64).collect())
    assert quality.judged(frame(spark, []), nobody, buckets=64).collect() == []


# Licenses.

def test_license_names_and_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [None, "", "MIT License", "the mit\n--license-- and Apache  license. mit license", "GNU general public. license", mit, "x " * 30 + mit.upper(),
             "Permission is granted to any person obtaining a copy", "Licensed under CC BY-NC 4.0.", "licensed under nothing", "a MIT Licenseé", "license " * 2000]
    texts += [f"plain words number {i}" for i in range(40)]
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].base_labels) == (1, 0, 0, "mit")
    assert (rows[3].n_words, rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (8, 3, 1, 6, "apache,mit")
    assert rows[4].base_labels == "gpl"
    assert (rows[5].base_labels, rows[5].labels) == ("", "mit") and rows[5].score > 0.7
    assert rows[6].labels == "mit"
    assert rows[7].labels == "" and rows[9].labels == "" and rows[10].base_labels == ""
    assert rows[8].labels == "cc-by-nc-4.0" and rows[8].score == 1.0
    assert rows[11].n_words == 2000 and rows[11].labels == ""
    assert all(0 <= r.score <= 1 for r in rows.values())


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"


def test_a_notice_in_a_third_of_the_rows_and_in_the_only_row(spark):
    texts = [BSD if i % 3 == 0 else f"plain words number {i}" for i in range(30)]
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert all((r.labels, r.score) == (("bsd", 1.0) if i % 3 == 0 else ("", 0.0)) for i, r in rows.items())
    only = licenses.scan(frame(spark, [(1, "Licensed under CC BY-NC 4.0")])).collect()
    assert [(r.labels, r.score) for r in only] == [("cc-by-nc-4.0", 1.0)]


def test_two_notices_in_one_file_and_every_notice_in_a_long_one(spark):
    both = f"{BSD} plain words. Licensed under CC BY-NC 4.0"
    every = " then ".join(notice for _, notice, _ in licenses.TEMPLATES)
    late = "permission " * 3000 + every
    texts = [both, every, late, "hereby permission " * 500, "redistribution of binary forms"] + [f"under nc cc 4 0 by number {i}" for i in range(20)]
    rows = {r.doc_id: r.labels for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    labels = ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert rows[0] == "bsd,cc-by-nc-4.0" and rows[1] == rows[2] == labels
    assert not any(rows[i] for i in range(3, len(texts)))


def test_licenses_of_awkward_and_no_documents(spark, docs):
    got = licenses.scan(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    assert licenses.scan(frame(spark, [])).collect() == []


# Toxicity.

def toxic_tables(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = sentence(rng, 40).split()
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["zorkvax", "quibblurk"]) + rng.choice(["", "s", "ed", "er"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rows, labels = toxic_tables(spark)
    odd = [(9001, None), (9002, ""), (9003, sentence(random.Random(4), 30) + " zorkvaxxx"), (9004, sentence(random.Random(5), 5000)), (None, "x y"), rows[0], rows[0]]
    out = toxicity.toxicity(frame(spark, rows + odd), labels).collect()
    assert len(out) == len(rows) + len(odd)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < len(rows)]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    scores = {r.doc_id: r.score for r in out}
    assert scores[9003] > scores[9004]


def test_toxicity_without_usable_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark, docs), labels).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), labels).collect() == []
    df = frame(spark, docs)
    assert toxicity.below(df, None, toxicity.Settings(), 0.5).columns == df.columns


# Vectors.

def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [b for b in base for _ in range(2)]
    rows = [r + rng.normal(size=16) * s for r in rows for s in (0, 0.05, 0.2)]
    rows += [rows[0] * 3, np.zeros(16), np.full(16, 1e-30)]
    data = [(i, [float(x) for x in r], "extra") for i, r in enumerate(rows)]
    odd = [(5000, None), (5001, []), (5002, [1.0, None]), (5003, [float("nan")] * 16), (5004, [float("inf")] + [0.0] * 15), (5005, [1.0, 0.0]), (5006, [2.0, 0.0])]
    data += [(i, v, "extra") for i, v in odd] + [(7, data[7][1], "extra")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n string")
    got = {}
    for r in vectors.near_duplicates(df, recall=0.9999, tile=4).collect():
        got.setdefault(r.vec_id, r)
    usable = [i for i, v, _ in data if v and None not in v and all(map(np.isfinite, v)) and any(v)]
    values = [v for _, v, _ in data if v and None not in v and all(map(np.isfinite, v)) and any(v)]
    pairs = []
    for a in range(len(values)):
        for b in range(a):
            if len(values[a]) == len(values[b]):
                x, y = (np.array(values[k]) / np.abs(values[k]).max() for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    pairs.append((a, b))
    links, root = collections.Counter(k for p in pairs for k in p), classes(len(values), pairs)
    least = {}
    for i, r in zip(usable, root, strict=True):
        least[r] = min(least.get(r, i), i)
    for k, i in enumerate(usable):
        assert (got[i].n_links, got[i].component_id) == (links[k], least[root[k]]), i
    for i in (120 * 3 + 1, 5000, 5001, 5002, 5003, 5004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    dim, y = 64, rng.normal(size=64)
    y /= np.linalg.norm(y)
    x = rng.normal(size=64)
    x /= np.linalg.norm(x)
    errors = []
    for seed in range(300):
        turn = vectors.rotations(dim, 1, seed)
        a, b = x @ turn, y @ turn
        code = np.sign(a) / 8
        f = code @ a
        errors.append((code @ b / f - x @ y) / (np.sqrt((1 - f * f) / (f * f)) / np.sqrt(dim - 1)))
    assert abs(np.mean(errors)) < 0.2 and np.max(np.abs(errors)) < 4


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# Pipeline.

def test_pipeline_stages_keep_their_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_tables(spark, 150)
    rng = random.Random(6)
    passage = sentence(rng, 50)
    rows += [(1000 + i, sentence(rng, 60) + " " + passage) for i in range(3)] + [(2000, rows[1][1]), (2001, None), (2002, "")]
    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.collect()
    clean = {d for d, _ in rows if d is not None and (d >= 1000 or d % 3)}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len(clean - kept) <= 2 and len(kept - clean) <= 3
    assert 2000 not in {r.doc_id for r in seen["simhash"]}
    assert all(passage not in r.text for r in seen["substrings"])
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["substrings"]}
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["mixing"]}
    assert len(corpus_pipeline.run(spark, str(tmp_path)).columns) == 9


def test_nothing_else_imports_the_subpackage():
    top = pathlib.Path(__file__).resolve().parents[2]
    others = [p for d in ("barloom", "suite", "tools", "tests") for p in (top / d).rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if re.search(r"\bllm\b", p.read_text())]
    assert rows_of  # helpers are importable on their own
