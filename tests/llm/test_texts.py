"""Token counts, packing, SimHash and substring dedup against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from barloom.llm import packing, simhash, substrings, token_counts

from .helpers import ASCII_LOWER, WORD, awkward_docs, classes, frame, hamming, rows_of, sentence

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs():
    return awkward_docs()


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_token_counts_are_the_librarys(spark, docs):
    tok = Tokenizer.from_file(BYTE_BPE)
    want = sorted(((d is not None, d or 0), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in docs)
    for chunk in (1 << 16, 50):
        got = token_counts.token_counts(frame(spark, docs), BYTE_BPE, limit=100, chunk=chunk, overlap=8, cached=30).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_splicing_widens_until_chunks_align():
    tok, rng = Tokenizer.from_file(BYTE_BPE), random.Random(2)
    pieces = ["foo", " ", "  ", "\n", "<|endoftext|>", "12345", "'s", "...", "　", "😀"]
    widened = 0
    for _ in range(150):
        text = "".join(rng.choice([*pieces, "é" * rng.randint(1, 60), "a" * rng.randint(1, 90)]) for _ in range(rng.randint(1, 60)))
        n, _, w = token_counts.spliced_count(tok, text, rng.choice([20, 40, 64]), rng.choice([4, 8, 16]), 14)
        assert n == len(tok.encode(text, add_special_tokens=False).ids)
        widened += w
    assert widened > 0
    assert token_counts.spliced_count(tok, "b" * 500, 20, 4, 14)[0] == len(tok.encode("b" * 500).ids)


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(frame(spark, []), BYTE_BPE).collect() == []


def check_pieces(pieces, docs, limits):
    tok = Tokenizer.from_file(WORD_BPE)
    ids = collections.Counter()
    for _, t in docs:
        ids[np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    by_crc = collections.Counter()
    for data, n in ids.items():
        by_crc[(len(data) // 4, zlib.crc32(data))] += n
    by_doc = collections.defaultdict(list)
    for d, t in docs:
        by_doc[d].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for x in by_doc[p.doc_id])
    sequences, whole = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        sequences[p.sequence_id].append(p)
        if p.length == p.doc_tokens:
            whole[(p.length, p.ids_crc32)] += 1
    assert not whole - by_crc
    assert sum(p.length for p in pieces) == sum(len(k) // 4 * n for k, n in ids.items())
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.segment < len(parts)
            at += p.length
        assert at <= limits[0] and len(parts) <= limits[1] and sum(p.loss_tokens for p in parts) <= limits[2]
    return sequences


@pytest.mark.parametrize("limits", [(4096, 256, 4096), (64, 3, 64), (64, 8, 20), (1, 1, 1)])
def test_packing_keeps_every_id_once_within_the_limits(spark, docs, limits):
    tokens, segments, loss = limits
    out = packing.pack(frame(spark, docs).coalesce(1), WORD_BPE, max_tokens=tokens, max_segments=segments, max_loss=loss, pool=8, cached=20).collect()
    sequences = check_pieces(out, docs, limits)
    if limits[0] == 4096:  # nothing but full sequences and powers of two
        assert all((n := sum(p.length for p in s)) & (n - 1) == 0 for s in sequences.values())


def test_packed_pieces_of_one_document_lie_end_to_end(spark):
    out = packing.pack(frame(spark, [(1, "word " * 500), (2, "x")]), WORD_BPE, max_tokens=128, max_segments=4, max_loss=128).collect()
    at = 0
    for p in sorted((p for p in out if p.doc_id == 1), key=lambda p: p.start):
        assert p.start == at
        at += p.length
    assert at == 501


def test_instruction_data_counts_only_answers_as_loss(spark):
    df = spark.createDataFrame([(i, "a b c d e f", 4) for i in range(12)], "id long, t string, prompt int")
    out = packing.pack(df, WORD_BPE, id_col="id", text_col="t", loss_start_col="prompt", max_tokens=64, max_segments=9, max_loss=9).collect()
    assert sum(p.loss_tokens for p in out) == 12 * 3
    used = collections.Counter()
    for p in out:
        used[p.sequence_id] += p.loss_tokens
    assert max(used.values()) <= 9


def test_ids_of_any_text_are_the_librarys():
    tok, rng = Tokenizer.from_file(WORD_BPE), random.Random(3)
    alphabet = ["a", "Be", "don", "'t", "'S", "'", "..", ",", "_", "9", "½", "é", "e\u0301", "…", "—", "😀", "ß", "Σ", "\x01", "\x1f", "\u3000", "\n", " ", "\t", "<|endoftext|>", "<|", "#", "中文", "{x}"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, (ids, head) in zip(texts, packing.id_bytes([t.encode() for t in texts], WORD_BPE, 50), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
        if "\n" in text and "<" not in text:
            assert head == len(tok.encode(text[:text.index("\n")], add_special_tokens=False).ids)
        elif "\n" not in text:
            assert head == 0


def test_every_limit_changes_what_is_packed(spark):
    rng = random.Random(8)
    docs = [(i, sentence(rng, rng.randint(1, 30)) + "\n" + sentence(rng, rng.randint(1, 60))) for i in range(120)]
    limits = {"tokens": (512, 900, 512), "segments": (512, 3, 512), "loss": (512, 900, 300), "both": (512, 4, 300)}
    found = {}
    for name, (tokens, segments, loss) in limits.items():
        out = packing.pack(frame(spark, docs).coalesce(1), WORD_BPE, max_tokens=tokens, max_segments=segments, max_loss=loss, pool=40, prompts=True).collect()
        sequences = check_pieces(out, docs, limits[name])
        found[name] = {(p.doc_id, p.start, p.sequence_id) for p in out}
        most = max(sum(p.loss_tokens for p in s) for s in sequences.values())
        assert (max(map(len, sequences.values())) == segments) == (name in ("segments", "both"))
        assert most > 0.9 * loss or name in ("tokens", "segments")
    assert len(set(map(frozenset, found.values()))) == 4


def test_repeats_of_documents_with_the_counts_names(spark):
    df = frame(spark, [(1, "a b c"), (2, None)]).selectExpr("*", "'x' AS _n_words", "'y' AS _N_REMOVED")
    out = substrings.without_repeats(df)
    assert out.columns == [*df.columns, "__n_words", "__n_removed"]
    assert sorted((r["__n_words"], r["_n_words"]) for r in out.collect()) == [(0, "x"), (3, "x")]


def test_packing_an_empty_table(spark):
    assert packing.pack(frame(spark, []), WORD_BPE).collect() == []


def test_fingerprints_and_groups(spark, docs):
    got = simhash.near_duplicates(frame(spark, docs), tile=3)
    fps = [plain_fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if hamming(fps[i], fps[j]) <= 3]
    root = classes(len(docs), pairs)
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = [(d, np.uint64(f).astype(np.int64).item(), least[r]) for (d, _), f, r in zip(docs, fps, root, strict=True)]
    assert rows_of(got, "doc_id", "fp", "component_id") == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_block_keys_and_tiles_lose_no_link(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for k in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).astype(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.fingerprint_links(df, simhash.pivots(), tile=2).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all(hamming(fps[at[r.a]], fps[at[r.b]]) <= 3 * len(fps) for r in links)
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if hamming(fps[i], fps[j]) <= 3])
    assert classes(len(fps), [(at[r.a], at[r.b]) for r in links]) == want


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def edited(rng, text, share):
    return " ".join(sentence(rng, 1) if rng.random() < share else w for w in text.split())


def test_one_row_of_each_group_of_similar_texts_stays(spark):
    rng = random.Random(3)
    rows = []
    for base in (sentence(rng, n) for n in (6, 12, 40, 150, 400, 400, 9000)):
        rows += [(len(rows) + k, edited(rng, base, share)) for k, share in enumerate((0, 0.004, 0.01, 0.02, 0.02, 0.03, 0.05, 0.2))]
    rows += [(1000, rows[0][1].upper()), (1001, rows[9][1] + " one more"), (1002, None), (1003, ""), (None, rows[17][1])]
    rng.shuffle(rows)
    sets = [shingle_set(t) for _, t in rows]
    root = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    want = {}
    for (d, _), r in zip(rows, root, strict=True):
        want[r] = min((x for x in (want.get(r), d) if x is not None), default=None)
    assert 15 < len(want) < len(rows) - 10
    for near in (simhash.Near(), simhash.Near(tile=3, tile_bytes=2000)):
        out = simhash.one_per_group(frame(spark, rows), near=near)
        assert out.columns == frame(spark, rows).columns
        assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(want.values())


def test_set_similarity_and_its_band_keys():
    near = simhash.Near()
    rng = np.random.default_rng(2)
    met = 0
    for k in range(300):
        pool = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        x, y = np.unique(pool[:162]), np.unique(pool[18:])  # 144 of 180 shared: exactly 0.8
        assert simhash.jaccard(x, y) == 0.8
        met += bool(set(simhash.band_keys(x, near)) & set(simhash.band_keys(y, near)))
    assert met >= 297
    none = np.zeros(0, np.uint64)
    assert simhash.jaccard(none, none) == 1.0 and simhash.jaccard(none, x) == 0.0 and simhash.band_keys(none, near) == []


def test_the_stage_keeps_one_row_of_each_group_whatever_the_ids(spark, docs):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, *others = (sentence(rng, 60) for _ in range(8))
    rows = [(3, a), (5, a), (5, b), (None, b), *[(None, t) for t in others], (None, others[0]), (8, None), (8, None), (None, "")]
    df = frame(spark, rows)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert rows_of(out, "doc_id", "text") == rows_of(frame(spark, [(3, a), (5, b), *[(None, t) for t in others], (8, None)]), "doc_id", "text")
    df = frame(spark, docs)
    sets = [shingle_set(t) for _, t in docs]
    groups = classes(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if similar(sets[i], sets[j])])
    least = {}
    for (d, _), g in zip(docs, groups, strict=True):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    kept = collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == collections.Counter(least.values())
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").collect() == []


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def plain_removal(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        out.append((len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 400, "part_bytes": 900, "bucket_bytes": 2000}])
def test_repeated_passages_go(spark, docs, sizes):
    df = frame(spark, docs)
    out = substrings.without_repeats(df, **sizes)
    assert out.columns == [*df.columns, "_n_words", "_n_removed"]
    got = sorted((r._n_words, r._n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert got == sorted(plain_removal([t for _, t in docs], 35))


def test_overlapping_repeats_in_one_text(spark):
    rng = random.Random(3)
    words = [rng.choice("ab") for _ in range(2500)]  # few words, many repeats at every offset
    texts = [" ".join(words), "a " * 300, "b " * 34, "b " * 35]
    out = substrings.without_repeats(frame(spark, list(enumerate(texts))), window=9, slice_bytes=500)
    got = sorted((r._n_words, r._n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert got == sorted(plain_removal(texts, 9))


def test_substrings_of_an_empty_table(spark):
    assert substrings.without_repeats(frame(spark, [])).collect() == []
