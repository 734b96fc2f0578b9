"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

Nulls and empty texts have 0 tokens. Repeated rows and ids are counted row by
row. Other columns of the input are not read.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordCache, arrow_map, latest_cache, runs, tokenizer

#: White space besides ASCII's; a text that holds any is encoded without cutting it at blanks.
OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
BLANK_WORD = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def encoded(tok, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start of each token, whether it begins a pre-token) in characters of `text`."""
    e = tok.encode(text, add_special_tokens=False)
    starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
    words = np.fromiter((-1 if w is None else w for w in e.word_ids), np.int64, len(e.ids))
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return starts, first


def spliced_count(tok, text: str, chunk: int, overlap: int, margin: int) -> tuple[int, int, int]:
    """(tokens, chunks encoded, times an overlap was widened) of one text.

    A chunk starts at a boundary of the whole text's pre-tokens, so its own
    pre-token boundaries are the whole text's as long as its cut end cannot
    have changed them: all but the last `margin` characters. The next chunk
    starts somewhere in the overlap. Where one of its boundaries falls on one
    that is already proven, the scan is in the same state there as that of
    the whole text, and all tokens after it are proven too. If no boundary
    is shared, the overlap is doubled; at worst it reaches the chunk's own
    start, which is a proven boundary.
    """
    total = chunks = widened = done = 0
    end = min(len(text), chunk)
    starts, first = encoded(tok, text[:end])
    base = 0
    chunks += 1
    while end < len(text):
        width = overlap
        proven = starts[first] + base
        proven = proven[(proven > done) & (proven <= end - margin)]
        while True:
            begin = max(done, end - width)
            upto = min(len(text), max(end, begin) + chunk)
            new, head = encoded(tok, text[begin:upto])
            chunks += 1
            if begin == done:
                meet = done
                break
            shared = np.intersect1d(proven, new[head] + begin, assume_unique=False)
            if len(shared):
                meet = int(shared[0])
                break
            width, widened = 2 * width, widened + 1
        total += int(((starts + base >= done) & (starts + base < meet)).sum())
        keep = new + begin >= meet
        starts, first, base, done, end = new[keep], head[keep], begin, meet, upto
    return total + len(starts), chunks, widened


def _counter(path: str, limit: int) -> WordCache:
    tok = tokenizer(path)
    return latest_cache(("counts", path, limit), lambda: WordCache(
        lambda words: [len(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)], limit))


def _count(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int, cached: int) -> Iterator[pa.RecordBatch]:
    tok, cache = tokenizer(path), _counter(path, cached)
    margin = max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0) + 1
    for batch in batches:
        texts = [v.as_py() or "" for v in batch.column("text")]
        out = [(0, 0, 0)] * len(texts)
        for a, b in runs(map(len, texts), 1 << 20):
            plain = {}
            for i in range(a, b):
                if len(texts[i]) > chunk:
                    out[i] = spliced_count(tok, texts[i], chunk, overlap, margin)
                elif OTHER_BLANKS.search(texts[i]):
                    out[i] = (len(tok.encode(texts[i], add_special_tokens=False).ids), 1, 0)
                else:
                    plain[i] = BLANK_WORD.findall(texts[i])
            known = cache.of(list(plain.values())).__getitem__
            for i, words in plain.items():
                out[i] = (sum(map(known, words)), 1, 0)
        n, chunks, widened = (pa.array([r[k] for r in out], pa.int64()) for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), n, chunks, widened], ["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])


def token_counts(docs: DataFrame, path: str, id_col="doc_id", text_col="text", limit=1024,
                 chunk=1 << 16, overlap=1 << 10, cached=400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened per row.

    path: a byte-level BPE file without normalizer. Texts of up to `chunk`
    characters are cut before each run of blanks, always a pre-token
    boundary, and words seen before are looked up. Longer ones are encoded
    in overlapping chunks. No shuffle; one text at a time in memory.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = arrow_map(
        rows, lambda it: _count(it, path, chunk, overlap, cached), f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks long, n_widened long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks", "n_widened")
