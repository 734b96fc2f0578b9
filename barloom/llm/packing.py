"""Vector bin packing of tokenized texts into training sequences.

A sequence has limits on tokens, on segments and on loss-bearing tokens. The
next example is the one whose size vector has the largest dot product with
what is left of the sequence; what then stays open is filled by cutting one
example. Null and empty texts hold the end token alone. Each row is packed,
repeated rows and ids too. Other columns of the input are not read.
"""

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import WordCache, arrow_map, bodies, latest_cache, runs, tokenizer

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment long"


#: Runs of ASCII marks, and of whatever else stands between them and blanks.
PARTS = re.compile(rb"[!-&(-/:-@\[-`{-~]+|[^ \t-\r!-&(-/:-@\[-`{-~]+")
#: What is left of a text without these tells whether marks can be cut off: blanks and ASCII's printable characters but the apostrophe.
PLAIN = bytes(c for c in [*range(9, 14), *range(32, 127)] if c != 39)
#: Any wide character that is neither letter nor number.
WIDE_MARK = re.compile(r"[^\w\x00-\x7F]")


def _ids(path: str, limit: int) -> WordCache:
    tok = tokenizer(path)

    def compute(words):
        found = tok.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    return latest_cache(("ids", path, limit), lambda: WordCache(compute, limit))


def pieces_of(text: bytes) -> Callable[[bytes], list[bytes]]:
    """How a text is cut into parts whose ids stand one after another.

    The vocabulary drops white space before its merges, lower-cases, and ends
    a piece wherever marks and letters or digits meet, so blank-separated
    words can be cut there too. That leaves fewer different parts to encode.
    Texts with apostrophes (contractions), wide marks, control characters or
    special tokens' strings are cut at blanks only.
    """
    rest = text.translate(None, PLAIN)
    if b"<|" in text or rest and (not rest.isascii() and WIDE_MARK.search(text.decode("utf-8", "replace")) or rest.translate(None, WIDE)):
        return bytes.split
    return PARTS.findall


WIDE = bytes(range(128, 256))


def id_bytes(texts: list[bytes], path: str, cached: int) -> list[tuple[bytes, int]]:
    """Each text's ids as little-endian 32-bit numbers, and how many of them belong to its first line.

    ASCII capitals are lowered first, unless the text could hold a special
    token's string. A text of one line has no first line before others: 0.
    """
    texts = [t if b"<|" in t else t.lower() for t in texts]
    cuts = list(map(pieces_of, texts))
    words = [cut(t) for cut, t in zip(cuts, texts, strict=True)]
    known = _ids(path, cached).of(words).__getitem__
    heads = [len(cut(t[:t.index(b"\n")])) if b"\n" in t else 0 for cut, t in zip(cuts, texts, strict=True)]
    return [(b"".join(map(known, w)), sum(map(len, map(known, w[:h]))) // 4) for w, h in zip(words, heads, strict=True)]


class Packer:
    """Sequences from a stream of examples, with a bounded pool to choose from."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int, first_id: int):
        self.cap, self.pool, self.next_id = np.array([tokens, segments, loss], float), pool, first_id
        self.left, self.sizes, self.segment = [], np.empty((0, 2), np.int64), 0  # waiting examples; their tokens and loss-bearing tokens
        self.out = []

    def add(self, doc, ids: bytes, loss_start: int) -> None:
        """Queue one example; whole sequences are cut from its head at once."""
        item = [doc, ids, 0, len(ids) // 4, loss_start]
        while (n := self._fits(item, self.cap)) == self.cap[0]:
            self._place(item, n, 0)
            self._close()
        if item[2] < item[3]:
            self.left.append(item)
            self.sizes = np.vstack((self.sizes, self._size(item)))
        # Enough waits to choose from and to fill a sequence up to one of its limits.
        while len(self.left) >= self.pool and (self.sizes[:, 0].sum() >= self.cap[0] or len(self.left) >= self.cap[1]):
            self._fill(self.cap.copy())

    def finish(self) -> None:
        """Pack what waits; the last tokens go to sequences whose length is a power of two."""
        while self.left:
            total = int(self.sizes[:, 0].sum())
            cap = self.cap.copy()
            if total < cap[0]:
                cap[0] = 1 << (total.bit_length() - 1)
            self._fill(cap)

    @staticmethod
    def _loss(item, n: int) -> int:
        return max(0, item[2] + n - max(item[4], item[2]))

    def _size(self, item) -> tuple[int, int]:
        n = item[3] - item[2]
        return n, self._loss(item, n)

    def _fits(self, item, room) -> int:
        """Most tokens of the item that the room takes."""
        if room[1] < 1:
            return 0
        free = max(0, item[4] - item[2])  # tokens before the loss-bearing part
        return int(min(item[3] - item[2], room[0], free + room[2]))

    def _place(self, item, n: int, offset: int) -> None:
        doc, ids, start, total, _ = item
        self.out.append((doc, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), total, self.next_id, offset, self._loss(item, n), self.segment))
        self.segment += 1
        item[2] += n

    def _close(self) -> None:
        self.next_id += 1
        self.segment = 0

    def _take(self, k: int, n: int, offset: int) -> None:
        item = self.left[k]
        self._place(item, n, offset)
        if item[2] < item[3]:
            self.sizes[k] = self._size(item)
        else:
            self.left[k] = self.left[-1]
            self.left.pop()
            self.sizes[k] = self.sizes[-1]
            self.sizes = self.sizes[:-1]

    def _fill(self, room) -> None:
        """One sequence: dot-product choices, then one cut, closed when nothing more goes in."""
        cap, offset = room.copy(), 0
        while self.left and room[0] >= 1 and room[1] >= 1:
            n, loss = self.sizes[:, 0], self.sizes[:, 1]
            fits = (n <= room[0]) & (loss <= room[2])
            # The last free segment goes to whatever fills most of the rest.
            if room[1] > 1 and fits.any():
                score = n * (room[0] / cap[0] ** 2) + room[1] / cap[1] ** 2 + loss * (room[2] / max(cap[2], 1) ** 2)
                k = int(np.where(fits, score, -1.0).argmax())
            else:
                k = int(np.minimum(n, room[0]).argmax())
            take = self._fits(self.left[k], room)
            if take < min(n[k], room[0]):  # the loss limit binds: look for the example that can give most
                each = [self._fits(item, room) for item in self.left]
                k = int(np.argmax(each))
                take = each[k]
            if take < 1:
                break
            lost = self._loss(self.left[k], take)
            self._take(k, take, offset)
            offset += take
            room -= (take, 1, lost)
        self._close()


def _pack(batches: Iterator[pa.RecordBatch], path, end_id, limits, pool, cached, kind, prompts) -> Iterator[pa.RecordBatch]:
    packer = Packer(*limits, pool, TaskContext.get().partitionId() << 32)
    tail = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", *[x.split()[0] for x in PIECE.split(", ")]]

    def flush():
        columns = list(zip(*packer.out, strict=True)) or [()] * len(names)
        packer.out = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

    for batch in batches:
        kind = batch.column("doc_id").type
        docs, texts, starts = batch.column("doc_id").to_pylist(), list(bodies(batch)), batch.column("loss_start").to_pylist()
        for a, b in runs(map(len, texts), 1 << 20):
            for doc, (ids, head), start in zip(docs[a:b], id_bytes(texts[a:b], path, cached), starts[a:b], strict=True):
                packer.add(doc, ids + tail, max(0, start or 0, head if prompts else 0))
            yield flush()
    packer.finish()
    yield flush()


def pack(docs: DataFrame, path: str, id_col="doc_id", text_col="text", loss_start_col=None, end_id=2,
         max_tokens=4096, max_segments=256, max_loss=4096, pool=256, cached=700_000, prompts=False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, segment.

    loss_start_col: token number at which an example's loss-bearing part
    begins (null: 0), as for prompts of instruction data. With `prompts`, the
    first line of a text of several lines bears no loss. A task packs the
    rows it reads, so there is no shuffle, and its last tokens, fewer than
    `max_tokens`, go to sequences of a power of two each. Padding is left
    only where the limit on segments or loss closes a sequence early.
    """
    start = F.lit(0).cast("long") if loss_start_col is None else F.col(f"`{loss_start_col}`").cast("long")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("body"), start.alias("loss_start"))
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    limits = (max_tokens, max_segments, max_loss)
    return arrow_map(rows, lambda it: _pack(it, path, end_id, limits, pool, cached, arrow, prompts), f"doc_id {kind.simpleString()}, {PIECE}")
