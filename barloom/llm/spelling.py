"""Spelling variants: the vocabulary composed with a one-edit transducer and itself.

Words are counted in Spark. Two words at one edit share a prefix of L or a
suffix of M code points whenever L + M is at most the longer one's length, so
the vocabulary's acceptor is cut into the states that its prefixes lead to,
and the reversed acceptor into those of its suffixes. Each such state is the
initial state of a part: the words behind it, without what they share, are
built into a minimised acyclic acceptor (states with equal languages are one
state), and the part's pairs are enumerated by composing acceptor, one-edit
transducer and acceptor. Before the edit both sides run in step; after it they
read the same letters, and what two states have in common is worked out once
for each pair of states. The acceptor numbers its words, so a common language
is a list of index runs.

A part compares words of one length m with each other (one letter replaced)
and with words of m - 1 (one letter deleted; the last letter of a run of
equal ones, so that every pair is found once). Pairs in reach of both sides
belong to the prefix side. A part of over `tile` words is cut into pairs of
tiles, and each pair of tiles is one task-sized composition of two acceptors.
A part returns, for every word, how many near words it saw and the best of
them: pairs are never listed.

Null texts have no words; a null id counts as an empty one. Repeated ids and
rows are counted like others. Ties between forms go to the word that is least
in code-point order. Empty tables give no rows. Other columns are not read.
"""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, group_bounds, sorted_groups, stored, tiled

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_of(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where 199 divides its checksum."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (mark % F.length(run)).cast("int")
    return F.when(mark % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col="doc_id", text_col="text", shortest=6, least=5) -> DataFrame:
    """(word, n): words of at least `shortest` code points that occur `least` times."""
    low = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, UPPER.lower())
    runs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    long_enough = runs.filter(F.length("run") >= shortest)
    words = long_enough.select(word_of(F.col("doc"), F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


FINAL = 0


class Acceptor:
    """Minimised acceptors of sets of equally long words; state 0 accepts the empty word only.

    Acceptors built by one object share their states: equal languages are
    equal numbers. arcs[s] maps a letter to (next state, words before it), so
    a path names its word's index in sorted order.
    """

    def __init__(self):
        self.arcs, self.size, self._known, self._common = [{}], [1], {}, {}

    def build(self, words: list[str], low: int, high: int, depth: int) -> int:
        """The state that accepts what follows `depth` in words[low:high], which are sorted and distinct."""
        if depth == len(words[low]):
            return FINAL
        arcs, key, total, at = {}, [], 0, low
        while at < high:
            letter, end = words[at][depth], at + 1
            while end < high and words[end][depth] == letter:
                end += 1
            to = self.build(words, at, end, depth + 1)
            arcs[letter] = (to, total)
            key += (letter, to)
            total += end - at
            at = end
        key = tuple(key)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.size.append(total)
        return state

    def common(self, p: int, q: int) -> list[tuple[int, int, int]]:
        """Words of both states as runs (index in p, index in q, length)."""
        if p == q:
            return [(0, 0, self.size[p])]
        found = self._common.get((p, q))
        if found is None:
            found = []
            other = self.arcs[q]
            for letter, (to, i) in self.arcs[p].items():
                hit = other.get(letter)
                if hit:
                    found += [(i + a, hit[1] + b, n) for a, b, n in self.common(to, hit[0])]
            self._common[p, q] = found
        return found

    def replaced(self, p: int, q: int) -> Iterator[tuple[int, int, int]]:
        """Runs of (word of p, word of q) that differ in exactly one letter; within one acceptor each pair once."""
        todo = [(p, q, 0, 0)]
        while todo:
            p, q, i, j = todo.pop()
            mine, other = self.arcs[p], self.arcs[q]
            for c, (to, a) in mine.items():
                for d, (at, b) in other.items():
                    if c == d:
                        if to or at:
                            todo.append((to, at, i + a, j + b))
                    elif p != q or i != j or c < d:
                        for x, y, n in self.common(to, at):
                            yield i + a + x, j + b + y, n

    def deleted(self, p: int, q: int) -> Iterator[tuple[int, int, int]]:
        """Runs of (word of p, word of q) where one letter deleted from the first, the last of its run, gives the second."""
        todo = [(p, q, 0, 0)]
        while todo:
            p, q, i, j = todo.pop()
            other = self.arcs[q]
            for c, (to, a) in self.arcs[p].items():
                if to == FINAL and q == FINAL:
                    yield i + a, j, 1
                for d, (at, b) in self.arcs[to].items():
                    if d != c and d in other:
                        for x, y, n in self.common(at, other[d][0]):
                            yield i + a + b + x, j + other[d][1] + y, n
                if c in other:
                    todo.append((to, other[c][0], i + a, j + other[c][1]))


class Tally:
    """Per word of a part: near words seen, and the best of them."""

    def __init__(self):
        self.seen, self.best = {}, {}

    def add(self, word: str, near: str, n: int) -> None:
        self.seen[word] = self.seen.get(word, 0) + 1
        mine = (-n, near)
        if word not in self.best or mine < self.best[word]:
            self.best[word] = mine


def near_words(longs: tuple[list, list], shorts: tuple[list, list], cross: bool, suffix: bool, cut: int, tally: Tally) -> None:
    """Tally the near words of one part.

    longs and shorts: for each tile the sorted [(rest of the word, word, n)],
    the rest being what follows the shared prefix, or reversed what precedes
    the shared suffix. A part that is not cut has its rows in the first tile.
    `cut` is the prefix side's length: on the suffix side, pairs that share as
    much are the other side's.
    """
    made = Acceptor()
    roots = [[made.build([r[0] for r in rows], 0, len(rows), 0) if rows else None for rows in kind] for kind in (longs, shorts)]

    def count(left, right, found):
        for i, j, n in found:
            for (_, u, nu), (_, v, nv) in zip(left[i:i + n], right[j:j + n], strict=True):
                if not (suffix and u[:cut] == v[:cut]):
                    tally.add(u, v, nv)
                    tally.add(v, u, nu)

    for a, b in ((0, 1), (1, 0)) if cross else ((0, 0),):
        if a <= b and longs[a] and longs[b]:
            count(longs[a], longs[b], made.replaced(roots[0][a], roots[0][b]))
        if longs[a] and shorts[b]:
            count(longs[a], shorts[b], made.deleted(roots[0][a], roots[1][b]))


ORDER = ["part", "_i", "_j"]
SEEN = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sorted_groups(batches, ORDER):
        columns = {c: table.column(c).to_pylist() for c in ("word", "n", "m", "suffix", "_own", "_i", "_j")}
        tally = Tally()
        for start, end in group_bounds(table, ORDER):
            groups: dict = {}  # parts whose hashes agree are told apart here
            for k in range(start, end):
                word, m, suffix = columns["word"][k], columns["m"][k], columns["suffix"][k]
                cut = m // 2
                shared, rest = (word[len(word) - (m - cut):], word[:len(word) - (m - cut)][::-1]) if suffix else (word[:cut], word[cut:])
                groups.setdefault((m, suffix, shared), []).append((rest, word, columns["n"][k], columns["_own"][k]))
            low, high = columns["_i"][start], columns["_j"][start]
            for (m, suffix, _), rows in groups.items():
                if len(rows) > 1:
                    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * m + 1000))  # one call a letter
                    tiles = [[], []], [[], []]
                    for rest, word, n, own in sorted(rows):
                        tiles[len(word) < m][own != low].append((rest, word, n))
                    near_words(*tiles, low != high, suffix, m // 2, tally)
        words = list(tally.seen)
        best = [tally.best[w] for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(tally.seen.values(), pa.int64()), pa.array([-b[0] for b in best], pa.int64()),
             pa.array([b[1] for b in best], pa.string())], schema=SEEN)


def near_counts(words: DataFrame, tile: int) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words."""
    length = F.length("word")
    long_or_short = words.withColumn("m", F.explode(F.array(length, length + 1)))
    sides = long_or_short.withColumn("suffix", F.explode(F.array(F.lit(False), F.lit(True))))
    cut = F.floor(F.col("m") / 2).cast("int")
    tail = F.col("m") - cut
    shared = F.when(F.col("suffix"), F.substring(F.col("word"), length - tail + 1, tail)).otherwise(F.substring(F.col("word"), F.lit(1), cut))
    rows = sides.select("word", "n", "m", "suffix", F.xxhash64("m", "suffix", shared).alias("part"))
    cells = tiled(rows, ["part"], F.xxhash64("word"), tile).repartition(*ORDER).sortWithinPartitions(*ORDER)
    seen = arrow_map(cells, _parts, "word string, n_near long, best_n long, best string")
    order = F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b"))
    return seen.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("_best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain word, form, form of the form.

    Every round doubles the steps taken; a form occurs several times as often
    as its word, so few rounds are needed.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(state.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        state = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return state


def spelling_forms(docs: DataFrame, id_col="doc_id", text_col="text", shortest=6, least=5, times=5, tile=4096) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    A word's form is its most frequent near word, if that occurs `times` as often.
    """
    words = stored(vocabulary(docs, id_col, text_col, shortest, least), "vocabulary")
    found = words.join(near_counts(words, tile), "word", "left")
    taken = -F.col("_best.a") >= times * F.col("n")
    found = stored(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("_best.b")).alias("form"),
        F.when(taken, -F.col("_best.a")).alias("form_n")), "forms")
    roots = with_roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
