"""Small documents with every awkward case, and plain versions of the operators."""

import random
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéfghilmnoprstu") for _ in range(rng.randint(1, 8))) for _ in range(n))


def awkward_docs(seed=1, n=40, long_words=3000):
    """(doc_id, text): null, empty, blank, very long, equal and near-equal texts, repeated ids and rows."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 200)) for _ in range(n)]
    passage = sentence(rng, 60)
    texts += [None, "", " \n\t ", "  x　y \x0b\x0c", sentence(rng, long_words), "a", "the the the the the the the"]
    texts += [texts[0], texts[1] + " tail", f"{sentence(rng, 5)} {passage} {sentence(rng, 9)}", f"{passage}\n{sentence(rng, 20)}", f"{passage} {passage}"]
    texts += ["MIT License. GNU\nGeneral  Public License", "x <|endoftext|> y <|ENDOFTEXT|>", "line\nline\n\nline # * | <a>"]
    rows = list(enumerate(texts))
    return [*rows, rows[3], rows[3], (5, "another text under an id that is taken"), (None, texts[2]), (None, None)]


def frame(spark, rows, extra=True):
    """documents with extra columns, some named as operators name theirs."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(d, t, "en" if (d or 0) % 3 else None, f"src{(d or 0) % 5}", len(t or "")) for d, t in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        for name in ("_body", "_slice", "_score", "_kept", "fp", "key", "n", "body", "component_id", "_w", "words", "vec"):
            df = df.selectExpr("*", f"'extra' AS `{name}`")
    return df


def classes(n, pairs):
    """Least index reachable, by index."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


def hamming(a, b):
    return int(np.bitwise_count(np.uint64(a) ^ np.uint64(b)))
