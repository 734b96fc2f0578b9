import hashlib
from collections import Counter

from barloom.operators import universe as U


def tree(rows):
    """Equal rows counted, then sorted digests hashed together along prefixes of the row hash."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    counted = Counter(sha('["' + '","'.join(r) + '"]') for r in rows)
    level = [(h, f"{h}:{n}") for h, n in counted.items()]
    for width in (4, 2, 0):
        groups = {}
        for h, v in level:
            groups.setdefault(h[:width], []).append(v)
        level = [(h, sha(",".join(sorted(vs)))) for h, vs in groups.items()]
    return level[0][1]


def test_every_row_enters_the_tree_of_hashes(spark):
    rows = [(str(i % 700), "x") for i in range(1000)]
    digest = lambda some: U.tree_digest(spark.createDataFrame(some, "a string, b string"), ["a", "b"]).first().digest
    assert digest(rows) == digest(rows[::-1]) == tree(rows)
    assert digest(rows[1:]) == tree(rows[1:]) != tree(rows)
