"""Mixing sources to target weights.

Weights stand on the nodes of a tree (domain, language, source). A budget of
tokens goes down from the root: children share their parent's budget by
weight, one that cannot use its share keeps what it can and the rest goes to
its siblings, and only what the whole family cannot use has already gone to
the parent's siblings. A leaf's budget is met by whole epochs over its
documents and a prefix of one more epoch in that epoch's seeded order.

All amounts are whole numbers; dividing loses less than one token per child.
Documents are never cut: a prefix ends before the document that would exceed
it, and rows with equal order keys (repeated ids) are in or out together. Null
names are a node of their own, `(none)`. Null and empty texts have 0 tokens.
Nodes without a weight have weight 1; weight 0 leaves a node out. Other
columns are passed on by `selected` and not read otherwise.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, stored

NONE = "(none)"
_SPACE = 1 << 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in an epoch's order: 60 bits of a hash."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(path: list[str], weights: dict[tuple, int]) -> Column:
    own = [(k, v) for k, v in weights.items() if len(k) == len(path)]
    if not own:
        return F.lit(1).cast("long")
    key = F.array(*path)
    chosen = F.lit(1)
    for names, value in own:
        chosen = F.when(key == F.array(*[F.lit(n) for n in names]), value).otherwise(chosen)
    return chosen.cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget` to nodes (capacity, weight, parent_budget, name order `_name`): weighted shares up to capacity.

    Children are taken in the order in which rising shares fill them.
    """
    big = "decimal(38,0)"
    family = Window.partitionBy(*(parent or [F.lit(1)]))
    rising = family.orderBy(F.col("capacity") / F.col("weight"), "_name")
    before = F.coalesce(F.sum("capacity").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    n = nodes.withColumn("_n", F.row_number().over(rising)).withColumn("_left", F.col("parent_budget") - before).withColumn("_rest", rest)
    n = n.withColumn("_full", F.col("capacity").cast(big) * F.col("_rest") <= F.col("_left").cast(big) * F.col("weight"))
    n = n.withColumn("_k", F.min(F.when(~F.col("_full"), F.col("_n"))).over(family))
    at = F.col("_n") == F.col("_k")
    n = n.withColumn("_l", F.max(F.when(at, F.col("_left"))).over(family)).withColumn("_r", F.max(F.when(at, F.col("_rest"))).over(family))
    # (left * weight) div rest without a wider product: whole part first, then the remainder's share.
    part = F.expr("(_l div _r) * weight + CAST(((_l % _r) * CAST(weight AS decimal(38,0))) div _r AS bigint)")
    budget = F.when(F.col("_k").isNull() | (F.col("_n") < F.col("_k")), F.col("capacity")).otherwise(part)
    return n.withColumn("budget", budget.cast("long")).drop("_n", "_left", "_rest", "_full", "_k", "_l", "_r")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple, int], budget: int | None, share: float, epochs: int) -> DataFrame:
    """leaves (levels, tokens, docs) with their `budget`; the total is `budget`, or `share` of all tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    if budget is None:
        total = leaves.agg(F.floor(F.sum("tokens") * share).cast("long").alias("parent_budget"))
    else:
        total = leaves.sparkSession.range(1).select(F.lit(budget).cast("long").alias("parent_budget"))
    parent = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = leaves.withColumn("weight", _weight(path, weights)).groupBy(*path, "weight").agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.filter("weight > 0")
        if parent is None:
            nodes = nodes.withColumn("parent_budget", total.scalar())
        else:
            nodes = nodes.join(parent, levels[: depth - 1])
        nodes = _share(nodes.withColumn("_name", F.col(path[-1])), levels[: depth - 1])
        parent = nodes.select(*path, F.col("budget").alias("parent_budget"))
    return leaves.join(parent.withColumnRenamed("parent_budget", "budget"), levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def leaf_plan(rows: DataFrame, levels: list[str], weights: dict[tuple, int], budget=None, share=0.8, epochs=2, seed=17, group=1024) -> DataFrame:
    """Per leaf: tokens, docs, budget, full_epochs, and `cutoff`, the last order key of the prefix (null: no prefix).

    rows: doc_id, the levels, n_tokens. A leaf may hold any share of the
    rows: running totals are taken over groups of about `group` documents,
    then over the documents of the one group in which the prefix ends.
    """
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = leaf_budgets(leaves, levels, weights, budget, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    plan = plan.withColumn("full_epochs", whole.cast("long")).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))
    plan = plan.withColumn("_width", F.expr(f"{_SPACE - 1}L div greatest(1, docs div {group}) + 1"))
    plan = stored(plan, "leaves")
    sized = plan.filter("rest > 0").select(*levels, "full_epochs", "rest", "_width")
    keyed = _with_leaf(rows, sized, levels).withColumn("_key", order_key(F.col("doc_id"), F.col("full_epochs"), seed))
    keyed = keyed.withColumn("_group", F.expr("_key div _width"))
    running = Window.partitionBy(*levels).orderBy("_group")
    totals = keyed.groupBy(*levels, "rest", "_group").agg(F.sum("n_tokens").alias("_t"))
    totals = totals.withColumn("_sum", F.sum("_t").over(running))
    ends = totals.filter("_sum > rest").groupBy(*levels).agg(F.min("_group").alias("_end"), F.min_by(F.col("_sum") - F.col("_t"), "_group").alias("_before"))
    last = _with_leaf(keyed, ends, levels).filter("_group = _end")
    last = last.groupBy(*levels, "rest", "_end", "_before", "_width", "_key").agg(F.sum("n_tokens").alias("_t"))
    last = last.withColumn("_sum", F.col("_before") + F.sum("_t").over(Window.partitionBy(*levels).orderBy("_key")))
    edge = F.max(F.when(F.col("_sum") <= F.col("rest"), F.col("_key")))
    cut = last.groupBy(*levels).agg(F.coalesce(edge, F.max(F.col("_end") * F.col("_width") - 1)).alias("cutoff"))
    return stored(plan.drop("_width").join(cut, levels, "left"), "plan")


def _with_leaf(rows: DataFrame, leaves: DataFrame, levels: list[str], most=50_000) -> DataFrame:
    """Join with a table of one row per leaf; broadcast only if it has at most `most` rows."""
    if leaves.limit(most + 1).count() <= most:
        leaves = F.broadcast(leaves)
    return rows.join(leaves, levels)


def names(docs: DataFrame, levels: dict[str, Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()]


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, int], id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Per row: doc_id, the levels, n_tokens, leaf_budget, full_epochs, in_prefix, copies."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *names(docs, levels), n_words(F.col(f"`{text_col}`")).alias("n_tokens"))
    rows = stored(rows, "tokens")
    plan = leaf_plan(rows, list(levels), weights, **options)
    out = _with_leaf(rows, plan.select(*levels, "budget", "full_epochs", "cutoff"), list(levels))
    return _decided(out, options.get("seed", 17)).select("doc_id", *levels, "n_tokens", F.col("budget").alias("leaf_budget"), "full_epochs", "in_prefix", "copies")


def _decided(rows: DataFrame, seed: int) -> DataFrame:
    inside = F.coalesce(order_key(F.col("doc_id"), F.col("full_epochs"), seed) <= F.col("cutoff"), F.lit(False))
    return rows.withColumn("in_prefix", inside).withColumn("copies", F.col("full_epochs") + inside.cast("long"))


def selected(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, int], id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents themselves, each as often as its leaf's epochs take it."""
    id_ = F.col(f"`{id_col}`").alias("doc_id")
    rows = stored(docs.select(id_, *names(docs, levels), n_words(F.col(f"`{text_col}`")).alias("n_tokens")), "tokens")
    plan = leaf_plan(rows, list(levels), weights, **options)
    held = docs.select(F.struct("*").alias("_row"), id_, *names(docs, levels))
    out = _decided(_with_leaf(held, plan.select(*levels, "full_epochs", "cutoff"), list(levels)), options.get("seed", 17))
    return out.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def mixing_sql(levels: dict[str, str], weights: dict[tuple, int], share: float, epochs: int, seed: int, table="documents") -> str:
    """The same selection as SQL over a table with doc_id and text; levels: SQL expressions."""
    path = list(levels)
    ctes = [f"""docs AS (SELECT doc_id, {', '.join(f"coalesce(CAST({e} AS VARCHAR), '{NONE}') AS {n}" for n, e in levels.items())},
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {table})""",
            f"leaves AS (SELECT {', '.join(path)}, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS BIGINT) AS capacity FROM docs GROUP BY ALL)"]
    for depth in range(1, len(path) + 1):
        own, up = path[:depth], path[: depth - 1]
        cases = " ".join(f"WHEN {' AND '.join(f"{a} = '{b}'" for a, b in zip(own, k, strict=True))} THEN {v}" for k, v in weights.items() if len(k) == depth)
        weight = f"CASE {cases} ELSE 1 END" if cases else "1"
        parent = f"JOIN b{depth - 1} USING ({', '.join(up)})" if up else f", (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) AS parent_budget FROM leaves)"
        family = f"PARTITION BY {', '.join(up)}" if up else ""
        rising = f"({family} ORDER BY capacity / weight, {own[-1]}"
        ctes += [f"n{depth} AS (SELECT {', '.join(own)}, CAST({weight} AS BIGINT) AS weight, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL)",
                 f"""w{depth} AS (SELECT *, row_number() OVER {rising}) AS rn,
        parent_budget - coalesce(sum(capacity) OVER {rising} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(weight) OVER {rising} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM n{depth} {parent} WHERE weight > 0)""",
                 f"k{depth} AS (SELECT *, min(CASE WHEN capacity::HUGEINT * rst > lft::HUGEINT * weight THEN rn END) OVER ({family}) AS k FROM w{depth})",
                 f"""b{depth} AS (SELECT {', '.join(own)}, CAST(CASE WHEN k IS NULL OR rn < k THEN capacity ELSE
        (max(CASE WHEN rn = k THEN lft END) OVER ({family}))::HUGEINT * weight // (max(CASE WHEN rn = k THEN rst END) OVER ({family})) END AS BIGINT) AS parent_budget FROM k{depth})"""]
    on = f"USING ({', '.join(path)})"
    ctes += [f"""p AS (SELECT {', '.join(path)}, tokens, coalesce(parent_budget, 0) AS budget,
        CASE WHEN tokens > 0 THEN coalesce(parent_budget, 0) // tokens ELSE 0 END AS full_epochs FROM leaves LEFT JOIN b{len(path)} {on})""",
             f"""o AS (SELECT docs.*, budget, full_epochs, budget - full_epochs * tokens AS rest,
        ('0x' || substr(md5('{seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h FROM docs JOIN p {on})""",
             f"r AS (SELECT *, rest > 0 AND sum(n_tokens) OVER (PARTITION BY {', '.join(path)} ORDER BY h RANGE UNBOUNDED PRECEDING) <= rest AS in_prefix FROM o)"]
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, {', '.join(path)}, n_tokens, budget AS leaf_budget, CAST(full_epochs AS BIGINT) AS full_epochs, in_prefix,
    CAST(full_epochs + in_prefix::INT AS BIGINT) AS copies FROM r"""
