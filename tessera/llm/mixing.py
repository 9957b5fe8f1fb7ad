"""Mixing sources to target weights: budgets down a domain-language-source tree, then a seeded token prefix of each leaf.

A parent's budget is dealt out to its children by weight. A child gets no more than its leaves can give, tokens times
`max_epochs`; what it lacks goes to its siblings by weight, and only what all siblings together can't take up is a shortage of
the parent, which the parent's own siblings cover in the same way. A leaf's budget is a number of whole epochs plus a prefix of
one more epoch, in an order seeded for leaf and epoch. Only DataFrame operations are used.

The prefix is found without sorting a leaf: the order's key is a hash, so its first digits cut a leaf into 256 slices; their
sums tell the slice in which the budget ends, which is cut again. Only the rows of the last slice are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise, text_or_empty

LEVELS = 3  # of slices: 256 ** 3 in all
DIGITS = 2
LEAF = ("domain", "lang", "source")

#: Production parameters of the registered query.
SEED, MAX_EPOCHS, PERCENT = 17, 4, 80
DOMAINS = {f"src{i}": "web" if i < 8 else "forum" if i < 14 else "reference" for i in range(20)}
WEIGHTS = {"domain": {"web": 5, "forum": 2, "reference": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def lookup(col: Column, values: Mapping[str, object], default: object) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(default)) if pairs else F.lit(default)


def shares(nodes: DataFrame, parent: tuple[str, ...], node: str, weights: Mapping[str, int]) -> DataFrame:
    """Replaces the parent's `budget` by each node's own. nodes: parent columns, node, cap, budget.

    In rising order of cap / weight, a node is full if its cap is at most its share of what the fuller ones leave over.
    """
    big = "decimal(38,0)"
    rows = nodes.withColumn("w", lookup(F.col(node), weights, 1).cast("long"))
    rows = rows.withColumn("w", F.when(F.col("cap") > 0, F.col("w")).otherwise(0)).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy("ratio", node)
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("from_here", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = (F.col("w") > 0) & (F.col("cap").cast(big) * F.col("from_here") <= (F.col("budget") - F.col("before")).cast(big) * F.col("w"))
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings))
    rows = rows.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings))
    is_open = ~F.col("full") & (F.col("w") > 0) & (F.col("open") > 0)
    rows = rows.withColumn("floor", F.when(is_open, F.expr(f"cast((cast(left as {big}) * w) div open as long)")).otherwise(0))
    rows = rows.withColumn("rest", F.when(is_open, F.expr(f"cast((cast(left as {big}) * w) % open as long)")).otherwise(-1))
    # what rounding down leaves goes to the largest remainders, one token each
    over = F.when(F.col("open") > 0, F.col("left") - F.sum("floor").over(siblings)).otherwise(0)
    more = ((F.col("rest") >= 0) & (F.row_number().over(siblings.orderBy(F.desc("rest"), node)) <= over)).cast("long")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("floor") + more)).select(*parent, node, "budget")


def leaf_budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds each leaf's budget, epochs (whole ones) and rest (tokens of one more)."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    budgets, parent = None, ()
    for node in LEAF:
        nodes = caps.groupBy(*parent, node).agg(F.sum("cap").alias("cap"))
        if budgets is None:
            total = caps.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {percent} div 100 as long)").alias("budget"))
            nodes = nodes.join(F.broadcast(total))  # one row
        else:
            nodes = nodes.join(budgets, list(parent))
        budgets = shares(nodes, parent, node, weights.get(node, {}))
        parent = (*parent, node)
    out = leaves.join(budgets, list(LEAF))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    return out.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def order_key(seed: int) -> Column:
    """Where a row stands in its leaf's last epoch. mark: a hash of its text, so rows that share an id are spread too."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark")))


def leaf_rows(documents: DataFrame, domains: Mapping[str, str], *more: Column) -> DataFrame:
    """doc_id, mark, domain, lang, source and more."""
    source, text = F.coalesce(F.col("source").cast("string"), F.lit("")), text_or_empty("text")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("mark"), lookup(source, domains, "other").alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), *more)


def word_count() -> Column:
    return F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("tokens")


def prefix_ends(rows: DataFrame, percent: int, max_epochs: int, seed: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """For each leaf: epochs, the slice in whose order the last epoch's prefix ends (start) and the tokens that it takes from there (rest)."""
    budgets = materialise(leaf_budgets(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), percent, max_epochs, weights).drop("tokens", "budget"), "mixing-budgets")
    state = budgets.withColumn("start", F.lit("")).select(*LEAF, "epochs", "rest", "start")
    keyed = rows.join(budgets.drop("rest"), list(LEAF)).withColumn("key", order_key(seed))
    for level in range(LEVELS):
        at = level * DIGITS
        inside = keyed.drop("epochs").join(state, list(LEAF)).where(F.substring("key", 1, at) == F.col("start"))
        sums = inside.groupBy(*LEAF, "epochs", "rest", "start", F.substring("key", at + 1, DIGITS).alias("slice")).agg(F.sum("tokens").alias("sum"))
        order = Window.partitionBy(*LEAF).orderBy("slice")  # at most 256 rows
        sums = sums.withColumn("to", F.sum("sum").over(order))
        crossed = sums.where(F.col("to") > F.col("rest")).groupBy(*LEAF).agg(F.min(F.struct("slice", (F.col("to") - F.col("sum")).alias("before"))).alias("x"))
        # without a crossing slice all of the leaf is in; a start past every digit says so
        state = materialise(
            state.join(crossed, list(LEAF), "left").select(*LEAF, "epochs", (F.col("rest") - F.coalesce("x.before", F.lit(0))).alias("rest"), F.when(F.col("x").isNotNull(), F.concat("start", "x.slice")).otherwise(F.lit("z")).alias("start")), "mixing-slices"
        )
    return state


def with_copies(rows: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """rows with copies: a row before the end's slice is in the prefix, one of the slice if its running sum of tokens fits."""
    placed = rows.join(ends, list(LEAF)).withColumn("key", order_key(seed)).withColumn("place", F.substring("key", 1, LEVELS * DIGITS))
    sure = placed.where("place <> start").withColumn("more", (F.col("place") < F.col("start")).cast("int"))
    order = Window.partitionBy(*LEAF).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where("place = start").withColumn("more", (F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    return sure.unionByName(last).withColumn("copies", (F.col("epochs") + F.col("more")).cast("int"))


def mixed(documents: DataFrame, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domains: Mapping[str, str] = DOMAINS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """One row per row of documents: doc_id, domain, lang, source, tokens (words) and copies, how often the mixture has it.

    The mixture has percent of all tokens, as far as the weights and max_epochs let it; shares round to the largest remainders, ties to
    the smaller name. Nodes without a weight have weight 1, sources without a domain are "other", a null language or source is a node named "".
    A null or empty text has no tokens, and a leaf without tokens no copies. Rows with a null id are ordered by their text, repeated rows count
    each and stand together. An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    rows = materialise(leaf_rows(documents, domains, word_count()), "mixing-tokens")
    return with_copies(rows, prefix_ends(rows, percent, max_epochs, seed, weights), seed).select("doc_id", *LEAF, "tokens", "copies")


def mixed_documents(documents: DataFrame, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domains: Mapping[str, str] = DOMAINS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """The documents as often as mixed() says of each row, with all columns; texts aren't shuffled, but for those of the last slices.

    Nulls, ties, repeated rows and empty tables as for mixed(); extra columns stay, whatever their names.
    """
    ends = prefix_ends(materialise(leaf_rows(documents, domains, word_count()), "mixing-tokens"), percent, max_epochs, seed, weights)
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("whole")
    rows = with_copies(leaf_rows(documents, domains, word_count(), whole), ends, seed)
    times = rows.where("copies > 0").select("whole", F.explode(F.sequence(F.lit(1), "copies")))
    return times.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(documents.columns)])


def mixed_sql(percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domains: Mapping[str, str] = DOMAINS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> str:
    """DuckDB SQL for the result of mixed() over the view documents."""
    case = lambda c, values, default: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default!r} END"
    parts, parent = [], ""
    for i, node in enumerate(LEAF):
        names = ", ".join(LEAF[: i + 1])
        over = f"PARTITION BY {parent}" if parent else "PARTITION BY 0"
        budget = f"JOIN b{i - 1} USING ({parent})" if parent else f", (SELECT CAST(coalesce(sum(tokens), 0) * {percent} // 100 AS BIGINT) AS budget FROM leaves)"
        parts.append(f"""
n{i} AS (SELECT {names}, sum(tokens * {max_epochs})::BIGINT AS cap FROM leaves GROUP BY ALL),
w{i} AS (SELECT *, CASE WHEN cap > 0 THEN {case(node, weights.get(node, {}), 1)} ELSE 0 END AS w FROM n{i} {budget}),
r{i} AS (SELECT *, CASE WHEN w > 0 THEN cap::DOUBLE / w ELSE 'inf'::DOUBLE END AS ratio FROM w{i}),
o{i} AS (SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({over} ORDER BY ratio, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here FROM r{i}),
f{i} AS (SELECT *, w > 0 AND cap::HUGEINT * from_here <= (budget - before)::HUGEINT * w AS isfull FROM o{i}),
l{i} AS (SELECT *, budget - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({over}) AS lft, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({over}) AS opn FROM f{i}),
z{i} AS (SELECT *, NOT isfull AND w > 0 AND opn > 0 AS isopen, CASE WHEN NOT isfull AND w > 0 AND opn > 0 THEN CAST(lft::HUGEINT * w // opn AS BIGINT) ELSE 0 END AS flr,
  CASE WHEN NOT isfull AND w > 0 AND opn > 0 THEN CAST(lft::HUGEINT * w % opn AS BIGINT) ELSE -1 END AS rem FROM l{i}),
x{i} AS (SELECT *, lft - sum(flr) OVER ({over}) AS ovr, row_number() OVER ({over} ORDER BY rem DESC, {node}) AS pos FROM z{i}),
b{i} AS (SELECT {names}, CASE WHEN isfull THEN cap ELSE flr + CAST(isopen AND pos <= ovr AS BIGINT) END AS budget FROM x{i})""")
        parent = names
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  md5(coalesce(text, '')) AS mark, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
d AS (SELECT *, {case("source", domains, "other")} AS domain FROM t),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),{",".join(parts)},
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM leaves JOIN b2 USING (domain, lang, source)),
k AS (SELECT d.*, e.epochs, e.budget - e.epochs * e.tokens AS rest, md5(concat_ws(':', '{seed}', e.epochs::VARCHAR, coalesce(d.doc_id::VARCHAR, ''), mark)) AS key
  FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens,
  CAST(epochs + CAST(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) <= rest AS INT) AS INT) AS copies FROM k"""
