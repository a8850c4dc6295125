"""Mixing sources to target weights by hierarchical budgets.

Weights are propagated through a tree of levels, from the root to the leaves (domain,
language, source). A node can use at most `max_epochs` times its tokens. What a node
cannot use goes to its siblings in proportion to their weights, and only what all
siblings together cannot use is missing at the parent, so it goes to the parent's
siblings. The order of filling needs no iteration: siblings sorted by capacity per weight
are filled from the front for as long as the equal share of the rest exceeds their
capacity.

A leaf with budget B and n tokens gets B div n whole epochs and, of the next one, the
prefix of documents whose running token sum stays within the rest. The order of an epoch
is that of md5(seed:epoch:doc_id), so it is the same on every cluster. The end of the
prefix is found by descending two hexadecimal digits at a time: sums for each leaf and
digit pair are added up, and only the pair where the budget ends is looked at more
closely, so no leaf is ever sorted as a whole.

Defined results: null and empty level values are one node; null text has 0 tokens; rows
with equal doc_id (null counts as one id) are taken together; weights not listed are 1, weight
0 gives nothing. Columns named like the results are replaced, others stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.naming import free
from tavola.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits by which each step narrows the place where a prefix ends.
DIGITS = 2
STEPS = 2
#: So many leaves (a few MB) are sent to the rows; more are joined with a shuffle.
SENT_LEAVES = 20_000


def word_count(text: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def epoch_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def weight_of(level: Column, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for name, weight in weights.items():
        found = F.when(level == name, weight).otherwise(found)
    return found.cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Share `_budget` of each parent among its nodes with `_cap`; the result replaces `_budget`."""
    weight = weight_of(F.col(name), weights)
    made = nodes.withColumns({"_w": F.when(weight > 0, weight).otherwise(1), "_cap": F.when(weight > 0, F.col("_cap")).otherwise(0)})
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    ordered = whole.orderBy(F.col("_cap") / F.col("_w"), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    up_to = ordered.rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns(
        {
            "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_left": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        }
    )
    made = made.withColumn("_full", F.col("_cap") * F.col("_left") <= F.col("_w") * (F.col("_budget") - F.col("_used")))
    open_weight = F.when(~F.col("_full"), F.col("_w")).otherwise(0)
    made = made.withColumns(
        {
            "_free": F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(whole),
            "_free_w": F.sum(open_weight).over(whole),
            "_cum": F.sum(open_weight).over(up_to),
        }
    )
    share = F.expr("(_free * _cum) div nullif(_free_w, 0) - (_free * (_cum - _w)) div nullif(_free_w, 0)")
    made = made.withColumn("_budget", F.when(F.col("_full"), F.col("_cap")).otherwise(share))
    return made.drop("_w", "_used", "_left", "_full", "_free", "_free_w", "_cum")


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], share: tuple[int, int], max_epochs: int
) -> DataFrame:
    """Leaves with `_tokens` get `_budget`; the root has `share` (numerator, denominator) of all tokens."""
    # A leaf that any level excludes is no capacity of its ancestors either.
    used = F.lit(True)
    for level, known in zip(levels, weights):
        used = used & (weight_of(F.col(level), known) > 0)
    leaves = leaves.withColumn("_cap", F.when(used, F.col("_tokens") * max_epochs).otherwise(0))
    budgets = leaves.agg(F.expr(f"(sum(_tokens) * {share[0]}) div {share[1]}").alias("_budget"))
    found = None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = leaves.groupBy(*levels[: depth + 1]).agg(F.sum("_cap").alias("_cap"))
        if found is None:
            nodes = nodes.withColumn("_budget", F.lit(0).cast("long")) if budgets is None else nodes.join(budgets)
        else:
            nodes = nodes.join(found.select(*parent, "_budget"), parent)
        found = fill(nodes, parent, level, weights[depth]).select(*levels[: depth + 1], "_budget")
    return leaves.join(found, levels).drop("_cap")


def sent(leaves: DataFrame, count: int) -> DataFrame:
    """The leaves' side of a join with rows: a leaf may have very many rows, so they stay where they are."""
    return F.broadcast(leaves) if count <= SENT_LEAVES else leaves


def prefix_ends(slim: DataFrame, leaves: DataFrame, levels: list[str], seed: int, count: int) -> DataFrame:
    """Leaves with `_epochs` (whole ones) and `_end`, the last order value taken in the next epoch."""
    state = leaves.select(
        *levels,
        F.expr("coalesce(_budget div nullif(_tokens, 0), 0)").alias("_epochs"),
        F.expr("coalesce(_budget % nullif(_tokens, 0), 0)").alias("_rest"),
    ).withColumn("_at", F.lit(""))
    for step in range(STEPS):
        rows = slim.join(sent(state, count), levels).withColumn("_key", epoch_order(seed, F.col("_epochs"), F.col("_id")))
        inside = rows.where(F.col("_key").startswith(F.col("_at"))) if step else rows
        sums = inside.groupBy(*levels, "_rest", F.substring("_key", 1, DIGITS * (step + 1)).alias("_part")).agg(F.sum("_n").alias("_n"))
        order = Window.partitionBy(*levels).orderBy("_part")
        sums = sums.withColumn("_sum", F.sum("_n").over(order))
        # The first part whose sum passes the rest holds the end; without one all is taken.
        last = sums.groupBy(*levels).agg(
            F.min(F.when(F.col("_sum") > F.col("_rest"), F.struct("_part", (F.col("_rest") - F.col("_sum") + F.col("_n")).alias("_rest")))).alias("_last")
        )
        state = cut(
            state.drop("_rest", "_at")
            .join(last, levels, "left")
            .select(*levels, "_epochs", F.coalesce("_last._rest", F.lit(0)).alias("_rest"), F.coalesce("_last._part", F.lit("g")).alias("_at"))
        )
    rows = slim.join(sent(state, count), levels).withColumn("_key", epoch_order(seed, F.col("_epochs"), F.col("_id")))
    ids = rows.where(F.col("_key").startswith(F.col("_at"))).groupBy(*levels, "_rest", "_key").agg(F.sum("_n").alias("_n"))
    ids = ids.withColumn("_sum", F.sum("_n").over(Window.partitionBy(*levels).orderBy("_key")))
    taken = ids.where(F.col("_sum") <= F.col("_rest")).groupBy(*levels).agg(F.max("_key").alias("_last"))
    # Without a row of the last part, the end lies before that part.
    return state.join(taken, levels, "left").select(*levels, "_epochs", F.coalesce("_last", "_at").alias("_end"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: list[dict[str, int]],
    share: tuple[int, int] = (1, 1),
    max_epochs: int = 2,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of `docs` taken, once for each epoch they are in, with `mix_epoch`, `mix_tokens` and the
    level columns `mix_<level>`.

    `levels` names the tree from the top and gives each level's value. The total is
    `share` of all tokens (words).
    """
    names = [f"mix_{n}" for n in levels]
    marks = {f"mix_{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    slim = cut(docs.select(*[c.alias(n) for n, c in marks.items()], F.col(doc_id).alias("_id"), word_count(text).alias("_n")))
    leaves = cut(slim.groupBy(*names).agg(F.sum("_n").alias("_tokens")))
    count = leaves.count()
    ends = cut(prefix_ends(slim, leaf_budgets(leaves, names, weights, share, max_epochs), names, seed, count))
    docs = docs.drop(*[c for c in docs.columns if c in [*names, "mix_epoch", "mix_tokens"] and c not in (doc_id, text)])
    epochs, end = free(docs, "_epochs", "_end")
    ends = ends.withColumnsRenamed({"_epochs": epochs, "_end": end})
    rows = docs.withColumns(marks | {"mix_tokens": word_count(text)}).join(sent(ends, count), names)
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(epochs))))
    inside = (F.col("mix_epoch") < F.col(epochs)) | (epoch_order(seed, F.col("mix_epoch"), F.col(doc_id)) <= F.col(end))
    full = F.col("mix_epoch") < max_epochs
    made = [*names, "mix_epoch", "mix_tokens"]
    return rows.where(full & inside).select(*[c for c in docs.columns if c not in made], *made)


def mix_sql(levels: dict[str, str], weights: list[dict[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """The same mix over `documents` in DuckDB's SQL; gives (doc_id, levels, epoch, tokens)."""
    names = [f"mix_{n}" for n in levels]
    keys = ", ".join(names)
    def weight_sql(depth: int) -> str:
        cases = " ".join(f"WHEN {names[depth]} = '{k}' THEN {w}" for k, w in weights[depth].items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    used = " AND ".join(f"{weight_sql(d)} > 0" for d in range(len(names)))
    ctes = [
        "slim AS (SELECT doc_id, "
        + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS mix_{n}" for n, c in levels.items())
        + f", coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n FROM documents)",
        f"leaves AS (SELECT {keys}, sum(n)::HUGEINT AS tokens, (sum(CASE WHEN {used} THEN n ELSE 0 END) * {max_epochs})::HUGEINT AS cap FROM slim GROUP BY ALL)",
        f"b0 AS (SELECT (sum(tokens) * {share[0]}) // {share[1]} AS budget FROM leaves)",
    ]
    for depth, name in enumerate(names):
        own, parent = names[: depth + 1], names[:depth]
        cols, above = ", ".join(own), ", ".join(parent)
        weight = weight_sql(depth)
        by = f"PARTITION BY {above} " if parent else ""
        source = f"b{depth}" + (f" USING ({above})" if parent else "")
        ctes += [
            f"n{depth} AS (SELECT {cols}, sum(cap)::HUGEINT AS cap0, {weight} AS w0 FROM leaves GROUP BY {cols})",
            f"m{depth} AS (SELECT {cols}, greatest(w0, 1)::HUGEINT AS w, CASE WHEN w0 > 0 THEN cap0 ELSE 0 END AS cap, budget::HUGEINT AS budget"
            f" FROM n{depth} {'JOIN' if parent else 'CROSS JOIN'} {source})",
            f"o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({by}ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,"
            f" sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by}ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM m{depth})",
            f"p{depth} AS (SELECT *, cap * lft <= w * (budget - used) AS filled FROM o{depth})",
            f"q{depth} AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}) AS free, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}) AS free_w,"
            f" sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}ORDER BY cap::DOUBLE / w, {name} ROWS UNBOUNDED PRECEDING) AS cum FROM p{depth})",
            f"b{depth + 1} AS (SELECT {cols}, CASE WHEN filled THEN cap ELSE (free * cum) // free_w - (free * (cum - w)) // free_w END AS budget FROM q{depth})",
        ]
    ctes += [
        f"leaf AS (SELECT {keys}, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest"
        f" FROM leaves JOIN b{len(names)} USING ({keys}))",
        f"marked AS (SELECT slim.*, epochs, rest, md5(concat('{seed}:', epochs, ':', coalesce(doc_id::VARCHAR, ''))) AS k FROM slim JOIN leaf USING ({keys}))",
        f"run AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY k) AS cum FROM marked)",
        f"taken AS (SELECT *, unnest(generate_series(0, epochs::BIGINT)) AS mix_epoch FROM run)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {keys}, mix_epoch, n AS mix_tokens FROM taken"
        f" WHERE mix_epoch < {max_epochs} AND (mix_epoch < epochs OR cum <= rest)"
    )
