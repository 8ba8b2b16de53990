"""Mixing sources to target weights with a hierarchical budget.

The leaves of a tree (say domain, language, source) hold documents.  A token budget flows from the root: a node's
children get shares by weight, none more than it can give (its tokens times ``max_epochs``); what one cannot take goes
to its siblings by their weights, and only what a whole family cannot take goes to the family's own siblings.  A leaf
fulfils its budget with whole epochs of its documents and a prefix of one more, each epoch in an order of its own that
the seed gives.  Documents are whole, so a prefix ends before its budget; what is left goes to the next documents of
siblings, then of the family's siblings (``granted``); what even that leaves goes on to the leaf that can take most of it,
wherever it stands, until no leaf's next document fits into what is left of all.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of a piece of a leaf's order, about.
PIECE = 10_000


def shares(amount: int, weights: list[float], capacity: list[int]) -> list[int]:
    """``amount`` by weight, none above its capacity, shortages to the others by weight; whole numbers by largest
    remainder (ties to the first).  Weights of 0 get nothing.  The sum is the amount or, if less, what can be taken."""
    out, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and capacity[i] > 0]
    amount = min(amount, sum(capacity[i] for i in open_))
    left = float(amount)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if capacity[i] <= left * weights[i] / total]
        for i in full or open_:
            out[i] = float(capacity[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(capacity[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    whole = [min(c, math.floor(x)) for x, c in zip(out, capacity)]
    order = sorted(range(len(out)), key=lambda i: (whole[i] - out[i], i))
    for i in order * 2:
        if sum(whole) >= amount:
            break
        if weights[i] > 0 and whole[i] < capacity[i]:
            whole[i] += 1
    return whole


def budgets(leaves: Mapping[tuple, int], amount: int, weights: Mapping[tuple, float], max_epochs: int) -> dict[tuple, int]:
    """Token budget of each leaf.  ``weights`` is by node (a prefix of a leaf's path); others weigh 1."""
    capacity: dict[tuple, int] = {}
    children: dict[tuple, set] = {}
    for path, tokens in leaves.items():
        for k in range(len(path) + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0) + tokens * max_epochs
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
    out, todo = {}, [((), amount)]
    while todo:
        node, given = todo.pop()
        if node not in children:
            out[node] = given
            continue
        own = sorted(children[node])
        todo += zip(own, shares(given, [weights.get(c, 1.0) for c in own], [capacity[c] for c in own]))
    return {p: out.get(p, 0) for p in leaves}


def granted(left: dict[tuple, int], nexts: Mapping[tuple, int], spare: int = 0) -> tuple[set[tuple], int]:
    """The leaves that may take their next document (of ``nexts`` tokens), and the tokens that stay.

    ``left`` is what each leaf lacks.  It is pooled in the leaf's family, which serves the leaves that lack the largest
    part of their next document first; what a family does not use is pooled with its siblings; ``spare`` joins at the root.
    """
    order = sorted(nexts, key=lambda p: (-left.get(p, 0) / nexts[p], nexts[p], p))
    pool, taken = dict(left), set()
    for k in range(max(map(len, left), default=0) - 1, -1, -1):
        up: dict[tuple, int] = {(): spare} if k == 0 else {}
        for path, tokens in pool.items():
            up[path[:k]] = up.get(path[:k], 0) + tokens
        for path in order:
            if path not in taken and nexts[path] <= up.get(path[:k], 0):
                up[path[:k]] -= nexts[path]
                taken.add(path)
        pool = up
    return taken, sum(pool.values())


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: Mapping[tuple, float], share: float,
    max_epochs: int = 1, seed: int = 0, tokens: Column | None = None,
) -> DataFrame:
    """Per row: doc_id, the level columns, n_tokens, budget (tokens that its leaf delivers), copies (times the document is taken).

    ``share`` times all tokens is the budget.  Null levels are the value ``null``.  In each epoch the documents stand in
    the order of a hash of seed, epoch and doc_id; of the last, partial epoch those stay whose running total is within
    the rest, and those that ``granted`` adds from what other leaves leave.  Documents without tokens are taken with every epoch of their leaf and never fill it.  Rows that agree in
    doc_id and tokens are exchangeable.

    The leaves (one row per path of the tree) come to the driver; documents do not.  Running totals use pieces of about
    ``PIECE`` documents, so a leaf with most rows is spread.
    """
    names = list(levels)
    rows = docs.select(
        "doc_id", *[F.coalesce(c.cast("string"), F.lit("null")).alias(n) for n, c in levels.items()],
        (tokens if tokens is not None else word_count()).alias("n_tokens"),
    )
    counted = rows.groupBy(*names).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    leaves = {tuple(r[n] for n in names): r["n"] for r in counted}
    given = budgets(leaves, int(share * sum(leaves.values())), weights, max_epochs)
    bits = max(0, math.ceil(math.log2(max([1, *(r["docs"] for r in counted)]) / PIECE)))
    types, spark = ", ".join(f"`{n}` string" for n in names), docs.sparkSession

    def per_leaf(fields: str, plan: list[tuple]) -> DataFrame:
        # One row per leaf.
        return F.broadcast(spark.createDataFrame(plan, f"{types}, {fields}"))

    free = {p for p in leaves if leaves[p] and all(weights.get(p[:k], 1.0) > 0 for k in range(1, len(p) + 1))}
    spare, first = 0, True
    while True:
        epochs = {p: given[p] // n if n else 0 for p, n in leaves.items()}
        rest = {p: given[p] - epochs[p] * n for p, n in leaves.items()}
        order = written(_running(rows, names, per_leaf("epochs long", [(*p, e) for p, e in epochs.items()]), seed, bits))

        def ends(most: int) -> dict[tuple, tuple[int, int, int]]:
            """Of each leaf, running totals of its order: the last within the rest, the next one, the last within ``most`` more."""
            r, u = F.col("rest"), F.col("_upto")
            found = order.join(per_leaf("rest long", [(*p, x) for p, x in rest.items()]), names).groupBy(*names).agg(
                F.max(F.when(u <= r, u)).alias("here"), F.min(F.when(u > r, u)).alias("next"), F.max(F.when(u <= r + most, u)).alias("far"))
            return {tuple(x[n] for n in names): (x["here"] or 0, x["next"] or 0, x["far"] or 0) for x in found.collect()}

        if first:
            at, first = ends(0), False
            left = {p: rest[p] - at[p][0] for p in rest}
            rest = {p: at[p][0] for p in rest}
            taken, spare = granted(left, {p: at[p][1] - rest[p] for p in free if epochs[p] < max_epochs and at[p][1]})
            rest |= {p: at[p][1] for p in taken}
        # What is left of all goes on down the orders; each round, one leaf at least takes all that it ever can.
        while spare:
            at = ends(spare)
            more = sorted((rest[p] - at[p][2], p) for p in free if epochs[p] < max_epochs and at[p][2] > rest[p])
            for add, p in more:
                if -add <= spare:
                    rest[p], spare = rest[p] - add, spare + add
            if not more:
                break
        given = {p: epochs[p] * leaves[p] + rest[p] for p in leaves}
        # A leaf at the end of an epoch can go on in the order of the next one.
        if not spare or not any(rest[p] == leaves[p] and epochs[p] + 1 < max_epochs for p in free):
            break
    plan = [(*p, given[p], epochs[p], rest[p]) for p in sorted(leaves)]
    partial = ((F.col("rest") > 0) & (F.col("_upto") <= F.col("rest"))).cast("long")
    return order.drop("epochs").join(per_leaf("budget long, epochs long, rest long", plan), names).select(
        "doc_id", *names, "n_tokens", "budget", (F.col("epochs") + partial).alias("copies"))


def _running(rows: DataFrame, names: list[str], epochs: DataFrame, seed: int, bits: int) -> DataFrame:
    """``rows`` with the running total of their leaf's tokens in the order of its first unfinished epoch."""
    identity = F.concat_ws("/", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = rows.join(epochs, names).withColumn("_draw", F.md5(identity))
    drawn = drawn.withColumn("_piece", F.shiftright(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long"), 32 - min(bits, 31)))
    sums = drawn.groupBy(*names, "_piece").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*names, "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*names, "_piece").orderBy("_draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = (F.col("_before") + F.sum("n_tokens").over(inside)).alias("_upto")
    return drawn.join(before, [*names, "_piece"]).select("doc_id", *names, "n_tokens", "epochs", upto)


def taken_rows(
    docs: DataFrame, levels: dict[str, Column], weights: Mapping[tuple, float], share: float, tokens: Column | None = None, **options
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; columns as given.

    ``mix`` counts copies of rows that agree in doc_id and tokens.  Where those do not divide among the rows, the rest goes
    to the first rows by a digest of their content; equal rows are counted, not ordered, and running totals are kept per
    piece of the digests.
    """
    count = tokens if tokens is not None else word_count()
    taken = mix(docs, levels, weights, share, tokens=tokens, **options).groupBy("doc_id", "n_tokens").agg(
        F.sum("copies").alias("_take"), F.count(F.lit(1)).alias("_rows")).where("_take > 0").withColumnsRenamed(
        {"doc_id": "_of", "n_tokens": "_tokens"})
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), count.alias("_n"))
    found = rows.join(taken, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_n") == F.col("_tokens")))
    each, rest = F.floor(F.col("_take") / F.col("_rows")), F.col("_take") % F.col("_rows")
    even = found.select("_row", each.alias("_copies"))
    digest = F.sha2(F.to_json("_row"), 256)
    variants = found.where(rest != 0).select("_row", "_id", "_n", rest.alias("_rest"), digest.alias("_key")).groupBy(
        "_id", "_n", "_rest", "_key").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_c")).withColumn(
        "_piece", F.substring("_key", 1, 2))
    group, first = ["_id", "_n"], Window.unboundedPreceding
    pieces = variants.groupBy(*group, "_piece").agg(F.sum("_c").alias("_s")).select(
        F.col("_id").alias("_i"), F.col("_n").alias("_m"), F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_piece").rowsBetween(first, -1)), F.lit(0)).alias("_earlier"))
    upto = F.sum("_c").over(Window.partitionBy(*group, "_piece").orderBy("_key").rowsBetween(first, 0))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_n") == F.col("_m")) & (F.col("_piece") == F.col("_p"))
    before = F.col("_earlier") + F.col("_upto") - F.col("_c")
    odd = variants.withColumn("_upto", upto).join(pieces, same).select(
        "_row", F.greatest(F.least(F.col("_c"), F.col("_rest") - before), F.lit(0)).alias("_copies"))
    # Copies are made in two steps, so that no array is as long as their number.
    many = even.unionByName(odd).where("_copies > 0").select("_row", "_copies", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_copies") - 1), F.lit(1000).cast("long"))).alias("_k"))
    copied = many.select("_row", F.explode(F.sequence(F.col("_k"), F.least(F.col("_k") + 999, F.col("_copies") - 1))).alias("_k"))
    return copied.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
