"""Splits, samples and their audits.  Every random choice is an order by hash,
ranked piecewise, so samples are reproducible and no stratum, however large,
is sorted by one task."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import hash_int, hash_rank, number_rows

# --- fixed values -------------------------------------------------------------
TRAIN_SHARE, DEV_SHARE = 0.8, 0.1
SIZE_BUCKETS = 5
# ------------------------------------------------------------------------------


def protein_partition(questions: DataFrame, species: str = "human", seed=42) -> DataFrame:
    """Chains of one species cut 80 / 10 / 10: species, uniprot, part."""
    ids = questions.where(F.col("species") == species).select("species", "uniprot").distinct()
    ranked = hash_rank(ids, ["species"], "uniprot", seed, "_rank", total="_n")
    n_train, n_dev = F.rint(F.col("_n") * TRAIN_SHARE), F.rint(F.col("_n") * DEV_SHARE)
    part = (
        F.when(F.col("_rank") <= n_train, "train")
        .when(F.col("_rank") <= n_train + n_dev, "dev").otherwise("test_iid")
    )
    return ranked.select("species", "uniprot", part.alias("part"))


def compose(questions: DataFrame, hard_negatives: DataFrame, species: str = "human", seed=42) -> DataFrame:
    """Route every row to its split (column ``split``)."""
    parts = protein_partition(questions, species, seed)
    base = F.col("family").isin("A", "B", "C", "D", "E", "F")
    split = (
        F.when(base & (F.col("species") == species), F.coalesce("part", F.lit("test_iid")))
        .when(base, "test_cross_species")
        .when(F.col("family") == "G", "test_compositional")
        .when(F.col("family") == "Ha", "test_selective_prompted")
        .when(F.col("family") == "Hb", "test_selective_unprompted")
    )
    routed = questions.join(parts, ["species", "uniprot"], "left").withColumn("split", split).drop("part")
    return routed.where("split is not null").unionByName(
        hard_negatives.withColumn("split", F.lit("test_hn")), allowMissingColumns=True
    )


def split_counts(split_rows: DataFrame) -> DataFrame:
    """Rows per split and family, with totals (NULL family / split)."""
    return split_rows.rollup("split", "family").agg(F.count(F.lit(1)).alias("n"))


def manifest(split_rows: DataFrame) -> DataFrame:
    """One JSON object per split: size and counts by family."""
    cells = split_rows.groupBy("split", "family").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("split").agg(
        F.sum("n").alias("n"),
        # a split has one entry per family, ten at most
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("families"),
    ).select("split", F.to_json(F.struct("n", "families")).alias("entry"))


@dataclass
class Cell:
    key: tuple
    available: int
    take: int = 0


def allocate(counts: dict[tuple, int], target: int, floor: int) -> dict[tuple, int]:
    """How many rows to take from each stratum.

    Proportional with a floor; a shortfall is handed out one row at a time to
    strata with rows left, a surplus is taken back one at a time from strata
    above the floor, largest first.
    """
    total = sum(counts.values())
    cells = [
        Cell(key, n, min(n, max(floor, round(target * n / total))))
        for key, n in sorted(counts.items(), key=lambda kv: (-kv[1], str(kv[0])))
    ]
    gap = target - sum(c.take for c in cells)
    while gap:
        if gap > 0:
            movable = [c for c in cells if c.take < c.available]
        else:
            movable = sorted((c for c in cells if c.take > floor), key=lambda c: -c.take)
        if not movable:
            break
        step = 1 if gap > 0 else -1
        for c in movable[: abs(gap)]:
            c.take += step
            gap -= step
    return {c.key: c.take for c in cells}


def stratified_sample(
    rows: DataFrame, target: int, by: list[str], identity: str = "qid", floor: int = 30, seed=42
) -> DataFrame:
    """Only stratum sizes reach the driver; rows are picked by rank."""
    sizes = {tuple(r[c] for c in by): r["count"] for r in rows.groupBy(*by).count().collect()}
    wanted = allocate(sizes, target, floor)
    schema = rows.select(*by).schema.add("_take", "long")
    table = rows.sparkSession.createDataFrame([(*k, v) for k, v in wanted.items()], schema)
    ranked = hash_rank(rows, by, identity, seed, "_rank")
    return ranked.join(table, by).where("_rank <= _take").drop("_rank", "_take")


def sample_audit(sample: DataFrame, by: list[str]) -> DataFrame:
    cells = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(
        F.sum("n").alias("actual"), F.count(F.lit(1)).alias("n_cells"),
        F.min("n").alias("min_cell"), F.max("n").alias("max_cell"),
        # the upper median of the cell sizes; there are as many as strata
        F.element_at(F.array_sort(F.collect_list("n")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median_cell"),
    )


def marginals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n and share of every listed column, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = rows.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("column").agg(F.sum("n").alias("_all"))
    return counted.join(totals, "column").select("column", "value", "n", (F.col("n") / F.col("_all")).alias("share"))


def divergence(sample: DataFrame, full: DataFrame, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """KL(sample || full) per column."""
    p = marginals(sample, columns).select("column", "value", F.col("share").alias("p"))
    q = marginals(full, columns).select("column", "value", F.col("share").alias("q"))
    both = p.join(q, ["column", "value"], "full").fillna(eps, ["p", "q"])
    return both.groupBy("column").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def without_leaks(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Drop rows whose (species, uniprot, template) occurs in training."""
    key = ["species", "uniprot", "template"]
    return rows.join(train.select(*key).distinct(), key, "left_anti")


def overlap(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Shared chains and shared (chain, template) pairs with training."""
    out = None
    for name, key in (("protein", ["species", "uniprot"]), ("pair", ["species", "uniprot", "template"])):
        mine = rows.select(*key).distinct()
        shared = mine.join(train.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left").agg(
            F.lit(name).alias("level"), F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_shared")
        )
        out = shared if out is None else out.unionByName(shared)
    return out.withColumn("rate", F.try_divide("n_shared", "n"))


def size_bucket(rank: Column, total: Column) -> Column:
    """Bucket b holds sorted positions (n*b)//5 .. (n*(b+1))//5 - 1."""
    return F.floor((SIZE_BUCKETS * rank - 1) / total)


def with_size_buckets(items: DataFrame, identity: str, size: str, piece: Column) -> DataFrame:
    """Rank all items by size and cut them into five buckets of equal count:
    adds bucket, place (0-based inside the bucket) and bucket_size."""
    ranked = number_rows(items.withColumn("_one", F.lit(1)), ["_one"], [size, identity], piece, "_rank", "_n")
    bucket = size_bucket(F.col("_rank"), F.col("_n"))
    lo = F.floor(F.col("_n") * F.col("bucket") / SIZE_BUCKETS)
    hi = F.floor(F.col("_n") * (F.col("bucket") + 1) / SIZE_BUCKETS)
    return (
        ranked.withColumn("bucket", bucket)
        .withColumn("place", F.col("_rank") - 1 - lo)
        .withColumn("bucket_size", hi - lo).drop("_one", "_rank")
    )


def sample_by_size(items: DataFrame, target: int, identity: str, size: str, piece: Column, seed=42) -> DataFrame:
    """About target / 5 random items of each size bucket; the remainder goes
    to the first buckets, and small pools are taken whole."""
    placed = with_size_buckets(items, identity, size, piece)
    ranked = hash_rank(placed, ["bucket"], identity, seed, "_rank")
    share = F.lit(target // SIZE_BUCKETS) + (F.col("bucket") < target % SIZE_BUCKETS).cast("int")
    keep = (F.col("_n") <= target) | (F.col("_rank") <= share)
    return ranked.where(keep).drop("_rank", "_n", "place", "bucket_size")


def stride_by_size(items: DataFrame, target: int, identity: str, size: str, piece: Column) -> DataFrame:
    """Every k-th item of each size bucket; no randomness at all."""
    per = max(1, target // SIZE_BUCKETS)
    placed = with_size_buckets(items, identity, size, piece)
    stride = F.greatest(F.lit(1), F.floor(F.col("bucket_size") / per))
    keep = (F.pmod("place", stride) == 0) & (F.floor(F.col("place") / stride) < per)
    return placed.where((F.col("_n") <= target) | keep).drop("_n", "place", "bucket_size")


def head_per_group(rows: DataFrame, by: list[str], n: int, identity: str = "qid", seed=0) -> DataFrame:
    """The first n rows of each group in a random order."""
    return hash_rank(rows, by, identity, seed, "_rank").where(F.col("_rank") <= n).drop("_rank")


def replaced_ids(current: DataFrame, removed: DataFrame, added: DataFrame, column: str) -> DataFrame:
    """(current - removed) + added, each id once."""
    kept = current.select(column).join(removed.select(column), column, "left_anti")
    return kept.unionByName(added.select(column)).distinct()


def excluded_ids(tables: list[DataFrame], column: str) -> DataFrame:
    """Distinct ids over several exclusion lists."""
    out = tables[0].select(column)
    for t in tables[1:]:
        out = out.unionByName(t.select(column))
    return out.where(F.col(column).isNotNull()).distinct()


def digest(rows: DataFrame, identity: str, buckets: int = 4096) -> DataFrame:
    """SHA-256 over all rows in id order.  Rows are hashed into groups by id
    hash first; the final digest is over the group digests, so no task sees
    more than one group's row digests."""
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    cells = rows.select(F.pmod(hash_int(F.col(identity)), F.lit(buckets)).alias("b"), F.col(identity).cast("string").alias("k"), line.alias("h"))
    # A group's digest is the sum of its row digests, taken as numbers, so it
    # does not depend on order and combines map-side.
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * n, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{n}") for n in range(8)]
    groups = cells.groupBy("b").agg(*parts, F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(",", "b", "n", *[f"s{n}" for n in range(8)])
    return groups.agg(
        F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("b", text.alias("t")))), lambda g: g["t"])), 256).alias("digest"),
        F.sum("n").alias("n"),
    )
