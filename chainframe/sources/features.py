"""Feature tables: reading, completing and deriving columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import fit_to_length
from ..operators.pairs import neighbor_counts
from ..schema import BLOCK, KEY, RESIDUES, relative_sasa

# --- fixed values: what a position without data holds -------------------------
FILL = {
    "aa": "X", "ss": "C", "plddt": 0.0, "sasa": 0.0, "rel_sasa": 0.0,
    "x": 0.0, "y": 0.0, "z": 0.0, "n_neigh": 0,
}
# ------------------------------------------------------------------------------


def densify(residues: DataFrame) -> DataFrame:
    """One row for every position 1..max(i), missing ones filled, and ``length``.

    The position list is spread over the blocks of a chain before it is
    expanded, so a long chain is expanded by many tasks.
    """
    span = residues.groupBy(*KEY).agg(F.max("i").alias("length"))
    blocks = span.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / BLOCK)))
    )
    positions = blocks.select(
        *KEY, "length",
        F.explode(
            F.sequence(
                F.col("_b") * BLOCK + 1, F.least("length", (F.col("_b") + 1) * BLOCK)
            )
        ).alias("i"),
    )
    filled = positions.join(residues, [*KEY, "i"], "left")
    types = {f.name: f.dataType for f in RESIDUES.fields}
    for name, value in FILL.items():
        if name in residues.columns:
            filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(types[name])))
    return filled


def derive(residues: DataFrame) -> DataFrame:
    """Relative exposure and the stored neighbour count from raw features."""
    with_sasa = residues.withColumn("rel_sasa", relative_sasa(F.col("sasa"), F.col("aa")))
    return neighbor_counts(with_sasa, 8.0)


# Column names of the feature files and of the residue table.
FILE_COLUMNS = {
    "uniprot": "uniprot", "residue": "i", "plddt": "plddt", "ss_3state": "ss",
    "sasa": "sasa", "rel_sasa": "rel_sasa", "ref_aa": "aa", "n_neighbors_8A": "n_neigh",
    "ca_x": "x", "ca_y": "y", "ca_z": "z",
}


def read_feature_parquet(
    spark: SparkSession, path: str, species: str, uniprot: str | None = None
) -> DataFrame:
    """Feature files as a dense residue table; ``uniprot`` is pushed down."""
    raw = spark.read.parquet(path)
    if uniprot is not None:
        raw = raw.where(F.col("uniprot") == uniprot)
    absent = [c for c in ("ca_x", "ca_y", "ca_z") if c not in raw.columns]
    if absent:
        raise ValueError(f"no coordinates in the feature table: {absent}")
    types = {f.name: f.dataType for f in RESIDUES.fields}
    named = raw.select(
        F.lit(species).alias("species"),
        *[F.col(old).cast(types[new]).alias(new) for old, new in FILE_COLUMNS.items() if old in raw.columns],
    )
    return densify(named)


def attach_matrix(pae_rows: DataFrame, residues: DataFrame) -> DataFrame:
    """Rows of the matrix padded or cropped to the chain length."""
    lengths = residues.where("i = 1").select(*KEY, "length")
    return pae_rows.drop("length").join(lengths, KEY).where("i <= length").withColumn(
        "pae", fit_to_length(F.col("pae"), F.col("length"))
    )


def write_features(residues: DataFrame, path: str) -> None:
    """Parquet by species, each chain's positions together and in order."""
    (
        residues.repartition(*KEY, F.floor((F.col("i") - 1) / BLOCK))
        .sortWithinPartitions(*KEY, "i")
        .write.mode("overwrite").partitionBy("species").parquet(path)
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in RESIDUES.fields])
