"""Structure files: fixed-column atoms, pair-error JSON, feature archives."""

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import number_rows
from ..schema import AA_THREE_TO_ONE, KEY, RESIDUES, lookup
from .features import densify, derive

# --- fixed values -------------------------------------------------------------
BACKBONE = ["N", "CA", "C", "O"]
# (first column, length), 1-based, of the fixed-column atom records.
FIELDS = {
    "record": (1, 6), "atom": (13, 4), "resname": (18, 3), "chain": (22, 1), "resnum": (23, 4),
    "x": (31, 8), "y": (39, 8), "z": (47, 8), "bfactor": (61, 6),
}
FILE_NAME = r"AF-([A-Za-z0-9]+)(?:-F1)?[-.]"
LABEL_CODES = {0: "H", 1: "E", 2: "C"}
PAE_LIMIT = 255
# ------------------------------------------------------------------------------


def identity_from_path(path: Column) -> Column:
    return F.regexp_extract(path, FILE_NAME, 1)


def read_lines(spark: SparkSession, path: str, species: str) -> DataFrame:
    """species, uniprot, line, value: the lines of the first model of structure files."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    return first_model(
        files.select(F.lit(species).alias("species"), identity_from_path(F.col("_path")).alias("uniprot"), "value")
    )


def first_model(files: DataFrame) -> DataFrame:
    """KEY, line, value from whole texts (one structure each): the numbered
    lines before the first end of a model."""
    before = F.substring_index("value", "\nENDMDL", 1)
    return files.select(*KEY, F.posexplode(F.split(before, r"\r?\n")).alias("line", "value"))


def parse_atoms(lines: DataFrame, names: list[str] | None = BACKBONE) -> DataFrame:
    """Atoms from fixed columns: KEY, line, chain, i, atom, aa, x, y, z, plddt.
    ``names`` are the atoms wanted (the backbone by default, all if None).
    Lines without numbers (column ``line``) have no order."""
    if "line" not in lines.columns:
        lines = lines.withColumn("line", F.lit(0))
    def part(name):
        start, size = FIELDS[name]
        return F.trim(F.substring("value", start, size))

    atoms = lines.where(F.col("value").startswith("ATOM")).select(
        *KEY, "line", part("atom").alias("atom"), part("resname").alias("_res"), part("chain").alias("chain"),
        part("resnum").try_cast("long").alias("i"),
        *[part(c).try_cast("float").alias(c) for c in "xyz"],
        part("bfactor").try_cast("float").alias("plddt"),
    ).where(F.col("i").isNotNull() & (F.lit(True) if names is None else F.col("atom").isin(names)))
    return atoms.withColumn("aa", lookup(AA_THREE_TO_ONE, F.col("_res"), "X")).drop("_res")


def backbone(atoms: DataFrame) -> DataFrame:
    """One row per residue with a CA: aa, plddt and the four backbone points;
    a missing N, C or O takes the CA position.  The chain that comes first
    counts, and of repeated records of an atom the last."""
    first_chain = atoms.groupBy(*KEY).agg(F.min(F.struct("line", "chain"))["chain"].alias("chain"))
    atoms = atoms.join(first_chain, [*KEY, "chain"])
    record = F.struct("line", F.struct("x", "y", "z").alias("point"), "aa", "plddt")
    got = atoms.groupBy(*KEY, "i").agg(
        *[F.max(F.when(F.col("atom") == a, record)).alias(a) for a in BACKBONE]
    ).where(F.col("CA").isNotNull())
    return got.select(*KEY, "i", "CA.aa", "CA.plddt", F.col("CA.point").alias("CA"), *[
        F.coalesce(F.col(f"{a}.point"), F.col("CA.point")).alias(a) for a in BACKBONE if a != "CA"
    ])


def residues_from_structure(lines: DataFrame) -> DataFrame:
    """A residue table from structure files alone: no labels, no exposure."""
    bb = backbone(parse_atoms(lines)).select(
        *KEY, "i", "aa", "plddt", F.col("CA.x").alias("x"), F.col("CA.y").alias("y"), F.col("CA.z").alias("z"),
    ).withColumns({"ss": F.lit("C"), "sasa": F.lit(0.0).cast("float")})
    return derive(densify(bb))


def compact_residues(bb: DataFrame) -> DataFrame:
    """Number the residues that have a CA 1..n without gaps (feature files
    keep the original number as ``resnum``)."""
    renamed = bb.withColumnRenamed("i", "resnum")
    return number_rows(renamed, KEY, ["resnum"], F.floor(F.col("resnum") / 4096), "i", "length")


def read_pae_json(spark: SparkSession, path: str, species: str) -> DataFrame:
    """pae_rows from pair-error files: a JSON object, or a list with one.

    One file is one JSON document, so it is one record; its rows become rows
    of the table at once.
    """
    matrix = T.StructType([T.StructField("predicted_aligned_error", T.ArrayType(T.ArrayType(T.DoubleType())))])
    files = spark.read.schema(matrix).option("multiLine", True).json(path).select(
        F.col("_metadata.file_path").alias("_path"), "predicted_aligned_error"
    )
    return pae_rows(files.select(
        F.lit(species).alias("species"), identity_from_path(F.col("_path")).alias("uniprot"),
        F.col("predicted_aligned_error").alias("matrix"),
    ))


def pae_rows(matrices: DataFrame) -> DataFrame:
    """KEY, i, pae (truncated to whole numbers) and ``err`` for rows with a
    value outside 0..255."""
    rows = matrices.select(*KEY, F.posexplode("matrix").alias("_p", "_row"))
    outside = F.exists("_row", lambda v: (v < 0) | (v > PAE_LIMIT))
    return rows.select(
        *KEY, (F.col("_p") + 1).cast("long").alias("i"),
        F.when(~outside, F.transform("_row", lambda v: v.cast("smallint"))).alias("pae"),
        F.when(outside, F.lit("PAE out of range")).alias("err"),
    )


_ARCHIVE = T.StructType([
    T.StructField("species", T.StringType()), T.StructField("uniprot", T.StringType()),
    T.StructField("i", T.LongType()), T.StructField("aa", T.StringType()),
    T.StructField("plddt", T.FloatType()), T.StructField("sasa", T.FloatType()), T.StructField("ss", T.StringType()),
    *[T.StructField(c, T.FloatType()) for c in "xyz"],
    T.StructField("pae", T.ArrayType(T.ShortType())), T.StructField("err", T.StringType()),
])


def _open_archives(species: str):
    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["uniprot"], pdf["content"]):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as a:
                        n = len(a["plddt"])
                        seq = str(np.asarray(a["seq"]).reshape(-1)[0])
                        pae = a["pae"]
                        codes = np.array([LABEL_CODES.get(k, "C") for k in range(256)])
                        out = pd.DataFrame({
                            "species": species, "uniprot": name, "i": np.arange(1, n + 1),
                            "aa": list(seq), "plddt": a["plddt"].astype("f4"), "sasa": a["sasa"].astype("f4"),
                            "ss": codes[a["ss3"].astype(int)],
                            **{c: a["ca_xyz"][:, k].astype("f4") for k, c in enumerate("xyz")},
                        })
                        out["pae"] = list(pae.astype("i2")) if pae.size else [None] * n
                        out["err"] = None
                except Exception as problem:  # a broken file is a row, not a failed job
                    known = {"species": species, "uniprot": name, "err": f"{type(problem).__name__}: {problem}"}
                    out = pd.DataFrame({c: pd.Series([known.get(c)], dtype=object) for c in _ARCHIVE.fieldNames()})
                yield out[_ARCHIVE.fieldNames()]
    return rows


def read_archives(spark: SparkSession, path: str, species: str) -> DataFrame:
    """Feature archives, one file per chain, opened inside tasks.  A broken
    file gives one row with ``err``."""
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"AF-([^/]+)\.npz$", 1).alias("uniprot"), "content"
    )
    return files.mapInPandas(_open_archives(species), _ARCHIVE)


def archive_residues(archives: DataFrame) -> DataFrame:
    good = archives.where("err is null").drop("pae", "err")
    return derive(densify(good)).select(*[f.name for f in RESIDUES.fields])


def archive_pae(archives: DataFrame) -> DataFrame:
    return archives.where("pae is not null").select(*KEY, "i", "pae")


def pool_of_files(spark: SparkSession, path: str) -> DataFrame:
    """uniprot and size of every structure file; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        identity_from_path(F.col("path")).alias("uniprot"), F.col("length").alias("size")
    )


def unfinished(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Chains whose features are not written yet."""
    return inputs.join(done.select(*KEY).distinct(), KEY, "left_anti")
