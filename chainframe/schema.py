"""Column conventions shared by every operator.

A *chain* is an ordered sequence with features at each position.  It is keyed
by ``KEY`` and stored long: one row per position ``i`` (1-based, dense), with
the chain length denormalised onto every row so that "last n" style regions
never need a join.

``block`` and ``tile`` are functions of the position.  They are what keeps a
single huge chain from landing in one task: everything that has to look at
neighbouring rows is keyed by (chain, block), never by chain alone.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["species", "uniprot"]

# Rows of one chain that share a task in position-ordered work.
BLOCK = 65_536
# Rows of one chain matched against a region in a single join bucket.
TILE = 64

RESIDUES = T.StructType(
    [
        T.StructField("species", T.StringType()),
        T.StructField("uniprot", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("aa", T.StringType()),
        T.StructField("plddt", T.FloatType()),
        T.StructField("sasa", T.FloatType()),
        T.StructField("rel_sasa", T.FloatType()),
        T.StructField("n_neigh", T.LongType()),
        T.StructField("ss", T.StringType()),
        T.StructField("x", T.FloatType()),
        T.StructField("y", T.FloatType()),
        T.StructField("z", T.FloatType()),
    ]
)

QUESTIONS = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("uniprot", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("program", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("answer_type", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("paraphrase_id", T.IntegerType()),
    ]
)

HARD_NEGATIVES = T.StructType(
    QUESTIONS.fields
    + [
        T.StructField("is_hard_negative", T.BooleanType()),
        T.StructField("hn_class", T.StringType()),
        T.StructField("hn_source_qid", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("answer_type", T.StringType()),
        T.StructField("gold_answer", T.StringType()),
        T.StructField("pred_answer", T.StringType()),
    ]
)

# --- fixed values -----------------------------------------------------------
# Theoretical maximum accessible area per residue letter (Tien et al. 2013);
# 200 stands in for any letter that is not listed.
MAX_SASA = {
    "A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0,
    "E": 223.0, "Q": 225.0, "G": 104.0, "H": 224.0, "I": 197.0,
    "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0, "P": 159.0,
    "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0,
    "X": 200.0,
}
MAX_SASA_DEFAULT = 200.0

AA_THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
# ----------------------------------------------------------------------------


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def lookup(mapping: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), key), F.lit(default))


def block_of(i: Column) -> Column:
    return F.floor((i - 1) / F.lit(BLOCK))


def tile_of(i: Column) -> Column:
    return F.floor((i - 1) / F.lit(TILE))


def relative_sasa(sasa: Column, aa: Column) -> Column:
    top = F.greatest(lookup(MAX_SASA, aa, MAX_SASA_DEFAULT), F.lit(1e-3))
    ratio = (sasa.cast("double") / top).cast("float")
    return F.least(F.greatest(ratio, F.lit(0.0).cast("float")), F.lit(1.5).cast("float"))
