"""Chains read from the driver tables.

``event_chains``: one chain per user, positions in time order.  A user may own
any share of the table, so positions are numbered piecewise by minute.
``vector_chains``: the vectors of one label inside one span of 500 vector ids,
in id order.  A chain has at most 500 positions because ids are unique.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..schema import KEY, relative_sasa

SPECIES = ["human", "mouse", "fly", "chicken"]
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
SPAN = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def species_of(number):
    return F.element_at(
        F.array(*[F.lit(s) for s in SPECIES]), (F.pmod(number, F.lit(4)) + 1).cast("int")
    )


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        species_of(F.col("user_id")).alias("species"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("uniprot"),
        "event_id", "ts", "event_type", "value",
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"),
    )


def _event_score():
    return F.least(F.col("value"), F.lit(100.0)).cast("float").alias("plddt")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY and plddt of every position.  Without positions there is nothing to
    number: one scan, no shuffle."""
    return _keyed_events(spark, sf_dir).select(*KEY, _event_score())


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed_events(spark, sf_dir)
    minute = F.unix_date(F.to_date("ts")) * 1440 + F.hour("ts") * 60 + F.minute("ts")
    numbered = number_rows(keyed, KEY, ["ts", "event_id"], minute, "i", "length")
    step = F.col("i") - 1
    cents = F.round(F.col("value") * 100).cast("long")
    placed = numbered.select(
        *KEY, "i", "length",
        F.substring(F.lit(LETTERS), F.pmod("event_id", F.lit(20)).cast("int") + 1, F.lit(1)).alias("aa"),
        _event_score(),
        (F.col("k") * 2.5).cast("float").alias("sasa"),
        F.when(F.col("event_type").isin("view", "click"), "H")
        .when(F.col("event_type").isin("purchase", "signup"), "E")
        .otherwise("C").alias("ss"),
        (F.pmod(step, F.lit(10)) * 3.8 + F.pmod(cents, F.lit(100)) / 100).cast("float").alias("x"),
        (F.pmod(F.floor(step / 10), F.lit(10)) * 3.8 + F.col("k") / 100).cast("float").alias("y"),
        (F.floor(step / 100) * 3.8).cast("float").alias("z"),
    )
    return placed.withColumn("rel_sasa", relative_sasa(F.col("sasa"), F.col("aa")))


def event_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain lengths alone need no positions."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("length")
    ).select(
        species_of(F.col("user_id")).alias("species"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("uniprot"), "length",
    )


def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(
        "label", F.floor(F.col("vec_id") / SPAN).alias("span")
    ).agg(F.count(F.lit(1)).alias("length")).select(
        species_of(F.col("label")).alias("species"),
        F.concat_ws("_", F.lit("V"), F.col("label").cast("string"), F.col("span").cast("string")).alias("uniprot"),
        "length",
    )


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    keyed = vectors.select(
        species_of(F.col("label")).alias("species"),
        F.concat_ws(
            "_", F.lit("V"), F.col("label").cast("string"),
            F.floor(F.col("vec_id") / SPAN).cast("string"),
        ).alias("uniprot"),
        "vec_id",
        *[F.col("embedding")[n].cast("double").alias(f"e{n}") for n in range(9)],
    )
    # At most SPAN rows per chain, so a plain window is bounded.
    chain = Window.partitionBy(*KEY)
    return (
        keyed.withColumn("i", F.row_number().over(chain.orderBy("vec_id")).cast("long"))
        .withColumn("length", F.count(F.lit(1)).over(chain))
    )


def vector_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    placed = v.select(
        *KEY, "i", "length",
        F.substring(F.lit(LETTERS), F.pmod("vec_id", F.lit(20)).cast("int") + 1, F.lit(1)).alias("aa"),
        F.least(F.abs("e0") * 600, F.lit(100.0)).cast("float").alias("plddt"),
        (F.abs("e7") * 900).cast("float").alias("sasa"),
        F.when(F.col("e3") > 0.04, "H").when(F.col("e3") < -0.04, "E").otherwise("C").alias("ss"),
        *[(F.col(f"e{n}") * 60).cast("float").alias(axis) for n, axis in enumerate("xyz")],
    )
    return placed.withColumn("rel_sasa", relative_sasa(F.col("sasa"), F.col("aa")))


def vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pae_rows of the vector chains: cell (i, j) = |e_i[4] - e_j[5]| * 60."""
    v = _vectors(spark, sf_dir)
    columns = v.groupBy(*KEY).agg(
        # one array per chain of at most SPAN numbers
        F.array_sort(F.collect_list(F.struct("i", "e5"))).alias("_others")
    )
    return v.select(*KEY, "i", "length", "e4").join(columns, KEY).select(
        *KEY, "i", "length",
        F.transform(
            "_others", lambda o: F.floor(F.abs(F.col("e4") - o["e5"]) * 60).cast("smallint")
        ).alias("pae"),
    )
