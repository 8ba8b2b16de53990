"""The lexical gate takes texts apart once for the fit."""

from pyspark.sql import functions as F

from chainframe.plans import gates


def test_texts_of_the_fit_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(f"good word {i}" if i % 2 else f"bad term {i}", float(i % 2)) for i in range(40)], "question string, label double")
    train = rows.mapInPandas(noted, rows.schema)
    got = gates.lexical_gate(train, rows.where(F.col("question").contains("1"))).first()
    assert seen.value == 40
    assert (got["n_test"], got["accuracy"], got["passed"]) == (13, 1.0, False)
