"""The driver's garbage goes with each written table, and before the toxicity model is fitted beside the JVM."""

from pyspark.sql import functions as F

from chainframe.llm import toxicity
from chainframe.llm.common import written


def whole_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    partial = ("Young", "Copy", "Scavenge", "Concurrent")
    return sum(b.getCollectionCount() for b in beans if not any(p in b.getName() for p in partial))


def test_garbage_goes_with_the_write(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    before = whole_collections(spark)
    first = written(rows)
    between = whole_collections(spark)
    second = written(first.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert before < between < whole_collections(spark)
    assert second.agg(F.sum("n")).first()[0] == 1000


def test_garbage_of_the_rows_goes_before_the_fit(spark, monkeypatch):
    frame = type(spark.range(1))
    seen, collect, fit = {}, frame.collect, toxicity.fit_logistic

    def collected(df):
        out = collect(df)
        seen["rows"] = whole_collections(spark)
        return out

    def fitted(*args, **options):
        seen["fit"] = whole_collections(spark)
        return fit(*args, **options)

    monkeypatch.setattr(frame, "collect", collected)
    monkeypatch.setattr(toxicity, "fit_logistic", fitted)
    docs = spark.createDataFrame([(i, f"good day {i}" if i % 2 else f"vile day {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert seen["rows"] < seen["fit"]
    monkeypatch.undo()
    assert {r["doc_id"] % 2 for r in scored.collect() if r["score"] > 0.5} == {0}
    # Nothing to learn from.
    assert toxicity.fit(docs, labels.limit(0)).bias == toxicity.fit(docs.limit(0), labels).bias
