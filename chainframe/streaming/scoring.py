"""Scoring predictions as they arrive.

A question is scored once: by its first prediction, in order of arrival of the files, then of the lines.  Keyed state
remembers the questions that have a result, so no batch reads earlier results, and a replayed batch finds the state and
the results of the checkpoint as they were before it.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scoring
from ..schema import PREDICTIONS

#: Place of a prediction: arrival of its file, the file, and the line.
PLACE = ["_arrived", "_file", "_line"]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of the JSON-lines files below ``path`` and the place of each; lines that are no JSON object are left
    out.  A file, which is what one process wrote between two flushes, is read as a whole so that its lines have numbers."""
    about = F.col("_metadata")
    files = spark.readStream.option("wholetext", True).text(path).select(
        F.unix_micros(about["file_modification_time"]).alias("_arrived"), about["file_path"].alias("_file"), "value")
    lines = files.select("_arrived", "_file", F.posexplode(F.split("value", "\r?\n")).alias("_line", "_text"))
    rows = lines.where(F.trim("_text").startswith("{")).withColumn("_r", F.from_json("_text", PREDICTIONS))
    return rows.select("_r.*", *PLACE)


def first_predictions(predictions: DataFrame) -> DataFrame:
    """The first prediction of each question that has none yet.  The state is one flag per question."""
    kept = [f for f in predictions.schema if f.name not in PLACE]
    names = [f.name for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for part in parts:
            part = part if best is None else pd.concat([best, part])
            best = part.sort_values(PLACE, kind="stable").head(1)
        if best is not None and len(best):
            state.update((True,))
            yield best[names]

    return predictions.groupBy("qid").applyInPandasWithState(first, schema, "scored boolean", "append", GroupStateTimeout.NoTimeout)


def score_stream(predictions: DataFrame, results: str, checkpoint: str):
    """Start the query; every micro-batch appends its new questions to the files of ``results``."""
    found = scoring.score(F.col("gold_answer"), F.col("answer_type"), F.coalesce("pred_answer", F.lit("")))
    firsts = first_predictions(predictions)
    scored = firsts.withColumn("_s", found).select(
        *firsts.columns, "_s.correct", "_s.abstained_correctly", "_s.gold_unreliable", "_s.pred_unreliable", "_s.failure_mode",
        (F.col("pred_answer").isNull() | (F.col("pred_answer") == "")).alias("no_parseable_answer"),
    )
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", results).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
