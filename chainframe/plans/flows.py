"""Whole runs over model output: parse, run the programs in one batch, then
score or vote.

A response that fails at any step is a row: its ``err`` says why, it scores as
unanswered, and it does not vote.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from ..session import cut_lineage
from . import evaluate, programs, voting
from .templates import ChainSet


def executed(questions: DataFrame, responses: DataFrame, chains: ChainSet, templates: list[str] | None = None) -> DataFrame:
    """The response rows with ``program``, ``value`` (text) and ``err``.

    ``questions``: qid, KEY, answer_type; ``responses``: qid, text and whatever
    else tells responses apart.  Equal programs of one question run once.
    ``templates`` is as for ``run_programs``.
    """
    asked = responses.join(questions.select("qid", *KEY, "answer_type"), "qid")
    # Read twice, and its long expressions would be repeated wherever a program or a value is used: computed once.
    parsed = cut_lineage(evaluate.parsed_responses(asked).drop("text"))
    ran_as = F.concat_ws("/", F.sha2("program", 256), "qid")
    wanted = parsed.where("program is not null").select(ran_as.alias("qid"), *KEY, "program").distinct()
    ran = programs.run_programs(wanted, chains, templates).select(F.col("qid").alias("_run"), "answer", "err")
    found = parsed.withColumn("_run", F.when(F.col("program").isNotNull(), ran_as)).join(ran, "_run", "left")
    nothing = F.col("program").isNull() & F.col("scalar").isNull()
    return found.select(
        *responses.drop("text").columns, *KEY, "answer_type", "program", "abstained",
        F.coalesce("answer", "scalar").alias("value"),
        F.when(nothing, "no answer found").otherwise(F.col("err")).alias("err"),
    )


def evaluate_responses(questions: DataFrame, responses: DataFrame, chains: ChainSet, templates: list[str] | None = None) -> DataFrame:
    """Score one response (qid, text) per question; ``questions`` also has
    gold_answer.  Questions without a response are unanswered."""
    got = executed(questions, responses, chains, templates)
    predicted = got.select("qid", F.col("value").alias("pred_answer"), "program", "err")
    return evaluate.evaluate(questions, predicted)


def exec_vote(questions: DataFrame, samples: DataFrame, chains: ChainSet, templates: list[str] | None = None) -> DataFrame:
    """Run every sampled response (qid, idx, text) and vote over the values
    that fit the answer type: qid, answer, agreement."""
    return voting.consensus(executed(questions, samples, chains, templates))
