"""Scoring runs, metrics over many breakdowns, and statistics on them."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text


def evaluate(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Join questions (qid, answer_type, gold_answer, ...) with their
    predicted answers (qid, pred_answer) and score each."""
    joined = questions.join(responses, "qid", "left")
    scored = joined.withColumn(
        "_s", scoring.score(F.col("gold_answer"), F.col("answer_type"), F.coalesce("pred_answer", F.lit("")))
    )
    return scored.select(
        *joined.columns, "_s.correct", "_s.abstained_correctly", "_s.gold_unreliable",
        "_s.pred_unreliable", "_s.failure_mode",
        (F.col("pred_answer").isNull() | (F.col("pred_answer") == "")).alias("no_parseable_answer"),
    )


def parsed_responses(responses: DataFrame) -> DataFrame:
    """qid, answer_type, text -> program / scalar / abstained columns.

    Abstention wins for abstaining types, then a program, then a scalar.  Each
    step is its own projection, so the searched text, its part without
    reasoning and the program are worked out once per row.
    """
    body, kind = F.col("_body"), F.col("answer_type")
    staged = (
        responses.withColumn("_body", text.response_body(F.col("text")))
        .withColumn("abstained", text.declines(body, kind))
        .withColumn("_read", text.strip_reasoning(body))
        .withColumn("program", F.when(~F.col("abstained"), text.program_in(F.col("_read"))))
    )
    scalar = F.when(F.col("abstained"), F.lit("Unreliable")).when(
        F.col("program").isNull(), text.typed_scalar(body, kind)
    )
    return staged.select(*responses.columns, "program", scalar.alias("scalar"), "abstained")


def metrics(scored: DataFrame, sets=((), ("family",), ("template",))) -> DataFrame:
    """Accuracy and selective metrics, all breakdowns in one pass.

    Columns that a row's breakdown does not use are NULL; ``level`` names it.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    right = F.col("correct")
    selective = F.col("gold_unreliable").isNotNull()
    off = selective & F.col("gold_unreliable")
    val = selective & ~F.col("gold_unreliable")
    n_sel = F.count_if(selective)
    aggregates = [
        F.count(F.lit(1)).alias("n_total"),
        F.try_divide(F.count_if(right), F.count(F.lit(1))).alias("accuracy_overall"),
        F.try_divide(F.count_if(off & right), F.count_if(off)).alias("abstention_recall"),
        F.try_divide(F.count_if(val & right), F.count_if(val)).alias("accuracy_when_value"),
        F.try_divide(F.count_if(selective & right), n_sel).alias("selective_accuracy"),
        F.try_divide(F.count_if(F.col("failure_mode") == "over_abstention"), n_sel).alias("over_abstention_rate"),
        F.try_divide(F.count_if(F.col("failure_mode") == "over_confident"), n_sel).alias("over_confident_rate"),
    ]
    grouped = scored.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    return grouped.agg(*aggregates, F.when(level == "", "overall").otherwise(level).alias("level"))


def last_per_question(rows: DataFrame, position: str) -> DataFrame:
    """Result files may repeat a question; the last line wins."""
    others = [c for c in rows.columns if c != "qid"]
    latest = rows.groupBy("qid").agg(F.max_by(F.struct(*others), F.col(position)).alias("_r"))
    return latest.select("qid", *[F.col(f"_r.{c}").alias(c) for c in others])


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first``; questions it lacks come from ``second``."""
    return first.unionByName(second.join(first.select("qid"), "qid", "left_anti"))


def bootstrap(scored: DataFrame, cells: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Accuracy with a 95 % percentile bootstrap interval per cell.

    Resampling n 0/1 values with replacement has a binomially distributed
    sum, so only the counts of a cell travel; the draws are exact in
    distribution for any number of rows.
    """
    counts = scored.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct")
    ).withColumn("_seed", F.abs(F.xxhash64(F.lit(seed), *cells)) % (2**31))

    def intervals(batches):
        for pdf in batches:
            lo, hi = [], []
            for n, c, s in zip(pdf["n"], pdf["n_correct"], pdf["_seed"]):
                means = np.random.default_rng(int(s)).binomial(n, c / n, resamples) / n
                a, b = np.percentile(means, [2.5, 97.5])
                lo.append(a)
                hi.append(b)
            out = pdf.drop(columns="_seed")
            out["accuracy"] = out["n_correct"] / out["n"]
            yield out.assign(ci_low=lo, ci_high=hi)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name != "_seed")
    return counts.mapInPandas(intervals, f"{schema}, accuracy double, ci_low double, ci_high double")


def _two_sided(k: int, n: int) -> float:
    """min(1, 2 P[X <= k]) for X ~ Binomial(n, 1/2), summed from the largest
    term down until terms no longer matter."""
    if n == 0:
        return 1.0
    step = 4096
    total, top = 0.0, k
    log_n = math.lgamma(n + 1)
    while top >= 0:
        j = np.arange(top, max(-1, top - step), -1, dtype=np.float64)
        lg = np.array([math.lgamma(v + 1) + math.lgamma(n - v + 1) for v in j])
        terms = np.exp(log_n - lg - n * math.log(2.0))
        total += float(terms.sum())
        if terms[-1] < total * 1e-17 or terms[-1] == 0.0:
            break
        top -= step
    return min(1.0, 2.0 * total)


def mcnemar(a: DataFrame, b: DataFrame, cells: list[str]) -> DataFrame:
    """Exact paired test on the questions both runs answered, per cell."""
    joined = a.select("qid", *cells, F.col("correct").alias("_a")).join(
        b.select("qid", F.col("correct").alias("_b")), "qid"
    )
    counts = joined.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("n_a_only"),
        F.count_if(~F.col("_a") & F.col("_b")).alias("n_b_only"),
    ).withColumn("n_same", F.col("n_shared") - F.col("n_a_only") - F.col("n_b_only"))

    def with_p(batches):
        for pdf in batches:
            p = [_two_sided(int(min(x, y)), int(x + y)) for x, y in zip(pdf["n_a_only"], pdf["n_b_only"])]
            yield pdf.assign(p_value=pd.Series(p, index=pdf.index, dtype="float64"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(with_p, f"{schema}, p_value double")


def significance(p: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**")
        .when(p < alpha, "*").otherwise("ns")
    )


def p_text(p: Column) -> Column:
    return F.when(p < 1e-4, "<0.0001").when(p < 1e-3, "<0.001").otherwise(F.format_string("%.3f", p))


def with_bonferroni(tests: DataFrame, comparisons: int, alpha: float = 0.05) -> DataFrame:
    corrected = alpha / comparisons
    return tests.withColumns({
        "p_text": p_text(F.col("p_value")),
        "stars": significance(F.col("p_value"), alpha),
        "significant_corrected": F.col("p_value") < corrected,
    })


def class_breakdown(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """Accuracy (percent) per hard-negative class and in total; questions
    without a class count as UNK."""
    joined = scored.join(classes.select("qid", "hn_class"), "qid", "left").withColumn(
        "hn_class", F.coalesce("hn_class", F.lit("UNK"))
    )
    return joined.rollup("hn_class").agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(100.0) * F.count_if(F.col("correct")) / F.count(F.lit(1))).alias("acc"),
        F.grouping("hn_class").alias("_all"),
    ).select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("hn_class")).alias("hn_class"), "n", "acc")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs on their common questions: overall, by family, by template."""
    joined = a.select("qid", "family", "template", F.col("correct").alias("_a")).join(
        b.select("qid", F.col("correct").alias("_b")), "qid"
    )
    n = F.count(F.lit(1))
    level = (
        F.when(F.grouping("family") == 0, "family").when(F.grouping("template") == 0, "template").otherwise("overall")
    )
    out = joined.groupingSets(
        [[], [F.col("family")], [F.col("template")]], F.col("family"), F.col("template")
    ).agg(
        level.alias("level"), F.coalesce("family", "template").alias("name"), n.alias("n"),
        (F.count_if(F.col("_a")) / n).alias("acc_a"), (F.count_if(F.col("_b")) / n).alias("acc_b"),
    )
    return out.select("level", "name", "n", "acc_a", "acc_b", (F.col("acc_b") - F.col("acc_a")).alias("delta"))


def ranked_by_delta(compared: DataFrame) -> DataFrame:
    """One row per template, so the sort is over a short list."""
    return compared.where("level = 'template'").orderBy(F.desc("delta"), "name")


def comparison_table(compared: DataFrame, label_a: str, label_b: str) -> str:
    """LaTeX rows of the family-level summary (a handful of rows)."""
    rows = {(r["level"], r["name"]): r for r in compared.where("level != 'template'").collect()}
    lines = [r"\begin{tabular}{lccr}", r"\toprule",
             rf"Family & {label_a} & {label_b} & $\Delta$ \\", r"\midrule"]
    for (level, name), r in sorted((k, v) for k, v in rows.items() if k[0] == "family"):
        lines.append(rf"{name} & {100*r['acc_a']:.1f}\% & {100*r['acc_b']:.1f}\% & {100*r['delta']:+.1f} \\")
    total = rows.get(("overall", None))
    if total:
        lines += [r"\midrule", rf"Overall & {100*total['acc_a']:.2f}\% & {100*total['acc_b']:.2f}\% & {100*total['delta']:+.2f} \\"]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}"])


def spearman(pairs: DataFrame, x: str, y: str, by: list[str], piece_x: Column, piece_y: Column) -> DataFrame:
    """Rank correlation per group, average ranks for ties.

    Ranks come from counts of distinct values, accumulated piece by piece, so
    a group of any size is ranked without sorting it in one task.
    """
    def ranks(column, piece):
        counted = pairs.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c")).withColumn("_piece", piece)
        inside = Window.partitionBy(*by, "_piece").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = counted.groupBy(*by, "_piece").agg(F.sum("_c").alias("_pc")).withColumn(
            "_before", F.coalesce(F.sum("_pc").over(before), F.lit(0))
        )
        below = F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
        return counted.join(pieces.drop("_pc"), [*by, "_piece"]).select(
            *by, column, (below + (F.col("_c") + 1) / 2).alias(f"_rank_{column}")
        )

    ranked = pairs.join(ranks(x, piece_x), [*by, x]).join(ranks(y, piece_y), [*by, y])
    corr = F.corr(F.col(f"_rank_{x}"), F.col(f"_rank_{y}")).alias("spearman")
    return ranked.groupBy(*by).agg(corr) if by else ranked.agg(corr)
