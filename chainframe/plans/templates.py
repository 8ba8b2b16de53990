"""Question templates: how parameters are drawn, how the program reads, and
the one relational plan that answers a template for every chain and every
parameter row at once.

A question row has ``qid``, the chain key, ``length`` and ``params``
(MAP<STRING, DOUBLE>).  A plan returns ``qid``, exactly one filled value
column out of ``b`` / ``n`` / ``f`` / ``s`` / (``r_start``, ``r_end``), and
``err``.  Set-valued templates return one row per member instead (``qid``,
``i`` and, for pairs, ``j``).
"""

import itertools
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matrix, offline, pairs, quantify, regions, runs, windows
from ..operators.ranking import hash_int
from ..schema import BLOCK, KEY, block_of

VALUE_COLUMNS = {
    "b": "boolean", "n": "bigint", "f": "double", "s": "string",
    "r_start": "bigint", "r_end": "bigint",
}


class ChainSet:
    """The tables that plans read: residues, the chain lengths, and the matrix
    if there is one.  ``literals`` lists the values a literal can take where
    that is known beforehand."""

    def __init__(self, residues: DataFrame, pae_rows: DataFrame | None = None,
                 lengths: DataFrame | None = None, literals: dict[str, list] | None = None):
        self.residues = residues
        self.pae_rows = pae_rows
        self.lengths = lengths
        self.literals = literals or {}

    def chains(self) -> DataFrame:
        if self.lengths is not None:
            return self.lengths
        return self.residues.where("i = 1").select(*KEY, "length")

    def with_literals(self, literals: dict[str, list]) -> "ChainSet":
        return ChainSet(self.residues, self.pae_rows, self.lengths, literals)


def param(name: str, kind: str = "long") -> Column:
    return F.try_element_at(F.col("params"), F.lit(name)).try_cast(kind)


def answers(df: DataFrame, err: Column | None = None, **values: Column) -> DataFrame:
    problem = (err if err is not None else F.lit(None)).cast("string")
    cols = [F.col("qid")]
    for name, kind in VALUE_COLUMNS.items():
        value = values.get(name, F.lit(None)).cast(kind)
        cols.append(F.when(problem.isNull(), value).alias(name))
    return df.select(*cols, problem.alias("err"))


def at_position(q: DataFrame, residues: DataFrame, i: Column, names: dict[str, str]) -> DataFrame:
    """Left lookup of features at a position; absent columns stay NULL.

    The right side has one row per position, so it is a merge join by hint: sized from the file, it would go through the driver.
    """
    right = residues.select(*KEY, F.col("i").alias("_at"), *[F.col(c).alias(n) for n, c in names.items()])
    return q.withColumn("_at", i).join(right.hint("merge"), [*KEY, "_at"], "left").drop("_at")


def index_error(*indices: Column) -> Column:
    return F.coalesce(*[regions.position_problem(i, F.col("length")) for i in indices])


def levels_of(c: ChainSet, *names: str) -> list[tuple] | None:
    """The literal combinations that the template draws from, if that is how
    the questions came about: a handful, and one pass over the data serves
    them all.  Otherwise None, and literals stay rows."""
    if all(n in c.literals for n in names):
        return sorted(itertools.product(*[[float(v) for v in c.literals[n]] for n in names]))
    return None


def per_level(rows: DataFrame, by: list[str], names: list[str], levels, measure) -> DataFrame:
    """One aggregate per listed literal combination in a single pass: ``by``,
    the literals as columns, ``value``."""
    cells = [
        F.struct(
            *[F.lit(float(v)).alias(n) for n, v in zip(names, level)],
            measure(*level).alias("value"),
        )
        for level in levels
    ]
    return (
        rows.groupBy(*by)
        .agg(F.array(*cells).alias("_cells"))
        .select(*by, F.explode("_cells").alias("_c"))
        .select(*by, *[F.col(f"_c.{n}").alias(n) for n in names], F.col("_c.value").alias("value"))
    )


def with_level(q: DataFrame, values: DataFrame, names: list[str], by=KEY) -> DataFrame:
    """Attach a per-level value to the questions that asked for that level.

    The values have a row for each level of each group, which Spark counts as one, so the join is a merge by hint.
    """
    keyed = q
    for n in names:
        keyed = keyed.withColumn(n, param(n, "double"))
    return keyed.join(values.hint("merge"), [*by, *names], "left")


def over_blocks(q: DataFrame) -> DataFrame:
    """Copy a question to every block of its chain, so that set answers are
    produced block by block."""
    last = F.floor((F.col("length") - 1) / BLOCK)
    return q.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


# ------------------------------------------------------------------ plans --

def _region_metric(metric, column):
    def plan(q, c):
        asked = q.select("qid", *KEY, "length", param("start").alias("start"), param("end").alias("end"))
        got = regions.region_values(asked, c.residues, {"v": metric})
        return answers(got, F.col("err"), **{column: F.col("v")})
    return plan


def _termini(q, c):
    w = param("window")
    sides = F.array(
        F.struct(F.lit("N").alias("side"), F.lit(1).cast("long").alias("start"), w.alias("end")),
        F.struct(F.lit("C").alias("side"), (F.col("length") - w + 1).alias("start"),
                 F.col("length").alias("end")),
    )
    fits = F.when(w.between(1, F.col("length")), sides)
    asked = q.select("qid", *KEY, "length", F.explode_outer(fits).alias("r")).select(
        F.concat_ws("|", "qid", "r.side").alias("rid"), *KEY, "length", "r.start", "r.end"
    )
    side = F.substring("rid", -1, 1)
    means = regions.region_values(asked, c.residues, {"v": windows.mean("plddt")}, "rid").withColumn(
        "qid", F.expr("substring(rid, 1, length(rid) - 2)")).groupBy("qid").agg(
        F.max(F.when(side == "N", F.col("v"))).alias("n_mean"),
        F.max(F.when(side == "C", F.col("v"))).alias("c_mean"),
    )
    got = q.join(means, "qid", "left")
    lower = F.when(param("n_first") == 1, F.col("n_mean") < F.col("c_mean")).otherwise(
        F.col("c_mean") < F.col("n_mean")
    )
    return answers(got, regions.region_problem(F.lit(1), w, F.col("length")), b=lower)


def asked_widths(q: DataFrame) -> DataFrame:
    return q.select(*KEY, "length", param("window").alias("w")).distinct()


def scored_windows(q: DataFrame, c: ChainSet, metric) -> DataFrame:
    """KEY, w, start, end, v of the windows that the questions ask for: one
    sort for listed widths, differences of running sums for any others."""
    levels = levels_of(c, "window")
    if levels is None:
        return windows.asked_windows(c.residues, asked_widths(q), {"v": metric})
    return windows.sliding_windows(c.residues, [int(w) for (w,) in levels], {"v": metric})


def _extreme_window(metric, largest):
    def plan(q, c):
        scored = scored_windows(q, c, metric)
        pick = quantify.argmax if largest else quantify.argmin
        best = pick(scored, F.col("v"), ["start", "end"], by=[*KEY, "w"])
        got = q.withColumn("w", param("window")).join(best, [*KEY, "w"], "left")
        err = F.when(F.col("start").isNull(), F.lit("empty domain"))
        return answers(got, err, r_start=F.col("start"), r_end=F.col("end"))
    return plan


def _any_window_above(q, c):
    scored = scored_windows(q, c, windows.mean("plddt"))
    top = scored.groupBy(*KEY, "w").agg(F.max("v").alias("top"))
    got = q.withColumn("w", param("window")).join(top, [*KEY, "w"], "left")
    return answers(got, b=F.coalesce(F.col("top") > param("threshold", "double"), F.lit(False)))


def dense_windows(q: DataFrame, c: ChainSet) -> DataFrame:
    """Mean score and contact density of every full window asked for."""
    levels = levels_of(c, "window")
    widths = asked_widths(q) if levels is None else [int(w) for (w,) in levels]
    contacts = pairs.close_pairs(c.residues, 8.0)
    density = pairs.window_contacts(c.residues, contacts, widths)
    scored = scored_windows(q, c, windows.mean("plddt")).withColumnRenamed("v", "mean")
    # One row per window on both sides, whatever Spark guesses from the file.
    return scored.join(density.drop("end").hint("merge"), [*KEY, "w", "start"])


def _dense_confident_window(level_name):
    def plan(q, c):
        levels = levels_of(c, level_name) if level_name else [(80.0,)]
        both = dense_windows(q, c)
        name = level_name or "plddt_thr"
        asked = q.withColumn("w", param("window")).withColumn(
            name, param(name, "double") if level_name else F.lit(80.0)
        )
        if levels is None:
            best = offline.best_above(both, asked, [*KEY, "w"], "mean", "density", name)
            tops = best.withColumnRenamed("best", "value")
        else:
            tops = per_level(
                both, [*KEY, "w"], [name], levels,
                lambda t: F.max(F.when(F.col("mean") > t, F.col("density"))),
            )
        got = asked.join(tops.hint("merge"), [*KEY, "w", name], "left")
        return answers(got, b=F.coalesce(F.col("value") > param("cd_thr", "double"), F.lit(False)))
    return plan


def level_counts(q: DataFrame, c: ChainSet, name: str, column: str, above: bool, finer: float = 1.0) -> DataFrame:
    """The questions with ``value``: positions whose feature is above (below)
    the question's literal ``name``."""
    feature, levels = F.col(column).cast("double"), levels_of(c, name)
    if levels is not None:
        test = (lambda t: feature > t) if above else (lambda t: feature < t)
        return with_level(q, per_level(c.residues, KEY, [name], levels, lambda t: F.count_if(test(t))), [name])
    asked = q.withColumn(name, param(name, "double"))
    found = offline.counts_upto(c.residues, asked, KEY, column, name, lambda v: F.floor(v * finer))
    value = (F.col("total") - F.col("upto") if above else F.col("below")).alias("value")
    return asked.join(found.select(*KEY, name, value), [*KEY, name], "left")


def _count_where(column, above, finer=1.0):
    def plan(q, c):
        got = level_counts(q, c, "threshold", column, above, finer)
        return answers(got, n=F.coalesce(F.col("value"), F.lit(0)))
    return plan


def _count_label(label):
    def plan(q, c):
        got = q.join(quantify.count(c.residues, F.col("ss") == label, name="value"), KEY, "left")
        return answers(got, n=F.coalesce(F.col("value"), F.lit(0)))
    return plan


def _two_ends(q, c, extra=None):
    names = {"x": "x", "y": "y", "z": "z", **(extra or {})}
    got = at_position(q, c.residues, param("i"), {f"a_{n}": col for n, col in names.items()})
    got = at_position(got, c.residues, param("j"), {f"b_{n}": col for n, col in names.items()})
    squares = [
        (F.col(f"a_{v}").cast("double") - F.col(f"b_{v}").cast("double"))
        * (F.col(f"a_{v}").cast("double") - F.col(f"b_{v}").cast("double"))
        for v in "xyz"
    ]
    return got.withColumn("_d", F.sqrt(squares[0] + squares[1] + squares[2]))


def _distance(q, c):
    return answers(_two_ends(q, c), index_error(param("i"), param("j")), f=F.col("_d"))


def _within(q, c):
    return answers(
        _two_ends(q, c), index_error(param("i"), param("j")),
        b=F.col("_d") < param("threshold", "double"),
    )


def contact_level_counts(q: DataFrame, c: ChainSet, inclusive: bool = False) -> DataFrame:
    """The questions with ``value``: pairs with d < threshold, j - i >= sep;
    ``inclusive`` counts d <= threshold, j - i > sep."""
    levels = levels_of(c, "sep", "threshold")
    if levels is None:
        sep = param("sep") + (1 if inclusive else 0)
        asked = q.select("qid", *KEY, "length", sep.alias("sep"), param("threshold", "double").alias("t"))
        found = pairs.asked_contact_counts(c.residues, asked)
        return q.join(found.select("qid", F.col("upto" if inclusive else "below").alias("value")), "qid", "left")
    close = pairs.close_pairs(
        c.residues, max(t for _, t in levels), min_sep=int(min(s for s, _ in levels))
    )
    gap = F.col("j") - F.col("i")

    def measure(sep, t):
        if inclusive:
            return F.count_if((F.col("d") <= t) & (gap > int(sep)))
        return F.count_if((F.col("d") < t) & (gap >= int(sep)))

    return with_level(q, per_level(close, KEY, ["sep", "threshold"], levels, measure), ["sep", "threshold"])


def _contact_count(q, c):
    return answers(contact_level_counts(q, c), n=F.coalesce(F.col("value"), F.lit(0)))


def _contact_set(q, c):
    asked = over_blocks(q).select(
        "qid", *KEY, "_block", param("sep").alias("sep"), param("threshold", "double").alias("t")
    )
    levels = levels_of(c, "sep", "threshold")
    if levels is None:
        # The answer can be as large as all pairs of a chain, so no distance is too large to make them.
        spans = pairs.chain_spans(c.residues)
        cut = asked.join(spans, KEY).withColumn("t", F.least("t", "span"))
        close = pairs.close_pairs(pairs.asked_reach(c.residues, cut, "t"), "reach")
    else:
        close = pairs.close_pairs(
            c.residues, max(t for _, t in levels), min_sep=int(min(s for s, _ in levels))
        )
    close = close.withColumn("_block", block_of(F.col("i")))
    return asked.join(close, [*KEY, "_block"]).where("d < t and j - i >= sep").select("qid", "i", "j")


def _buried_low_set(q, c):
    asked = over_blocks(q).select(
        "qid", *KEY, "_block",
        param("sasa_thr", "double").alias("a"), param("plddt_thr", "double").alias("t"),
    )
    placed = c.residues.withColumn("_block", block_of(F.col("i")))
    small = F.col("rel_sasa").cast("double") < F.col("a")
    low = F.col("plddt").cast("double") < F.col("t")
    return asked.join(placed, [*KEY, "_block"]).where(small & low).select("qid", "i")


def _block(value):
    def plan(q, c):
        asked = q.select(
            "qid", *KEY, "length", "params",
            *[param(n).alias(n) for n in ("a_start", "a_end", "b_start", "b_end")],
        )
        limit = param("threshold", "double") if value == "high" else None
        got = matrix.block_values(asked, c.pae_rows, limit)
        column = {
            "mean": {"f": F.col("mean_pae")},
            "below": {"b": F.col("mean_pae") < param("threshold", "double")},
            "max": {"f": F.col("max_pae")},
            "high": {"n": F.col("n_high")},
        }[value]
        return answers(got, F.col("err"), **column)
    return plan


def _feature(column, kind, test=None):
    def plan(q, c):
        got = at_position(q, c.residues, param("i"), {"_v": column})
        value = F.col("_v") if test is None else test(F.col("_v"))
        return answers(got, index_error(param("i")), **{kind: value})
    return plan


def _density(q, c):
    asked = q.select("qid", *KEY, "length", param("start").alias("start"), param("end").alias("end"))
    got = regions.contact_density(asked, pairs.close_pairs(c.residues, 8.0))
    return answers(got, F.col("err"), f=F.col("density"))


def _longest_helix(q, c):
    got = q.join(runs.longest_run(c.residues, "H"), KEY, "left")
    err = F.when(F.col("size").isNull(), F.lit("no run of that label"))
    return answers(got, err, n=F.col("size"))


def _helix_runs(q, c):
    got = q.join(runs.run_counts(c.residues, ["H"]), KEY, "left")
    return answers(got, n=F.coalesce(F.col("n_H"), F.lit(0)))


def helix_strand_gap(residues: DataFrame, radius: float | str) -> DataFrame:
    """Smallest helix-to-strand distance per chain, if within ``radius``."""
    near = pairs.close_between(
        residues.where("ss = 'H'"), residues.where("ss = 'E'"), radius
    )
    return near.groupBy(*KEY).agg(F.min("d").alias("gap"))


def near_interface(q: DataFrame, c: ChainSet) -> DataFrame:
    """The questions with ``near``: some helix position is closer to a strand
    position than the question's threshold."""
    levels, t = levels_of(c, "threshold"), param("threshold", "double")
    if levels is not None:
        got = q.join(helix_strand_gap(c.residues, max(t_ for (t_,) in levels)), KEY, "left")
        return got.withColumn("near", F.coalesce(F.col("gap") < t, F.lit(False)))
    asked = q.select(*KEY, t.alias("t"))
    facts = c.residues.groupBy(*KEY).agg(
        (F.bool_or(F.col("ss") == "H") & F.bool_or(F.col("ss") == "E")).alias("_both")
    ).join(pairs.chain_spans(c.residues), KEY)
    gaps = helix_strand_gap(pairs.asked_reach(c.residues, asked, "t"), "reach")
    got = q.join(facts, KEY, "left").join(gaps, KEY, "left")
    near = F.when(t > F.col("span"), F.col("_both")).otherwise(F.col("gap") < t)
    return got.withColumn("near", F.coalesce(near, F.lit(False)))


def _interface(q, c):
    return answers(near_interface(q, c), b=F.col("near"))


def _or_unreliable(df, unreliable: Column, err=None, **values) -> DataFrame:
    """Abstaining templates answer the string ``Unreliable`` or the value."""
    kept = {n: F.when(~unreliable, v) for n, v in values.items()}
    return answers(df, err, s=F.when(unreliable, F.lit("Unreliable")), **kept)


def _distance_or(q, c):
    got = _two_ends(q, c, {"score": "plddt"})
    t = param("plddt_thr", "double")
    low = (F.col("a_score").cast("double") < t) | (F.col("b_score").cast("double") < t)
    return _or_unreliable(got, low, index_error(param("i"), param("j")), f=F.col("_d"))


def _block_or(q, c):
    asked = q.select(
        "qid", *KEY, "length", "params",
        *[param(n).alias(n) for n in ("a_start", "a_end", "b_start", "b_end")],
    )
    got = matrix.block_values(asked, c.pae_rows)
    return _or_unreliable(
        got, F.col("mean_pae") > param("pae_max", "double"), F.col("err"), f=F.col("mean_pae")
    )


def _buried_or(clamped):
    """``clamped`` keeps the +-5 window inside the chain (the gold answer);
    the program text leaves it as written and fails at the ends."""
    def plan(q, c):
        lo, hi = param("i") - 5, param("i") + 5
        if clamped:
            lo, hi = F.greatest(F.lit(1), lo), F.least(F.col("length"), hi)
        asked = q.select("qid", *KEY, "length", "params", lo.alias("start"), hi.alias("end"))
        got = regions.region_values(asked, c.residues, {"_m": windows.mean("plddt")})
        got = at_position(got, c.residues, param("i"), {"_v": "rel_sasa"})
        low = F.col("_m") < param("plddt_thr", "double")
        err = F.coalesce(index_error(param("i")), F.col("err"))
        return _or_unreliable(got, low, err, b=F.col("_v").cast("double") < param("sasa_thr", "double"))
    return plan


def _with_low_share(q, c):
    got = level_counts(q, c, "plddt_thr", "plddt", False).withColumnRenamed("value", "_low")
    share = F.coalesce(F.col("_low"), F.lit(0)) * 100 / F.col("length")
    return got.withColumn("_poor", share > param("coverage_thr", "double")).drop("_low", "plddt_thr")


def _contacts_or(inclusive):
    """``inclusive`` is the gold rule, the strict form is the program text."""
    def plan(q, c):
        got = contact_level_counts(_with_low_share(q, c), c, inclusive)
        return _or_unreliable(got, F.col("_poor"), n=F.coalesce(F.col("value"), F.lit(0)))
    return plan


def _interface_or(q, c):
    return _or_unreliable(near_interface(_with_low_share(q, c), c), F.col("_poor"), b=F.col("near"))


# ------------------------------------------------------------- parameters --
# A sampler gets ``draw(tag, n)`` (uniform integer in [0, n)) and the chain
# length, and returns the parameters and the condition under which the
# template applies to the chain.

_LISTED: list[dict] = []
_SHARED: list[dict[str, Column]] = []


def _choice(draw, tag, values):
    for seen in _LISTED:
        seen[tag] = list(values)
    if _SHARED:
        own = F.try_element_at(_SHARED[-1][tag], F.col("template"))
        return F.element_at(own, (draw(tag, F.size(own)) + 1).cast("int"))
    listed = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(listed, (draw(tag, len(values)) + 1).cast("int"))


def _no_params(draw, L):
    return {}, L >= 1


def _region(draw, L):
    size = draw("size", F.greatest(F.least(F.lit(80), L - 1) - 19, F.lit(1))) + 20
    start = draw("start", F.greatest(L - size, F.lit(1))) + 1
    return {"start": start, "end": start + size - 1}, L >= 30


def _sized(sizes, **lists):
    def sample(draw, L):
        out = {"window": _choice(draw, "window", sizes)}
        out.update({k: _choice(draw, k, v) for k, v in lists.items()})
        return out, out["window"] < L
    return sample


def _listed(minimum=1, **lists):
    def sample(draw, L):
        return {k: _choice(draw, k, v) for k, v in lists.items()}, L >= minimum
    return sample


def _termini_params(draw, L):
    return {
        "window": _choice(draw, "window", [15, 20, 25, 30]), "n_first": draw("n_first", 2),
    }, L >= 60


def _pair(min_sep, minimum=None, **lists):
    """First i, then j among the positions at least ``min_sep`` away."""
    def sample(draw, L):
        i = draw("i", L) + 1
        left = F.greatest(i - min_sep, F.lit(0))
        right = F.greatest(L - i - min_sep + 1, F.lit(0))
        k = draw("j", F.greatest(left + right, F.lit(1)))
        j = F.when(k < left, k + 1).otherwise(i + min_sep + k - left)
        out = {"i": i, "j": j, **{n: _choice(draw, n, v) for n, v in lists.items()}}
        return out, (L >= (minimum or min_sep + 2)) & (left + right > 0)
    return sample


def _two_regions(**lists):
    """Two disjoint regions of at least 15 positions, 10 apart."""
    def sample(draw, L):
        top = F.least(F.lit(60), F.greatest(F.lit(15), F.floor(L / 3)), F.floor((L - 11) / 2))
        a_size = draw("a_size", F.greatest(top - 14, F.lit(1))) + 15
        a_start = draw("a_start", F.greatest(L - 2 * a_size - 10, F.lit(1))) + 1
        a_end = a_start + a_size - 1
        b_start = a_end + 11
        room = F.least(F.lit(60), L - b_start + 1)
        b_size = draw("b_size", F.greatest(room - 14, F.lit(1))) + 15
        out = {"a_start": a_start, "a_end": a_end, "b_start": b_start, "b_end": b_start + b_size - 1}
        out.update({k: _choice(draw, k, v) for k, v in lists.items()})
        return out, L >= 41
    return sample


def _position(minimum=1, margin=0, **lists):
    def sample(draw, L):
        i = draw("i", F.greatest(L - 2 * margin, F.lit(1))) + 1 + margin
        return {"i": i, **{k: _choice(draw, k, v) for k, v in lists.items()}}, L >= minimum
    return sample


def _separated(**lists):
    def sample(draw, L):
        out = {"sep": _choice(draw, "sep", [20, 30, 50]), "threshold": _choice(draw, "threshold", [6, 8, 10])}
        out.update({k: _choice(draw, k, v) for k, v in lists.items()})
        return out, (L >= 50) & (out["sep"] < L - 5)
    return sample


# --------------------------------------------------------------- registry --

@dataclass
class Template:
    name: str
    family: str
    answer_type: str
    program: str
    sample: Callable
    plan: Callable
    wording: list[str] = field(default_factory=list)
    gold_plan: Callable | None = None
    needs_matrix: bool = False

    def sampled(self) -> tuple[dict, Column, int]:
        """Parameters and validity as functions of the columns ``_d0``,
        ``_d1``, ... (raw draws) and ``length``; and how many draws there are."""
        tags: list[str] = []

        def draw(tag, n):
            if tag not in tags:
                tags.append(tag)
            size = n.cast("long") if isinstance(n, Column) else F.lit(n)
            return F.pmod(F.col(f"_d{tags.index(tag)}"), size)

        values, valid = self.sample(draw, F.col("length"))
        return values, valid, len(tags)

    def literals(self) -> dict[str, list]:
        """The lists that the sampler draws literals from."""
        seen: dict[str, list] = {}
        _LISTED.append(seen)
        self.sampled()
        _LISTED.pop()
        return seen

    def params_column(self) -> Column:
        values, _, _ = self.sampled()
        entries = [v for n in sorted(values) for v in (F.lit(n), values[n].cast("double"))]
        return F.create_map(*entries).cast("map<string,double>")


def raw_draws(n: int, *seed: Column) -> dict[str, Column]:
    """``n`` independent 32-bit draws per row, from the chain key and ``seed``."""
    return {f"_d{k}": hash_int(*[F.col(c) for c in KEY], *seed, F.lit(str(k))) for k in range(n)}


def number_text(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def fill(text: Column) -> Column:
    """Put the parameters of a row into the ``{name}`` places of a text."""
    whole = F.transform(
        F.map_entries("params"),
        lambda e: F.struct(e["key"].alias("k"), number_text(e["value"]).alias("v")),
    )
    first = param("n_first", "double") == 1
    derived = F.array(
        F.struct(F.lit("i_lo").alias("k"), number_text(param("i", "double") - 5).alias("v")),
        F.struct(F.lit("i_hi").alias("k"), number_text(param("i", "double") + 5).alias("v")),
        F.struct(F.lit("near").alias("k"), F.when(first, "N").otherwise("C").alias("v")),
        F.struct(F.lit("far").alias("k"), F.when(first, "C").otherwise("N").alias("v")),
    )
    return F.aggregate(
        F.concat(whole, derived), text,
        lambda out, e: F.replace(out, F.concat(F.lit("{"), e["k"], F.lit("}")), F.coalesce(e["v"], F.lit(""))),
    )


REGION = "range({start}, {end})"
BLOCKS = "range({a_start}, {a_end}), range({b_start}, {b_end})"
CONTACTS = "filter (i, j) in all_pairs(min_sep={sep}) where distance(i, j) < {threshold}"
INTERFACE = (
    'exists r in all_residues where ss(r) == "H" and exists s in all_residues '
    'where ss(s) == "E" and distance(r, s) < {threshold}'
)
LOW_SHARE = "(count r in all_residues where plddt(r) < {plddt_thr}) * 100 / protein_length() > {coverage_thr}"


def _base() -> list[Template]:
    t = Template
    return [
        t("A1", "A", "Float", f"mean_plddt({REGION})", _region,
          _region_metric(windows.mean("plddt"), "f"),
          ["Give the mean pLDDT over residues {start} to {end}.",
           "Over residues {start} through {end}, how high is the average confidence?"]),
        t("A2", "A", "Bool", "mean_plddt(first({window})) < mean_plddt(last({window}))",
          _termini_params, _termini,
          ["Over {window} residues at each end, is the {near}-terminal confidence below the {far}-terminal one?",
           "Is the {near}-terminus less confident than the {far}-terminus when {window} residues are averaged?"]),
        t("A3", "A", "Region", "argmin reg in sliding_window({window}) by mean_plddt(reg)",
          _sized([20, 30, 40, 50]), _extreme_window(windows.mean("plddt"), False),
          ["Which {window}-residue window has the lowest mean confidence?",
           "Locate the stretch of {window} residues with the weakest average pLDDT."]),
        t("A4", "A", "Int", "count r in all_residues where plddt(r) > {threshold}",
          _listed(threshold=[50, 70, 80, 90]), _count_where("plddt", True),
          ["How many residues have a pLDDT above {threshold}?",
           "Count the residues whose confidence exceeds {threshold}."]),
        t("A5", "A", "Bool", "exists reg in sliding_window({window}) where mean_plddt(reg) > {threshold}",
          _sized([20, 30, 50], threshold=[70, 80, 90]), _any_window_above,
          ["Does some {window}-residue window average a pLDDT above {threshold}?",
           "Is there a run of {window} residues with mean confidence over {threshold}?"]),
        t("B1", "B", "Float", "distance(residue({i}), residue({j}))", _pair(2), _distance,
          ["How far apart are residues {i} and {j}?",
           "State the CA distance from residue {i} to residue {j} in angstrom."]),
        t("B2", "B", "Bool", "distance(residue({i}), residue({j})) < {threshold}",
          _pair(4, threshold=[6, 8, 10, 12]), _within,
          ["Are residues {i} and {j} less than {threshold} angstrom apart?",
           "Is the distance between residues {i} and {j} below {threshold} angstrom?"]),
        t("B3", "B", "PairSet", CONTACTS, _separated(), _contact_set,
          ["List the pairs at least {sep} apart in sequence whose distance is under {threshold} angstrom.",
           "Which pairs separated by {sep} or more positions come within {threshold} angstrom?"]),
        t("B4", "B", "Int", f"size({CONTACTS})", _separated(), _contact_count,
          ["How many pairs at least {sep} apart in sequence are within {threshold} angstrom distance?",
           "Count contacts under {threshold} angstrom with a separation of {sep} or more."]),
        t("C1", "C", "Float", f"mean_pae({BLOCKS})", _two_regions(), _block("mean"),
          ["What is the mean PAE of residues {a_start}-{a_end} against {b_start}-{b_end}?",
           "Average the aligned error between {a_start}-{a_end} and {b_start}-{b_end}."],
          needs_matrix=True),
        t("C2", "C", "Bool", f"mean_pae({BLOCKS}) < {{threshold}}",
          _two_regions(threshold=[5, 8, 12]), _block("below"),
          ["Is the mean PAE between {a_start}-{a_end} and {b_start}-{b_end} below {threshold}?",
           "Does the aligned error of {a_start}-{a_end} versus {b_start}-{b_end} average under {threshold}?"],
          needs_matrix=True),
        t("C3", "C", "Float", f"max_pae({BLOCKS})", _two_regions(), _block("max"),
          ["What is the largest PAE between {a_start}-{a_end} and {b_start}-{b_end}?",
           "Give the maximum aligned error of {a_start}-{a_end} against {b_start}-{b_end}."],
          needs_matrix=True),
        t("C4", "C", "Int", f"count_high_pae({BLOCKS}, {{threshold}})",
          _two_regions(threshold=[5, 8, 12, 15]), _block("high"),
          ["How many cells of {a_start}-{a_end} against {b_start}-{b_end} have a PAE above {threshold}?",
           "Count aligned errors over {threshold} between {a_start}-{a_end} and {b_start}-{b_end}."],
          needs_matrix=True),
        t("D1", "D", "Bool", "rel_sasa(residue({i})) < {threshold}",
          _position(threshold=[0.10, 0.15, 0.20]),
          _feature("rel_sasa", "b", lambda v: v.cast("double") < param("threshold", "double")),
          ["Is residue {i} buried at a relative SASA cutoff of {threshold}?",
           "Does residue {i} expose less than {threshold} of its surface?"]),
        t("D2", "D", "Region", "argmax reg in sliding_window({window}) by mean_rel_sasa(reg)",
          _sized([15, 20, 30]), _extreme_window(windows.mean("rel_sasa"), True),
          ["Which {window}-residue window is the most solvent exposed?",
           "Locate the {window} residues with the highest mean relative SASA."]),
        t("D3", "D", "Int", "count r in all_residues where rel_sasa(r) < {threshold}",
          _listed(threshold=[0.10, 0.15, 0.20]), _count_where("rel_sasa", False, 64.0),
          ["How many residues are buried below a relative SASA of {threshold}?",
           "Count the residues with solvent exposure under {threshold}."]),
        t("D4", "D", "Int", "n_neighbors(residue({i}))", _position(), _feature("n_neigh", "n"),
          ["How many neighbours does residue {i} have within 8 angstrom?",
           "Count the residues packed around residue {i} inside 8 angstrom."]),
        t("D5", "D", "Bool", "n_neighbors(residue({i})) > {threshold}",
          _position(threshold=[8, 12, 16]),
          _feature("n_neigh", "b", lambda v: v > param("threshold", "double")),
          ["Does residue {i} have more than {threshold} neighbours within 8 angstrom?",
           "Is residue {i} packed by over {threshold} neighbours?"]),
        t("E1", "E", "SecStruct", "ss(residue({i}))", _position(), _feature("ss", "s"),
          ["Which secondary structure does residue {i} have?",
           "Name the secondary-structure class (H/E/C) of residue {i}."]),
        t("E2", "E", "Bool", 'ss(residue({i})) == "H"', _position(),
          _feature("ss", "b", lambda v: v == "H"),
          ["Is residue {i} in a helix?", "Does residue {i} carry the helix label?"]),
        t("E3", "E", "Int", 'count r in all_residues where ss(r) == "H"', _no_params,
          _count_label("H"),
          ["How many helix residues are there?", "Count the residues in helices."]),
        t("E4", "E", "Int", 'count r in all_residues where ss(r) == "E"', _no_params,
          _count_label("E"),
          ["How many strand residues are there?", "Count the residues in strands."]),
        t("E5", "E", "Int", 'length(longest_run("H"))', _no_params, _longest_helix,
          ["How long is the longest helix?", "Give the length of the longest run of helix residues."]),
        t("E6", "E", "Int", "n_helices()", _no_params, _helix_runs,
          ["How many separate helices are there?", "Count the helix segments."]),
        t("F1", "F", "Float", f"contact_density({REGION})", _region, _density,
          ["What share of residue pairs in {start}-{end} are in contact?",
           "Give the contact density of residues {start} to {end}."]),
        t("F2", "F", "Bool",
          "exists reg in sliding_window({window}) where mean_plddt(reg) > 80 and contact_density(reg) > {cd_thr}",
          _sized([20, 30, 40], cd_thr=[0.20, 0.30, 0.40]), _dense_confident_window(None),
          ["Is there a {window}-residue window with mean pLDDT over 80 and contact density over {cd_thr}?",
           "Does a confident compact core of {window} residues exceed contact density {cd_thr}?"]),
        t("F3", "F", "Float", f"radius_of_gyration({REGION})", _region,
          _region_metric(windows.gyration(), "f"),
          ["What is the radius of gyration of residues {start} to {end}?",
           "How compact are residues {start}-{end}, as a radius of gyration?"]),
        t("F4", "F", "Region", "argmin reg in sliding_window({window}) by radius_of_gyration(reg)",
          _sized([20, 30, 40]), _extreme_window(windows.gyration(), False),
          ["Which {window}-residue window is the most compact?",
           "Locate the {window} residues with the smallest radius of gyration."]),
        t("G1", "G", "ResidueSet",
          "filter r in all_residues where rel_sasa(r) < {sasa_thr} and plddt(r) < {plddt_thr}",
          _listed(sasa_thr=[0.10, 0.15, 0.20], plddt_thr=[60, 70, 80]), _buried_low_set,
          ["Which residues are buried below {sasa_thr} yet have a pLDDT under {plddt_thr}?",
           "List residues with relative SASA under {sasa_thr} and confidence under {plddt_thr}."]),
        t("G2", "G", "Bool",
          "exists reg in sliding_window({window}) where mean_plddt(reg) > {plddt_thr} and contact_density(reg) > {cd_thr}",
          _sized([20, 30, 40], plddt_thr=[70, 80], cd_thr=[0.20, 0.30]),
          _dense_confident_window("plddt_thr"),
          ["Does a {window}-residue window exceed mean pLDDT {plddt_thr} and contact density {cd_thr}?",
           "Is some stretch of {window} residues above {plddt_thr} confidence and {cd_thr} density?"]),
        t("G3", "G", "Bool", INTERFACE, _listed(threshold=[6, 8, 10]), _interface,
          ["Does a helix residue come within {threshold} angstrom of a strand residue?",
           "Is any helix closer than {threshold} angstrom to a strand?"]),
    ]


def _abstaining() -> list[Template]:
    shapes = [
        ("1", "Float|Unreliable",
         "if plddt(residue({i})) < {plddt_thr} or plddt(residue({j})) < {plddt_thr} "
         'then "Unreliable" else distance(residue({i}), residue({j}))',
         _pair(4, 20, plddt_thr=[50, 60, 70]), _distance_or, None, False,
         "How far apart are residues {i} and {j}?",
         "Answer unreliable if either pLDDT is below {plddt_thr}."),
        ("2", "Float|Unreliable",
         f'if mean_pae({BLOCKS}) > {{pae_max}} then "Unreliable" else mean_pae({BLOCKS})',
         _two_regions(pae_max=[15, 20, 25]), _block_or, None, True,
         "What is the mean PAE of {a_start}-{a_end} against {b_start}-{b_end}?",
         "Answer unreliable if it exceeds {pae_max}."),
        ("3", "Bool|Unreliable",
         'if mean_plddt(range({i_lo}, {i_hi})) < {plddt_thr} then "Unreliable" '
         "else (rel_sasa(residue({i})) < {sasa_thr})",
         _position(12, 5, sasa_thr=[0.10, 0.15, 0.20], plddt_thr=[50, 60, 70]),
         _buried_or(False), _buried_or(True), False,
         "Is residue {i} buried at relative SASA {sasa_thr}?",
         "Answer unreliable if the five residues on each side average below {plddt_thr}."),
        ("4", "Int|Unreliable",
         f'if {LOW_SHARE} then "Unreliable" else size({CONTACTS})',
         _separated(plddt_thr=[50, 60], coverage_thr=[20, 30, 40]),
         _contacts_or(False), _contacts_or(True), False,
         "How many contacts under {threshold} angstrom span more than {sep} positions?",
         "Answer unreliable if over {coverage_thr} percent of residues score below {plddt_thr}."),
        ("5", "Bool|Unreliable",
         f'if {LOW_SHARE} then "Unreliable" else ({INTERFACE})',
         _listed(50, threshold=[6, 8, 10], plddt_thr=[50, 60], coverage_thr=[20, 30, 40]),
         _interface_or, None, False,
         "Does a helix come within {threshold} angstrom of a strand?",
         "Answer unreliable if over {coverage_thr} percent of residues score below {plddt_thr}."),
    ]
    out = []
    for number, kind, program, sample, plan, gold, matrix_, ask, rule in shapes:
        hidden = "Answer unreliable if the prediction is too uncertain there."
        out.append(Template(f"Ha{number}", "Ha", kind, program, sample, plan, [f"{ask} {rule}"], gold, matrix_))
        out.append(Template(f"Hb{number}", "Hb", kind, program, sample, plan, [f"{ask} {hidden}"], gold, matrix_))
    return out


TEMPLATES: dict[str, Template] = {t.name: t for t in [*_base(), *_abstaining()]}
FAMILIES: dict[str, list[Template]] = {}
for _t in TEMPLATES.values():
    FAMILIES.setdefault(_t.family, []).append(_t)
SET_TYPES = ("PairSet", "ResidueSet")
# A2's program swaps its two calls when the C-terminus is asked about first.
SWAPPED_TERMINI = "mean_plddt(last({window})) < mean_plddt(first({window}))"


def drawn_params(templates: list[Template]) -> Column:
    """Parameters of a row's template from its raw draws, NULL where the chain
    does not suit the template or the template is not listed.

    One expression for all templates: the literal lists are looked up by
    template, and templates whose draws then read alike share a branch.
    """
    lists: dict[str, dict[str, list]] = {}
    for t in templates:
        for tag, values in t.literals().items():
            lists.setdefault(tag, {})[t.name] = values
    _SHARED.append({
        tag: F.create_map(*[
            v for name, values in by_name.items()
            for v in (F.lit(name), F.array(*[F.lit(float(x)) for x in values]))
        ])
        for tag, by_name in lists.items()
    })
    branches: dict[str, tuple[Column, list[str]]] = {}
    for t in templates:
        values, valid, _ = t.sampled()
        reads = str(valid) + "".join(f"{n}={values[n]}" for n in sorted(values))
        branches.setdefault(reads, (F.when(valid, t.params_column()), []))[1].append(t.name)
    _SHARED.pop()
    out = None
    for column, names in branches.values():
        out = (F.when if out is None else out.when)(F.col("template").isin(names), column)
    return out


def questions_for(template: str, chains: DataFrame, slots: int = 1, seed=0) -> DataFrame:
    """``slots`` parameter draws of one template for every chain it fits."""
    t = TEMPLATES[template]
    _, valid, n = t.sampled()
    slot = F.col("slot").cast("string")
    drawn = chains.withColumn(
        "slot", F.explode(F.array(*[F.lit(k) for k in range(slots)]))
    ).withColumns(raw_draws(n, F.lit(template), F.lit(str(seed)), slot))
    return (
        drawn.where(valid)
        .withColumn("params", t.params_column())
        .select(
            F.concat_ws("/", *KEY, F.lit(template), slot).alias("qid"),
            *KEY, "length", F.lit(template).alias("template"), "params",
        )
    )


def answer_template(template: str, q: DataFrame, chains: ChainSet, gold: bool = True, drawn: bool = False) -> DataFrame:
    """Answers of one template; ``gold=False`` follows the program text where
    that differs from the reference answer.  ``drawn`` says that the questions
    were drawn by the template, so their literals are on its lists."""
    t = TEMPLATES[template]
    if drawn:
        chains = chains.with_literals(t.literals())
    plan = t.gold_plan if gold and t.gold_plan is not None else t.plan
    return plan(q, chains)
