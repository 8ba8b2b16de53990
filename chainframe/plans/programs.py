"""Running program texts in batches.

Programs are grouped by shape.  A shape is the program of a template with its
literals open; every program of the same shape becomes a parameter row of the
same plan.  Texts of any other
shape are reported in ``err``; their operators are available as DataFrame
functions.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, literal_map
from ..session import cut_lineage
from .generate import answer_all
from .templates import SWAPPED_TERMINI, TEMPLATES, ChainSet



NUMBER = r"(?<![A-Za-z_0-9.])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
CHECKED = "="


def _skeleton(text: str) -> str:
    """Program text with single spaces between words only and ``#`` for every
    number; the same steps as ``skeleton`` below."""
    tidy = re.sub(r"\s*([^\w\s])\s*", r"\1", re.sub(r"\s+", " ", text.strip()))
    return re.sub(NUMBER, "#", tidy)


def skeleton(program: Column) -> Column:
    return F.regexp_replace(_tidy(program), NUMBER, "#")


def _tidy(program: Column) -> Column:
    spaced = F.regexp_replace(F.trim(F.regexp_replace(program, r"\s+", " ")), r"\s*([^\w\s])\s*", "$1")
    return spaced


def _shapes() -> dict[str, tuple[str, list[str]]]:
    """skeleton -> (template, names of the literals in order).  A literal that
    is fixed in the template is named ``=value`` and must match."""
    texts = [(t.name, t.program) for t in TEMPLATES.values()]
    # The literal 80 of F2 is the open score threshold of G2.
    texts = [pair for pair in texts if pair[0] != "F2"] + [("A2", SWAPPED_TERMINI)]
    out = {}
    for name, text in texts:
        names = [n or CHECKED + v for n, v in re.findall(r"\{(\w+)\}|" + f"({NUMBER})", text)]
        if name == "A2":
            names.append("n_first" + CHECKED + ("0" if text == SWAPPED_TERMINI else "1"))
        out.setdefault(_skeleton(re.sub(r"\{\w+\}", "0", text)), (name, names))
    return out


def match_shapes(programs: DataFrame) -> DataFrame:
    """Adds ``template`` and ``params`` (NULL when no shape fits).

    The skeleton of a program is looked up among the known ones, so the cost
    per row does not depend on how many shapes there are.
    """
    shapes = _shapes()
    names_of = F.create_map(*[
        v for k, (_, names) in shapes.items()
        for v in (F.lit(k), F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    ])
    template_of = literal_map({k: t for k, (t, _) in shapes.items()})
    read = programs.withColumns({
        "_skeleton": skeleton(F.coalesce("program", F.lit(""))),
        "_numbers": F.transform(
            F.regexp_extract_all(_tidy(F.coalesce("program", F.lit(""))), F.lit(f"({NUMBER})"), F.lit(1)),
            lambda v: v.try_cast("double"),
        ),
    }).withColumns({
        "template": F.try_element_at(template_of, F.col("_skeleton")),
        "_names": F.try_element_at(names_of, F.col("_skeleton")),
    })
    value = lambda n: F.element_at(F.split(n, CHECKED), -1).try_cast("double")
    number = lambda k: F.get(F.col("_numbers"), k)
    # name -> value; i_lo and i_hi both stand for i, five places off.
    entries = F.transform("_names", lambda n, k: F.struct(
        F.when(n.isin("i_lo", "i_hi"), "i").when(F.contains(n, F.lit(CHECKED)), F.split_part(n, F.lit(CHECKED), F.lit(1))).otherwise(n).alias("key"),
        F.when(n == "i_lo", number(k) + 5).when(n == "i_hi", number(k) - 5)
        .when(n.startswith("n_first"), value(n)).otherwise(number(k)).alias("value"),
    ))
    fixed_ok = F.forall(
        F.transform("_names", lambda n, k: ~n.startswith(CHECKED) | (number(k) == value(n))), lambda ok: ok
    )
    opened = read.withColumns({"_entries": entries, "_fixed_ok": fixed_ok})
    distinct = F.array_distinct(F.filter("_entries", lambda e: e["key"] != ""))
    keyed = opened.withColumn("_distinct", distinct)
    # A literal that occurs twice must have one value.
    single = F.size("_distinct") == F.size(F.array_distinct(F.transform("_distinct", lambda e: e["key"])))
    return keyed.withColumn(
        "params", F.when(F.col("_fixed_ok") & single, F.map_from_entries("_distinct"))
    ).withColumn(
        "template", F.when(F.col("params").isNotNull(), F.col("template"))
    ).drop("_skeleton", "_numbers", "_names", "_entries", "_fixed_ok", "_distinct")


def run_programs(programs: DataFrame, chains: ChainSet, templates: list[str] | None = None) -> DataFrame:
    """``programs``: qid, KEY, program.  Returns qid, answer (JSON text), err.

    An empty program gives neither answer nor error.  ``templates`` limits the
    shapes that are planned when it is known which can occur.
    """
    lengths = chains.chains()
    # Every shape reads the matched programs; their texts are taken apart once, not once per shape.
    matched = cut_lineage(match_shapes(programs).join(lengths, KEY, "left"))
    if templates is None:
        # At most one name per shape comes back.
        rows = matched.select("template").where("template is not null").distinct().collect()
        templates = sorted(r["template"] for r in rows)
    usable = [t for t in templates if chains.pae_rows is not None or not TEMPLATES[t].needs_matrix]
    runnable = matched.where(F.col("template").isin(usable) & F.col("length").isNotNull())
    problem = (
        F.when(F.coalesce(F.col("program"), F.lit("")) == "", None)
        .when(F.col("length").isNull(), "unknown chain")
        .when(F.col("template").isNull(), F.concat(F.lit("unsupported program: "), "program"))
        .otherwise("no pair matrix")
    )
    rest = matched.where(
        F.col("template").isNull() | F.col("length").isNull() | ~F.col("template").isin(usable)
    ).select("qid", F.lit(None).cast("string").alias("answer"),
             problem.alias("err"))
    if not usable:
        return rest
    return answer_all(runnable, chains, usable, gold=False).unionByName(rest)
