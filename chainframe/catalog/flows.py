"""Runs over model output from text to score or vote, and rows that must not
end a job, as registered queries.  Every chain asks questions, and the
responses carry whole document texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..plans import flows, programs
from ..plans.templates import ChainSet
from ..schema import KEY
from ..session import cut_lineage
from ..sources.bindings import event_chains, event_lengths, table
from . import sql as S
from .workload import fixed

QUERIES, ORACLES = {}, {}


def register(name, oracle):
    def keep(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn
    return keep


_SHAPES = ["A4", "B1", "E6"]
_FACTS = f"""{S.EV}, h AS (SELECT species, uniprot, count(*) AS n FROM (SELECT *, lag(ss) OVER (PARTITION BY species, uniprot ORDER BY i) AS p FROM ev)
    WHERE ss = 'H' AND (p IS NULL OR p <> 'H') GROUP BY ALL),
  c AS (SELECT species, uniprot, count(*) FILTER (CAST(plddt AS DOUBLE) > length % 90) AS hi, coalesce(any_value(h.n), 0) AS n, any_value(length) AS length
    FROM ev LEFT JOIN h USING (species, uniprot) GROUP BY ALL)"""


def _chain_set(spark, sf):
    # Several plans read the positions several times each; numbering them once is cheaper.
    return ChainSet(cut_lineage(event_chains(spark, sf)), lengths=event_lengths(spark, sf))


def _with_text(spark, sf):
    """Each chain with the text of the document that has the user's number."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("U"), F.col("doc_id").cast("string")).alias("uniprot"), F.col("text").cast("string").alias("body"))
    return event_lengths(spark, sf).join(docs, "uniprot", "left").withColumn("body", F.coalesce("body", F.lit("")))


def _programs():
    return {
        "count": F.concat(F.lit("count r in all_residues where plddt(r) > "), (F.col("length") % 90).cast("string")),
        "far": F.concat(F.lit("distance(residue(1), residue("), (F.col("length") + 1).cast("string"), F.lit("))")),
    }


def _listed(chains, values, name):
    """One row per chain and place of ``values``: qid, KEY, f, ``name``."""
    return chains.select(*KEY, F.posexplode(F.array(*values)).alias("f", name)).withColumn("qid", F.concat_ws("/", *KEY, F.col("f").cast("string")))


@register("evaluate_responses", f"""WITH {_FACTS}, r AS (SELECT species || '/' || uniprot || '/' || f AS qid,
    CASE f WHEN 0 THEN CAST(hi AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN 'Unreliable' WHEN 4 THEN 'E' END AS pred_answer,
    CASE f WHEN 3 THEN 'residue index out of range' END AS err,
    CASE f WHEN 1 THEN n >= 90 ELSE f <> 3 END AS correct FROM c, (SELECT unnest(range(0, 5)) AS f)) SELECT * FROM r""")
def evaluate_responses(spark, sf):
    """Five responses per chain: a right program in a fence behind a whole
    document, a program whose result is 10 off, an abstention, a program that
    leaves the chain, and a plain label."""
    chains, p = _with_text(spark, sf), _programs()
    texts = [
        F.concat("body", F.lit("\n```dsl\n"), p["count"], F.lit(";\n```")), F.concat("body", F.lit("\nProgram: n_helices();\n")),
        F.lit("<answer>Not enough information</answer>"), F.concat(F.lit("Program: "), p["far"]), F.lit("strand"),
    ]
    types = ["Int", "Int", "Bool|Unreliable", "Float", "SecStruct"]
    # The right answers of the first two come from the plain table; both the parsing and the scoring read them.
    chain_set = _chain_set(spark, sf)
    before = F.lag("ss").over(Window.partitionBy(*KEY).orderBy("i"))
    facts = cut_lineage(chain_set.residues.withColumn("_p", before).groupBy(*KEY).agg(
        F.count_if(F.col("plddt").cast("double") > F.col("length") % 90).alias("hi"),
        F.count_if((F.col("ss") == "H") & ((F.col("_p") != "H") | F.col("_p").isNull())).alias("n")))
    golds = [F.col("hi").cast("string"), (F.col("n") + 10).cast("string"), F.lit("Unreliable"), F.lit("1.0"), F.lit("E")]
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), F.col("f") + 1)
    questions = _listed(facts, golds, "gold_answer").withColumn("answer_type", kind)
    responses = _listed(chains, texts, "text").select("qid", "text")
    got = flows.evaluate_responses(questions, responses, chain_set, _SHAPES)
    return got.select("qid", "pred_answer", "err", "correct")


@register("exec_vote", f"""WITH {_FACTS} SELECT species || '/' || uniprot AS qid, CAST(hi AS VARCHAR) AS answer,
  {S.fixed('CASE WHEN hi = n THEN 1.0 ELSE CAST(2 AS DOUBLE) / 3 END')} AS agreement FROM c""")
def exec_vote(spark, sf):
    """Five samples per chain: two spellings of one program, another program,
    one of unknown shape and one that leaves the chain; three can vote."""
    chains, p = _with_text(spark, sf), _programs()
    texts = [
        F.concat("body", F.lit("\nProgram: n_helices();\n")), F.concat("body", F.lit("\n```dsl\n"), p["count"], F.lit(";\n```")),
        F.lit("Program: mean_plddt(foo)"), F.concat(F.lit("Program: "), F.regexp_replace(p["count"], " r ", "  r ")), F.concat(F.lit("Program: "), p["far"]),
    ]
    samples = _listed(chains, texts, "text").select(F.concat_ws("/", *KEY).alias("qid"), F.col("f").alias("idx"), "text")
    questions = chains.select(F.concat_ws("/", *KEY).alias("qid"), *KEY, F.lit("Int").alias("answer_type"))
    return flows.exec_vote(questions, samples, _chain_set(spark, sf), _SHAPES).withColumn("agreement", fixed(F.col("agreement")))


#: (answer type, gold, prediction, correct)
_HOSTILE = [
    ("Int", "5", "1e30", False), ("Int", "5", "99999999999999999999", False), ("ResidueSet", "[1, 2]", "[1e300]", False),
    ("Float", "2.0", "-1e400", False), ("Region", "[1, 2]", "[1, 99999999999999999999]", False), ("Int", "5", "about 5", True),
]


@register("score_hostile_answers", "SELECT event_id AS qid, event_id % 6 = 5 AS correct FROM events")
def score_hostile_answers(spark, sf):
    """Numbers beyond 64 bits are wrong answers and never end the job."""
    case = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "g", "p"), row)]) for row in _HOSTILE]),
                        (F.col("event_id") % len(_HOSTILE) + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("qid"), case.alias("c"))
    return rows.select("qid", scoring.score(F.col("c.g"), F.col("c.t"), F.col("c.p"))["correct"].alias("correct"))


@register("run_hostile_programs", f"""WITH {_FACTS} SELECT species || '/' || uniprot || '/' || f AS qid, CASE WHEN f = 2 THEN CAST(n AS VARCHAR) END AS answer, f <> 2 AS failed
  FROM c, (SELECT unnest(range(0, 3)) AS f)""")
def run_hostile_programs(spark, sf):
    """Regions and indices far outside the chain are an ``err`` of their row."""
    texts = [F.lit("mean_plddt(range(1, 1000000000000))"), F.lit("distance(residue(1), residue(99999999999999999999))"), F.lit("n_helices()")]
    asked = _listed(event_lengths(spark, sf), texts, "program").select("qid", *KEY, "program")
    got = programs.run_programs(asked, _chain_set(spark, sf))
    return got.select("qid", "answer", F.col("err").isNotNull().alias("failed"))


_OWN = """SELECT species, uniprot, any_value(length) AS length FROM ev GROUP BY ALL"""


@register("programs_own_literals", f"""WITH {S.EV}, {S.edges('ev')}, c AS ({_OWN}),
  m AS (SELECT r.species, r.uniprot, r.i, avg(CAST(w.plddt AS DOUBLE)) AS v FROM ev r JOIN ev w ON w.species = r.species AND w.uniprot = r.uniprot
    AND w.i BETWEEN r.i AND r.i + r.length % 37 WHERE r.i + r.length % 37 <= r.length GROUP BY ALL),
  a AS (SELECT c.*, (SELECT count(*) FROM ev r WHERE r.species = c.species AND r.uniprot = c.uniprot AND CAST(r.plddt AS DOUBLE) > c.length % 90 + 0.5) AS f0,
    (SELECT count(*) FROM edges g WHERE g.species = c.species AND g.uniprot = c.uniprot AND g.j - g.i >= 1 + c.length % 40 AND g.d < 4 + c.length % 17) AS f1,
    (SELECT coalesce(bool_or(v > 40 + c.length % 30), false) FROM m WHERE m.species = c.species AND m.uniprot = c.uniprot) AS f2,
    (SELECT coalesce(min(g.d) < 2 + c.length % 9, false) FROM edges g JOIN ev a ON a.species = g.species AND a.uniprot = g.uniprot AND a.i = g.i
      JOIN ev b ON b.species = g.species AND b.uniprot = g.uniprot AND b.i = g.j WHERE g.species = c.species AND g.uniprot = c.uniprot AND (a.ss = 'H' AND b.ss = 'E' OR a.ss = 'E' AND b.ss = 'H')) AS f3
    FROM c)
  SELECT species || '/' || uniprot || '/' || f AS qid, CASE f WHEN 0 THEN CAST(f0 AS VARCHAR) WHEN 1 THEN CAST(f1 AS VARCHAR) WHEN 2 THEN CAST(f2 AS VARCHAR) ELSE CAST(f3 AS VARCHAR) END AS answer
  FROM a, (SELECT unnest(range(0, 4)) AS f)""")
def programs_own_literals(spark, sf):
    """Four programs per chain, each with a threshold, separation or width that no list names."""
    n = F.col("length")
    texts = [
        F.format_string("count r in all_residues where plddt(r) > %d.5", n % 90),
        F.format_string("size(filter (i, j) in all_pairs(min_sep=%d) where distance(i, j) < %d)", n % 40 + 1, n % 17 + 4),
        F.format_string("exists reg in sliding_window(%d) where mean_plddt(reg) > %d", n % 37 + 1, n % 30 + 40),
        F.format_string('exists r in all_residues where ss(r) == "H" and exists s in all_residues where ss(s) == "E" and distance(r, s) < %d', n % 9 + 2),
    ]
    asked = _listed(event_lengths(spark, sf), texts, "program").select("qid", *KEY, "program")
    return programs.run_programs(asked, _chain_set(spark, sf), ["A4", "B4", "A5", "G3"]).select("qid", "answer")
