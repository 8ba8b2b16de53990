"""Answer extraction, scoring, voting and run statistics as registered
queries.  Questions, golds, predictions and responses are derived row by row
from the events, documents and lineitem tables; that derivation is plain SQL
text shared by both engines, the operator under test is not."""

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..plans import evaluate, voting
from ..sources.bindings import table
from . import sql as S
from .workload import fixed

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


# ---------------------------------------------------------- derived inputs --

_TYPES = ["Bool", "Int", "Float", "Region", "SecStruct", "Float|Unreliable", "Int|Unreliable",
          "Bool|Unreliable", "ResidueSet", "PairSet"]


def _case(values, subject="event_id % 10"):
    body = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values))
    return f"CASE {subject} {body} END"


def _list(n, item):
    return "'[' || " + " || ', ' || ".join(item.format(v) for v in range(n)) + " || ']'"


_WHOLE = "CAST(CAST(floor(value) AS BIGINT) AS STRING)"
_YES = "CASE WHEN value > 50 THEN 'true' ELSE 'false' END"
_OFF = "CASE WHEN value < 40 THEN 'Unreliable' ELSE {} END"
_GIVE_UP = "CASE WHEN k % 3 = 0 THEN 'I cannot determine this.' ELSE {} END"

GOLDS = _case([
    _YES, _WHOLE, "CAST(value AS STRING)", "'[' || k || ', ' || (k + 20) || ']'",
    "CASE WHEN k < 30 THEN 'H' WHEN k < 60 THEN 'E' ELSE 'C' END",
    _OFF.format("CAST(value AS STRING)"), _OFF.format(_WHOLE), _OFF.format(_YES),
    _list(9, "(k + {})"), _list(9, "'[' || k || ', ' || (k + 20 + {}) || ']'"),
])
PREDS = _case([
    "CASE k % 5 WHEN 0 THEN 'Yes, it does' WHEN 1 THEN ' no ' WHEN 2 THEN '\"True.\"' WHEN 3 THEN 'maybe' ELSE 'False, clearly' END",
    "'about ' || (CAST(floor(value) AS BIGINT) + k % 9 - 4) || ' of them'",
    "CAST(value + (k % 7) * 0.2 AS STRING)",
    "CASE k % 3 WHEN 0 THEN '[' || k || ', ' || (k + 20) || ']' WHEN 1 THEN 'residues ' || k || ' to ' || (k + 20) ELSE '[' || k || ', ' || (k + 21) || ']' END",
    "CASE k % 4 WHEN 0 THEN 'Helix' WHEN 1 THEN 'beta-strand' WHEN 2 THEN 'H' ELSE 'coil.' END",
    _GIVE_UP.format("CAST(value + (k % 5) * 0.3 AS STRING)"), _GIVE_UP.format(_WHOLE),
    _GIVE_UP.format("CASE WHEN k > 50 THEN 'yes' ELSE 'no' END"),
    f"CASE WHEN k % 2 = 0 THEN {_list(10, '(k + {})')} ELSE {_list(8, '(k + {})')} END",
    "CASE WHEN k % 2 = 0 THEN " + _list(10, "'[' || k || ', ' || (k + 20 + {}) || ']'") + " ELSE "
    + _list(7, "'[' || k || ', ' || (k + 20 + {}) || ']'") + " END",
])
_KTAB = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"
ANSWERS = f"""SELECT CAST(event_id AS STRING) AS qid, event_type AS family,
  event_type || (user_id % 5) AS template, {_case(["'" + t + "'" for t in _TYPES])} AS answer_type,
  {GOLDS} AS gold_answer, {PREDS} AS pred_answer FROM ({_KTAB})"""


def sql(spark, sf_dir, query, *tables):
    """Run shared SQL text over the driver tables."""
    frames = {name: table(spark, sf_dir, name) for name in tables}
    text_ = query.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text_ = text_.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(text_, **frames)


def answer_rows(spark, sf_dir):
    return sql(spark, sf_dir, ANSWERS, "events")


def scored_rows(spark, sf_dir):
    rows = answer_rows(spark, sf_dir)
    return evaluate.evaluate(rows.drop("pred_answer"), rows.select("qid", "pred_answer"))


# -------------------------------------------------------------- SQL scorer --

_NUM = "try_cast(nullif(regexp_extract({0}, '(-?\\d+\\.?\\d*(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE)"
_TIDY = "trim(lower(trim({0}, ' \t\n\r')), '\"''.')"
_BOOL = ("CASE WHEN {1} IN ('true','yes','y','1') THEN true WHEN {1} IN ('false','no','n','0') THEN false "
         "WHEN trim(split_part({1}, ',', 1)) IN ('yes','true') THEN true WHEN trim(split_part({1}, ',', 1)) IN ('no','false') THEN false END")
_PHRASES = " OR ".join("contains({1}, '" + p.replace("'", "''") + "')" for p in text.UNRELIABLE_PHRASES)


def _num(c):
    return _NUM.format(c)


def _bool(c):
    return _BOOL.format(c, _TIDY.format(c))


def _off(c):
    return "(" + _PHRASES.format(c, _TIDY.format(c)) + ")"


_LABEL = ("CASE WHEN {1} IN ('helix','alpha-helix','α-helix','h') THEN 'H' WHEN {1} IN ('strand','beta-strand','β-strand','sheet','e') THEN 'E' "
          "WHEN {1} IN ('coil','loop','c','-') THEN 'C' ELSE {0} END").format("pred_answer", _TIDY.format("pred_answer"))
_INTS = "list_transform(regexp_extract_all({0}, '-?\\d+'), lambda v: CAST(v AS BIGINT))"
_G, _P = _num("gold_answer"), _num("pred_answer")
_SETS = "list_distinct(CAST(gold_answer AS BIGINT[]{0}))", "list_distinct(CAST(pred_answer AS BIGINT[]{0}))"


def _jac(pairs):
    g, p = (s.format("[]" if pairs else "") for s in _SETS)
    inter = f"len(list_intersect({g}, {p}))"
    return f"({inter} / CAST(len({g}) + len({p}) - {inter} AS DOUBLE)) >= 0.9"


_MATCH = f"""CASE base WHEN 'Bool' THEN coalesce({_bool('gold_answer')} = {_bool('pred_answer')}, false)
  WHEN 'Int' THEN coalesce(abs(trunc({_G}) - round_even({_P}, 0)) <= 2 OR (trunc({_G}) <> 0 AND abs(trunc({_G}) - round_even({_P}, 0)) / abs(trunc({_G})) <= 0.10), false)
  WHEN 'Float' THEN coalesce(abs({_G} - {_P}) <= 0.5 OR abs({_G} - {_P}) / greatest(abs({_G}), abs({_P}), 1e-9) <= 0.05, false)
  WHEN 'Region' THEN coalesce(({_INTS.format('gold_answer')})[1:2] = ({_INTS.format('pred_answer')})[1:2], false)
  WHEN 'SecStruct' THEN upper({_LABEL}) = upper(gold_answer)
  WHEN 'ResidueSet' THEN {_jac(False)} WHEN 'PairSet' THEN {_jac(True)} END"""
_SCORED = f"""answers AS ({ANSWERS}), based AS (SELECT *, replace(answer_type, '|Unreliable', '') AS base,
    contains(answer_type, 'Unreliable') AS sel, gold_answer = 'Unreliable' AS goff, {_off('pred_answer')} AS poff FROM answers),
  scored AS (SELECT qid, family, template, answer_type, gold_answer, pred_answer,
    CASE WHEN sel AND (goff OR poff) THEN goff AND poff ELSE ({_MATCH}) END AS correct,
    CASE WHEN sel AND goff THEN poff END AS abstained_correctly,
    CASE WHEN sel THEN goff END AS gold_unreliable, CASE WHEN sel THEN poff END AS pred_unreliable,
    CASE WHEN sel AND goff AND NOT poff THEN 'over_confident' WHEN sel AND NOT goff AND poff THEN 'over_abstention' END AS failure_mode
  FROM based)"""


@register("score_answers", f"WITH {_SCORED} SELECT qid, correct, abstained_correctly, gold_unreliable, pred_unreliable, failure_mode FROM scored")
def score_answers(spark, sf):
    return scored_rows(spark, sf).select(
        "qid", "correct", "abstained_correctly", "gold_unreliable", "pred_unreliable", "failure_mode"
    )


@register("parse_scalars", f"""WITH answers AS ({ANSWERS}) SELECT qid, {_P} AS number, {_bool('pred_answer')} AS flag, {_off('pred_answer')} AS unreliable FROM answers""")
def parse_scalars(spark, sf):
    rows = answer_rows(spark, sf)
    p = F.col("pred_answer")
    return rows.select("qid", text.parse_numeric(p).alias("number"), text.parse_bool(p).alias("flag"), text.is_unreliable(p).alias("unreliable"))


_R = "CAST(count(*) FILTER ({}) AS DOUBLE)"


def _ratio(a, b):
    return S.fixed(f"CASE WHEN count(*) FILTER ({b}) > 0 THEN {_R.format(a)} / count(*) FILTER ({b}) END")


@register("metrics_by_level", f"""WITH {_SCORED} SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(template) = 0 THEN 'template' ELSE 'overall' END AS level,
  family, template, count(*) AS n_total, {_ratio('correct', 'true')} AS accuracy_overall,
  {_ratio('gold_unreliable AND correct', 'gold_unreliable')} AS abstention_recall,
  {_ratio('NOT gold_unreliable AND correct', 'NOT gold_unreliable')} AS accuracy_when_value,
  {_ratio('gold_unreliable IS NOT NULL AND correct', 'gold_unreliable IS NOT NULL')} AS selective_accuracy,
  {_ratio("failure_mode = 'over_abstention'", 'gold_unreliable IS NOT NULL')} AS over_abstention_rate,
  {_ratio("failure_mode = 'over_confident'", 'gold_unreliable IS NOT NULL')} AS over_confident_rate
  FROM scored GROUP BY GROUPING SETS ((), (family), (template))""")
def metrics_by_level(spark, sf):
    got = evaluate.metrics(scored_rows(spark, sf))
    rates = [c for c in got.columns if c.endswith(("_overall", "_recall", "_value", "_accuracy", "_rate"))]
    return got.withColumns({c: fixed(F.col(c)) for c in rates})


_DIFF = """CASE WHEN gold_answer = 'Unreliable' OR other = 'Unreliable' THEN gold_answer <> other
  WHEN base = 'Bool' THEN gold_answer <> other
  WHEN base = 'Float' THEN abs(CAST(gold_answer AS DOUBLE) - CAST(other AS DOUBLE)) >= 1e-9 AND (abs(CAST(gold_answer AS DOUBLE) - CAST(other AS DOUBLE)) > 0.6
    OR abs(CAST(gold_answer AS DOUBLE) - CAST(other AS DOUBLE)) / greatest(abs(CAST(gold_answer AS DOUBLE)), abs(CAST(other AS DOUBLE)), 1e-9) > 0.07)
  WHEN base = 'Int' THEN abs(CAST(gold_answer AS BIGINT) - CAST(other AS BIGINT)) >= 3
    OR abs(CAST(gold_answer AS BIGINT) - CAST(other AS BIGINT)) / CAST(greatest(abs(CAST(gold_answer AS BIGINT)), abs(CAST(other AS BIGINT)), 1) AS DOUBLE) > 0.12
  ELSE gold_answer <> other END"""
_NEXT = "lead(gold_answer, 1) OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id)"
_PAIRED = f"""SELECT * FROM (SELECT CAST(event_id AS STRING) AS qid, {_case(["'" + t + "'" for t in _TYPES])} AS answer_type, gold_answer, {_NEXT} AS other
  FROM (SELECT *, {GOLDS} AS gold_answer FROM ({_KTAB}))) WHERE other IS NOT NULL"""


@register("answers_differ", f"WITH p AS ({_PAIRED}) SELECT qid, {_DIFF} AS differs FROM (SELECT *, replace(answer_type, '|Unreliable', '') AS base FROM p)")
def answers_differ(spark, sf):
    """Consecutive answers of the same type and user, under the mining rule."""
    rows = sql(spark, sf, _PAIRED, "events")
    return rows.select("qid", scoring.answers_differ(F.col("gold_answer"), F.col("other"), F.col("answer_type")).alias("differs"))


# --------------------------------------------------------------- responses --

_PROGRAM = "'count r in all_residues where plddt(r) > ' || (doc_id % 90)"
_NL = "chr(10)"
RESPONSES = f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Int' WHEN 1 THEN 'Bool|Unreliable' WHEN 2 THEN 'Region' ELSE 'SecStruct' END AS answer_type,
  CASE doc_id % 11
   WHEN 0 THEN text || {_NL} || '```dsl' || {_NL} || {_PROGRAM} || ';' || {_NL} || '```'
   WHEN 1 THEN '<think>' || text || ' n_helices()</think> use `' || {_PROGRAM} || '` here'
   WHEN 2 THEN '{{"program": "' || {_PROGRAM} || '"}}'
   WHEN 3 THEN text || {_NL} || 'Program: ' || {_PROGRAM} || ';' || {_NL} || 'done'
   WHEN 4 THEN text || {_NL} || '  "' || {_PROGRAM} || '" ' || {_NL} || text
   WHEN 5 THEN text || ' distance(1) <answer> ' || doc_id || ' to ' || (doc_id + 30) || '</answer>'
   WHEN 6 THEN 'Yes, there is a helix from ' || doc_id || ' to ' || (doc_id + 12)
   WHEN 7 THEN '<answer>Not enough information</answer>'
   WHEN 8 THEN 'strand'
   WHEN 9 THEN '```json' || {_NL} || '{{"query": "' || {_PROGRAM} || '"}}' || {_NL} || '```'
   ELSE text END AS text FROM documents"""


_WORDS = "|".join(text.PROGRAM_WORDS)
_LINES = "list_transform(string_split(r.text, chr(10)), lambda v: trim(trim(trim(v), '\"')))"
_READS = ("contains(v, '(') AND contains(v, ')') AND regexp_matches(v, '(^|[^\\p{L}\\p{N}_])("
          + _WORDS + ")($|[^\\p{L}\\p{N}_])')")


@register("extract_program", f"""WITH r AS ({RESPONSES}) SELECT doc_id, CASE WHEN doc_id % 11 IN (0, 1, 2, 3, 9) THEN {_PROGRAM}
  ELSE (list_filter({_LINES}, lambda v: {_READS}))[1] END AS program FROM r""")
def extract_program(spark, sf):
    """Programs in responses built around whole document texts."""
    rows = sql(spark, sf, RESPONSES, "documents")
    return rows.select("doc_id", text.extract_program(F.col("text")).alias("program"))


@register("parse_responses")
def parse_responses(spark, sf):
    """Program, typed scalar or abstention of every response."""
    return evaluate.parsed_responses(sql(spark, sf, RESPONSES, "documents")).drop("text")


@register("tool_calls", """SELECT event_id, 'tool_dsl' AS name, 'count r in all_residues where (plddt(r) > ' || CAST(floor(value) AS BIGINT) || ')' AS payload,
  user_id || ',' || event_id AS args FROM events""")
def tool_calls(spark, sf):
    """Balanced payload of an action line and its argument list."""
    rows = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit(" tool_dsl (count r in all_residues where (plddt(r) > "), F.floor("value").cast("string"), F.lit(")) then stop)")).alias("line"),
        F.concat(F.lit("i="), F.col("user_id").cast("string"), F.lit(", '"), F.col("event_id").cast("string"), F.lit("'")).alias("raw"),
    )
    call = text.tool_call(F.col("line"))
    return rows.select("event_id", call["name"].alias("name"), call["payload"].alias("payload"),
                       F.array_join(text.tool_arguments(F.col("raw")), ",").alias("args"))


# ------------------------------------------------------------------- votes --
# Five samples per question: ids are unique, so id div 5 bounds a group.

_SAMPLES = f"SELECT CAST(floor(event_id / 5) AS BIGINT) AS qid, event_id % 5 AS idx, value, event_type, k FROM ({_KTAB})"


def _samples(spark, sf):
    return sql(spark, sf, _SAMPLES, "events")


@register("vote_bool", f"WITH s AS ({_SAMPLES}) SELECT qid, count(*) FILTER (value > 40) * 2 >= count(*) AS answer, {S.fixed('greatest(count(*) FILTER (value > 40), count(*) FILTER (value <= 40)) / CAST(count(*) AS DOUBLE)')} AS agreement FROM s WHERE k % 4 <> 0 GROUP BY qid")
def vote_bool(spark, sf):
    """Samples with k divisible by 4 failed and do not vote."""
    s = _samples(spark, sf).withColumn("v", F.when(F.col("k") % 4 != 0, F.col("value") > 40))
    return voting.bool_vote(s, "v").withColumn("agreement", fixed(F.col("agreement")))


@register("vote_mode", f"""WITH s AS ({_SAMPLES}), c AS (SELECT qid, event_type, count(*) AS n, min(idx) AS f FROM s GROUP BY ALL)
  SELECT qid, event_type AS answer, {S.fixed('n / CAST(total AS DOUBLE)')} AS agreement FROM (SELECT *, sum(n) OVER (PARTITION BY qid) AS total,
    row_number() OVER (PARTITION BY qid ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def vote_mode(spark, sf):
    return voting.mode_vote(_samples(spark, sf), "event_type").withColumn("agreement", fixed(F.col("agreement")))


@register("vote_float", f"""WITH s AS ({_SAMPLES}), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value) AS rn, count(*) OVER (PARTITION BY qid) AS n FROM s),
  p AS (SELECT qid, value AS answer FROM m WHERE rn = n // 2 + 1)
  SELECT qid, answer, {S.fixed('count(*) FILTER (abs(value - answer) <= greatest(0.05 * abs(answer), 1e-3)) / CAST(count(*) AS DOUBLE)')} AS agreement FROM s JOIN p USING (qid) GROUP BY qid, answer""")
def vote_float(spark, sf):
    """Upper median of the samples of a question."""
    return voting.float_vote(_samples(spark, sf)).withColumn("agreement", fixed(F.col("agreement")))


@register("vote_float_large_groups", """SELECT l_returnflag AS qid, l_extendedprice AS answer FROM (SELECT l_returnflag, l_extendedprice,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rn = n // 2 + 1""")
def vote_float_large_groups(spark, sf):
    """The same vote when three groups share the whole lineitem table."""
    s = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("qid"), F.col("l_extendedprice").alias("value"))
    return voting.float_vote(s).select("qid", "answer")


_IOU = "greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1)"


@register("vote_region", f"""WITH s AS (SELECT qid, idx, k % 30 AS s, k % 30 + 10 + idx AS e FROM ({_SAMPLES})),
  sc AS (SELECT a.qid, a.idx, a.s, a.e, floor(coalesce(sum({_IOU} / CAST((a.e - a.s + 1) + (b.e - b.s + 1) - {_IOU} AS DOUBLE)), 0) / greatest(1, count(b.idx)) * 1e12 + 0.5) / 1e12 AS score
    FROM s a LEFT JOIN s b ON a.qid = b.qid AND a.idx <> b.idx GROUP BY ALL)
  SELECT qid, s AS start, e AS "end", {S.fixed('score')} AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rn FROM sc) WHERE rn = 1""")
def vote_region(spark, sf):
    s = _samples(spark, sf).select("qid", "idx", (F.col("k") % 30).alias("start"), (F.col("k") % 30 + 10 + F.col("idx")).alias("end"))
    return voting.region_vote(s).withColumn("agreement", fixed(F.col("agreement")))


@register("vote_set", f"""WITH s AS (SELECT qid, idx, range(k // 10, k // 10 + CAST(floor(value) AS BIGINT) % 6) AS m FROM ({_SAMPLES})),
  sc AS (SELECT a.qid, a.idx, floor(coalesce(sum(CASE WHEN len(a.m) = 0 AND len(b.m) = 0 THEN 1.0 ELSE len(list_intersect(a.m, b.m)) / CAST(len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)) AS DOUBLE) END), 0)
      / greatest(1, count(b.idx)) * 1e12 + 0.5) / 1e12 AS score FROM s a LEFT JOIN s b ON a.qid = b.qid AND a.idx <> b.idx GROUP BY ALL)
  SELECT qid, idx, {S.fixed('score')} AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rn FROM sc) WHERE rn = 1""")
def vote_set(spark, sf):
    s = _samples(spark, sf).select("qid", "idx", F.floor(F.col("k") / 10).alias("lo"), F.pmod(F.floor("value"), F.lit(6)).alias("n"))
    members = s.where("n > 0").select("qid", "idx", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("i"))
    return voting.set_vote(members, s).withColumn("agreement", fixed(F.col("agreement")))


@register("consensus_by_type")
def consensus_by_type(spark, sf):
    """All answer types in one call: type gate, then the vote of the type."""
    rows = sql(spark, sf, f"""SELECT CAST(user_id AS STRING) || '/' || (event_id % 10) AS qid, event_id AS idx,
      {_case(["'" + t + "'" for t in _TYPES])} AS answer_type, {GOLDS} AS value FROM ({_KTAB})""", "events")
    return voting.consensus(rows)


@register("retry_rounds", f"""WITH s AS ({_SAMPLES}) SELECT qid, min(idx) FILTER (value > 30) AS att, count(*) AS n, coalesce(min(idx) FILTER (value > 30) + 1, count(*)) AS n_attempts,
  min_by(value, idx) FILTER (value > 30) AS value FROM s GROUP BY qid""".replace("min(idx) FILTER (value > 30) AS att, count(*) AS n, ", ""))
def retry_rounds(spark, sf):
    """Attempts with a value up to 30 failed; the first success counts."""
    s = _samples(spark, sf).select("qid", (F.col("idx") + 1).alias("attempt"), "value", F.when(F.col("value") <= 30, "failed").alias("err"))
    return voting.first_success(s)


@register("reflection_gate", f"""WITH s AS ({_SAMPLES}), c AS (SELECT qid, event_type, count(*) AS n, min(idx) AS f FROM s GROUP BY ALL),
  v AS (SELECT qid, event_type AS first_, n / 5.0 AS agr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1)
  SELECT v.qid, CASE WHEN agr < 0.6 AND EXISTS (SELECT 1 FROM s WHERE s.qid = v.qid AND s.event_type = 'view') THEN 'view' ELSE first_ END AS answer FROM v""")
def reflection_gate(spark, sf):
    """A second answer ('view') replaces weak consensus if it was sampled."""
    s = _samples(spark, sf).withColumn("value", F.col("event_type"))
    first = voting.mode_vote(s)
    second = s.select("qid").distinct().withColumn("value", F.lit("view"))
    return voting.keep_reflected(second, s, first, 0.6).select("qid", "answer")


# -------------------------------------------------------------- statistics --

_RUNS = f"""runs AS (SELECT CAST(event_id AS STRING) AS qid, event_type AS family, event_type || (user_id % 5) AS template, value > 30 AS a, k < 70 AS b,
  CASE event_id % 3 WHEN 0 THEN 'HN1' WHEN 1 THEN 'HN2' END AS hn_class FROM ({_KTAB}))"""


def _runs(spark, sf):
    rows = sql(spark, sf, f"WITH {_RUNS} SELECT * FROM runs", "events")
    pick = lambda c: rows.select("qid", "family", "template", F.col(c).alias("correct"))
    return pick("a"), pick("b"), rows.where("hn_class is not null").select("qid", "hn_class")


@register("mcnemar_exact", f"""WITH {_RUNS}, c AS (SELECT family, count(*) AS n_shared, count(*) FILTER (a AND NOT b) AS n_a_only, count(*) FILTER (b AND NOT a) AS n_b_only FROM runs GROUP BY family)
  SELECT *, n_shared - n_a_only - n_b_only AS n_same, {S.fixed("least(1.0, 2 * list_sum(list_transform(range(0, least(n_a_only, n_b_only) + 1), lambda j: exp(lgamma(n_a_only + n_b_only + 1) - lgamma(j + 1) - lgamma(n_a_only + n_b_only - j + 1) - (n_a_only + n_b_only) * ln(2)))))")} AS p_value FROM c""")
def mcnemar_exact(spark, sf):
    a, b, _ = _runs(spark, sf)
    return evaluate.mcnemar(a, b, ["family"]).withColumn("p_value", fixed(F.col("p_value")))


@register("mcnemar_report", f"""WITH m AS ({ORACLES["mcnemar_exact"]})
  SELECT *, CASE WHEN p_value < 1e-4 THEN '<0.0001' WHEN p_value < 1e-3 THEN '<0.001' ELSE printf('%.3f', p_value) END AS p_text,
  CASE WHEN p_value < 0.0001 THEN '****' WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS stars,
  p_value < 0.05 / 5 AS significant_corrected FROM m""")
def mcnemar_report(spark, sf):
    """Text, stars and the corrected verdict per family."""
    a, b, _ = _runs(spark, sf)
    tests = evaluate.mcnemar(a, b, ["family"]).withColumn("p_value", fixed(F.col("p_value")))
    return evaluate.with_bonferroni(tests, comparisons=5)


@register("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    a, _, _ = _runs(spark, sf)
    return evaluate.bootstrap(a, ["family"])


@register("hard_negative_breakdown", f"""WITH {_RUNS} SELECT CASE WHEN grouping(c) = 1 THEN 'ALL' ELSE c END AS hn_class, count(*) AS n, {S.fixed('100.0 * count(*) FILTER (a) / count(*)')} AS acc
  FROM (SELECT *, coalesce(hn_class, 'UNK') AS c FROM runs) GROUP BY ROLLUP (c)""")
def hard_negative_breakdown(spark, sf):
    a, _, classes = _runs(spark, sf)
    return evaluate.class_breakdown(a, classes).withColumn("acc", fixed(F.col("acc")))


@register("compare_runs", f"""WITH {_RUNS} SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(template) = 0 THEN 'template' ELSE 'overall' END AS level,
  coalesce(family, template) AS name, count(*) AS n, {S.fixed('count(*) FILTER (a) / CAST(count(*) AS DOUBLE)')} AS acc_a, {S.fixed('count(*) FILTER (b) / CAST(count(*) AS DOUBLE)')} AS acc_b FROM runs GROUP BY GROUPING SETS ((), (family), (template))""")
def compare_runs(spark, sf):
    a, b, _ = _runs(spark, sf)
    got = evaluate.compare_runs(a, b).drop("delta")
    return got.withColumns({c: fixed(F.col(c)) for c in ("acc_a", "acc_b")})


@register("compare_runs_ranked", f"""WITH {_RUNS} SELECT template AS name, {S.fixed('(count(*) FILTER (b) - count(*) FILTER (a)) / CAST(count(*) AS DOUBLE)')} AS delta FROM runs GROUP BY template""")
def compare_runs_ranked(spark, sf):
    a, b, _ = _runs(spark, sf)
    got = evaluate.ranked_by_delta(evaluate.compare_runs(a, b))
    return got.select("name", fixed(F.col("delta")).alias("delta"))


@register("last_result_wins", """SELECT user_id AS qid, arg_max(value, event_id) AS value, max(event_id) AS position FROM events GROUP BY user_id""")
def last_result_wins(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("qid"), "value", F.col("event_id").alias("position"))
    return evaluate.last_per_question(rows, "position")


@register("prefer_reevaluated", """SELECT event_id AS qid, value FROM events WHERE value > 50 UNION ALL SELECT event_id, -1.0 FROM events WHERE value <= 50""")
def prefer_reevaluated(spark, sf):
    """Re-evaluated rows where they exist, else the first evaluation."""
    ev = table(spark, sf, "events").select(F.col("event_id").alias("qid"), "value")
    return evaluate.prefer(ev.where("value > 50"), ev.withColumn("value", F.lit(-1.0)))


@register("resume_unfinished", """SELECT event_id AS qid FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')""")
def resume_unfinished(spark, sf):
    """Questions that have no result yet."""
    ev = table(spark, sf, "events")
    done = ev.where("event_type = 'view'").select(F.col("event_id").alias("qid"))
    return ev.select(F.col("event_id").alias("qid")).join(done, "qid", "left_anti")


@register("spearman_correlation", f"""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
  SELECT l_returnflag, {S.fixed('corr(x, y)')} AS spearman FROM r GROUP BY l_returnflag""")
def spearman_correlation(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    got = evaluate.spearman(li, "l_quantity", "l_extendedprice", ["l_returnflag"],
                            F.floor("l_quantity"), F.floor(F.col("l_extendedprice") / 10))
    return got.withColumn("spearman", fixed(F.col("spearman")))
