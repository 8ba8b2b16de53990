"""Question generation, hard negatives, splits, samples, audits, statistics
and prompt texts as registered queries."""

from pyspark.sql import functions as F

from ..operators import regions
from ..operators.matrix import block_values
from ..operators.ranking import hash_int
from ..plans import gates, generate, hard_negatives, programs, prompts, splits, statistics
from ..plans.templates import ChainSet, answer_template, questions_for, raw_draws
from ..schema import KEY
from ..session import cut_lineage
from ..sources.bindings import SPECIES, event_chains, event_lengths, event_scores, table, vector_lengths, vector_matrix
from . import sql as S
from .evaluation import _KTAB, sql
from .workload import fixed

QUERIES, ORACLES = {}, {}
EV = f"WITH {S.EV} "


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def H(*parts: str) -> str:
    """The 32-bit draw in SQL; parts are SQL expressions of text."""
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 8))::BIGINT"


_FAMILIES = ["A", "B", "C", "D", "E", "F", "G", "Ha", "Hb"]


def _pick(values, subject):
    return f"CASE {subject} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


# Question rows derived from events: one per event.
QROWS = f"""SELECT CAST(event_id AS STRING) AS qid, {_pick(SPECIES, 'user_id % 4')} AS species, 'U' || user_id AS uniprot,
  {_pick(_FAMILIES, 'event_id % 9')} AS family, {_pick(_FAMILIES, 'event_id % 9')} || (k % 3) AS template,
  {_pick(['Bool', 'Int', 'Float'], 'k % 3')} AS answer_type, k FROM ({_KTAB})"""
HROWS = f"""SELECT qid || '/' || hn AS qid, species, uniprot, family, template, answer_type, k, hn AS hn_class FROM
  (SELECT *, CASE WHEN k % 4 = 0 THEN 'HN2' ELSE 'HN1' END AS hn FROM ({QROWS}))"""


def _event_set(spark, sf):
    return ChainSet(event_chains(spark, sf), lengths=event_lengths(spark, sf))


def question_rows(spark, sf):
    return sql(spark, sf, QROWS, "events")


def hard_rows(spark, sf):
    return sql(spark, sf, HROWS, "events")


# ---------------------------------------------------------------- generation --

def _family_case(draw):
    total, upto, out = sum(generate.FAMILY_WEIGHTS.values()), 0.0, "CASE "
    names = list(generate.FAMILY_WEIGHTS)
    for n in names[:-1]:
        upto += generate.FAMILY_WEIGHTS[n] / total
        out += f"WHEN {draw} < {int(upto * 2**32)} THEN '{n}' "
    return out + f"ELSE '{names[-1]}' END"


@register("weighted_family_draw", EV + f"""SELECT family, count(*) AS n FROM (SELECT {_family_case(H('species', 'uniprot', 'CAST(i AS VARCHAR)'))} AS family FROM ev) GROUP BY family""")
def weighted_family_draw(spark, sf):
    """A weighted family per position; counts follow the weights."""
    ev = event_chains(spark, sf)
    draw = hash_int(F.col("species"), F.col("uniprot"), F.col("i"))
    return ev.select(generate.weighted_choice(generate.FAMILY_WEIGHTS, draw).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@register("distinct_questions_per_chain", EV + f""", c AS (SELECT species, uniprot, slot, attempt, {S.choice(H('species', 'uniprot', "'A4'", 'CAST(slot AS VARCHAR)', 'CAST(attempt AS VARCHAR)', "'0'"), [50, 70, 80, 90])} AS t
    FROM (SELECT species, uniprot, unnest(range(0, 8)) AS slot FROM ev WHERE i = 1), (SELECT unnest(range(0, 3)) AS attempt)),
  a AS (SELECT *, row_number() OVER (PARTITION BY species, uniprot, t ORDER BY slot, attempt) AS u FROM c),
  b AS (SELECT *, row_number() OVER (PARTITION BY species, uniprot, slot ORDER BY attempt) AS f FROM a WHERE u = 1),
  d AS (SELECT *, row_number() OVER (PARTITION BY species, uniprot ORDER BY slot) AS n FROM b WHERE f = 1)
  SELECT species || '/' || uniprot || '/A4/' || (n - 1) AS qid, t AS threshold FROM d WHERE n <= 3""")
def distinct_questions_per_chain(spark, sf):
    """Duplicate parameters dropped, first acceptable attempt per slot, at
    most three questions."""
    chains = event_lengths(spark, sf)
    tries = chains.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn(
        "attempt", F.explode(F.sequence(F.lit(0), F.lit(2)))
    ).withColumns(raw_draws(1, F.lit("A4"), F.col("slot").cast("string"), F.col("attempt").cast("string")))
    rows = tries.withColumns({
        "params": generate.TEMPLATES["A4"].params_column(), "template": F.lit("A4"),
        "family": F.lit("A"), "track": F.lit("main"),
    })
    return generate.choose(rows, {"main": 3}).select("qid", F.element_at("params", "threshold").alias("threshold"))


@register("question_texts", EV + ", " + S.questions("B2", "ev", {
    "i": "1 + d0 % length", "lft": "greatest(i - 4, 0)", "rgt": "greatest(length - i - 3, 0)", "k": "d1 % greatest(lft + rgt, 1)",
    "j": "CASE WHEN k < lft THEN k + 1 ELSE i + 4 + k - lft END", "t": S.choice("d2", [6, 8, 10, 12])}, "length >= 6 AND lft + rgt > 0", 3, 2) + f"""
  SELECT qid, 'distance(residue(' || i || '), residue(' || j || ')) < ' || CAST(t AS BIGINT) AS program, 'Bool' AS answer_type,
    CASE WHEN {H("'0'", 'qid')} % 2 = 0 THEN 'Are residues ' || i || ' and ' || j || ' less than ' || CAST(t AS BIGINT) || ' angstrom apart?'
      ELSE 'Is the distance between residues ' || i || ' and ' || j || ' below ' || CAST(t AS BIGINT) || ' angstrom?' END AS question FROM q""")
def question_texts(spark, sf):
    """Program and question text rendered from parameters."""
    q = questions_for("B2", event_lengths(spark, sf), 2)
    return generate.with_texts(q).select("qid", "program", "answer_type", "question")


@register("rerendered_texts", EV + ", " + S.questions("A4", "ev", {"t": S.choice("d0", [50, 70, 80, 90])}, "true", 1, 2) + f"""
  SELECT qid, {H("'0'", 'qid')} % 2 <> 0 AS changed FROM q""")
def rerendered_texts(spark, sf):
    """Texts written anew; rows whose stored wording was the other one change."""
    q = generate.with_texts(questions_for("A4", event_lengths(spark, sf), 2))
    stale = q.withColumn("question", generate.question_text(F.lit(0)))
    return generate.rerender(stale).select("qid", "changed")


@register("generate_questions")
def generate_questions(spark, sf):
    """The three tracks over vector chains: main, compositional, abstaining."""
    chains = vector_lengths(spark, sf)
    rows = generate.candidates(chains, generate.TRACKS, with_matrix=True)
    picked = cut_lineage(generate.choose(rows))
    return generate.with_texts(picked).withColumn("params", generate.params_key(F.col("params")))


@register("balanced_truth_values", EV + ", " + S.questions("B2", "ev", {
    "i": "1 + d0 % length", "lft": "greatest(i - 4, 0)", "rgt": "greatest(length - i - 3, 0)", "k": "d1 % greatest(lft + rgt, 1)",
    "j": "CASE WHEN k < lft THEN k + 1 ELSE i + 4 + k - lft END", "t": S.choice("d2", [6, 8, 10, 12])}, "length >= 6 AND lft + rgt > 0", 3, 40) + f""",
  a AS (SELECT q.qid, q.species, q.uniprot, q.slot, {S.dist()} < t AS v FROM q JOIN ev a ON a.species = q.species AND a.uniprot = q.uniprot AND a.i = q.i
    JOIN ev b ON b.species = q.species AND b.uniprot = q.uniprot AND b.i = q.j),
  r AS (SELECT *, row_number() OVER (PARTITION BY species, uniprot, v ORDER BY slot) AS turn, count(*) FILTER (v) OVER (PARTITION BY species, uniprot) AS yes,
    count(*) FILTER (NOT v) OVER (PARTITION BY species, uniprot) AS no FROM a)
  SELECT qid, v AS answer FROM r WHERE least(yes, no) = 0 OR turn <= least(yes, no) + 3""")
def balanced_truth_values(spark, sf):
    """Forty distance questions per chain, without the surplus of the more frequent answer."""
    chains = _event_set(spark, sf)
    q = questions_for("B2", chains.chains(), 40)
    got = q.join(answer_template("B2", q, chains, drawn=True).select("qid", "b"), "qid")
    slot = F.element_at(F.split("qid", "/"), -1).cast("int")
    return generate.balanced(got, F.col("b"), [slot]).select("qid", F.col("b").alias("answer"))


_RUN = ["A4", "B1", "E6"]


@register("run_program_texts", EV + """, rr AS (SELECT species, uniprot, count(*) AS n FROM (SELECT *, lag(ss) OVER (PARTITION BY species, uniprot ORDER BY i) AS p FROM ev)
    WHERE ss = 'H' AND (p IS NULL OR p <> 'H') GROUP BY ALL), c AS (SELECT species, uniprot, count(*) FILTER (CAST(plddt AS DOUBLE) > length) AS hi, any_value(length) AS length FROM ev GROUP BY ALL)
  SELECT c.species || '/' || c.uniprot || '/' || f AS qid, CASE f WHEN 0 THEN CAST(hi AS VARCHAR) WHEN 1 THEN CAST(coalesce(rr.n, 0) AS VARCHAR) END AS answer,
    CASE f WHEN 2 THEN 'residue index out of range' WHEN 3 THEN 'unsupported program: foo(1)' END AS err
  FROM c LEFT JOIN rr USING (species, uniprot), (SELECT unnest(range(0, 5)) AS f)""")
def run_program_texts(spark, sf):
    """Five program texts per chain: two that run, one that leaves the chain,
    one of unknown shape and an empty one."""
    texts = F.array(
        F.concat(F.lit("count r in  all_residues where plddt( r ) > "), F.col("length").cast("string")),
        F.lit("n_helices( )"),
        F.concat(F.lit("distance(residue(1), residue("), (F.col("length") + 1).cast("string"), F.lit("))")),
        F.lit("foo(1)"), F.lit(""),
    )
    asked = event_lengths(spark, sf).select(*KEY, F.posexplode(texts).alias("f", "program")).select(
        F.concat_ws("/", *KEY, F.col("f").cast("string")).alias("qid"), *KEY, "program"
    )
    return programs.run_programs(asked, _event_set(spark, sf), _RUN)


# ------------------------------------------------------------ hard negatives --

@register("fraction_sample_per_chain", f"""WITH q AS ({QROWS}) SELECT qid FROM (SELECT *, row_number() OVER (PARTITION BY species, uniprot ORDER BY {H("'hn/0'", 'qid')}, qid) AS r,
  count(*) OVER (PARTITION BY species, uniprot) AS n FROM q) WHERE r <= greatest(1, round_even(n * CAST(0.10 AS DOUBLE), 0))""")
def fraction_sample_per_chain(spark, sf):
    return hard_negatives.sample_fraction(question_rows(spark, sf)).select("qid")


def _class_sql():
    draw, out = H("'class/0'", "qid"), "CASE family "
    for family, (a, b, _) in hard_negatives.CLASS_WEIGHTS.items():
        lo, hi = int(a * 2**32), int((a + b) * 2**32)
        out += f"WHEN '{family}' THEN CASE WHEN {draw} < {lo} THEN 'HN1' WHEN {draw} < {hi} THEN 'HN2' ELSE 'HN3' END "
    return out + "END"


@register("hard_negative_class", f"WITH q AS ({QROWS}) SELECT qid, {_class_sql()} AS hn FROM q")
def hard_negative_class(spark, sf):
    return question_rows(spark, sf).select("qid", hard_negatives.class_choice().alias("hn"))


_D8 = [4, 5, 6, 8, 10, 12, 15, 20]
_B2 = S.questions("B2", "ev", {
    "i": "1 + d0 % length", "lft": "greatest(i - 4, 0)", "rgt": "greatest(length - i - 3, 0)", "k": "d1 % greatest(lft + rgt, 1)",
    "j": "CASE WHEN k < lft THEN k + 1 ELSE i + 4 + k - lft END", "t": S.choice("d2", [6, 8, 10, 12])}, "length >= 6 AND lft + rgt > 0", 3, 2)


def _positives(template, spark, sf, chains):
    q = questions_for(template, chains.chains(), 2).withColumns(
        {"family": F.lit(template[0]), "answer_type": F.lit(generate.TEMPLATES[template].answer_type)}
    )
    got = answer_template(template, q, chains, drawn=True)
    return cut_lineage(q.join(got.select("qid", generate.answer_text(got).alias("answer")), "qid"))


@register("hard_negative_threshold_flip", EV + ", " + _B2 + f""", p AS (SELECT q.*, {S.dist()} AS d FROM q
    JOIN ev a ON a.species = q.species AND a.uniprot = q.uniprot AND a.i = q.i JOIN ev b ON b.species = q.species AND b.uniprot = q.uniprot AND b.i = q.j),
  v AS (SELECT p.*, c.c, {H("'hn2/0'", 'qid', "CAST(CAST(c.c AS BIGINT) AS VARCHAR) || '.0'")} AS o FROM p, (SELECT unnest({_D8}) AS c) c WHERE c.c <> t)
  SELECT qid, CAST(c AS DOUBLE) AS threshold, CAST(d < c AS VARCHAR) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS rn FROM v WHERE (d < c) <> (d < t)) WHERE rn = 1""")
def hard_negative_threshold_flip(spark, sf):
    """HN2 of distance questions: another threshold that flips the answer."""
    chains = _event_set(spark, sf)
    positives = _positives("B2", spark, sf, chains)
    found = hard_negatives.first_differing(hard_negatives.threshold_flips(positives), chains, ["B2"])
    return found.select("qid", F.element_at("new_params", "threshold").alias("threshold"), F.col("new_answer").alias("answer"))


@register("hard_negative_resampled", EV + ", " + S.questions("A4", "ev", {"t": S.choice("d0", [50, 70, 80, 90])}, "true", 1, 2) + f""",
  n AS (SELECT species, uniprot, t, count(*) FILTER (CAST(plddt AS DOUBLE) > t) AS c FROM ev, (SELECT unnest([50, 70, 80, 90]) AS t) GROUP BY ALL),
  v AS (SELECT q.qid, q.species, q.uniprot, q.t AS t0, o, {S.choice(H('species', 'uniprot', "'A4'", "'hn1/0'", 'qid', 'CAST(o AS VARCHAR)', "'0'"), [50, 70, 80, 90])} AS t1 FROM q, (SELECT unnest(range(0, 30)) AS o)),
  w AS (SELECT v.*, a.c AS c0, b.c AS c1 FROM v JOIN n a ON a.species = v.species AND a.uniprot = v.uniprot AND a.t = t0 JOIN n b ON b.species = v.species AND b.uniprot = v.uniprot AND b.t = t1)
  SELECT qid, o AS "order", t1 AS threshold, CAST(c1 AS VARCHAR) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS rn FROM w
    WHERE t1 <> t0 AND (abs(c0 - c1) >= 3 OR abs(c0 - c1) / CAST(greatest(c0, c1, 1) AS DOUBLE) > 0.12)) WHERE rn = 1""")
def hard_negative_resampled(spark, sf):
    """HN1 of count questions: new parameters until the answer differs."""
    chains = _event_set(spark, sf)
    found = hard_negatives.first_differing(
        hard_negatives.resampled(_positives("A4", spark, sf, chains), ["A4"]), chains, ["A4"]
    )
    return found.select("qid", "order", F.element_at("new_params", "threshold").alias("threshold"), F.col("new_answer").alias("answer"))


@register("mine_hard_negatives")
def mine_hard_negatives(spark, sf):
    """Both classes with fallback, for distance questions."""
    chains = _event_set(spark, sf)
    found = hard_negatives.mine(_positives("B2", spark, sf, chains), chains, ["B2"])
    return found.select("qid", "hn_source_qid", "hn_class", "program", "answer", "is_hard_negative")


# -------------------------------------------------------------------- splits --

_PART = f"""parts AS (SELECT uniprot, CASE WHEN r <= round_even(n * CAST(0.8 AS DOUBLE), 0) THEN 'train' WHEN r <= round_even(n * CAST(0.8 AS DOUBLE), 0) + round_even(n * CAST(0.1 AS DOUBLE), 0) THEN 'dev' ELSE 'test_iid' END AS part
  FROM (SELECT uniprot, row_number() OVER (ORDER BY {H("'42'", 'uniprot')}, uniprot) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT uniprot FROM q WHERE species = 'human')))"""
_SPLIT = f"""q AS ({QROWS}), {_PART}, s AS (SELECT q.qid, species, q.uniprot, family, template, answer_type, CASE WHEN family = 'G' THEN 'test_compositional' WHEN family = 'Ha' THEN 'test_selective_prompted'
   WHEN family = 'Hb' THEN 'test_selective_unprompted' WHEN species = 'human' THEN part ELSE 'test_cross_species' END AS split, CAST(NULL AS VARCHAR) AS hn_class FROM q LEFT JOIN parts USING (uniprot)
  UNION ALL SELECT qid, species, uniprot, family, template, answer_type, 'test_hn', hn_class FROM ({HROWS}))"""


def _split_rows(spark, sf):
    return splits.compose(question_rows(spark, sf), hard_rows(spark, sf))


@register("protein_partition", f"WITH q AS ({QROWS}), {_PART} SELECT uniprot, part FROM parts")
def protein_partition(spark, sf):
    return splits.protein_partition(question_rows(spark, sf)).select("uniprot", "part")


@register("compose_splits", f"WITH {_SPLIT} SELECT qid, split FROM s")
def compose_splits(spark, sf):
    return _split_rows(spark, sf).select("qid", "split")


@register("split_family_counts", f"WITH {_SPLIT} SELECT split, family, count(*) AS n FROM s GROUP BY ROLLUP (split, family)")
def split_family_counts(spark, sf):
    return splits.split_counts(_split_rows(spark, sf))


@register("split_manifest", f"""WITH {_SPLIT}, c AS (SELECT split, family, count(*) AS n FROM s GROUP BY ALL)
  SELECT split, '{{"n":' || CAST(sum(n) AS BIGINT) || ',"families":{{' || string_agg('"' || family || '":' || n, ',' ORDER BY family) || '}}}}' AS entry FROM c GROUP BY split""")
def split_manifest(spark, sf):
    return splits.manifest(_split_rows(spark, sf))


@register("stratified_sample_sizes")
def stratified_sample_sizes(spark, sf):
    """Rows taken from each (family, answer_type) stratum for a target of 2000."""
    rows = question_rows(spark, sf)
    got = splits.stratified_sample(rows, 2000, ["family", "answer_type"], floor=30)
    return got.groupBy("family", "answer_type").agg(F.count(F.lit(1)).alias("n"))


@register("sample_audit", f"WITH q AS ({QROWS}), c AS (SELECT count(*) AS n FROM q WHERE family <> 'G' GROUP BY family, answer_type) "
          "SELECT CAST(sum(n) AS BIGINT) AS actual, count(*) AS n_cells, min(n) AS min_cell, max(n) AS max_cell, list_sort(list(n))[len(list(n)) // 2 + 1] AS median_cell FROM c")
def sample_audit(spark, sf):
    return splits.sample_audit(question_rows(spark, sf).where("family <> 'G'"), ["family", "answer_type"])


_MARG = """m{0} AS (SELECT c.column_name AS "column", c.value, count(*) AS n FROM {1}, (VALUES (1)) v, LATERAL (SELECT unnest(['family', 'species', 'answer_type']) AS column_name, unnest([family, species, answer_type]) AS value) c GROUP BY ALL),
  p{0} AS (SELECT "column", value, n, n / CAST(sum(n) OVER (PARTITION BY "column") AS DOUBLE) AS share FROM m{0})"""


@register("category_marginals", f"""WITH q AS ({QROWS}), {_MARG.format('a', 'q')} SELECT "column", value, n, {S.fixed('share')} AS share FROM pa""")
def category_marginals(spark, sf):
    got = splits.marginals(question_rows(spark, sf), ["family", "species", "answer_type"])
    return got.withColumn("share", fixed(F.col("share")))


@register("divergence_of_sample", f"""WITH q AS ({QROWS}), h AS (SELECT * FROM q WHERE k < 60), {_MARG.format('a', 'h')}, {_MARG.format('b', 'q')}
  SELECT coalesce(pa."column", pb."column") AS "column", {S.fixed('sum(coalesce(pa.share, 1e-9) * ln(coalesce(pa.share, 1e-9) / coalesce(pb.share, 1e-9)))')} AS kl
  FROM pa FULL JOIN pb ON pa."column" = pb."column" AND pa.value = pb.value GROUP BY ALL""")
def divergence_of_sample(spark, sf):
    """KL of the rows with k < 60 against all rows."""
    q = question_rows(spark, sf)
    got = splits.divergence(q.where("k < 60"), q, ["family", "species", "answer_type"])
    return got.withColumn("kl", fixed(F.col("kl")))


_TT = f"q AS ({QROWS}), tr AS (SELECT * FROM q WHERE k >= 50), te AS (SELECT * FROM q WHERE k < 50)"


@register("leak_free_rows", f"WITH {_TT} SELECT qid FROM te WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.uniprot = te.uniprot AND tr.species = te.species AND tr.template = te.template)")
def leak_free_rows(spark, sf):
    q = question_rows(spark, sf)
    return splits.without_leaks(q.where("k < 50"), q.where("k >= 50")).select("qid")


@register("disjointness_levels", f"""WITH {_TT}, a AS (SELECT 'protein' AS level, species || uniprot AS e FROM te UNION SELECT 'pair', species || uniprot || template FROM te),
  b AS (SELECT 'protein' AS level, species || uniprot AS e FROM tr UNION SELECT 'pair', species || uniprot || template FROM tr)
  SELECT level, count(*) AS n, count(b.e) AS n_shared, {S.fixed('count(b.e) / CAST(count(*) AS DOUBLE)')} AS rate FROM a LEFT JOIN b USING (level, e) GROUP BY level""")
def disjointness_levels(spark, sf):
    q = question_rows(spark, sf)
    return splits.overlap(q.where("k < 50"), q.where("k >= 50")).withColumn("rate", fixed(F.col("rate")))


_DOCS = "d AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS rk, count(*) OVER () AS n FROM documents), b AS (SELECT *, (5 * rk - 1) // n AS bucket FROM d), " \
    "p AS (SELECT *, rk - 1 - (n * bucket) // 5 AS place, (n * (bucket + 1)) // 5 - (n * bucket) // 5 AS bs FROM b)"


def _sized_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars"), F.floor(F.col("n_chars") / 64)


@register("sample_by_size", f"WITH {_DOCS} SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {H(chr(39)+'42'+chr(39), 'CAST(doc_id AS VARCHAR)')}, doc_id) AS r FROM p) WHERE n <= 123 OR r <= 24 + CASE WHEN bucket < 3 THEN 1 ELSE 0 END")
def sample_by_size(spark, sf):
    """123 documents over five size buckets."""
    docs, piece = _sized_docs(spark, sf)
    return splits.sample_by_size(docs, 123, "doc_id", "n_chars", piece).select("doc_id", "bucket")


@register("stride_by_size", f"WITH {_DOCS} SELECT doc_id, bucket FROM p WHERE n <= 100 OR (place % greatest(1, bs // 20) = 0 AND place // greatest(1, bs // 20) < 20)")
def stride_by_size(spark, sf):
    docs, piece = _sized_docs(spark, sf)
    return splits.stride_by_size(docs, 100, "doc_id", "n_chars", piece).select("doc_id", "bucket")


@register("head_per_family", f"WITH q AS ({QROWS}) SELECT qid FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {H(chr(39)+'0'+chr(39), 'qid')}, qid) AS r FROM q) WHERE r <= 50")
def head_per_family(spark, sf):
    return splits.head_per_group(question_rows(spark, sf), ["family"], 50).select("qid")


@register("replaced_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def replaced_ids(spark, sf):
    """(current - removed) + added over id lists."""
    c = table(spark, sf, "customer").withColumn("id", F.col("c_custkey"))
    current = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return splits.replaced_ids(current, c.where("c_acctbal < 0"), c.where("c_nationkey = 3"), "id")


@register("excluded_ids", "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def excluded_ids(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"))
    su = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return splits.excluded_ids([li, su], "id")


_DIGEST_LINE = "sha256('{' || " + " || ',' || ".join(
    f"""'"{c}":' || {'CAST(k AS VARCHAR)' if c == 'k' else f"""'"' || {c} || '"'"""}""" for c in ("answer_type", "family", "k", "qid", "species", "template", "uniprot")) + " || '}')"


@register("content_digest", f"""WITH q AS ({QROWS}), c AS (SELECT {H('qid')} % 4096 AS b, {_DIGEST_LINE} AS h FROM q),
  g AS (SELECT b, count(*) AS n, concat_ws(',', b, count(*), {", ".join(f"sum(('0x' || substr(h, {1 + 8 * n}, 8))::BIGINT)" for n in range(8))}) AS t FROM c GROUP BY b)
  SELECT sha256(string_agg(t, ';' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM g""")
def content_digest(spark, sf):
    return splits.digest(question_rows(spark, sf), "qid")


# --------------------------------------------------------------------- gates --

@register("release_gates", f"""WITH {_SPLIT}, r AS (SELECT 'schema' AS gate, count(*) AS n_issues FROM s UNION ALL
   SELECT 'protein_disjointness', count(*) FROM (SELECT uniprot FROM s WHERE split IN ('train', 'dev', 'test_iid') GROUP BY uniprot HAVING count(DISTINCT split) > 1) UNION ALL
   SELECT 'cross_species_pure', count(*) FROM s WHERE split = 'test_cross_species' AND species = 'human' UNION ALL
   SELECT 'hn_class_distribution', CASE WHEN avg(CASE WHEN hn_class = 'HN1' THEN 1.0 ELSE 0.0 END) < 0.5 THEN 1 ELSE 0 END FROM s WHERE split = 'test_hn')
  SELECT *, n_issues = 0 AS passed FROM r""")
def release_gates(spark, sf):
    """The derived rows lack program, params and other fields, which the
    schema gate reports for every row."""
    return gates.gate_table(_split_rows(spark, sf))


@register("missing_fields", f"WITH {_SPLIT} SELECT qid, ['question', 'program', 'answer', 'params', 'paraphrase_id'] AS missing FROM s")
def missing_fields(spark, sf):
    return gates.missing_fields(_split_rows(spark, sf)).select("qid", "missing")


@register("lexical_gate")
def lexical_gate(spark, sf):
    """Words alone against the quality label, on whole document texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("text").alias("question"), F.col("quality").cast("double").alias("label"),
        (hash_int(F.col("doc_id")) < int(0.8 * 2**32)).alias("in_train"),
    )
    return gates.lexical_gate(labelled.where("in_train"), labelled.where("not in_train"))


_SURF = f"SELECT doc_id, text AS question, {_pick(['A', 'B', 'C', 'D', 'E', 'F', 'G'], 'doc_id % 7')} AS family, doc_id % 50 AS a, n_chars % 7 AS b FROM documents"


@register("surface_check", f"""WITH s AS ({_SURF}) SELECT doc_id, list_sort(list_distinct(list_filter([a, b], lambda v: v >= 1 AND NOT list_contains(list_transform(regexp_extract_all(question, '\\d+'), lambda x: try_cast(x AS BIGINT)), v)))) AS missing_params,
  CASE family """ + " ".join(f"WHEN '{f}' THEN regexp_matches(lower(question), '{'|'.join(w)}')" + (" OR regexp_matches(question, '(^|[^\\p{L}\\p{N}_])SS($|[^\\p{L}\\p{N}_])')" if f == "E" else "") for f, w in gates.FAMILY_WORDS.items()) + " ELSE true END AS ok_keyword FROM s")
def surface_check(spark, sf):
    """Parameters and family words looked for in whole document texts."""
    rows = sql(spark, sf, _SURF, "documents").withColumn(
        "params", F.create_map(F.lit("a"), F.col("a").cast("double"), F.lit("b"), F.col("b").cast("double"), F.lit("c"), F.lit(0.5))
    )
    return gates.surface_check(rows).select("doc_id", "missing_params", "ok_keyword")


@register("most_missing_templates", f"""WITH s AS ({_SURF}), c AS (SELECT family, list_filter([a, b], lambda v: v >= 1 AND NOT list_contains(list_transform(regexp_extract_all(question, '\\d+'), lambda x: try_cast(x AS BIGINT)), v)) AS m FROM s)
  SELECT family AS template, count(*) AS n FROM c WHERE len(m) > 0 GROUP BY family""")
def most_missing_templates(spark, sf):
    """Report of the templates whose texts miss a number most often."""
    rows = sql(spark, sf, _SURF, "documents").withColumns({
        "params": F.create_map(F.lit("a"), F.col("a").cast("double"), F.lit("b"), F.col("b").cast("double")),
        "template": F.col("family"),
    })
    return gates.most_missing(gates.surface_check(rows).withColumn("ok_keyword", F.lit(True)))


@register("wording_leaks", "SELECT doc_id, doc_id % 3 = 0 AS leaks FROM documents")
def wording_leaks(spark, sf):
    """Texts that contain an operator call of their program are rejected."""
    docs = table(spark, sf, "documents")
    shown = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Mean_plddt(range"))).otherwise(F.col("text"))
    return docs.select("doc_id", shown.alias("q"), F.lit("A1").alias("template")).select("doc_id", gates.leaks_program(F.col("q")).alias("leaks"))


@register("wording_statistics", "SELECT role AS template, count(*) AS n, count(DISTINCT text) AS n_distinct FROM conversations GROUP BY role")
def wording_statistics(spark, sf):
    pool = table(spark, sf, "conversations").select(F.col("role").alias("template"), F.col("text").alias("wording"))
    return gates.wording_statistics(pool)


# ---------------------------------------------------------------- statistics --

@register("chain_statistics", EV + f"""SELECT species, count(*) FILTER (i = 1) AS n_chains, {S.fixed('avg(length) FILTER (i = 1)')} AS length_mean, {S.fixed('stddev_pop(length) FILTER (i = 1)')} AS length_std,
  min(length) AS length_min, max(length) AS length_max, {S.fixed('avg(CAST(plddt AS DOUBLE))')} AS plddt_mean, {S.fixed('avg(CASE WHEN CAST(plddt AS DOUBLE) < 50 THEN 1.0 ELSE 0.0 END)')} AS frac_lt_50,
  {S.fixed('avg(CASE WHEN CAST(plddt AS DOUBLE) >= 50 AND CAST(plddt AS DOUBLE) < 70 THEN 1.0 ELSE 0.0 END)')} AS frac_50_70, {S.fixed('avg(CASE WHEN CAST(plddt AS DOUBLE) >= 70 AND CAST(plddt AS DOUBLE) < 90 THEN 1.0 ELSE 0.0 END)')} AS frac_70_90,
  {S.fixed('avg(CASE WHEN CAST(plddt AS DOUBLE) >= 90 THEN 1.0 ELSE 0.0 END)')} AS frac_ge_90 FROM ev GROUP BY species""")
def chain_statistics(spark, sf):
    got = statistics.chain_statistics(event_chains(spark, sf))
    return got.withColumns({c: fixed(F.col(c)) for c in got.columns if c.startswith("frac") or c.endswith(("_mean", "_std"))})


@register("length_percentiles", EV + "SELECT species, " + ", ".join(
    f"{S.fixed(f'quantile_cont(CAST(length AS DOUBLE), {q})', 4)} AS p{int(q * 100)}" for q in (0.10, 0.25, 0.50, 0.75, 0.90)) + " FROM ev WHERE i = 1 GROUP BY species")
def length_percentiles(spark, sf):
    got = statistics.length_percentiles(event_lengths(spark, sf))
    return got.withColumns({c: fixed(F.col(c), 4) for c in got.columns if c.startswith("p")})


@register("score_median", EV + f"SELECT species, {S.fixed('quantile_cont(CAST(plddt AS DOUBLE), 0.5)', 4)} AS p50 FROM ev GROUP BY species")
def score_median(spark, sf):
    return statistics.score_median(event_scores(spark, sf)).withColumn("p50", fixed(F.col("p50"), 4))


@register("matrix_statistics", f"""WITH {S.VC_BASE}, {S.PAE}, c AS (SELECT species, uniprot, avg(v) AS m, avg(CASE WHEN v < 5 THEN 1.0 ELSE 0.0 END) AS lo, avg(CASE WHEN v > 15 THEN 1.0 ELSE 0.0 END) AS hi FROM pae WHERE j > i GROUP BY ALL)
  SELECT species, {S.fixed('avg(m)')} AS mean_upper, {S.fixed('avg(lo)')} AS frac_high_conf, {S.fixed('avg(hi)')} AS frac_low_conf FROM c GROUP BY species""")
def matrix_statistics(spark, sf):
    got = statistics.matrix_statistics(vector_matrix(spark, sf))
    return got.withColumns({c: fixed(F.col(c)) for c in got.columns if c != "species"})


@register("cross_check_scores", """SELECT event_type, count(*) AS n, count(*) FILTER (abs(value - round(value)) <= 0.05) AS n_match, """ + S.fixed("avg(abs(value - round(value)))") + """ AS mean_diff,
  """ + S.fixed("max(abs(value - round(value)))") + """ AS max_diff, 0 AS n_unpaired FROM events GROUP BY event_type""")
def cross_check_scores(spark, sf):
    """Two derivations of a score compared within a tolerance."""
    ev = table(spark, sf, "events")
    other = ev.select("event_id", "event_type", F.round("value").alias("value"))
    got = statistics.agreement(ev, other, ["event_id", "event_type"], "value", statistics.TOLERANCE["score"], ["event_type"])
    return got.withColumns({c: fixed(F.col(c)) for c in ("mean_diff", "max_diff")})


@register("cross_check_labels", f"SELECT event_type AS grp, count(*) AS n, {S.fixed('avg(CASE WHEN (value > 50) = (k > 50) THEN 1.0 ELSE 0.0 END)')} AS rate FROM ({_KTAB}) GROUP BY event_type")
def cross_check_labels(spark, sf):
    rows = sql(spark, sf, f"SELECT event_id, event_type AS grp, value > 50 AS a, k > 50 AS b FROM ({_KTAB})", "events")
    a, b = rows.withColumn("v", F.col("a")), rows.withColumn("v", F.col("b"))
    return statistics.label_agreement(a, b, ["event_id", "grp"], "v", ["grp"]).withColumn("rate", fixed(F.col("rate")))


# --------------------------------------------------------------------- texts --

@register("chain_bands", EV + """, k AS (SELECT species, uniprot, length, unnest(range(0, least(length, 80))) AS k FROM ev WHERE i = 1),
  s AS (SELECT *, 1 + CASE WHEN length <= 80 THEN k WHEN k = 79 THEN length - 1 ELSE CAST(floor(k * ((length - 1) / CAST(79 AS DOUBLE))) AS BIGINT) END AS i FROM k)
  SELECT s.species, s.uniprot, string_agg(CASE WHEN plddt >= 90 THEN '#' WHEN plddt >= 70 THEN '+' WHEN plddt >= 50 THEN '.' ELSE '?' END, '' ORDER BY k) AS plddt_band, string_agg(ss, '' ORDER BY k) AS ss_band
  FROM s JOIN ev e ON e.species = s.species AND e.uniprot = s.uniprot AND e.i = s.i GROUP BY s.species, s.uniprot""")
def chain_bands(spark, sf):
    return prompts.bands(event_chains(spark, sf)).drop("band_min", "band_max")


_BAND = prompts.BAND
_SUMMARY = f"""b AS (SELECT c.species, c.uniprot, k, CASE WHEN length <= {_BAND} THEN k + 1 WHEN k = {_BAND - 1} THEN length
      ELSE CAST(floor(k * ((length - 1) / {_BAND - 1}.0)) AS BIGINT) + 1 END AS i FROM (SELECT species, uniprot, length, unnest(range(0, least(length, {_BAND}))) AS k FROM ev WHERE i = 1) c),
  bands AS (SELECT b.species, b.uniprot, string_agg(CASE WHEN plddt >= 90 THEN '#' WHEN plddt >= 70 THEN '+' WHEN plddt >= 50 THEN '.' ELSE '?' END, '' ORDER BY k) AS pb,
      string_agg(ss, '' ORDER BY k) AS sb, min(CAST(plddt AS DOUBLE)) AS lo, max(CAST(plddt AS DOUBLE)) AS hi FROM b JOIN ev USING (species, uniprot, i) GROUP BY ALL),
  w AS (SELECT species, uniprot, max(length) AS length, avg(CAST(plddt AS DOUBLE)) AS mean FROM ev GROUP BY ALL),
  rr AS (SELECT species, uniprot, count(*) FILTER (ss = 'H') AS nh, count(*) FILTER (ss = 'E') AS ne FROM (SELECT *, lag(ss) OVER (PARTITION BY species, uniprot ORDER BY i) AS p FROM ev)
    WHERE p IS NULL OR p <> ss GROUP BY ALL)"""


@register("chain_summary_texts", EV + f""", {_SUMMARY} SELECT species, uniprot,
  printf('Protein: %s (%s)' || chr(10) || '  Length: %d residues' || chr(10) || '  Mean pLDDT: %.1f' || chr(10) || '  Helix runs: %d, strand runs: %d' || chr(10)
    || '  pLDDT band ({_BAND} bins, range %.0f-%.0f): %s' || chr(10) || '  SS band:   %s' || chr(10), uniprot, species, length, mean, nh, ne, lo, hi, pb, sb) || '{prompts.LEGEND.replace("'", "''").rstrip()}' || chr(10) AS summary
  FROM w JOIN rr USING (species, uniprot) JOIN bands USING (species, uniprot)""")
def chain_summary_texts(spark, sf):
    return prompts.chain_summaries(event_chains(spark, sf))


def _tier_sql(k: int, group: str, avoid: str) -> str:
    """Ranks, gaps and picks of one tier; ``w{k-1}`` has the targets with how many examples they took."""
    he, hq = H("'ex/0'", avoid), H("'ex/0'", "qid")
    start = H(f"'ex/0/{k}'", "target")
    return f"""
  r{k} AS (SELECT {group} AS g, {avoid} AS a, qid, row_number() OVER (PARTITION BY {group} ORDER BY {he}, {avoid}, {hq}, qid) AS rk FROM train),
  n{k} AS (SELECT g, count(*) AS n FROM r{k} GROUP BY g), g{k} AS (SELECT g, a, min(rk) AS f, count(*) AS c FROM r{k} GROUP BY g, a),
  a{k} AS (SELECT w.*, w.{group} AS grp, coalesce(f, 0) AS f, coalesce(c, 0) AS c, coalesce(n, 0) - coalesce(c, 0) AS free
    FROM w{k - 1} w LEFT JOIN n{k} ON n{k}.g = w.{group} LEFT JOIN g{k} ON g{k}.g = w.{group} AND g{k}.a = w.{avoid}),
  t{k} AS (SELECT *, greatest(least(4 - taken, free), 0) AS take, {start} % greatest(free, 1) AS st FROM a{k}),
  w{k} AS (SELECT target, uniprot, family, template, al, taken + take AS taken FROM t{k}),
  p{k} AS (SELECT target, taken + o + 1 AS place, grp, CASE WHEN c = 0 OR (st + o) % free < f - 1 THEN (st + o) % free + 1 ELSE (st + o) % free + 1 + c END AS rk
    FROM (SELECT *, unnest(range(0, take)) AS o FROM t{k} WHERE take > 0)),
  e{k} AS (SELECT target, place, r{k}.qid AS exemplar, {k} AS tier FROM p{k} JOIN r{k} ON r{k}.g = p{k}.grp AND r{k}.rk = p{k}.rk)"""


_POOL = f"q AS ({QROWS}), train AS (SELECT qid, uniprot, family, template, 1 AS al FROM q WHERE k >= 50)"
_TIERS = ",".join(_tier_sql(k, *t) for k, t in enumerate([("template", "uniprot"), ("family", "template"), ("al", "family")], 1))


@register("exemplar_choice", f"""WITH {_POOL}, w0 AS (SELECT qid AS target, uniprot, family, template, 1 AS al, 0 AS taken FROM q WHERE k < 50), {_TIERS}
  SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3""")
def exemplar_choice(spark, sf):
    """Four examples per held-out question, by tier."""
    q = question_rows(spark, sf)
    return prompts.pick_exemplars(q.where("k >= 50"), q.where("k < 50"), 4)


@register("exemplars_across_families", f"""WITH {_POOL}, w AS (SELECT qid AS target, template AS own FROM q WHERE k < 50),
  r AS (SELECT family, template, qid, row_number() OVER (PARTITION BY family ORDER BY {H("'across/0'", "template")}, template, {H("'across/0'", "qid")}, qid) AS rk FROM train),
  n AS (SELECT family, count(*) AS n FROM r GROUP BY family), g AS (SELECT family, template, min(rk) AS f, count(*) AS c FROM r GROUP BY family, template),
  a AS (SELECT target, n.family, coalesce(f, 0) AS f, coalesce(c, 0) AS c, n - coalesce(c, 0) AS free FROM w CROSS JOIN n LEFT JOIN g ON g.family = n.family AND g.template = w.own),
  t AS (SELECT *, {H("'across/0'", "target", "family")} % free AS st, unnest(range(0, least(free, 5))) AS o FROM a WHERE free > 0),
  p AS (SELECT *, CASE WHEN c = 0 OR (st + o) % free < f - 1 THEN (st + o) % free + 1 ELSE (st + o) % free + 1 + c END AS rk, row_number() OVER (PARTITION BY target ORDER BY o, family) AS place FROM t)
  SELECT target, place, qid AS exemplar FROM p JOIN r USING (family, rk) WHERE place <= 5""")
def exemplars_across_families(spark, sf):
    """Five examples per held-out question from five families, none of its template."""
    q = question_rows(spark, sf)
    return prompts.pick_across_families(q.where("k >= 50"), q.where("k < 50"), 5)


@register("prompt_texts")
def prompt_texts(spark, sf):
    ev = event_chains(spark, sf)
    q = generate.with_texts(questions_for("A4", event_lengths(spark, sf), 2)).withColumns(
        {"family": F.lit("A"), "answer": F.lit("1")}
    )
    q = cut_lineage(q)
    examples = prompts.few_shot_block(prompts.pick_exemplars(q, q, 2), q)
    return prompts.prompts(q, prompts.chain_summaries(ev), examples, "program", budget=4000)


@register("tool_inspect_residue", EV + """SELECT species || '/' || uniprot AS rid, printf('residue %d: pLDDT=%.2f, SS=%s, rel_sasa=%.3f, aa=%s', i, CAST(plddt AS DOUBLE), ss, CAST(rel_sasa AS DOUBLE), aa) AS observation FROM ev WHERE i = 7""")
def tool_inspect_residue(spark, sf):
    ev = event_chains(spark, sf)
    asked = event_lengths(spark, sf).select(F.concat_ws("/", *KEY).alias("rid"), *KEY, F.lit(7).cast("long").alias("i"))
    return prompts.inspect_residues(asked, ev)


@register("tool_distance", EV + f"""SELECT a.species || '/' || a.uniprot AS rid, CASE WHEN b.i IS NULL THEN 'tool error: residue index out of range' ELSE printf('CA-CA distance between residues %d and %d = %.2f A', a.i, b.i, {S.dist()}) END AS observation
  FROM ev a LEFT JOIN ev b ON a.species = b.species AND a.uniprot = b.uniprot AND b.i = 60 WHERE a.i = 7""")
def tool_distance(spark, sf):
    ev = event_chains(spark, sf)
    asked = event_lengths(spark, sf).select(F.concat_ws("/", *KEY).alias("rid"), *KEY, F.lit(7).cast("long").alias("i"), F.lit(60).cast("long").alias("j"))
    return prompts.measure_distances(asked, ev)


_LABELS = ", ".join(f"count(*) FILTER (i BETWEEN 5 AND 30 AND ss = '{v}')" for v in "HEC")
_IN = "FILTER (i BETWEEN 5 AND 30)"
_STATS = ", ".join(f"{fn}(CAST({c} AS DOUBLE)) {_IN}" for fn, c in (("avg", "plddt"), ("min", "plddt"), ("max", "plddt"), ("stddev_pop", "plddt"), ("avg", "rel_sasa")))


@register("tool_region_stats", EV + f"""SELECT species || '/' || uniprot AS qid, CASE WHEN any_value(length) < 30 THEN 'tool error: region out of range' ELSE
  printf('region [%d,%d]: mean_plddt=%.2f, min_plddt=%.2f, max_plddt=%.2f, std_plddt=%.2f, mean_rel_sasa=%.3f, n_helix_residues=%d, n_strand_residues=%d, n_coil_residues=%d, length=%d, radius_of_gyration=%.2f',
    5, 30, {_STATS}, {_LABELS}, 26, sqrt({" + ".join(f"var_pop(CAST({c} AS DOUBLE)) {_IN}" for c in "xyz")})) END AS observation FROM ev GROUP BY species, uniprot""")
def tool_region_stats(spark, sf):
    ev = event_chains(spark, sf)
    asked = event_lengths(spark, sf).select(F.concat_ws("/", *KEY).alias("qid"), *KEY, "length", F.lit(5).alias("start"), F.lit(30).alias("end"))
    return prompts.region_observations(regions.region_values(asked, ev, prompts.region_tool_metrics()))


@register("tool_block_mean", f"""WITH {S.VC_BASE}, {S.PAE} SELECT species || '/' || uniprot AS qid, printf('mean PAE([%d,%d] vs [%d,%d]) = %.2f', 1, 7, 11, 23, avg(v)) AS observation FROM pae WHERE i BETWEEN 1 AND 7 AND j BETWEEN 11 AND 23 GROUP BY ALL""")
def tool_block_mean(spark, sf):
    pae = vector_matrix(spark, sf)
    asked = pae.where("i = 1").select(F.concat_ws("/", *KEY).alias("qid"), *KEY, "length", *[F.lit(v).alias(n) for n, v in (("a_start", 1), ("a_end", 7), ("b_start", 11), ("b_end", 23))])
    return prompts.block_observation(block_values(asked, pae))
