"""The question templates as registered queries: two parameter draws per
chain and template, answered by the template's batch plan, and SQL that draws
the same parameters and computes each answer the direct way."""

from pyspark.sql import functions as F

from ..operators.pairs import neighbor_counts
from ..plans.templates import SET_TYPES, TEMPLATES, ChainSet, answer_template, questions_for
from ..session import cut_lineage
from ..sources.bindings import event_chains, event_lengths, vector_chains, vector_lengths, vector_matrix
from . import sql as S

SLOTS = 2
STORED_NEIGHBOURS = ("D4", "D5")
# Their plans read the residues four times (scores, both sides of the contact
# join, window starts); numbering the events once is cheaper.
READ_OFTEN = ("F2", "G2")


def fixed(col, digits: int = 6):
    p = float(10**digits)
    return F.floor(col * p + 0.5) / p


def chain_set(spark, sf_dir, template: str) -> ChainSet:
    if TEMPLATES[template].needs_matrix:
        return ChainSet(
            vector_chains(spark, sf_dir), vector_matrix(spark, sf_dir), vector_lengths(spark, sf_dir)
        )
    residues = event_chains(spark, sf_dir)
    if template in READ_OFTEN:
        residues = cut_lineage(residues)
    if template in STORED_NEIGHBOURS:
        residues = neighbor_counts(residues)
    return ChainSet(residues, lengths=event_lengths(spark, sf_dir))


def _query(template: str, gold: bool):
    kind = TEMPLATES[template].answer_type

    def run(spark, sf_dir):
        c = chain_set(spark, sf_dir, template)
        q = questions_for(template, c.chains(), SLOTS)
        got = answer_template(template, q, c, gold, drawn=True)
        if kind in SET_TYPES:
            return got
        if kind.startswith("Region"):
            return got.select("qid", "r_start", "r_end")
        column = {"Bool": "b", "Int": "n", "Float": "f", "SecStruct": "s"}[kind.split("|")[0]]
        value = fixed(F.col("f")) if column == "f" else F.col(column)
        if kind.endswith("Unreliable"):
            return got.select("qid", F.col("s").alias("abstained"), value.alias("answer"), "err")
        return got.select("qid", value.alias("answer"))

    return run


_REGION = {
    "size": "20 + d0 % greatest(least(80, length - 1) - 19, 1)",
    "s": "1 + d1 % greatest(length - size, 1)",
    "e": "s + size - 1",
}
_BLOCKS = {
    "top": "least(60, greatest(15, length // 3), (length - 11) // 2)",
    "asz": "15 + d0 % greatest(top - 14, 1)",
    "a0": "1 + d1 % greatest(length - 2 * asz - 10, 1)",
    "a1": "a0 + asz - 1",
    "b0": "a1 + 11",
    "b1": "b0 + 14 + d2 % greatest(least(60, length - b0 + 1) - 14, 1)",
}
_IN_BLOCK = "pae p JOIN q ON p.species = q.species AND p.uniprot = q.uniprot AND p.i BETWEEN a0 AND a1 AND p.j BETWEEN b0 AND b1"


def _pair(sep):
    return {
        "i": "1 + d0 % length",
        "lft": f"greatest(i - {sep}, 0)",
        "rgt": f"greatest(length - i - {sep} + 1, 0)",
        "k": "d1 % greatest(lft + rgt, 1)",
        "j": f"CASE WHEN k < lft THEN k + 1 ELSE i + {sep} + k - lft END",
    }


_SEP = {"sep": S.choice("d0", [20, 30, 50]), "t": S.choice("d1", [6, 8, 10])}
_SEP_OK = "length >= 50 AND sep < length - 5"
_KEYS = "USING (species, uniprot)"
_WIN = """wins AS (
  SELECT r.species, r.uniprot, q.qid, r.i AS s, r.i + CAST(q.w AS BIGINT) - 1 AS e, {value} AS v
  FROM q JOIN ev r ON q.species = r.species AND q.uniprot = r.uniprot
  JOIN ev m ON m.species = r.species AND m.uniprot = r.uniprot AND m.i BETWEEN r.i AND r.i + q.w - 1
  WHERE r.i + q.w - 1 <= r.length GROUP BY ALL)"""
_PLDDT = "avg(CAST(m.plddt AS DOUBLE))"
_RG = "sqrt(var_pop(CAST(m.x AS DOUBLE)) + var_pop(CAST(m.y AS DOUBLE)) + var_pop(CAST(m.z AS DOUBLE)))"


def _at(column, j="i"):
    return f"(SELECT max({column}) FROM ev r WHERE r.species = q.species AND r.uniprot = q.uniprot AND r.i = q.{j})"


def _two(select, extra=""):
    return (
        f"SELECT qid, {select} FROM q JOIN ev a ON a.species = q.species AND a.uniprot = q.uniprot AND a.i = q.i"
        f" JOIN ev b ON b.species = q.species AND b.uniprot = q.uniprot AND b.i = q.j{extra}"
    )


def _q(template, chain, params, valid="true", draws=0):
    return S.questions(template, chain, params, valid, draws, SLOTS)


def _over_chain(select):
    return f"SELECT qid, {select} FROM q LEFT JOIN ev r {_KEYS} GROUP BY qid"


_LOW = "sum(CASE WHEN CAST(plddt AS DOUBLE) < pt THEN 1 ELSE 0 END) * 100 / CAST(any_value(q.length) AS DOUBLE) > any_value(cov)"
_POOR = f"poor AS (SELECT qid, {_LOW} AS poor FROM q JOIN ev r {_KEYS} GROUP BY qid)"
_GAP = f"""gaps AS (SELECT a.species, a.uniprot, min({S.dist()}) AS gap FROM ev a JOIN ev b
  ON a.species = b.species AND a.uniprot = b.uniprot AND a.ss = 'H' AND b.ss = 'E' GROUP BY ALL)"""
_ABSTAIN = "CASE WHEN {poor} THEN 'Unreliable' END AS abstained, CASE WHEN NOT ({poor}) THEN {value} END AS answer, CAST(NULL AS VARCHAR) AS err"


def _dense(extra_params, level, template):
    q = _q(template, "ev", extra_params, "w < length", 3 if "pt" in extra_params else 2)
    win = _WIN.format(value=_PLDDT)
    return f"""WITH {S.EV}, {q}, {win}, {S.edges('ev')},
    dens AS (SELECT wins.qid, wins.s, wins.v, q.cd,
        (SELECT count(*) FROM edges g WHERE g.species = wins.species AND g.uniprot = wins.uniprot
          AND g.d <= 8.0 AND g.i >= wins.s AND g.j <= wins.e) / (q.w * (q.w - 1) / 2) AS dn, {level} AS lv
      FROM wins JOIN q USING (qid))
    SELECT qid, coalesce(bool_or(v > lv AND dn > cd), false) AS answer FROM dens GROUP BY qid"""


def _oracles() -> dict[str, str]:
    o = {}
    ev = f"WITH {S.EV}, "

    def w_(sizes, **k):
        return {"w": S.choice("d0", sizes), **k}

    o["A1"] = ev + _q("A1", "ev", _REGION, "length >= 30", 2) + f"""
      SELECT qid, {S.fixed('avg(CAST(plddt AS DOUBLE))')} AS answer FROM q JOIN ev r {_KEYS} WHERE r.i BETWEEN s AND e GROUP BY qid"""
    o["A2"] = ev + _q("A2", "ev", {**w_([15, 20, 25, 30]), "nf": "d1 % 2"}, "length >= 60", 2) + f"""
      , m AS (SELECT qid, any_value(nf) AS nf, avg(CAST(plddt AS DOUBLE)) FILTER (r.i <= w) AS a,
        avg(CAST(plddt AS DOUBLE)) FILTER (r.i > r.length - w) AS b FROM q JOIN ev r {_KEYS} GROUP BY qid)
      SELECT qid, CASE WHEN nf = 1 THEN a < b ELSE b < a END AS answer FROM m"""
    for name, value, order, sizes in (
        ("A3", _PLDDT, "v", [20, 30, 40, 50]),
        ("D2", "avg(CAST(m.rel_sasa AS DOUBLE))", "v DESC", [15, 20, 30]),
        ("F4", _RG, "v", [20, 30, 40]),
    ):
        o[name] = ev + _q(name, "ev", w_(sizes), "w < length", 1) + ", " + _WIN.format(value=value) + f"""
          SELECT qid, s AS r_start, e AS r_end FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, s) AS rn FROM wins) WHERE rn = 1"""
    o["A4"] = ev + _q("A4", "ev", {"t": S.choice("d0", [50, 70, 80, 90])}, "true", 1) + _over_chain(
        "count(*) FILTER (CAST(plddt AS DOUBLE) > t) AS answer")
    o["A5"] = ev + _q("A5", "ev", {**w_([20, 30, 50]), "t": S.choice("d1", [70, 80, 90])}, "w < length", 2) + \
        ", " + _WIN.format(value=_PLDDT) + """
      SELECT q.qid, coalesce(bool_or(v > t), false) AS answer FROM q LEFT JOIN wins USING (qid) GROUP BY q.qid"""
    o["B1"] = ev + _q("B1", "ev", _pair(2), "length >= 4 AND lft + rgt > 0", 2) + _two(f"{S.fixed(S.dist())} AS answer")
    o["B2"] = ev + _q("B2", "ev", {**_pair(4), "t": S.choice("d2", [6, 8, 10, 12])},
                      "length >= 6 AND lft + rgt > 0", 3) + _two(f"{S.dist()} < t AS answer")
    close = f"edges g ON g.species = q.species AND g.uniprot = q.uniprot AND g.j - g.i >= sep AND g.d < t"
    o["B3"] = ev + S.edges("ev") + ", " + _q("B3", "ev", _SEP, _SEP_OK, 2) + f"SELECT qid, g.i, g.j FROM q JOIN {close}"
    o["B4"] = ev + S.edges("ev") + ", " + _q("B4", "ev", _SEP, _SEP_OK, 2) + \
        f"SELECT qid, count(g.i) AS answer FROM q LEFT JOIN {close} GROUP BY qid"
    vc = f"WITH {S.VC}, {S.PAE}, "
    for name, select, values in (
        ("C1", S.fixed("avg(v)"), None), ("C2", "avg(v) < any_value(t)", [5, 8, 12]),
        ("C3", S.fixed("CAST(max(v) AS DOUBLE)"), None), ("C4", "count(*) FILTER (v > t)", [5, 8, 12, 15]),
    ):
        params = dict(_BLOCKS) if values is None else {**_BLOCKS, "t": S.choice("d3", values)}
        o[name] = vc + _q(name, "vc", params, "length >= 41", 3 if values is None else 4) + \
            f"SELECT qid, {select} AS answer FROM {_IN_BLOCK} GROUP BY qid"
    i0 = {"i": "1 + d0 % length"}
    o["D1"] = ev + _q("D1", "ev", {**i0, "t": S.choice("d1", [0.10, 0.15, 0.20])}, "true", 2) + \
        f"SELECT qid, {_at('CAST(rel_sasa AS DOUBLE)')} < t AS answer FROM q"
    o["D3"] = ev + _q("D3", "ev", {"t": S.choice("d0", [0.10, 0.15, 0.20])}, "true", 1) + _over_chain(
        "count(*) FILTER (CAST(rel_sasa AS DOUBLE) < t) AS answer")
    nb = ev + S.neighbours("ev") + ", "
    o["D4"] = nb + _q("D4", "ev", i0, "true", 1) + f"SELECT qid, n_neigh AS answer FROM q JOIN nb USING (species, uniprot, i)"
    o["D5"] = nb + _q("D5", "ev", {**i0, "t": S.choice("d1", [8, 12, 16])}, "true", 2) + \
        "SELECT qid, n_neigh > t AS answer FROM q JOIN nb USING (species, uniprot, i)"
    o["E1"] = ev + _q("E1", "ev", i0, "true", 1) + f"SELECT qid, {_at('ss')} AS answer FROM q"
    o["E2"] = ev + _q("E2", "ev", i0, "true", 1) + f"SELECT qid, {_at('ss')} = 'H' AS answer FROM q"
    for name, label in (("E3", "H"), ("E4", "E")):
        o[name] = ev + _q(name, "ev", {}) + _over_chain(f"count(*) FILTER (ss = '{label}') AS answer")
    runs = f"""rr AS (SELECT species, uniprot, min(i) AS s, max(i) AS e FROM (
        SELECT *, i - row_number() OVER (PARTITION BY species, uniprot, ss ORDER BY i) AS g FROM ev)
      WHERE ss = 'H' GROUP BY species, uniprot, ss, g)"""
    o["E5"] = ev + runs + ", " + _q("E5", "ev", {}) + f"SELECT qid, max(e - s + 1) AS answer FROM q LEFT JOIN rr {_KEYS} GROUP BY qid"
    o["E6"] = ev + runs + ", " + _q("E6", "ev", {}) + f"SELECT qid, count(s) AS answer FROM q LEFT JOIN rr {_KEYS} GROUP BY qid"
    o["F1"] = ev + S.edges("ev") + ", " + _q("F1", "ev", _REGION, "length >= 30", 2) + f"""
      SELECT qid, {S.fixed('count(g.i) / (any_value(size) * (any_value(size) - 1) / 2)')} AS answer
      FROM q LEFT JOIN edges g ON g.species = q.species AND g.uniprot = q.uniprot AND g.d <= 8.0 AND g.i >= s AND g.j <= e
      GROUP BY qid"""
    o["F2"] = _dense(w_([20, 30, 40], cd=S.choice("d1", [0.20, 0.30, 0.40])), "80", "F2")
    o["F3"] = ev + _q("F3", "ev", _REGION, "length >= 30", 2) + f"""
      SELECT qid, {S.fixed(_RG.replace('m.', 'r.'))} AS answer FROM q JOIN ev r {_KEYS} WHERE r.i BETWEEN s AND e GROUP BY qid"""
    o["G1"] = ev + _q("G1", "ev", {"a": S.choice("d0", [0.10, 0.15, 0.20]), "t": S.choice("d1", [60, 70, 80])}, "true", 2) + f"""
      SELECT qid, r.i FROM q JOIN ev r {_KEYS} WHERE CAST(rel_sasa AS DOUBLE) < a AND CAST(plddt AS DOUBLE) < t"""
    o["G2"] = _dense(w_([20, 30, 40], pt=S.choice("d1", [70, 80]), cd=S.choice("d2", [0.20, 0.30])), "q.pt", "G2")
    o["G3"] = ev + _GAP + ", " + _q("G3", "ev", {"t": S.choice("d0", [6, 8, 10])}, "true", 1) + \
        f"SELECT qid, coalesce(gap < t, false) AS answer FROM q LEFT JOIN gaps {_KEYS}"

    for v in ("Ha", "Hb"):
        o[v + "1"] = ev + _q(v + "1", "ev", {**_pair(4), "t": S.choice("d2", [50, 60, 70])},
                             "length >= 20 AND lft + rgt > 0", 3) + _two(_ABSTAIN.format(
            poor="CAST(a.plddt AS DOUBLE) < t OR CAST(b.plddt AS DOUBLE) < t", value=S.fixed(S.dist())))
        o[v + "2"] = vc + _q(v + "2", "vc", {**_BLOCKS, "t": S.choice("d3", [15, 20, 25])}, "length >= 41", 4) + f""",
          m AS (SELECT qid, avg(v) AS mean, any_value(t) AS t FROM {_IN_BLOCK} GROUP BY qid)
          SELECT qid, {_ABSTAIN.format(poor='mean > t', value=S.fixed('mean'))} FROM m"""
        o[v + "3"] = ev + _q(v + "3", "ev", {
            "i": "6 + d0 % greatest(length - 10, 1)", "a": S.choice("d1", [0.10, 0.15, 0.20]),
            "t": S.choice("d2", [50, 60, 70])}, "length >= 12", 3) + f""",
          m AS (SELECT qid, avg(CAST(plddt AS DOUBLE)) AS mean, any_value(t) AS t, any_value(a) AS a,
            max(CASE WHEN r.i = q.i THEN CAST(rel_sasa AS DOUBLE) END) AS sa
            FROM q JOIN ev r {_KEYS} WHERE r.i BETWEEN q.i - 5 AND q.i + 5 GROUP BY qid)
          SELECT qid, {_ABSTAIN.format(poor='mean < t', value='sa < a')} FROM m"""
        rule = "g.j - g.i > sep AND g.d <= t" if v == "Ha" else "g.j - g.i >= sep AND g.d < t"
        o[v + "4"] = ev + S.edges("ev") + ", " + _q(v + "4", "ev", {
            **_SEP, "pt": S.choice("d2", [50, 60]), "cov": S.choice("d3", [20, 30, 40])}, _SEP_OK, 4) + f""",
          {_POOR}, n AS (SELECT qid, count(g.i) AS n FROM q LEFT JOIN edges g ON g.species = q.species
            AND g.uniprot = q.uniprot AND {rule} GROUP BY qid)
          SELECT qid, {_ABSTAIN.format(poor='poor', value='n')} FROM poor JOIN n USING (qid)"""
        o[v + "5"] = ev + _GAP + ", " + _q(v + "5", "ev", {
            "t": S.choice("d0", [6, 8, 10]), "pt": S.choice("d1", [50, 60]),
            "cov": S.choice("d2", [20, 30, 40])}, "length >= 50", 3) + f""",
          {_POOR}, n AS (SELECT qid, coalesce(gap < t, false) AS near FROM q LEFT JOIN gaps {_KEYS})
          SELECT qid, {_ABSTAIN.format(poor='poor', value='near')} FROM poor JOIN n USING (qid)"""
    return o


def _name(template: str) -> str:
    if template.startswith("Hb"):
        return f"template_{template.lower()}_program"
    return f"template_{template.lower()}"


# Ha plans give the reference answer, Hb plans follow the program text.
QUERIES = {_name(t): _query(t, gold=not t.startswith("Hb")) for t in TEMPLATES}
ORACLES = {_name(t): text for t, text in _oracles().items()}
