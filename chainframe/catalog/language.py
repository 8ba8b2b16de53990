"""Operators of the query language, one registered query each, over whole
tables: domains, quantifiers, per-position, pair and region values, runs,
sets, arithmetic."""

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import matrix, pairs, quantify, regions, runs, sets, windows
from ..operators.ranking import number_rows
from ..schema import KEY
from ..sources.bindings import event_chains, event_lengths, table, vector_chains, vector_matrix
from . import sql as S
from .workload import fixed

QUERIES, ORACLES = {}, {}
EV, VC = f"WITH {S.EV} ", f"WITH {S.VC} "
K = "species, uniprot"
D = "CAST({} AS DOUBLE)".format


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _chains(residues):
    return residues.where("i = 1").select(*KEY, "length")


# ------------------------------------------------------------ per position --

@register("residue_features", EV + f"SELECT {K}, i, aa, ss, {D('plddt')} AS plddt, {D('sasa')} AS sasa, {D('rel_sasa')} AS rel_sasa FROM ev")
def residue_features(spark, sf):
    """plddt, ref_aa, ss, sasa, rel_sasa of every residue."""
    ev = event_chains(spark, sf)
    return ev.select(*KEY, "i", "aa", "ss", *[F.col(c).cast("double").alias(c) for c in ("plddt", "sasa", "rel_sasa")])


@register("residue_coordinates", EV + f"SELECT {K}, i, {D('x')} AS x, {D('y')} AS y, {D('z')} AS z FROM ev")
def residue_coordinates(spark, sf):
    return event_chains(spark, sf).select(*KEY, "i", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@register("neighbors_stored_radius", EV + ", " + S.neighbours("ev") + f" SELECT {K}, i, n_neigh FROM nb")
def neighbors_stored_radius(spark, sf):
    return pairs.neighbor_counts(event_chains(spark, sf)).select(*KEY, "i", "n_neigh")


@register("neighbors_radius_5", VC + ", " + S.neighbours("vc", 5.0) + f" SELECT {K}, i, n_neigh FROM nb")
def neighbors_radius_5(spark, sf):
    return pairs.neighbor_counts(vector_chains(spark, sf), 5.0).select(*KEY, "i", "n_neigh")


@register("densified_positions", f"""{EV}, g AS (SELECT *, i * 2 - 1 AS pos FROM ev),
  full_ AS (SELECT species, uniprot, unnest(range(1, max(pos) + 1)) AS i FROM g GROUP BY {K})
  SELECT f.species, f.uniprot, f.i, coalesce(g.aa, 'X') AS aa, coalesce(g.ss, 'C') AS ss, coalesce({D('g.plddt')}, 0) AS plddt
  FROM full_ f LEFT JOIN g ON g.species = f.species AND g.uniprot = f.uniprot AND g.pos = f.i""")
def densified_positions(spark, sf):
    """Missing positions are filled; here every second position is missing."""
    from ..sources.features import densify

    sparse = event_chains(spark, sf).withColumn("i", F.col("i") * 2 - 1).drop("length")
    return densify(sparse).select(*KEY, "i", "aa", "ss", F.col("plddt").cast("double").alias("plddt"))


# ----------------------------------------------------------------- domains --

@register("domain_regions", EV + f"""SELECT {K},
  count(*) FILTER (i BETWEEN 5 AND 20) AS n_range, sum(i) FILTER (i <= 12) AS s_first,
  sum(i) FILTER (i > length - 12) AS s_last, sum(i) FILTER (i BETWEEN 30 AND 44) AS s_window
  FROM ev GROUP BY {K}""")
def domain_regions(spark, sf):
    """range(5, 20), first(12), last(12) and window(30, 15) as position sets."""
    ev = event_chains(spark, sf)
    inside = {
        "s_first": regions.first_n(12), "s_last": regions.last_n(12), "s_window": regions.window_of(30, 15),
    }
    return ev.groupBy(*KEY).agg(
        F.count_if(F.col("i").between(5, 20)).alias("n_range"),
        *[F.sum(F.when(F.col("i").between(a, b), F.col("i"))).alias(n) for n, (a, b) in inside.items()],
    )


@register("domain_sliding_window_step", EV + f"""SELECT {K}, i AS start, i + 14 AS "end" FROM ev
  WHERE i <= length - 14 AND (i - 1) % 4 = 0""")
def domain_sliding_window_step(spark, sf):
    got = windows.sliding_windows(event_chains(spark, sf), [15], {"v": windows.mean("plddt")}, step=4)
    return got.select(*KEY, "start", "end")


@register("domain_all_pairs_size", EV + f"""SELECT {K}, (SELECT count(*) FROM ev b WHERE b.species = a.species
  AND b.uniprot = a.uniprot AND b.i >= a.i + 7) AS later FROM ev a""".replace("SELECT species, uniprot, (", "SELECT species, uniprot, CAST(sum(n) AS BIGINT) AS n_pairs FROM (SELECT a.species, a.uniprot, (").replace("AS later FROM ev a", "AS n FROM ev a) GROUP BY species, uniprot"))
def domain_all_pairs_size(spark, sf):
    """size(all_pairs(min_sep=7)) is a formula of the length."""
    return event_lengths(spark, sf).select(
        *KEY, pairs.pair_domain_size(F.col("length"), 7).alias("n_pairs")
    )


@register("domain_region_is_endpoints", EV + f"SELECT {K}, count(*) FILTER (i IN (10, 20) AND {D('plddt')} > 30) AS endpoints, "
          f"count(*) FILTER (i BETWEEN 10 AND 20 AND {D('plddt')} > 30) AS interval FROM ev GROUP BY {K}")
def domain_region_is_endpoints(spark, sf):
    """count r in range(10, 20) visits the endpoints; to_set() visits all."""
    ev = event_chains(spark, sf)
    ends = sets.region_endpoints(F.lit(10).cast("long"), F.lit(20).cast("long"))
    full = sets.region_positions(F.lit(10).cast("long"), F.lit(20).cast("long"))
    good = F.col("plddt").cast("double") > 30
    return ev.groupBy(*KEY).agg(
        F.count_if(F.array_contains(ends, F.col("i")) & good).alias("endpoints"),
        F.count_if(F.array_contains(full, F.col("i")) & good).alias("interval"),
    )


# ------------------------------------------------------------- quantifiers --

@register("quantifier_exists", EV + f"SELECT {K}, bool_or({D('plddt')} > 99 AND ss = 'C') AS answer FROM ev GROUP BY {K}")
def quantifier_exists(spark, sf):
    ev = event_chains(spark, sf)
    return quantify.exists(ev, (F.col("plddt").cast("double") > 99) & (F.col("ss") == "C"), event_lengths(spark, sf))


@register("quantifier_forall", EV + f"SELECT {K}, bool_and({D('plddt')} > 2 OR ss = 'H') AS answer FROM ev GROUP BY {K}")
def quantifier_forall(spark, sf):
    ev = event_chains(spark, sf)
    return quantify.forall(ev, (F.col("plddt").cast("double") > 2) | (F.col("ss") == "H"), event_lengths(spark, sf))


@register("quantifier_count", EV + f"SELECT {K}, count(*) FILTER ({D('plddt')} BETWEEN 20 AND 60) AS answer FROM ev GROUP BY {K}")
def quantifier_count(spark, sf):
    ev = event_chains(spark, sf)
    return quantify.count(ev, F.col("plddt").cast("double").between(20, 60), event_lengths(spark, sf))


@register("quantifier_filter", EV + f"SELECT {K}, i FROM ev WHERE ss = 'E' AND {D('rel_sasa')} < 0.2")
def quantifier_filter(spark, sf):
    ev = event_chains(spark, sf)
    return quantify.select(ev, (F.col("ss") == "E") & (F.col("rel_sasa").cast("double") < 0.2)).select(*KEY, "i")


@register("quantifier_argmin_where", EV + f"""SELECT {K}, i, {S.fixed('value')} AS value FROM (
  SELECT *, {D('plddt')} AS value, row_number() OVER (PARTITION BY {K} ORDER BY plddt, i) AS rn FROM ev WHERE ss = 'H') WHERE rn = 1""")
def quantifier_argmin_where(spark, sf):
    ev = event_chains(spark, sf)
    best = quantify.argmin(ev, F.col("plddt"), ["i"], where=F.col("ss") == "H")
    return best.select(*KEY, "i", fixed(F.col("value")).alias("value"))


@register("quantifier_argmax_ties", EV + f"""SELECT {K}, i, {S.fixed('value')} AS value FROM (
  SELECT *, {D('plddt')} AS value, row_number() OVER (PARTITION BY {K} ORDER BY plddt DESC, i) AS rn FROM ev) WHERE rn = 1""")
def quantifier_argmax_ties(spark, sf):
    """Scores are capped at 100, so ties are common; the first one wins."""
    ev = event_chains(spark, sf)
    best = quantify.argmax(ev, F.col("plddt"), ["i"])
    return best.select(*KEY, "i", fixed(F.col("value")).alias("value"))


@register("quantifier_empty_domain", EV + f"""SELECT {K}, false AS any_, true AS all_, 0 AS n,
  'empty domain' AS err FROM ev WHERE i = 1""")
def quantifier_empty_domain(spark, sf):
    """A window wider than every chain: exists is false, forall is true,
    count is 0 and argmin is an error."""
    ev = event_chains(spark, sf)
    none = windows.sliding_windows(ev, [5000], {"v": windows.mean("plddt")})
    chains, test = event_lengths(spark, sf), F.col("v") > 50
    return (
        quantify.exists(none, test, chains, name="any_")
        .join(quantify.forall(none, test, chains, name="all_"), KEY)
        .join(quantify.count(none, test, chains, name="n"), KEY)
        .join(quantify.argmin(none, F.col("v"), ["start"], groups=chains).select(*KEY, "err"), KEY)
    )


@register("quantifier_nested", EV + f""", {S.edges('ev')},
  both_ AS (SELECT {K}, i, j FROM edges WHERE d <= 8.0 UNION ALL SELECT {K}, j, i FROM edges WHERE d <= 8.0),
  nb AS (SELECT a.species, a.uniprot, a.i, bool_and({D('b.plddt')} > 10) AS ok FROM ev a
    JOIN both_ g ON g.species = a.species AND g.uniprot = a.uniprot AND g.i = a.i
    JOIN ev b ON b.species = a.species AND b.uniprot = a.uniprot AND b.i = g.j GROUP BY ALL)
  SELECT e.species, e.uniprot, count(*) FILTER (e.ss = 'H' AND coalesce(nb.ok, true)) AS answer
  FROM ev e LEFT JOIN nb ON nb.species = e.species AND nb.uniprot = e.uniprot AND nb.i = e.i GROUP BY ALL""")
def quantifier_nested(spark, sf):
    """count r where ss(r) == "H" and forall s with distance(r, s) <= 8: plddt(s) > 10."""
    ev = event_chains(spark, sf)
    near = pairs.close_pairs(ev, 8.0, keep=["plddt"])
    ends = near.select(*KEY, F.explode(F.array(
        F.struct(F.col("i").alias("i"), F.col("plddt_j").alias("other")),
        F.struct(F.col("j").alias("i"), F.col("plddt_i").alias("other")),
    )).alias("e")).select(*KEY, "e.i", "e.other")
    inner = quantify.forall(ends, F.col("other").cast("double") > 10, by=[*KEY, "i"], name="ok")
    outer = ev.join(inner, [*KEY, "i"], "left")
    return quantify.count(outer, (F.col("ss") == "H") & F.coalesce("ok", F.lit(True)), event_lengths(spark, sf))


# -------------------------------------------------------------------- pairs --

@register("pair_values", VC + f""", {S.PAE} SELECT a.species, a.uniprot, {S.fixed(S.dist())} AS distance,
  abs(a.i - b.i) AS separation, p.v AS pae FROM vc a JOIN vc b ON b.species = a.species AND b.uniprot = a.uniprot
  AND a.i = 3 AND b.i = a.length - 2 JOIN pae p ON p.species = a.species AND p.uniprot = a.uniprot AND p.i = a.i AND p.j = b.i""")
def pair_values(spark, sf):
    """distance, seq_separation and pae of (residue(3), residue(L - 2))."""
    vc, pae = vector_chains(spark, sf), vector_matrix(spark, sf)
    a = vc.where("i = 3").alias("a")
    b = vc.where("i = length - 2").alias("b")
    rows = pae.where("i = 3").select(*KEY, "pae")
    return a.join(b, KEY).join(rows, KEY).select(
        *KEY, fixed(pairs.distance("a", "b")).alias("distance"),
        F.abs(F.col("a.i") - F.col("b.i")).alias("separation"),
        matrix.cell(F.col("pae"), F.col("b.i")).cast("long").alias("pae"),
    )


@register("pair_missing_index", EV + f"SELECT {K}, CASE WHEN length < 70 THEN 'residue index out of range' END AS err, "
          f"(SELECT {D('max(plddt)')} FROM ev r WHERE r.species = ev.species AND r.uniprot = ev.uniprot AND r.i = 70) AS v FROM ev WHERE i = 1")
def pair_missing_index(spark, sf):
    """plddt(residue(70)): chains that are too short report an error."""
    ev = event_chains(spark, sf)
    hit = ev.where("i = 70").select(*KEY, F.col("plddt").cast("double").alias("v"))
    problem = regions.position_problem(F.lit(70), F.col("length"))
    return event_lengths(spark, sf).join(hit, KEY, "left").select(*KEY, problem.alias("err"), "v")


@register("pair_split_predicate", EV + f"""SELECT {K}, CAST(coalesce(sum(n), 0) AS BIGINT) AS answer FROM (
  SELECT a.species, a.uniprot, (SELECT count(*) FROM ev b WHERE b.species = a.species AND b.uniprot = a.uniprot
    AND b.i >= a.i + 5 AND {D('b.plddt')} < 20) AS n FROM ev a WHERE a.ss = 'H') GROUP BY {K}""")
def pair_split_predicate(spark, sf):
    """count (i, j) in all_pairs(5) where ss(i) == "H" and plddt(j) < 20,
    from running counts instead of pairs."""
    return pairs.count_split_pairs(
        event_chains(spark, sf), F.col("ss") == "H", F.col("plddt").cast("double") < 20, 5
    ).select(*KEY, F.col("answer").cast("long").alias("answer"))


@register("contact_edges", EV + f", {S.edges('ev')} SELECT {K}, i, j, {S.fixed('d')} AS d FROM edges WHERE d <= 8.0")
def contact_edges(spark, sf):
    return pairs.close_pairs(event_chains(spark, sf), 8.0).withColumn("d", fixed(F.col("d")))


@register("long_range_contacts", EV + f""", {S.edges('ev')} SELECT e.species, e.uniprot, count(g.i) AS answer FROM
  (SELECT DISTINCT {K} FROM ev) e LEFT JOIN edges g ON g.species = e.species AND g.uniprot = e.uniprot
  AND g.d <= 8.0 AND g.j - g.i > 12 AND g.i >= 5 AND g.j <= 45 GROUP BY ALL""")
def long_range_contacts(spark, sf):
    """long_range_contacts(range(5, 45)) with sep 12 and radius 8."""
    ev = event_chains(spark, sf)
    asked = event_lengths(spark, sf).select(F.concat_ws("/", *KEY).alias("qid"), *KEY, "length", F.lit(5).alias("start"), F.least(F.lit(45), "length").alias("end"))
    found = regions.contact_counts(asked, pairs.close_pairs(ev, 8.0, min_sep=13), min_gap=12)
    return asked.join(found, "qid", "left").select(*KEY, F.coalesce("contacts", F.lit(0)).alias("answer"))


@register("contact_density_radius_6", VC + f""", {S.edges('vc')} SELECT e.species, e.uniprot,
  {S.fixed('count(g.i) / 190.0')} AS answer FROM (SELECT DISTINCT {K} FROM vc) e LEFT JOIN edges g
  ON g.species = e.species AND g.uniprot = e.uniprot AND g.d <= 6.0 AND g.i >= 1 AND g.j <= 20 GROUP BY ALL""")
def contact_density_radius_6(spark, sf):
    """contact_density(range(1, 20), radius=6.0)."""
    vc = vector_chains(spark, sf)
    asked = _chains(vc).select(F.concat_ws("/", *KEY).alias("qid"), *KEY, "length", F.lit(1).alias("start"), F.lit(20).alias("end"))
    got = regions.contact_density(asked, pairs.close_pairs(vc, 6.0))
    return got.select(*KEY, fixed(F.col("density")).alias("answer"))


@register("window_contact_density", EV + f""", {S.edges('ev')} SELECT r.species, r.uniprot, r.i AS start,
  (SELECT count(*) FROM edges g WHERE g.species = r.species AND g.uniprot = r.uniprot AND g.d <= 8.0
    AND g.i >= r.i AND g.j <= r.i + 24) / 300.0 AS density FROM ev r WHERE r.i + 24 <= r.length""")
def window_contact_density(spark, sf):
    ev = event_chains(spark, sf)
    got = pairs.window_contacts(ev, pairs.close_pairs(ev, 8.0), [25])
    return got.select(*KEY, "start", "density")


# ------------------------------------------------------------------ regions --

def _m(c, fn="avg"):
    return S.fixed(f"{fn}(CAST({c} AS DOUBLE))")


_RG = S.fixed("sqrt(var_pop(CAST(x AS DOUBLE)) + var_pop(CAST(y AS DOUBLE)) + var_pop(CAST(z AS DOUBLE)))")


@register("region_score_values", EV + f"""SELECT {K}, {_m('plddt')} AS mean_plddt, {_m('plddt', 'min')} AS min_plddt,
  {_m('plddt', 'max')} AS max_plddt, {_m('plddt', 'stddev_pop')} AS std_plddt, {_m('rel_sasa')} AS mean_rel_sasa, {_RG} AS rg
  FROM ev WHERE i BETWEEN 10 AND 40 GROUP BY {K}""")
def region_score_values(spark, sf):
    got = regions.fixed_region(event_chains(spark, sf), 10, 40, {
        "mean_plddt": windows.mean("plddt"), "min_plddt": windows.lowest("plddt"),
        "max_plddt": windows.highest("plddt"), "std_plddt": windows.deviation("plddt"),
        "mean_rel_sasa": windows.mean("rel_sasa"), "rg": windows.gyration(),
    })
    values = [c for c in got.columns if c not in (*KEY, "err")]
    return got.select(*KEY, *[fixed(F.col(c)).alias(c) for c in values])


_NESTED = """q AS (SELECT species, uniprot, length, f, 1 + f * 7 AS s, length - f * 5 AS e FROM (SELECT DISTINCT species, uniprot, length FROM ev), (SELECT unnest(range(0, 6)) AS f))"""
_BAD = "CASE WHEN s > e THEN 'region out of range' END AS err"


def _nested(spark, sf):
    """Six regions per chain, each inside the one before, the first being the whole chain."""
    f = F.explode(F.sequence(F.lit(0), F.lit(5)))
    return event_lengths(spark, sf).select(*KEY, "length", f.alias("f")).select(
        F.concat_ws("/", *KEY, F.col("f").cast("string")).alias("qid"), *KEY, "length",
        (F.col("f") * 7 + 1).cast("long").alias("start"), (F.col("length") - F.col("f") * 5).alias("end"))


@register("region_values_nested", EV + f""", {_NESTED} SELECT q.species || '/' || q.uniprot || '/' || f AS qid, {_m('plddt')} AS mean, {_m('plddt', 'min')} AS low,
  {_m('plddt', 'max')} AS high, {_m('plddt', 'stddev_pop')} AS std, {_m('rel_sasa')} AS exposed, {_RG} AS rg, CASE WHEN any_value(s) <= any_value(e) THEN count(*) FILTER (ss = 'H') END AS n_h,
  {_BAD.replace('s > e', 'any_value(s) > any_value(e)')} FROM q LEFT JOIN ev ON ev.species = q.species AND ev.uniprot = q.uniprot AND ev.i BETWEEN s AND e GROUP BY q.species, q.uniprot, f""")
def region_values_nested(spark, sf):
    """All region metrics over whole chains and long nested regions: two lookups each, however long."""
    wanted = {
        "mean": windows.mean("plddt"), "low": windows.lowest("plddt"), "high": windows.highest("plddt"), "std": windows.deviation("plddt"),
        "exposed": windows.mean("rel_sasa"), "rg": windows.gyration(), "n_h": windows.occurrences("ss", "H"),
    }
    got = regions.region_values(_nested(spark, sf), event_chains(spark, sf), wanted)
    return got.select("qid", *[fixed(F.col(c)).alias(c) for c in wanted if c != "n_h"], "n_h", "err")


@register("contact_density_nested", EV + f""", {S.edges('ev')}, {_NESTED} SELECT q.species || '/' || q.uniprot || '/' || f AS qid,
  CASE WHEN any_value(s) <= any_value(e) THEN {S.fixed('CASE WHEN any_value(s) = any_value(e) THEN 0.0 ELSE count(g.i) / ((any_value(e) - any_value(s) + 1) * (any_value(e) - any_value(s)) / 2) END')} END AS density,
  {_BAD.replace('s > e', 'any_value(s) > any_value(e)')} FROM q LEFT JOIN edges g ON g.species = q.species AND g.uniprot = q.uniprot AND g.d <= 8.0 AND g.i >= s AND g.j <= e
  GROUP BY q.species, q.uniprot, f""")
def contact_density_nested(spark, sf):
    """Contacts inside long nested regions, counted by dominance."""
    got = regions.contact_density(_nested(spark, sf), pairs.close_pairs(event_chains(spark, sf), 8.0))
    return got.select("qid", fixed(F.col("density")).alias("density"), "err")


@register("region_mean_neighbors", EV + ", " + S.neighbours("ev") + f"SELECT {K}, {S.fixed('avg(n_neigh)')} AS answer FROM nb WHERE i > length - 15 GROUP BY {K}")
def region_mean_neighbors(spark, sf):
    """mean_n_neighbors(last(15))."""
    res = pairs.neighbor_counts(event_chains(spark, sf))
    got = regions.fixed_region(res, *regions.last_n(15), {"v": windows.mean("n_neigh")})
    return got.select(*KEY, fixed(F.col("v")).alias("answer"))


@register("region_out_of_range", EV + f"""SELECT {K}, CASE WHEN any_value(length) < 75 THEN 'region out of range' END AS err,
  CASE WHEN any_value(length) >= 75 THEN {S.fixed("avg(CAST(plddt AS DOUBLE)) FILTER (i > length - 75)")} END AS v FROM ev GROUP BY {K}""")
def region_out_of_range(spark, sf):
    """mean_plddt(last(75)): an error on shorter chains."""
    got = regions.fixed_region(event_chains(spark, sf), *regions.last_n(75), {"v": windows.mean("plddt")})
    return got.select(*KEY, "err", fixed(F.col("v")).alias("v"))


@register("region_lengths", EV + f"SELECT {K}, 31 AS region_length, length AS chain_length FROM ev WHERE i = 1")
def region_lengths(spark, sf):
    """length(range(10, 40)), and protein_length(), which is also what
    length() of any other argument gives."""
    size = F.lit(40) - F.lit(10) + 1
    return event_lengths(spark, sf).select(*KEY, size.alias("region_length"), F.col("length").alias("chain_length"))


@register("sliding_window_values", EV + f"""SELECT a.species, a.uniprot, a.i AS start, {_m('b.plddt')} AS mean_plddt,
  {_m('b.plddt', 'min')} AS min_plddt, {_m('b.plddt', 'max')} AS max_plddt FROM ev a JOIN ev b
  ON b.species = a.species AND b.uniprot = a.uniprot AND b.i BETWEEN a.i AND a.i + 19 WHERE a.i + 19 <= a.length GROUP BY ALL""")
def sliding_window_values(spark, sf):
    got = windows.sliding_windows(event_chains(spark, sf), [20], {
        "mean_plddt": windows.mean("plddt"), "min_plddt": windows.lowest("plddt"), "max_plddt": windows.highest("plddt"),
    })
    return got.select(*KEY, "start", *[fixed(F.col(c)).alias(c) for c in ("mean_plddt", "min_plddt", "max_plddt")])


@register("pae_blocks", f"""WITH {S.VC_BASE}, {S.PAE} SELECT {K}, {S.fixed('avg(v)')} AS mean_pae, CAST(max(v) AS DOUBLE) AS max_pae,
  count(*) FILTER (v > 8) AS n_high FROM pae WHERE i BETWEEN 2 AND 16 AND j BETWEEN length - 14 AND length GROUP BY {K}""")
def pae_blocks(spark, sf):
    """mean_pae, max_pae and count_high_pae(.., 8) of [2, 16] x last(15)."""
    pae = vector_matrix(spark, sf)
    asked = pae.where("i = 1").select(
        F.concat_ws("/", *KEY).alias("qid"), *KEY, "length",
        F.lit(2).alias("a_start"), F.lit(16).alias("a_end"),
        (F.col("length") - 14).alias("b_start"), F.col("length").alias("b_end"),
    )
    got = matrix.block_values(asked, pae, F.lit(8))
    return got.select(*KEY, fixed(F.col("mean_pae")).alias("mean_pae"), "max_pae", "n_high")


# --------------------------------------------------------------------- runs --

_RUNS = f"""rr AS (SELECT {K}, ss, min(i) AS s, max(i) AS e FROM (
  SELECT *, i - row_number() OVER (PARTITION BY {K}, ss ORDER BY i) AS g FROM ev) GROUP BY {K}, ss, g)"""


@register("runs_of_label", EV + f", {_RUNS} SELECT {K}, s AS start, e AS \"end\" FROM rr WHERE ss = 'E'")
def runs_of_label(spark, sf):
    return runs.runs(event_chains(spark, sf), "E").select(*KEY, "start", "end")


@register("longest_run", EV + f""", {_RUNS} SELECT {K}, s AS start, e AS "end", e - s + 1 AS size FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY e - s DESC, s) AS rn FROM rr WHERE ss = 'C') WHERE rn = 1""")
def longest_run(spark, sf):
    return runs.longest_run(event_chains(spark, sf), "C")


@register("run_counts", EV + f", {_RUNS} SELECT {K}, count(*) FILTER (ss = 'H') AS n_helices, count(*) FILTER (ss = 'E') AS n_strands FROM rr GROUP BY {K}")
def run_counts(spark, sf):
    got = runs.run_counts(event_chains(spark, sf), ["H", "E"])
    return got.withColumnsRenamed({"n_H": "n_helices", "n_E": "n_strands"})


@register("chain_summary_values", EV + f"SELECT {K}, max(length) AS length, {_m('plddt')} AS mean_plddt FROM ev GROUP BY {K}")
def chain_summary_values(spark, sf):
    """protein_length and mean_protein_plddt."""
    return event_chains(spark, sf).groupBy(*KEY).agg(
        F.max("length").alias("length"), fixed(F.avg(F.col("plddt").cast("double"))).alias("mean_plddt")
    )


# --------------------------------------------------------------------- sets --

_SETS = f"a AS (SELECT {K}, i FROM ev WHERE ss = 'H'), b AS (SELECT {K}, i FROM ev WHERE {D('plddt')} > 60)"


def _two_sets(spark, sf):
    ev = event_chains(spark, sf)
    return ev, ev.where("ss = 'H'"), ev.where(F.col("plddt").cast("double") > 60)


@register("set_union", EV + f", {_SETS} SELECT * FROM a UNION SELECT * FROM b")
def set_union(spark, sf):
    _, a, b = _two_sets(spark, sf)
    return sets.union(a, b)


@register("set_intersection", EV + f", {_SETS} SELECT * FROM a INTERSECT SELECT * FROM b")
def set_intersection(spark, sf):
    _, a, b = _two_sets(spark, sf)
    return sets.intersection(a, b)


@register("set_difference", EV + f", {_SETS} SELECT * FROM a EXCEPT SELECT * FROM b")
def set_difference(spark, sf):
    _, a, b = _two_sets(spark, sf)
    return sets.difference(a, b)


@register("set_size_and_membership", EV + f""", {_SETS} SELECT e.species, e.uniprot, count(b.i) AS n, coalesce(bool_or(b.i = 25), false) AS has_25,
  coalesce(bool_or(b.i BETWEEN 20 AND 30), false) AS in_region FROM (SELECT DISTINCT {K} FROM ev) e LEFT JOIN b USING ({K}) GROUP BY ALL""")
def set_size_and_membership(spark, sf):
    """size(set), contains(set, 25), and whether a member is in_region(20, 30)."""
    ev, _, b = _two_sets(spark, sf)
    hits = b.groupBy(*KEY).agg(
        F.bool_or(F.col("i") == 25).alias("has_25"),
        F.bool_or(sets.in_region(F.col("i"), F.lit(20), F.lit(30))).alias("in_region"),
    )
    out = sets.size(b, event_lengths(spark, sf)).withColumnRenamed("answer", "n").join(hits, KEY, "left")
    return out.fillna(False, ["has_25", "in_region"])


# --------------------------------------------------------------- arithmetic --

@register("arithmetic", """SELECT event_id, value + 2 * 3 - 1 AS a, value / 4 AS quotient, CASE WHEN user_id % 10 <> 0 THEN value / (user_id % 10) END AS guarded,
  CAST((event_id % 7) ** 3 AS BIGINT) AS p, -value AS neg, value BETWEEN 10 AND 20 AS inside, NOT (value > 10) AS small,
  value > 10 AND value < 20 OR event_type = 'view' AS logic, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS branch,
  CASE WHEN user_id % 10 = 0 THEN 'division by zero' END AS err FROM events""")
def arithmetic(spark, sf):
    """+ - * / ** unary minus, between, not, and/or, if-then-else; division by
    zero is an error value, not a failed job."""
    v, d = F.col("value"), F.pmod("user_id", F.lit(10))
    return table(spark, sf, "events").select(
        "event_id", (v + 2 * 3 - 1).alias("a"), scalars.divide(v, F.lit(4)).alias("quotient"),
        scalars.divide(v, d).alias("guarded"),
        scalars.integer_power(F.pmod("event_id", F.lit(7)), F.lit(3)).alias("p"),
        (-v).alias("neg"), v.between(10, 20).alias("inside"), (~(v > 10)).alias("small"),
        ((v > 10) & (v < 20) | (F.col("event_type") == "view")).alias("logic"),
        F.when(v > 50, "high").otherwise("low").alias("branch"),
        scalars.division_error(d).alias("err"),
    )


@register("math_helpers", """SELECT event_id, abs(value - 50) AS a, least(value, 30, event_id) AS lo, greatest(value, 30) AS hi,
  CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c FROM events""")
def math_helpers(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.abs(v - 50).alias("a"), F.least(v, F.lit(30.0), F.col("event_id").cast("double")).alias("lo"),
        F.greatest(v, F.lit(30.0)).alias("hi"), F.floor(v).alias("f"), F.ceil(v).alias("c"),
    )


@register("round_half_even", """SELECT event_id, round_even(value, 0) AS r0, round_even(event_id / 2.0, 0) AS half FROM events""")
def round_half_even(spark, sf):
    """round(): half-even on the binary value."""
    return table(spark, sf, "events").select(
        "event_id", scalars.py_round(F.col("value"), 0).alias("r0"),
        scalars.py_round(F.col("event_id") / 2, 0).alias("half"),
    )


@register("piecewise_row_numbers", """SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem""")
def piecewise_row_numbers(spark, sf):
    """Positions along a chain for a key of any size: lines of a supplier in
    shipping order, numbered day by day."""
    li = table(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return number_rows(li.select("l_suppkey", *order), ["l_suppkey"], order, F.unix_date(F.to_date("l_shipdate"))).drop("l_shipdate")
