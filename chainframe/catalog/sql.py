"""Independent SQL for the chain bindings and for parameter draws, used to
check registered queries on another engine."""

from ..schema import MAX_SASA
from ..sources.bindings import LETTERS

_MAX = "[" + ", ".join(str(MAX_SASA[a]) for a in LETTERS) + "]"
_REL = (
    f"CAST(least(greatest(CAST(CAST(sasa AS DOUBLE) / ({_MAX})[instr('{LETTERS}', aa)] AS FLOAT), 0), 1.5)"
    " AS FLOAT) AS rel_sasa"
)

EV = f"""ev AS (
  SELECT *, {_REL} FROM (
    SELECT species, uniprot, i, length,
      substr('{LETTERS}', CAST(event_id % 20 AS INTEGER) + 1, 1) AS aa,
      CAST(least(value, 100.0) AS FLOAT) AS plddt,
      CAST(k * 2.5 AS FLOAT) AS sasa,
      CASE WHEN event_type IN ('view', 'click') THEN 'H'
           WHEN event_type IN ('purchase', 'signup') THEN 'E' ELSE 'C' END AS ss,
      CAST(((i - 1) % 10) * CAST(3.8 AS DOUBLE) + (cents % 100) / CAST(100 AS DOUBLE) AS FLOAT) AS x,
      CAST((((i - 1) // 10) % 10) * CAST(3.8 AS DOUBLE) + k / CAST(100 AS DOUBLE) AS FLOAT) AS y,
      CAST(((i - 1) // 100) * CAST(3.8 AS DOUBLE) AS FLOAT) AS z
    FROM (
      SELECT ['human', 'mouse', 'fly', 'chicken'][1 + user_id % 4] AS species,
        'U' || user_id AS uniprot, event_id, event_type, value,
        CAST(round(value * 100) AS BIGINT) AS cents,
        CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
        count(*) OVER (PARTITION BY user_id) AS length
      FROM events)))"""

VC_BASE = """vb AS (
  SELECT ['human', 'mouse', 'fly', 'chicken'][1 + label % 4] AS species,
    'V_' || label || '_' || (vec_id // 500) AS uniprot, vec_id,
    CAST(embedding AS DOUBLE[]) AS e,
    row_number() OVER (PARTITION BY label, vec_id // 500 ORDER BY vec_id) AS i,
    count(*) OVER (PARTITION BY label, vec_id // 500) AS length
  FROM embeddings)"""

VC = f"""{VC_BASE}, vc AS (
  SELECT *, {_REL} FROM (
    SELECT species, uniprot, i, length,
      substr('{LETTERS}', CAST(vec_id % 20 AS INTEGER) + 1, 1) AS aa,
      CAST(least(abs(e[1]) * 600, 100.0) AS FLOAT) AS plddt,
      CAST(abs(e[8]) * 900 AS FLOAT) AS sasa,
      CASE WHEN e[4] > 0.04 THEN 'H' WHEN e[4] < -0.04 THEN 'E' ELSE 'C' END AS ss,
      CAST(e[1] * 60 AS FLOAT) AS x, CAST(e[2] * 60 AS FLOAT) AS y, CAST(e[3] * 60 AS FLOAT) AS z
    FROM vb))"""

PAE = """pae AS (
  SELECT a.species, a.uniprot, a.i, b.i AS j, a.length,
    CAST(floor(abs(a.e[5] - b.e[6]) * 60) AS BIGINT) AS v
  FROM vb a JOIN vb b USING (species, uniprot))"""


def dist(a: str = "a", b: str = "b") -> str:
    def sq(c):
        d = f"(CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE))"
        return f"{d} * {d}"

    return f"sqrt({sq('x')} + {sq('y')} + {sq('z')})"


def edges(chain: str, name: str = "edges") -> str:
    """All pairs i < j of a chain with their distance."""
    return f"""{name} AS (
  SELECT a.species, a.uniprot, a.i AS i, b.i AS j, {dist()} AS d
  FROM {chain} a JOIN {chain} b ON a.species = b.species AND a.uniprot = b.uniprot AND a.i < b.i)"""


def neighbours(chain: str, radius: float = 8.0, name: str = "nb") -> str:
    zero = "" if radius == 8.0 else " AND d > 0"
    return f"""{edges(chain, 'nb_edges')}, {name} AS (
  SELECT c.species, c.uniprot, c.i, c.length, coalesce(k.n, 0) AS n_neigh
  FROM {chain} c LEFT JOIN (
    SELECT species, uniprot, i, count(*) AS n FROM (
      SELECT species, uniprot, i FROM nb_edges WHERE d <= {radius}{zero}
      UNION ALL SELECT species, uniprot, j FROM nb_edges WHERE d <= {radius}{zero})
    GROUP BY ALL) k ON c.species = k.species AND c.uniprot = k.uniprot AND c.i = k.i)"""


def fixed(x: str, digits: int = 6) -> str:
    """Half-up rounding by plain IEEE arithmetic."""
    p = 10**digits
    return f"floor(({x}) * {p}.0 + 0.5) / {p}.0"


def choice(draw: str, values) -> str:
    listed = ", ".join(f"CAST({v} AS DOUBLE)" for v in values)
    return f"([{listed}])[CAST(1 + {draw} % {len(values)} AS INTEGER)]"


def questions(template: str, chain: str, params: dict[str, str], valid: str, draws: int,
              slots: int = 2, seed: int = 0) -> str:
    raw = "".join(
        f", ('0x' || substr(md5(concat_ws('/', species, uniprot, '{template}', '{seed}',"
        f" CAST(slot AS VARCHAR), '{k}')), 1, 8))::BIGINT AS d{k}"
        for k in range(draws)
    )
    cols = "".join(f", {expr} AS {name}" for name, expr in params.items())
    return f"""q AS (
  SELECT * FROM (
    SELECT *, species || '/' || uniprot || '/{template}/' || slot AS qid{cols}
    FROM (SELECT *{raw} FROM (
      SELECT species, uniprot, length, unnest(range(0, {slots})) AS slot FROM {chain} WHERE i = 1)))
  WHERE {valid})"""
