"""The text operators over whole tables, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clusters, with_inertia
from .common import table
from .decontaminate import contamination, is_contaminated
from .fingerprints import edit_likeness
from .language import languages
from .mixing import mix
from .near_dedup import near_duplicates
from .periodic import digests, periodic_runs
from .pieces import decoded, encoded
from .secrets import secrets
from .sharding import shards
from .substrings import cut_repeats
from .tokens import read_tokens, write_tokens
from .toxicity import toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items"), 256).alias("items_sha256"), is_contaminated(F.col("_found.n_hit"), F.col("_found.n_words")).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(spark, write_tokens(docs, TOKENIZER), with_ids=False)


def levels() -> dict:
    """The tree of the mix: a domain is a group of sources."""
    return {
        "domain": F.concat(F.lit("d"), (F.crc32(F.col("source").cast("string").cast("binary")) % 4).cast("string")),
        "lang": F.col("lang"), "source": F.col("source"),
    }


#: English gets half of each domain; other nodes weigh 1.
WEIGHTS = {(f"d{k}", "en"): 3.0 for k in range(4)}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), levels(), WEIGHTS, share=0.8, max_epochs=4, seed=8)


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoded(encoded(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clusters(table(spark, sf_dir, "embeddings")))


def _round_sql(k: int) -> str:
    """One round: assignment ``a{k}`` by the centroids ``c{k}``, and the moved centroids ``c{k+1}``."""
    return f"""
a{k} AS (
  SELECT vec_id, any_value(q) AS q, arg_min(c, d * 16 + c) AS c, min(d) AS d
  FROM (SELECT v.vec_id, v.q, m.c, list_sum([(v.q[i] - m.q[i]) * (v.q[i] - m.q[i]) FOR i IN range(1, 65)])::BIGINT AS d
        FROM v CROSS JOIN c{k} m)
  GROUP BY vec_id),
s{k} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q
  FROM (SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c),
c{k + 1} AS (SELECT c{k}.c, coalesce(s{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN s{k} ON s{k}.c = c{k}.c)"""


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (
  SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h LIMIT 16)),
{",".join(_round_sql(k) for k in range(4))},
t AS (SELECT c, sum(d)::BIGINT AS s FROM a3 GROUP BY c)
SELECT vec_id, a3.c::INTEGER AS cluster, d AS distance, t.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM t) AS inertia,
       sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN t ON t.c = a3.c JOIN c3 ON c3.c = a3.c
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_token_ids": op7_token_ids,
    "op8_mixing": op8_mixing,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_fingerprints": op10_fingerprints,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_centroids": op12_centroids,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op5_decontamination": OP5_SQL, "op12_centroids": OP12_SQL}
