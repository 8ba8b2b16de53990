"""Near-duplicate documents by BagMinHash and exact multiset overlap.

A document is the multiset of its five-word shingles.  BagMinHash sees every shingle and weight interval as a Poisson
process over (time, signature component, discretised weight): interval 0 is weight 1, interval k the weights above
2**(k-1) up to 2**k, with a rate equal to its width.  The earliest time per component among points whose weight the
document reaches is its signature, and two signatures agree in a component with the probability of the weighted Jaccard
similarity.  Points come in order of time, so a process stops as soon as it is later than the document's slowest
component.

Bands of components are hashed into buckets.  Candidates are verified by exact multiset Jaccard.  No bucket is expanded
into pairs: its members are compared with its leader, the member that meets most others; after the connected components
of the verified links are known, members of different components are compared where what they share with the leader
leaves the possibility of a link (see ``between``).

Nodes are distinct word sequences (128 bits of a BLAKE2 over the words' bytes), so exact copies take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, mix, sound_hashes, steps, text_bytes, word_spans, written

SHINGLE, SIMILARITY = 5, 0.8
#: Signature components and bands.  A pair at similarity 0.8 shares a band but for 5e-8.
COMPONENTS, BANDS = 128, 32
#: Steps of overlap with the leader in which partners are looked for.
GRADES = 10
#: Fixed odd multipliers of the hash streams.
STREAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def stream(k: int, turn: int) -> np.uint64:
    return np.uint64(int(STREAM[k]) * turn & (1 << 64) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each row: digest of its words, distinct shingle hashes and their counts.  Fewer than ``k`` words are one
    shingle of all their words in order; no words, none."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words, spelled, bounds = sound_hashes(low, starts, ends), *_spelled(low, starts, ends, first, offsets)
    grams = words.copy()
    for i in range(1, k):
        grams[:-i or None] = grams[:-i or None] * STREAM[0] + words[i:]
    grams = mix(grams)
    for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        digest = hashlib.blake2b(spelled[bounds[row] : bounds[row + 1]], digest_size=16).digest()
        if b - a >= k:
            yield digest, *np.unique(grams[a : b - k + 1], return_counts=True)
        elif b > a:
            whole = words[a : a + 1]
            for i in range(a + 1, b):
                whole = whole * STREAM[0] + words[i : i + 1]
            yield digest, mix(whole + np.uint64(b - a)), np.ones(1, np.int64)
        else:
            yield digest, np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The words of all rows, one byte between two words of a row, and where each row begins."""
    change = np.zeros(len(low) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    later = np.ones(len(starts), bool)
    later[first[:-1][first[:-1] < first[1:]]] = False
    gaps = starts[later] - 1
    keep[gaps] = True
    out = low.copy()
    out[gaps] = 32
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()


def bag_minhash(hashes: np.ndarray, counts: np.ndarray, rows: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """Signatures (earliest times) of ``n`` multisets given as flat (hash, count, row)."""
    out = np.full(n * components, np.inf)
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    below = np.where(level == 0, 0, width)
    seed, row, most = mix(hashes[which] + level.astype(np.uint64) * STREAM[1]), rows[which], counts[which]
    time, latest, turn = np.zeros(len(which)), np.full(n, np.inf), 0
    while len(seed):
        draw = mix(seed + stream(1, 2 * turn + 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        place = mix(seed + stream(2, 2 * turn + 2))
        component = ((place & np.uint64(0xFFFFFFFF)) % np.uint64(components)).astype(np.int64)
        weight = below + np.ceil(((place >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32 * width)
        alive = time < latest[row]
        hit = alive & (weight <= most)
        np.minimum.at(out, row[hit] * components + component[hit], time[hit])
        turn += 1
        if turn < 8 or turn % 8 == 0:
            latest = out.reshape(n, components).max(1)
            alive &= time < latest[row]
        if not alive.all():
            seed, row, most, time, width, below = (x[alive] for x in (seed, row, most, time, width, below))
    return out.reshape(n, components)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per row and band, different between bands."""
    parts = signatures.view(np.uint64).reshape(len(signatures), bands, -1)
    out = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = mix(out * STREAM[0] + parts[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, node, n (shingles), bands for each row; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in steps(offsets):
                found = list(shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k))
                sizes = [len(h) for _, h, _ in found]
                sig = bag_minhash(
                    np.concatenate([h for _, h, _ in found]), np.concatenate([c for _, _, c in found]),
                    np.repeat(np.arange(len(found)), sizes), len(found),
                )
                bands = band_hashes(sig)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[low:high], "node": pa.array([d for d, _, _ in found], pa.binary()),
                    "n": pa.array([int(c.sum()) for _, _, c in found], pa.int64()),
                    "bands": pa.array([b if s else None for b, s in zip(bands, sizes)], pa.list_(pa.int64())),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, node binary, n long, bands array<long>")


def bags(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node and its shingles, the i-th occurrence of a shingle with a hash of its own: the multiset as a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in steps(offsets):
                nodes, sets = [], []
                for digest, h, c in shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k):
                    turn = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                    nodes.append(digest)
                    sets.append(mix(np.repeat(h, c) + turn.astype(np.uint64) * STREAM[0]).view(np.int64))
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "bag": pa.array(sets, pa.list_(pa.int64()))})

    return docs.select("text").mapInArrow(lean(run), "node binary, bag array<long>")


def compared(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """Each pair (a, b) with the sizes of both bags, their overlap, what only ``a`` has (beyond), and what only ``b`` has (missing)."""
    left = bag.select(F.col("node").alias("a"), F.col("bag").alias("_x"))
    right = bag.select(F.col("node").alias("b"), F.col("bag").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size("_x").alias("na"), F.size("_y").alias("nb"), F.size(F.array_intersect("_x", "_y")).alias("both"),
        F.array_except("_x", "_y").alias("beyond"), F.array_except("_y", "_x").alias("missing"),
    )


def linked(similarity: float):
    return F.col("both") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("both"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large and small stars over the edges (a, b).

    Each star needs the minimum of a node's neighbours (a partial aggregate) and a join on the node, so a hub is spread
    by skew handling; every round is written, and rounds end when nothing changes.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi"), F.col("lo")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi")
        now = written(small.select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("hi <> lo").distinct())
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def between(stars: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of members of one leader, in different components, that can be similar at all.

    Of two linked members x and y in different components at least one, say y, has no link with the leader c.  Their
    overlap is |x & c| + |y & c| - |c| plus the number of shingles in which both differ from c in the same way.  With
    q = s / (1 + s), the link says overlap >= q (|x| + |y|), the missing link says |y & c| < q (|y| + |c|), so x and y
    share more than q |x| + (1 - q) |c| - |x & c| >= 0 of their differences from c: one of the rarest differences of x, all
    but so many.  If, besides, no shingle beyond c is in both, all they share is c's, so overlap <= |x & c| and |y & c|,
    and each has at most the size overlap / q - own size of the other.  Differences are listed in one order for all members,
    so a pair also needs enough of them from the first shared one on, in both lists.  Copies edited apart from each other meet no such
    condition, so a large group of them is not expanded into pairs.
    """
    q = similarity / (1 + similarity)
    placed = stars.join(found.select(F.col("node").alias("a"), F.col("component").alias("_c")), "a", "left")
    placed = placed.withColumn("c", F.coalesce("_c", "a")).withColumn("free", ~linked(similarity))
    lead = found.select(F.col("node").alias("b"), F.col("component").alias("_l"))
    mixed = placed.join(lead, "b", "left").where(F.col("c") != F.coalesce("_l", "b")).select("b").distinct()
    least = F.lit(q) * F.col("na") + F.lit(1 - q) * F.col("nb") - F.col("both")
    group = written(placed.join(mixed, "b", "left_semi").select(
        "b", "a", "na", "nb", "both", "c", "free", least.alias("least"), (F.col("both") / q - F.col("na") + 1e-9).alias("most"),
        F.size("beyond").alias("nu"), F.concat("beyond", "missing").alias("apart")))
    spread = group.select("b", "a", "nu", F.posexplode("apart").alias("at", "g"))
    often = spread.groupBy("b", "g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # In order: shingles beyond c, then missing ones, rare ones first.  Those that no other member has match nothing.
    own = spread.join(often, ["b", "g"]).withColumn("u", F.col("at") < F.col("nu")).groupBy("b", "a").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("u")).alias("late"), "m", "g"))).alias("known"),
        F.count_if("u").alias("ku"))
    some = group.join(own, ["b", "a"]).withColumn("grade", F.floor(F.lit(GRADES) * F.col("both") / F.col("nb")).cast("int"))

    def side(k: str, df: DataFrame, tokens) -> DataFrame:
        plain = [F.col(c).alias(c + k) for c in ("a", "na", "c", "most")]
        need = (F.lit(q) * F.col("na") - F.col("both")).alias("need" + k)
        spread = df.select("b", "grade", "nb", *plain, need, F.size("known").alias("_k"), F.posexplode(tokens).alias("at", "t"))
        return spread.select(
            "b", "grade", "nb", *[c + k for c in ("a", "na", "c", "most", "need")],
            (F.col("_k") - F.col("at")).alias("left" + k), "t.g", (~F.col("t.late")).alias("u"))

    # The partners by their overlap with c: the smaller it is, the more differences must agree, so the fewer are tried.
    grades = some.where("free").select("b", "grade").distinct()
    graded = some.drop("grade").join(grades, "b")
    share = F.lit(similarity) * F.col("na") + F.col("nb") - F.col("both") - (F.col("grade") + 1) / GRADES * F.col("nb")
    skip = F.floor(F.greatest("least", share) - 1e-9).cast("int")
    lone_u, lone_m = F.col("nu") - F.col("ku"), F.size("apart") - F.col("nu") - F.size("known") + F.col("ku")
    first = F.size("apart") - skip - lone_u
    take = F.when(first <= F.col("ku"), first).otherwise(F.greatest(F.col("ku"), first - lone_m)).cast("int")
    x = side("1", graded.withColumn("take", take).where("take > 0"), F.slice("known", 1, F.col("take")))
    y = side("2", some.where("free"), F.col("known")).drop("u", "nb")
    near_size = F.least("na1", "na2") >= F.lit(similarity) * F.greatest("na1", "na2")
    possible = F.col("u") | ((F.col("na2") <= F.col("most1")) & (F.col("na1") <= F.col("most2")))
    # Both sides list their differences in one order, so what follows the first one they share bounds all they share.
    enough = F.least("left1", "left2") >= F.col("need1") + F.col("need2") + F.col("nb") - 1e-6
    apart = (F.col("a1") != F.col("a2")) & (F.col("c1") != F.col("c2"))
    pairs = x.join(y, ["b", "grade", "g"]).where(apart & near_size & possible & enough)
    return written(pairs.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")).distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, class_id, kept.

    ``class_id`` is the smallest doc_id of the row's class, the connected component of verified links; a row with no
    partner is its own class.  Texts without words (null included) are alone; so are rows with a null id when their
    text has no row with an id.  ``kept`` marks rows whose doc_id is the class_id, and rows with a null id; repeated
    rows of one doc_id are one document and share its fate.
    """
    signed = written(signatures(docs, k))
    nodes = signed.where("bands IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    nodes = written(nodes)
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    full = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = written(member.join(full, "bucket"))
    # The leader of a bucket is the member that meets most others over all buckets: the middle of a group of copies.
    met = shared.groupBy("node").agg(F.sum("m").alias("met"))
    leader = shared.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("b"))
    pairs = written(shared.join(leader, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    # One text of every node that shares a bucket; it is found by its doc_id, which is spread evenly.
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("doc", "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    some = texts.join(wanted.select("doc").distinct(), "doc", "left_semi")
    nameless = texts.where("doc IS NULL")
    bag = bags(some.unionByName(nameless), k)
    bag = written(bag.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("bag").alias("bag")))
    stars = written(compared(pairs, bag))
    links = stars.where(linked(similarity)).select("a", "b")
    found = written(components(links))
    extra = written(compared(between(stars, found, similarity), bag).where(linked(similarity)).select("a", "b"))
    if not extra.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(extra))
    classes = nodes.select("node", "doc").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = classes.groupBy("component").agg(F.min("doc").alias("class_id"))
    by_node = classes.join(named, "component").select("node", "class_id")
    joined = signed.select("doc_id", "node", (F.col("n") > 0).alias("_w")).join(by_node, "node", "left")
    own = F.when(F.col("_w"), F.col("class_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", own.alias("class_id")).withColumn(
        "kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each class, with all their columns; rows with a null id stay."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
