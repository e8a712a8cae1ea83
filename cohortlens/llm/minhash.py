"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its distinct word n-grams; its signature holds, for each of ``COORDINATES`` hash functions, the least
hash of the set. Two sets agree in a coordinate with a chance equal to their similarity, so linked ones collide in at least t
coordinates, where t is the most that a linked pair falls short of with a chance under ``MISS``. Links are confirmed on the
whole sets.

1. *Posting.* Each document is posted under its coordinate-value pairs. A document that collides in fewer than t coordinates
   is done, which holds for most. Equal sets become one class, and what follows sees one document of each class.
2. *Stars.* In an early round each posting pairs its most central document (the one with the most collisions) with the
   others, so that a group of near copies becomes a star or a few, not all of its pairs. Linked documents take the name of
   the most linked one among them and their neighbours: equal names are of one component, which is all that is needed here.
3. *Merging.* What is left of a posting is counted in such names: a posting with one name can't link it to another, and
   documents that are left with fewer than t postings are done (skipped). So are those whose n-grams
   that stand in other components, too, are too few for a link: this is exact, and ends groups of copies that are alike but
   not linked. Of the others a document is posted under its prefix alone, all but the t - 1 postings of most components: two
   documents that collide in t postings meet in both prefixes. Members of the largest component of a posting are paired with
   the members of others only. Pairs of different components, of fitting sizes, with enough such n-grams and with odd
   sketches close enough are made distinct, and their collisions are counted over the whole signatures. An odd sketch has a
   bit for each of 512 ranges of hashes, set if it holds an odd number of n-grams: two sketches differ in no more bits than
   the sets differ in n-grams, so this, too, is exact.

Links decide components only, so this loses none between different texts but for ``MISS``.

Results for odd input: null or empty text has no n-grams and stays alone; fewer words than n are one n-gram; a null id has
component null, links nothing and is kept; repeated rows are one class, and all of them are kept or none; rows of one id with
different texts are judged apart; ids may be numbers or texts; very long texts are whole sets; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm.common import in_arrow, slices, splitmix, text_bytes
from cohortlens.llm.exchange import Keys, named, repeated, whole_number
from cohortlens.llm.ngram_join import _prints, _without_id, candidate_sets, classes, shingle_sets, verified
from cohortlens.operators.components import connected_components
from cohortlens.storage import erase, stored, written

COORDINATES = 64
#: Chance that a pair at the threshold collides in fewer coordinates than asked for.
MISS = 1e-9
#: Bits of an odd sketch.
BITS = 512
EARLY = 1


def least_collisions(percent: int, coordinates: int, miss: float) -> int:
    """The largest t for which a pair of that similarity collides in fewer than t coordinates with a chance of at most
    ``miss``; 1 at least."""
    tail = 0.0
    for t in range(coordinates + 1):
        tail += comb(coordinates, t) * (percent / 100) ** t * (1 - percent / 100) ** (coordinates - t)
        if tail > miss:
            return max(1, t)
    return coordinates


def signature_keys(tokens: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """For each set with tokens a row of keys, one for each coordinate: coordinate and least hash (32 bits), mixed one to one."""
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), coordinates), np.uint64)
    if len(counts):
        seeds = splitmix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for c in range(coordinates):
            least = np.minimum.reduceat((tokens ^ seeds[2 * c]) * (seeds[2 * c + 1] | np.uint64(1)), starts)
            out[:, c] = splitmix(np.uint64(c << 32) | least >> np.uint64(32))
    return out


def signature_kernel(words: int, coordinates: int):
    """Keys: the signature. Extra numbers: set size, two fingerprints, and the keys."""

    def kernel(batch: pa.RecordBatch) -> Keys:
        tokens, n = shingle_sets(*text_bytes(batch.column("text")), words)
        keys = signature_keys(tokens, n, coordinates)
        own = np.zeros((len(n), coordinates), np.uint64)
        own[n > 0] = keys
        many = np.where(n > 0, coordinates, 0)
        return Keys(keys.reshape(-1), np.tile(np.arange(coordinates), len(keys)), many, many, np.column_stack([n, _prints(tokens, n), own.view(np.int64)]))

    return kernel


def odd_sketches(sets: DataFrame) -> DataFrame:
    """(rk, odd): a bit for each of 512 ranges, whether an odd number of the n-grams of the set fall into it, as 8 longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "tokens", 1 << 20):
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u8")
                row = np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy(zero_copy_only=False))
                place = row * BITS + (splitmix(tokens + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(55)).astype(np.int64)
                odd = np.packbits(np.bincount(place, minlength=batch.num_rows * BITS) & 1).view("<i8").reshape(-1, BITS // 64)
                yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array(list(odd), pa.list_(pa.int64()))], ["rk", "odd"])

    return in_arrow(sets.select("rk", "n", "tokens"), run, "rk long, odd array<long>")


def _close(n: Column, m: Column, percent: int) -> Column:
    """Whether sketches odd_a and odd_b of sets of n and m n-grams differ in no more bits than linked sets do in n-grams."""
    apart = F.expr(" + ".join(f"bit_count(odd_a[{i}] ^ odd_b[{i}])" for i in range(BITS // 64)))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def star_names(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the one of most links among it and its neighbours (ties: the greatest), then
    with that one's name, and that one's, so that nodes of one name are connected, and stars whose hubs are linked are one."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    near = both.unionByName(degree.select("u", F.col("u").alias("v"))).join(degree.select(F.col("u").alias("v"), "d"), "v")
    found = near.groupBy(F.col("u").alias("node")).agg(F.max(F.struct("d", "v")).alias("m")).select("node", F.col("m.v").alias("component"))
    hubs = found.select(F.col("node").alias("component"), F.col("component").alias("next"))
    for _ in range(2):
        found = found.join(hubs, "component").select("node", F.col("next").alias("component"))
    return found


def star_pairs(postings: DataFrame, percent: int, own: bool) -> DataFrame:
    """(a, b): of each posting (key, rk, n, root, hits) of several components one member with the others: the most central
    one, or with ``own`` (in further rounds) one by the hash of posting and member."""
    order = F.xxhash64("key", "rk") if own else -F.col("hits")
    hub = F.min(F.struct(order.alias("o"), "rk", "n", "root")).alias("hub")
    hubs = postings.groupBy("key").agg(hub, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "hub")
    met = postings.join(hubs, "key").where((F.col("root") != F.col("hub.root")) & _fits(F.col("n"), F.col("hub.n"), percent))
    return met.select(F.least("rk", "hub.rk").alias("a"), F.greatest("rk", "hub.rk").alias("b")).distinct()


def contested(postings: DataFrame, least: int) -> DataFrame:
    """(key, rk, n, root, top, rank, total): postings of several components, of documents that have enough of them; ``top`` is
    the largest component of the posting, ranks go from the posting of fewest components on."""
    held = postings.groupBy("key", "root").agg(F.count("*").alias("c"))
    live = held.groupBy("key").agg(F.count("*").alias("spread"), F.max(F.struct("c", "root")).alias("m")).where("spread > 1").select("key", "spread", F.col("m.root").alias("top"))
    own = Window.partitionBy("rk")  # the postings of a document: as many as coordinates
    ranked = postings.join(live, "key").withColumns({"rank": F.row_number().over(own.orderBy("spread", "key")), "total": F.count("*").over(own)})
    return ranked.where(F.col("total") >= least).select("key", "rk", "n", "root", "top", "rank", "total")


def shared_tokens(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(rk, m): how many n-grams of each of the docs (rk, root) stand in another one's component, too; none for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "tokens", 1 << 20):
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<i8")
                n = batch.column("n").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in ("rk", "root")] + [pa.array(tokens)], ["rk", "root", "token"])

    long = in_arrow(sets.join(docs, "rk").select("rk", "root", "n", "tokens"), run, "rk long, root long, token long")
    several = long.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return long.join(several, "token").groupBy("rk").agg(F.count("*").alias("m"))


def prefix_pairs(ranked: DataFrame, shared: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b): all pairs of different components that meet in the prefixes of both and can be linked, as far as sizes,
    shared n-grams and sketches tell; each under its first common posting. ``shared`` has rk, m and odd."""
    prefix = ranked.where(F.col("rank") <= F.col("total") - least + 1).join(shared, "rk").where(F.col("m") * 100 >= F.col("n") * percent)
    own = Window.partitionBy("rk").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prefix = prefix.withColumn("all", F.collect_list("key").over(own))  # as many as coordinates, in an order that all share
    a, b = (prefix.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rk", "n", "root", "top", "m", "odd", "all"))) for s in "ab")
    once = (F.col("root_b") == F.col("top_b")) | (F.col("rk_a") < F.col("rk_b"))
    enough = F.least("m_a", "m_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    met = a.where("root_a <> top_a").join(b, "key").where((F.col("root_a") != F.col("root_b")) & once & enough & _fits(F.col("n_a"), F.col("n_b"), percent) & _close(F.col("n_a"), F.col("n_b"), percent) & (F.array_intersect("all_a", "all_b")[0] == F.col("key")))
    return met.select(F.least("rk_a", "rk_b").alias("a"), F.greatest("rk_a", "rk_b").alias("b"))


def colliding(pairs: DataFrame, signed: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs with close sketches that collide in at least so many coordinates of their whole signatures."""
    side = lambda s: signed.select(F.col("rk").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("keys", "n", "odd")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_close(F.col("n_a"), F.col("n_b"), percent))
    return both.where(F.size(F.array_intersect("keys_a", "keys_b")) >= least).select("a", "b")


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80, coordinates: int = COORDINATES, miss: float = MISS, early: int = EARLY) -> DataFrame:
    """One row per input row: the id column, n_shingles, component_id (the least id reachable by links) and kept."""
    spark, rows = df.sparkSession, named(df, id_col, text_col)
    least = least_collisions(percent, coordinates, miss)
    extras = ("n", "fp1", "fp2", *(f"k{c}" for c in range(coordinates)))
    marks = repeated(rows.where("doc_id is not null"), signature_kernel(words, coordinates), extras, all_rows=True)
    signatures = F.when(F.expr(f"length(marks) div 4 >= {least}"), F.array(*extras[3:])).alias("keys")
    info, info_path = stored(marks.select("dk", "rk", "n", "fp1", "fp2", F.expr("length(marks) div 4").alias("hits"), signatures), "signatures")
    wanted = classes(info).where(f"n > 0 and hits >= {least}").select("dk", "rk", "n", "hits")
    sets, sets_path = stored(candidate_sets(rows, wanted, words), "tokens")
    signatures = info.select("dk", "rk", "keys").where("keys is not null").dropDuplicates(["dk", "rk"])
    signed, signed_path = stored(wanted.join(signatures, ["dk", "rk"]).join(odd_sketches(sets), "rk").select("rk", "n", "hits", "keys", "odd"), "classes")
    links, root, paths = None, None, [info_path, signed_path, sets_path]
    for number in range(early + 1):
        rooted = signed.withColumn("root", F.col("rk")) if root is None else signed.join(root, signed.rk == root.node, "left").withColumn("root", F.coalesce("component", "rk"))
        postings = rooted.select(F.explode("keys").alias("key"), "rk", "n", "root", "hits")
        if number < early:
            pairs = star_pairs(postings, percent, own=number > 0)
        else:
            ranked, path = stored(contested(postings, least), "contested")
            paths.append(path)
            shared = shared_tokens(sets, ranked.select("rk", "root").distinct()).join(signed.select("rk", "odd"), "rk")
            pairs = prefix_pairs(ranked, shared, percent, least)
        found, path = stored(verified(colliding(pairs, signed, percent, least), sets, percent).select("a", "b"), "links")
        paths.append(path)
        links = found if links is None else links.unionByName(found)
        if number < early:
            root, path = stored(star_names(links), "names")
            paths.append(path)
    root = written(connected_components(links, "a", "b"), "roots")
    names = sets.select("rk", "dk").join(root, sets.rk == root.node).groupBy("component").agg(F.min("dk").alias("least"))
    of_class = classes(info).alias("c").join(root, F.col("c.rk") == root.node, "left").join(names, "component", "left")
    of_class = of_class.select("n", "fp1", "fp2", F.coalesce("least", "dk").alias("component_id"), F.coalesce("component", "rk").alias("component"))
    out = info.select("dk", "rk", "n", "fp1", "fp2").join(of_class, ["n", "fp1", "fp2"])
    own = lambda of, alone: F.when(F.col("n") > 0, F.col(of)).otherwise(F.col(alone)).alias(of)
    out = written(out.select("dk", "rk", "n", own("component", "rk"), own("component_id", "dk")), "components")
    for path in paths:
        erase(spark, path)
    kind = rows.schema["doc_id"].dataType
    if whole_number(rows, "doc_id"):
        whole = out.select(F.col("dk").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
    else:  # names are hashes: the least id is found among the ids themselves
        out = rows.where("doc_id is not null").select("dk", "rk", "doc_id").join(out.select("dk", "rk", "n", "component").distinct(), ["dk", "rk"])
        first = out.groupBy("component").agg(F.min("doc_id").alias("least"))
        alone = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
        whole = out.join(first, "component").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))
    whole = whole.unionByName(_without_id(rows, id_col, words))
    return whole.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
