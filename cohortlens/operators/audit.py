"""Profiles of a manifest, duplicates, quarantine and the canonical manifest."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalars import hamming
from cohortlens.schema import group_key

FIVE = (0.05, 0.5, 0.95)


def distribution(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """min, p05, median, p95 and max with linear interpolation, null when empty.

    Equal values are counted first, so what the exact percentiles hold grows with the distinct values."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    out = counted.groupBy(*by).agg(F.min("v").alias("min"), F.expr("percentile(v, array(0.05, 0.5, 0.95), n)").alias("p"), F.max("v").alias("max"))
    return out.select(*by, "min", *(F.col("p")[i].alias(name) for i, name in enumerate(("p05", "median", "p95"))), "max")


def suffix(path: str = "path") -> Column:
    found = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    return F.when(found == "", "<none>").otherwise(found)


def counters(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(counter, value, n) of several columns from one pass; null values aren't counted."""
    parts = F.array(*(F.struct(F.lit(name).alias("counter"), c.cast("string").alias("value")) for name, c in columns.items()))
    return df.select(F.explode(parts).alias("c")).select("c.*").where("value is not null").groupBy("counter", "value").agg(F.count("*").alias("n"))


def group_sizes(manifest: DataFrame) -> DataFrame:
    """Groups, records without a group, and the distribution of group sizes."""
    sizes = manifest.where("group_id is not null").groupBy("source", "group_id").agg(F.count("*").alias("n"))
    alone = manifest.agg(F.count_if(F.col("group_id").isNull()).alias("images_without_group"))
    return sizes.agg(F.count("*").alias("group_count")).crossJoin(alone).crossJoin(distribution(sizes, "n"))  # one row each


def unmanifested(listing: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Files that no record names."""
    return listing.join(manifest.select(path).distinct(), path, "left_anti")


def extents(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Least and largest value of each column, null when empty."""
    return df.agg(*(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))))


def cluster_summary(members: DataFrame, by: tuple[str, ...], identity: str = "path") -> DataFrame:
    """Per cluster: sorted paths, groups, labels and supplied splits, and what it crosses. Nulls and empty splits don't count."""
    sets = {"group_keys": group_key(), "labels": F.col("label"), "supplied_splits": F.when(F.col("supplied_split") != "", F.col("supplied_split")), "sources": F.col("source")}
    out = members.groupBy(*by).agg(F.sort_array(F.collect_list(identity)).alias("paths"), *(F.sort_array(F.collect_set(c)).alias(n) for n, c in sets.items()))
    flags = {"crosses_groups": "group_keys", "crosses_supplied_splits": "supplied_splits", "conflicting_labels": "labels", "crosses_sources": "sources"}
    return out.withColumns({name: F.size(of) > 1 for name, of in flags.items()})


def cluster_flags(members: DataFrame, by: tuple[str, ...], identity: str = "path") -> DataFrame:
    """Per cluster: its representative (the least member), number of members, and what it crosses; the same as
    ``cluster_summary`` tells, but without lists, so that a cluster of any size is a few partial sums."""
    values = {"crosses_groups": group_key(), "crosses_supplied_splits": F.when(F.col("supplied_split") != "", F.col("supplied_split")), "conflicting_labels": F.col("label"), "crosses_sources": F.col("source")}
    several = [F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(name) for name, c in values.items()]
    return members.groupBy(*by).agg(F.min(identity).alias("representative"), F.count("*").alias("members"), *several)


def memberships(manifest: DataFrame, digest: str = "digest", across: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact clusters in two tables: (by, representative, members, flags) of each cluster of two records or more (``across``:
    of several sources), and (by, representative, member) for each of its records, by a join that can split a hot digest."""
    by = (digest,) if across else ("in_source", digest)
    known = manifest.where(F.col(digest).isNotNull()).withColumns({"in_source": F.col("source"), "member": F.concat("source", F.lit(":"), "path") if across else F.col("path")})
    clusters = cluster_flags(known, by, "member").where("crosses_sources" if across else "members > 1")
    return clusters, known.join(clusters.select(*by, "representative"), list(by)).select(*by, "representative", "member")


def exact_clusters(manifest: DataFrame, digest: str = "digest", across: bool = False) -> DataFrame:
    """Clusters of records of one digest: inside each source, or ``across`` sources (named source:path then).

    Sizes are counted first and joined, so only records of clusters are gathered."""
    by = (digest,) if across else ("source", digest)
    known = manifest.where(F.col(digest).isNotNull())
    several = F.max("source") != F.min("source") if across else F.count("*") > 1
    sizes = known.groupBy(*by).agg(several.alias("kept")).where("kept").drop("kept")
    members = known.join(sizes, list(by)).withColumn("key", F.concat("source", F.lit(":"), "path"))
    renamed = members.withColumn("in_source", F.col("source"))
    return cluster_summary(renamed, (digest,) if across else ("in_source", digest), "key" if across else "path")


def quarantine_reasons(exact: bool) -> Column:
    """Why a cluster is set aside: equal content or sketches at distance 0 with conflicting labels, and such sketches
    across supplied splits."""
    if exact:
        reasons = [F.when(F.col("conflicting_labels"), "exact_label_conflict")]
    else:
        zero = F.col("distance") == 0
        reasons = [F.when(zero & F.col("conflicting_labels"), "phash_zero_label_conflict"), F.when(zero & F.col("crosses_supplied_splits"), "phash_zero_split_crossing")]
    return F.array_compact(F.array(*reasons))


def classified(clusters: DataFrame, exact: bool) -> DataFrame:
    out = clusters.withColumn("quarantine_reasons", quarantine_reasons(exact))
    return out.withColumn("quarantine_eligible", F.size("quarantine_reasons") > 0)


#: Hashes up to which all of those that share a band are compared.
HOT_BAND = 2_000


def near_pairs(hashes: DataFrame, most: int = 5, bands: int = 4, path: str = "path", by: tuple[str, ...] = (), hot: int = HOT_BAND) -> DataFrame:
    """(by, hash_a, hash_b, distance) of distinct 64-bit hashes that share a band of 64 / bands bits and differ in at most
    ``most`` bits. Pairs that differ in every band are missed by design: bands find all up to bands - 1 bits.

    Equal hashes are one before the join, and a pair counts in its first shared band only, so no distinct is needed. A band
    that more than ``hot`` hashes share is split: if two of them differ in at most ``most`` bits, then one of the other bands
    differs in at most most / (bands - 1) of them. So one side is dealt by each other band, the other one by each value of it
    that so few flips lead to; what meets agrees in one band and nearly in a second one. The pairs are the same."""
    if bands < 2:
        raise ValueError("at least two bands")
    width = 64 // bands
    chunk = lambda h, b: F.shiftrightunsigned(h, width * (bands - 1 - b)).bitwiseAND(F.lit((1 << width) - 1))
    distinct = hashes.where("hash is not null").select(*by, "hash").distinct()
    dealt = distinct.select(*by, "hash", F.posexplode(F.array(*(chunk(F.col("hash"), b) for b in range(bands)))).alias("band", "chunk"))
    # hashes are unsigned numbers: flipping the top bit makes the signed order theirs
    less = F.col("hash_a").bitwiseXOR(F.lit(-(1 << 63))) < F.col("hash_b").bitwiseXOR(F.lit(-(1 << 63)))
    x = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    apart = lambda b: F.bit_count(chunk(x, b))
    first = reduce(and_, (~((F.col("band") > b) & (apart(b) == 0)) for b in range(bands - 1)), F.lit(True))

    def told(joined: DataFrame) -> DataFrame:
        pairs = joined.where(less & first).withColumn("distance", hamming(F.col("hash_a"), F.col("hash_b")).cast("int"))
        return pairs.where(F.col("distance") <= most).select(*by, "hash_a", "hash_b", "distance")

    keys = [*by, "band", "chunk"]
    side = lambda df, s: df.withColumnRenamed("hash", f"hash_{s}")
    marked = dealt.join(dealt.groupBy(*keys).agg((F.count("*") > hot).alias("hot")), keys)
    cold, split = marked.where("not hot").drop("hot"), marked.where("hot").drop("hot")
    flips = most // (bands - 1)
    masks = [sum(1 << i for i in at) for k in range(flips + 1) for at in combinations(range(width), k)]
    others = split.withColumn("other", F.explode(F.array(*map(F.lit, range(bands))))).where("other <> band")
    value = reduce(lambda c, b: c.when(F.col("other") == b, chunk(F.col("hash"), b)), range(1, bands), F.when(F.col("other") == 0, chunk(F.col("hash"), 0)))
    exact = others.withColumn("near", value)
    flipped = exact.withColumn("near", F.explode(F.transform(F.array(*(F.lit(m).cast("bigint") for m in masks)), lambda m: m.bitwiseXOR(F.col("near")))))
    earliest = reduce(and_, (~((F.col("other") > b) & (F.col("band") != b) & (apart(b) <= flips)) for b in range(bands - 1)), F.lit(True))
    met = side(flipped, "a").join(side(exact, "b"), [*keys, "other", "near"]).where(earliest)
    return told(side(cold, "a").join(side(cold, "b"), keys)).unionByName(told(met))


def near_edges(manifest: DataFrame, most: int = 5, across: bool = False) -> DataFrame:
    """(source, hash_a, hash_b, distance; without source ``across`` sources): equal hashes of two records or more (distance
    0) and near pairs of hashes. Each is a cluster; what needs none of its members needs no more than this."""
    by = () if across else ("source",)
    known = manifest.where("hash is not null" if across else "hash is not null and source is not null")
    same = known.groupBy(*by, "hash").agg(F.count("*").alias("n")).where("n > 1").select(*by, F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance"))
    return same.unionByName(near_pairs(known, most, by=by)) if most else same  # different hashes are further apart than 0


def near_clusters(manifest: DataFrame, most: int = 5, across: bool = False) -> DataFrame:
    """Clusters of equal hashes (distance 0) and of near pairs of hashes, each with all its members' summary. Quarantine and
    components go by those of distance 0: with ``most`` 0 only they are looked for, and no pairs are compared."""
    by = () if across else ("source",)
    known = manifest.where("hash is not null").withColumn("key", F.concat("source", F.lit(":"), "path"))
    sides = near_edges(manifest, most, across).select(*by, "hash_a", "hash_b", "distance", F.explode(F.array_distinct(F.array("hash_a", "hash_b"))).alias("hash"))
    members = sides.join(known, [*by, "hash"])
    keys = ("hash_a", "hash_b", "distance")
    if not across:
        members = members.withColumn("in_source", F.col("source"))
        keys = ("in_source", *keys)
    out = cluster_summary(members, keys, "key" if across else "path")
    return out.where("crosses_sources") if across else out


def apply_decisions(manifest: DataFrame, exact: DataFrame, near: DataFrame, key: str = "key", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The manifest without quarantined records, copies and repeated rows; and (quarantined, deduplicated) counts.

    ``exact`` and ``near`` are (paths, quarantine_eligible) with paths as keys. Every path of an eligible cluster goes; of
    each exact cluster the least of the paths left stays; of equal keys the row of least ``order`` stays, or of rows that
    agree in it too the least by all columns: always exactly one. A null order comes first. Rows without a key are all kept."""
    both = exact.select("paths", "quarantine_eligible").unionByName(near.select("paths", "quarantine_eligible"))
    out = both.where("quarantine_eligible").select(F.explode("paths").alias("k")).distinct()
    left = exact.select(F.xxhash64("paths").alias("c"), "paths", F.explode("paths").alias("k")).join(out, "k", "left_anti")
    least = left.groupBy("c", "paths").agg(F.min("k").alias("canonical"))
    copies = left.join(least, ["c", "paths"]).where("k <> canonical").select("k").distinct()
    rows = manifest.select(F.col(key).alias("k"), F.struct(F.col(order).alias("o"), F.to_json(F.struct("*")).alias("j")).alias("place"), F.struct("*").alias("row"))
    kept = rows.join(out, "k", "left_anti").join(copies, "k", "left_anti")
    firsts = kept.where("k is not null").groupBy("k").agg(F.min_by("row", "place").alias("row"), F.count("*").alias("n"))
    repeats = firsts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
    counts = out.agg(F.count("*").alias("quarantined")).crossJoin(copies.agg(F.count("*").alias("copies"))).crossJoin(repeats)  # one row each
    whole = firsts.select("row").unionByName(kept.where("k is null").select("row")).select("row.*")
    return whole, counts.select("quarantined", (F.col("copies") + F.col("repeats")).alias("deduplicated"))


def integrity_failures(invalid: int, exact: DataFrame, near: DataFrame) -> DataFrame:
    """(position, message) rows of what makes an audit fail."""
    # Messages by reason, in the order of reporting.
    messages = [("exact_label_conflict", "exact duplicate components have conflicting labels"), ("phash_zero_label_conflict", "pHash-distance-zero components have conflicting labels"), ("phash_zero_split_crossing", "pHash-distance-zero components cross supplied splits")]
    reasons = exact.select(F.explode("quarantine_reasons").alias("r")).unionByName(near.select(F.explode("quarantine_reasons").alias("r"))).distinct()
    spark = exact.sparkSession
    table = spark.createDataFrame([(i + 1, r, m) for i, (r, m) in enumerate(messages)], "position int, r string, message string")
    found = table.join(reasons, "r", "left_semi").select("position", "message")
    first = spark.createDataFrame([(0, f"{invalid} invalid or missing manifest image(s)")] if invalid else [], "position int, message string")
    return first.unionByName(found)


def distance_shares(clusters: DataFrame) -> DataFrame:
    """(distance, n, share) of clusters."""
    counts = clusters.groupBy("distance").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a few distances


def review_clusters(clusters: DataFrame, integrity: bool, distances: list[int] | None = None) -> DataFrame:
    """Clusters that break integrity, or those left for review; of some distances if asked."""
    out = clusters.where(F.col("quarantine_eligible") == integrity)
    return out if distances is None else out.where(F.col("distance").isin(distances))


def audit_summary(exact: DataFrame, near: DataFrame, by: str = "in_source") -> DataFrame:
    """Per source: clusters of either kind, those with conflicting labels and those that cross supplied splits."""
    parts = [df.select(by, F.lit(kind).alias("kind"), "conflicting_labels", "crosses_supplied_splits", "quarantine_eligible") for kind, df in (("exact", exact), ("near", near))]
    sums = [F.count_if((F.col("kind") == k) & c).alias(f"{k}_{name}") for k in ("exact", "near") for name, c in (("clusters", F.lit(True)), ("label_conflicts", F.col("conflicting_labels")), ("cross_split", F.col("crosses_supplied_splits")), ("quarantine", F.col("quarantine_eligible")))]
    return parts[0].unionByName(parts[1]).groupBy(by).agg(*sums)
