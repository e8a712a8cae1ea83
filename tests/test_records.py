import hashlib
import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens import catalog, schema
from cohortlens.operators import audit, eda, splits
from cohortlens.operators.components import connected_components
from cohortlens.plans import views


def manifest(spark, rows):
    """Rows of (path, label, group, split[, digest, hash, source])."""
    shape = "seq long, path string, source string, label string, raw_label string, group_id string, supplied_split string, digest string, hash long"
    full = [(i, r[0], r[6] if len(r) > 6 else "s", r[1], r[1], r[2], r[3], r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, shape)


def clusters(spark, rows):
    return spark.createDataFrame(rows, "paths array<string>, quarantine_eligible boolean, distance int")


@pytest.mark.parametrize(
    ("exact", "distance", "conflict", "crossing", "reasons"),
    [(True, None, True, False, ["exact_label_conflict"]), (True, None, False, True, []), (False, 0, True, False, ["phash_zero_label_conflict"]), (False, 0, False, True, ["phash_zero_split_crossing"]), (False, 4, True, True, [])],
)
def test_quarantine_policy(spark, exact, distance, conflict, crossing, reasons):
    df = spark.createDataFrame([(distance, conflict, crossing)], "distance int, conflicting_labels boolean, crosses_supplied_splits boolean")
    row = audit.classified(df, exact).first()
    assert row.quarantine_reasons == reasons and row.quarantine_eligible == bool(reasons)


def test_near_pairs(spark):
    df = manifest(spark, [("a", "amd", "1", "train", None, 0), ("b", "amd", "2", "test", None, 7)])
    row = audit.near_clusters(df, 3).first()
    assert (row.paths, row.distance, row.crosses_groups, row.crosses_supplied_splits) == (["a", "b"], 3, True, True)
    assert audit.near_clusters(df, 2).count() == 0
    # one bit in each of the four bands: near, but no band in common
    far = manifest(spark, [("a", "amd", "1", None, None, 0), ("b", "amd", "2", None, None, 0x0001000100010001)])
    assert audit.near_clusters(far, 5).count() == 0


def test_near_pairs_are_each_there_once_and_unsigned(spark):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(6):
            w = v
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                w ^= 1 << b
            values.add(w)
    want = Counter()
    for a in values:
        for b in values:
            if a < b and any((a >> s) & 0xFFFF == (b >> s) & 0xFFFF for s in (0, 16, 32, 48)) and (a ^ b).bit_count() <= 5:
                want[a, b] += 1
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values for _ in range(2)], "hash long")
    got = Counter((r.hash_a % (1 << 64), r.hash_b % (1 << 64)) for r in audit.near_pairs(df).collect())
    assert got == want and len(want) > 50


@pytest.mark.parametrize(("most", "bands", "hot"), [(5, 4, 0), (5, 4, 3), (7, 4, 0), (3, 2, 0)])
def test_split_bands_find_the_same_pairs(spark, most, bands, hot):
    rnd = random.Random(most)
    values = set()
    for v in [rnd.getrandbits(64) for _ in range(8)]:
        for _ in range(12):
            w = v
            for b in rnd.sample(range(64), rnd.randrange(0, 7)):
                w ^= 1 << b
            values.add(w)
    width = 64 // bands
    shared = lambda a, b: any((a >> s) % (1 << width) == (b >> s) % (1 << width) for s in range(0, 64, width))
    want = Counter((a, b) for a in values for b in values if a < b and shared(a, b) and (a ^ b).bit_count() <= most)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, "s") for v in values], "hash long, source string")
    got = Counter((r.hash_a % (1 << 64), r.hash_b % (1 << 64)) for r in audit.near_pairs(df, most, bands, by=("source",), hot=hot).collect())
    assert got == want and want


def test_a_hot_band_is_not_compared_pair_by_pair(spark):
    """100,000 hashes that share a band: candidates are a small part of their pairs, and planted pairs are found."""
    mixed = F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1)).bitwiseOR(F.lit(7 << 48))
    df = spark.range(100_000).select(mixed.alias("hash"))
    planted = df.limit(50).select(F.col("hash").bitwiseXOR(F.lit((1 << 40) | (1 << 20) | (1 << 3))).alias("hash"))
    found = audit.near_pairs(df.unionByName(planted)).collect()
    assert len([r for r in found if r.distance == 3]) >= 50 and len(found) < 1000


def test_exact_clusters(spark):
    df = manifest(spark, [("a", "amd", "1", "", "d"), ("b", "dme", None, "train", "d"), ("c", "amd", "1", None, "e"), ("x", "amd", "1", None, "d", None, "t")])
    row = audit.exact_clusters(df).first()
    assert row.paths == ["a", "b"] and row.group_keys == ["s:1"] and row.supplied_splits == ["train"]
    assert (row.conflicting_labels, row.crosses_groups, row.crosses_supplied_splits) == (True, False, False)
    across = audit.exact_clusters(df, across=True).first()
    assert across.paths == ["s:a", "s:b", "t:x"] and across.crosses_sources


def test_decisions(spark):
    df = manifest(spark, [("a", "amd", "1", None), ("b", "amd", "1", None), ("a", "amd", "1", None), ("c", "amd", "2", None)]).withColumn("key", F.concat("source", F.lit(":"), "path"))
    kept, counts = audit.apply_decisions(df, clusters(spark, [(["s:a", "s:b"], False, None)]), clusters(spark, [(["s:b", "s:c"], True, 0)]))
    assert [(r.path, r.seq) for r in kept.collect()] == [("a", 0)]
    assert tuple(counts.first()) == (2, 1)
    # the copy that stays is the least of those left
    kept, counts = audit.apply_decisions(df, clusters(spark, [(["s:a", "s:b", "s:c"], False, None)]), clusters(spark, [(["s:a", "s:z"], True, 0)]))
    assert [r.path for r in kept.collect()] == ["b"] and tuple(counts.first()) == (2, 1)


def test_one_row_of_each_key_stays(spark):
    """Rows of a key that agree in their order, or in everything, are repeats too."""
    df = manifest(spark, [("a", "amd", "1", None), ("a", "amd", "1", None), ("a", "amd", "2", None), ("b", "amd", "1", None), ("c", "amd", None, None), ("c", "amd", None, None)])
    df = df.withColumns({"key": F.concat("source", F.lit(":"), "path"), "seq": F.xxhash64("path"), "k": F.lit(1), "row": F.lit("x")})
    none = clusters(spark, [([], False, 0)]).limit(0)
    kept, counts = audit.apply_decisions(df.repartition(3), none, none)
    assert sorted((r.path, r.group_id) for r in kept.collect()) == [("a", "1"), ("b", "1"), ("c", None)] and kept.columns == df.columns
    assert tuple(counts.first()) == (0, 3)
    kept, counts = audit.apply_decisions(df.withColumn("key", F.lit(None).cast("string")), none, none)
    assert kept.count() == 6 and tuple(counts.first()) == (0, 0)


def test_integrity_messages(spark):
    both = spark.createDataFrame([(["phash_zero_split_crossing", "phash_zero_label_conflict"],)], "quarantine_reasons array<string>")
    none = both.limit(0)
    got = [r.message for r in audit.integrity_failures(2, none, both).orderBy("position").collect()]
    assert got == ["2 invalid or missing manifest image(s)", "pHash-distance-zero components have conflicting labels", "pHash-distance-zero components cross supplied splits"]
    assert audit.integrity_failures(0, none, none).count() == 0


def test_distribution_and_counters(spark):
    df = spark.createDataFrame([(float(i), "a.PNG" if i % 2 else "dir.x/b") for i in range(5)] + [(None, "c.jpg")], "v double, path string")
    assert tuple(audit.distribution(df, "v").first()) == (0.0, pytest.approx(0.2), 2.0, pytest.approx(3.8), 4.0)
    assert tuple(audit.distribution(df.where("v > 99"), "v").first()) == (None,) * 5
    got = {(r.counter, r.value): r.n for r in audit.counters(df, {"suffix": audit.suffix(), "big": F.when(F.col("v") > 3, "yes")}).collect()}
    assert got == {("suffix", ".png"): 2, ("suffix", "<none>"): 3, ("suffix", ".jpg"): 1, ("big", "yes"): 1}


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(5, None), (None, 6), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_linked_groups_stay_together(spark):
    df = manifest(spark, [(f"p{i}", "amd" if i % 3 else "dme", str(i % 10), None) for i in range(60)])
    links = clusters(spark, [(["s:p0", "s:p1"], False, 0), (["s:p1", "s:p2", "s:gone"], False, 0), (["s:p3", "s:p4"], False, 2)])
    assigned, components = splits.derived_splits(df, links, {"train": 0.7, "val": 0.15, "test": 0.15}, 13)
    split = {r.group_key: r.split for r in assigned.collect()}
    assert len(split) == 10 and split["s:0"] == split["s:1"] == split["s:2"]
    assert {r.group_key: r.component for r in components.collect()}["s:2"] == "s:0"
    done = splits.applied(df, assigned)
    assert splits.derived_violations(done, components).collect() == []
    bad = done.withColumn("split", F.when(F.col("path") == "p0", "other").otherwise(F.col("split")))
    assert {r.kind for r in splits.derived_violations(bad, components).collect()} == {"group", "component"}
    with pytest.raises(Exception, match="no split"):
        splits.applied(df, assigned.where("group_key <> 's:5'")).collect()
    with pytest.raises(ValueError, match="needs a group"):
        splits.derived_splits(df.withColumn("group_id", F.lit(None).cast("string")), links, {"a": 1.0}, 1)


def test_derived_violations_where_every_group_crosses(spark):
    rows = spark.createDataFrame([("s0", g, split) for g in "ab" for split in ("train", "test")] + [("s1", "c", "train")], "source string, group_id string, split string")
    components = rows.select(F.concat("source", F.lit(":"), "group_id").alias("group_key")).distinct().withColumn("component", F.substring("group_key", 1, 2))
    found = {tuple(r) for r in splits.derived_violations(rows, components).collect()}
    assert found == {("group", f"group assigned to multiple splits: s0:{g}") for g in "ab"} | {("component", "pHash-zero linked groups cross splits: s0:a, s0:b")}


def test_sketches_equal_brute_force(spark, tmp_path):
    """Counts are made where a text lies: no row for each token. Documents that share an id are one."""
    texts = [(1, "A b\x0bC \u00a0d a É"), (2, None), (3, ""), (4, "x y " * 50 + "z"), (4, "q r s"), (5, "\x1c word\x85 é")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for key in {k for k, _ in texts}:
        tokens = [t for k, text in texts if k == key for t in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if t]
        counts = Counter(int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 64 for t in tokens)
        middle = statistics.median(counts[s] for s in range(64))
        bits = sum(1 << 63 - s for s in range(64) if counts[s] > middle)
        want[str(key)] = bits - (1 << 64) if bits >> 63 else bits
    found = views.sketches(spark, str(tmp_path))
    assert {r.path: r.hash for r in found.collect()} == want and found.count() == len(want)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_shares_of_distances_need_no_members(spark):
    df = manifest(spark, [(f"p{i}", "amd", "g", None, "d", h, s) for i, (h, s) in enumerate([(1, "a"), (1, "a"), (3, "a"), (1, "b"), (7, "b"), (1 << 40, "b")])])
    for across in (False, True):
        edges, whole = audit.near_edges(df, across=across), audit.near_clusters(df, across=across)
        if not across:
            assert sorted(map(tuple, audit.distance_shares(edges).collect())) == sorted(map(tuple, audit.distance_shares(whole).collect()))
        assert edges.count() >= whole.count() > 0


@pytest.mark.parametrize("name", ["q25_quarantine", "q26_canonical_manifest", "q34_greedy_split", "q63_decision_counts"])
def test_quarantine_and_components_compare_no_pairs(spark, sf_dir, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("pairs of different hashes are compared")

    monkeypatch.setattr(audit, "near_pairs", none)
    catalog.QUERIES[name](spark, sf_dir)


def test_supplied_test_is_kept(spark):
    df = manifest(spark, [("a", "amd", "1", "test"), ("b", "amd", "2", "train"), ("c", "amd", "3", "train")])
    assigned, _ = splits.derived_splits(df, clusters(spark, []), {"train": 0.85, "val": 0.15}, 1, keep_supplied_test=True)
    assert {r.group_key: r.split for r in assigned.collect()}["s:1"] == "test"
    with pytest.raises(ValueError, match="cross"):
        splits.derived_splits(df, clusters(spark, [(["s:a", "s:b"], False, 0)]), {"train": 1.0}, 1, keep_supplied_test=True)


def test_units_with_several_labels_are_read_whole(spark, monkeypatch):
    df = manifest(spark, [(f"{g}{t}{i}", t, g, "test" if t == "dme" else None) for g in "123" for t in ("amd", "dme", "normal") for i in range(2)])
    monkeypatch.setattr(splits, "MOST_UNITS", 3)
    units = splits._units(df, splits.group_components(df, clusters(spark, [])))
    assert units == [((f"s:{g}",), {"amd": 2, "dme": 2, "normal": 2}, {"test"}) for g in "123"]
    monkeypatch.setattr(splits, "MOST_UNITS", 2)
    with pytest.raises(ValueError, match="more than 2 units"):
        splits._units(df, splits.group_components(df, clusters(spark, [])))


def test_greedy_assignment_balances_labels():
    units = [((f"g{i}",), {"amd": 1 + i % 4, "dme": i % 3}) for i in range(60)]
    got = splits.greedy_assignment(units, {"train": 0.7, "val": 0.15, "test": 0.15}, 3)
    assert got == splits.greedy_assignment(units, {"train": 0.7, "val": 0.15, "test": 0.15}, 3)
    for label in ("amd", "dme"):
        total = sum(c[label] for _, c in units)
        share = sum(c[label] for (g,), c in units if got[g] == "train") / total
        assert abs(share - 0.7) < 0.05
    with pytest.raises(ValueError):
        splits.greedy_assignment(units, {"train": 0.0}, 3)


def test_folds(spark):
    df = manifest(spark, [(f"{label}{g}-{i}", label, f"{label}{g}", None) for label in schema.LABELS for g in range(15) for i in range(2)])
    rows = splits.stratified_folds(df, clusters(spark, []), 5, 3, 20260913).collect()
    by = Counter((r.fold, r.split) for r in rows)
    assert all(by[f, "test"] == 9 and by[f, "val"] == 9 for f in range(5))
    assert max(Counter(r.group_key for r in rows if r.split == "test").values()) == 1
    with pytest.raises(ValueError, match="evenly"):
        splits.stratified_folds(df, clusters(spark, []), 4, 3, 1)
    counts = splits.hash_folds(df, 5).groupBy("label", "fold").count().collect()
    assert all(r["count"] == 3 for r in counts)


def test_ratio_splits(spark):
    df = manifest(spark, [(f"p{i}", "amd", str(i), None) for i in range(20)])
    got = Counter(r.split for r in splits.shuffled_group_splits(df, {"train": 70, "val": 15, "test": 15}, 3).collect())
    assert got == {"train": 14, "val": 3, "test": 3}
    with pytest.raises(ValueError):
        splits.shuffled_group_splits(manifest(spark, [("a", "amd", None, None)]), {"train": 1}, 1)


def test_supplied_validation(spark):
    df = manifest(spark, [("a", "amd", "1", "train"), ("a", "amd", "1", "test"), ("b", "amd", None, "train"), ("c", "amd", "2", "train")])
    assert sorted(map(tuple, splits.supplied_violations(df).collect()), key=str) == [("duplicate_path", "a", None), ("leaked_group", "s:1", "test,train"), ("without_group", "1", None)]


def test_records_round_trip(spark, tmp_path):
    from cohortlens.sources.manifests import read_manifest, read_split
    from cohortlens.sources.sinks import write_manifest

    rows = [("a/b.png", "s", "AMD", "amd", ["normal", "amd"], "1", "eye", "e", None, "train", "test"), ("c.png", "s", "NORMAL", "normal", ["amd", "normal"], None, "image", None, None, None, None)]
    df = spark.createDataFrame(rows, schema.MANIFEST)
    write_manifest(df, str(tmp_path / "m.jsonl"))
    back = read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert sorted(map(tuple, back.collect())) == sorted((*r[:4], sorted(r[4]), *r[5:]) for r in rows)
    line = spark.read.text(str(tmp_path / "m.jsonl")).first().value
    assert line.index('"available_labels"') < line.index('"cohort"') < line.index('"supplied_split"')
    assert read_split(spark, str(tmp_path / "m.jsonl"), "test").count() == 1
    with pytest.raises(ValueError):
        read_split(spark, str(tmp_path / "m.jsonl"), "val")
    (tmp_path / "bad.jsonl").write_text('{"path": "x"}\n\n{oops\n')
    with pytest.raises(Exception, match="Malformed|malformed|FAILFAST"):
        read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    assert schema.label_violations(df.withColumn("label", F.lit("dme"))).count() == 2
    with pytest.raises(Exception, match="isn't available"):
        schema.checked_labels(df.withColumn("label", F.lit("dme"))).collect()
    assert schema.canonical_labels(["dme", "normal"]) == ("normal", "dme")
    with pytest.raises(ValueError):
        schema.parse_labels([])


def whole(df):
    """With every column of a record."""
    given = {"available_labels": F.array(F.lit("amd"), F.lit("dme")), "label_unit": F.lit("image")}
    missing = {f.name: given.get(f.name, F.lit(None).cast(f.dataType)) for f in schema.MANIFEST.fields if f.name not in df.columns}
    return df.withColumns(missing)


def test_a_bad_line_is_named(spark, tmp_path):
    """Also if it lies in a later split of its file, after blank lines."""
    from cohortlens.sources.manifests import malformed_lines, numbered_lines, read_manifest

    df = whole(manifest(spark, [(f"p{i}", "amd", "g", None) for i in range(400)]))
    lines = [r.value for r in schema.serialised(df).collect()]
    lines[7:7] = ["", "   "]
    (tmp_path / "good.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        assert spark.read.text(str(tmp_path / "good.jsonl")).rdd.getNumPartitions() > 3
        assert {r.line: r.value for r in numbered_lines(spark, str(tmp_path / "good.jsonl")).collect()} == dict(enumerate(lines, 1))
        assert read_manifest(spark, str(tmp_path / "good.jsonl"), checked=True).count() == 400
        rows = read_manifest(spark, str(tmp_path / "good.jsonl"), numbered=True).collect()
        assert {r.seq: r.path for r in rows} == {i: x.split('"path":"')[1].split('"')[0] for i, x in enumerate(lines, 1) if x.strip()}
        bad = [*lines]
        bad[350], bad[360] = '{"path": "x"', '{"path": "only"}'
        (tmp_path / "bad.jsonl").write_text("\n".join(bad))
        assert [r.line for r in malformed_lines(spark, str(tmp_path / "bad.jsonl")).orderBy("line").collect()] == [351, 361]
        with pytest.raises(ValueError, match=r"bad\.jsonl:351"):
            read_manifest(spark, str(tmp_path / "bad.jsonl"), checked=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_last_of_repeated_paths_counts(spark, tmp_path):
    from cohortlens.sources.manifests import read_predictions

    known = whole(manifest(spark, [("a", "dme", "1", None), ("a", "amd", "2", None), ("b", "dme", "3", None)]))
    (tmp_path / "p.csv").write_text("path,target,probability_amd,probability_dme\na,amd,0.4,0.6\nb,dme,0.1,0.9\n")
    rows = {r.path: r.group_key for r in read_predictions(spark, str(tmp_path / "p.csv"), known, "t", "s").rows.collect()}
    assert rows == {"a": "s:2", "b": "s:3"}


def test_memberships_of_a_hot_digest(spark):
    df = manifest(spark, [(f"p{i}", "amd" if i else "dme", "1", "", "d") for i in range(300)] + [("x", "amd", None, "train", "e"), ("y", "amd", None, "train", "e"), ("z", "amd", None, None, "f")])
    flags, members = audit.memberships(df)
    got = {r.digest: r for r in flags.collect()}
    assert (got["d"].members, got["d"].representative, got["d"].conflicting_labels, got["d"].crosses_supplied_splits) == (300, "p0", True, False)
    assert set(got) == {"d", "e"} and members.groupBy("representative").count().count() == 2 and members.count() == 302
    whole = {r.digest: r for r in audit.exact_clusters(df).collect()}
    assert all(tuple(got[k][c] for c in ("crosses_groups", "crosses_supplied_splits", "conflicting_labels")) == tuple(whole[k][c] for c in ("crosses_groups", "crosses_supplied_splits", "conflicting_labels")) for k in whole)


def test_exploration(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", None, 3.0), ("b", "y", 0.3)], "k string, c string, v double")
    assert {(r.k, r.c): r.n for r in eda.group_counts(df, ("k", "c")).collect()}["a", "none"] == 1
    assert {r.c for r in eda.tail_bucketed(df, "c", 2).collect()} == {"x", "other"}
    assert [tuple(r) for r in eda.outer_shares(df.where("k = 'a'"), df.where("k = 'b'"), "k", ("l", "r")).orderBy("k").collect()] == [("a", 1.0, 0.0), ("b", 0.0, 1.0)]
    assert eda.at_least(df, ("k",), 2).count() == 3
    assert [r.c for r in eda.most_frequent(df.where("c is not null"), "c", 1).collect()] == ["x"]
    hist = {r.bin: r.n for r in eda.fixed_histogram(df, "v", 1.0, 2.0, 2, ("k",)).collect()}
    assert hist == {0: 1, 1: 1}
    assert [tuple(r) for r in eda.rate(df, F.col("v") > 1, ("k",)).orderBy("k").collect()] == [("a", 3, pytest.approx(2 / 3)), ("b", 1, 0.0)]


def test_greedy_assignment_by_hand():
    """The cost in full, unit by unit, against the table form."""
    rnd = random.Random(4)
    units = [((f"g{i}",), {k: rnd.randrange(1, 6) for k in rnd.sample(["amd", "dme", "cnv"], 2)}) for i in range(40)]
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    order = list(range(40))
    random.Random(9).shuffle(order)
    goal = {s: {k: r * sum(c.get(k, 0) for _, c in units) for k in ("amd", "dme", "cnv")} for s, r in ratios.items()}
    have = {s: dict.fromkeys(("amd", "dme", "cnv"), 0) for s in ratios}
    want = {}
    for i in sorted(order, key=lambda i: (-sum(units[i][1].values()), order.index(i))):
        grows = {s: sum(((have[s][k] + units[i][1].get(k, 0) - t) ** 2 - (have[s][k] - t) ** 2) / max(t, 1) for k, t in goal[s].items()) for s in ratios}
        least = min(grows.values())
        want[f"g{i}"] = next(s for s in ratios if grows[s] <= least + 1e-9)
        for k, n in units[i][1].items():
            have[want[f"g{i}"]][k] += n
    assert splits.greedy_assignment(units, ratios, 9) == want


def one_by_one(vectors, ratios):
    """Counts by vector and split of units dealt in turn, with fractions."""
    from fractions import Fraction

    labels, names = range(len(vectors[0])), list(ratios)
    whole = sum(Fraction(r) for r in ratios.values())
    goal = {s: [Fraction(r) / whole * sum(v[i] for v in vectors) for i in labels] for s, r in ratios.items()}
    have, out = {s: [0] * len(vectors[0]) for s in ratios}, {}
    for v in sorted(vectors, key=lambda v: (-sum(v), v)):
        cost = {s: sum(((have[s][i] + v[i] - goal[s][i]) ** 2 - (have[s][i] - goal[s][i]) ** 2) / max(goal[s][i], 1) for i in labels) for s in ratios}
        best = min(names, key=lambda s: (cost[s], names.index(s)))
        have[best] = [h + x for h, x in zip(have[best], v, strict=True)]
        out.setdefault(v, dict.fromkeys(names, 0))[best] += 1
    return {v: list(c.values()) for v, c in out.items()}


@pytest.mark.parametrize(("seed", "units", "ratios"), [(1, 10_000, {"train": 0.7, "val": 0.15, "test": 0.15}), (2, 700, {"a": 0.85, "b": 0.15}), (3, 300, {"a": 1, "b": 1, "c": 1, "d": 2}), (4, 3, {"a": 1, "b": 1})])
def test_dealing_runs_equals_one_by_one(seed, units, ratios):
    rnd = random.Random(seed)
    kinds = [tuple(rnd.randrange(4) * rnd.randrange(3) for _ in range(3)) for _ in range(12)] + [(0, 0, 0), (5, 0, 0)]
    vectors = [rnd.choice(kinds[: 3 + i % 12]) for i in range(units)]
    got = splits.dealt_runs(dict(Counter(vectors)), ratios)
    want = one_by_one(vectors, ratios)
    assert {v: got[v] for v in want} == want and set(got) == set(want)


def test_splits_by_runs(spark):
    rows = [(f"p{g}-{i}", ("amd", "dme")[g % 2], str(g), "test" if g % 10 == 0 else "train") for g in range(60) for i in range(1 + g % 3)]
    df = manifest(spark, rows)
    none = spark.createDataFrame([], "paths array<string>, distance int")
    got, components = splits.derived_splits(df, none, {"train": 0.8, "val": 0.2}, 1, True, by_runs=True)
    dealt = {r.group_key: r.split for r in got.collect()}
    assert len(dealt) == 60 and {dealt[f"s:{g}"] for g in range(0, 60, 10)} == {"test"} and splits.derived_violations(splits.applied(df, got), components).count() == 0
    units = Counter((1 + g % 3, g % 2, dealt[f"s:{g}"]) for g in range(60) if g % 10)
    want = one_by_one([((1 + g % 3), 0) if g % 2 == 0 else (0, 1 + g % 3) for g in range(60) if g % 10], {"train": 0.8, "val": 0.2})
    for v, (train, val) in want.items():
        size, odd = sum(v), int(v[0] == 0)
        assert (units[size, odd, "train"], units[size, odd, "val"]) == (train, val)


def test_balanced_batches(spark):
    rows = [("a", "x", i) for i in range(50)] + [("a", "y", 100 + i) for i in range(3)] + [("b", "x", 200)] + [(None, "x", 1), ("b", None, 2)]
    df = spark.createDataFrame(rows, "source string, target string, n int").repartition(4)
    got = splits.balanced_batches(df, 8, 200, seed=1).collect()
    assert len(got) == 1600 and Counter(r.batch for r in got) == dict.fromkeys(range(200), 8)
    by = Counter((r.source, r.target) for r in got)
    assert by["b", "x"] == 800 and abs(by["a", "x"] - 400) < 80 and set(by) == {("a", "x"), ("a", "y"), ("b", "x")}
    assert len({r.n for r in got if r.target == "x" and r.source == "a"}) == 50
    again = splits.balanced_batches(df, 8, 200, seed=1).select("batch", "position", "source", "target")
    assert sorted(map(tuple, again.collect())) == sorted((r.batch, r.position, r.source, r.target) for r in got)
    assert splits.balanced_batches(df, 8, 200, seed=1, epoch=1).select("batch", "position", "target").exceptAll(again.select("batch", "position", "target")).count() > 0
    assert splits.balanced_batches(df.limit(0), 8, 2, seed=1).collect() == []


def test_balanced_batches_after_a_shuffle(spark):
    """Every place is filled, however the rows have been dealt and whatever adaptive execution makes of it."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "4k")
        spark.conf.set(names[1], "40")
        rows = spark.range(20_000).selectExpr("id", "concat('s', id % 4) as source", "cast(id % 7 % 3 as int) as target", "cast(id as string) as at", "1 as r")
        for given in (rows.repartition("id"), rows.groupBy("id", "source", "target", "at", "r").count(), rows.unionByName(rows)):
            got = splits.balanced_batches(given, 16, 200, seed=3)
            found = got.collect()
            assert len(found) == 3200 and len({(r.batch, r.position) for r in found}) == 3200 and got.count() == 3200
            assert got.columns == ["batch", "position", *given.columns]
            assert Counter(r.source for r in found) == dict.fromkeys(["s0", "s1", "s2", "s3"], 800)
            assert len({r.id for r in found}) > 2800
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
