import gzip
import hashlib

import pytest

from cohortlens.llm import files, queries, warc
from cohortlens.storage import new_path


def brute(rows, least=1000):
    kept = {}
    for key, url, html in rows:
        if key is not None:
            data = (html or "").encode()
            kept[key] = max(kept.get(key, ((False, ""), "", b"")), ((url is not None, url or ""), hashlib.sha1(data).hexdigest(), data))
    pay = {k: v[2] for k, v in kept.items()}
    last = {}
    for k, p in pay.items():
        last[p] = max(last.get(p, k), k)
    out = []
    for k, p in pay.items():
        again = len(p) >= least and last[p] != k
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None))
    return sorted(out)


ROWS = [(i, f"http://a/{i}", t) for i, t in enumerate(["x" * 1000, "x" * 999, "x" * 1000, None, "", "x" * 999, "é" * 500, "é" * 500, "é" * 499, "\r\n\r\nWARC/1.1\r\n" * 100])] + [(20, None, "x" * 1000), (21, "http://b c/\r\n", "y"), (None, "u", "z"), (4, "http://a/4", ""), (4, "http://a/4", "other"), (4, None, "third")]


def got(df):
    return sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string")
    one, two = new_path(spark, "warc"), new_path(spark, "warc")
    manifest = warc.write(df.repartition(4), one, roll_bytes=300)
    assert len(manifest) > 3
    assert got(warc.read(spark, one)) == brute(ROWS)
    payload = {r.key: r.payload for r in warc.read(spark, one).collect()}
    assert bytes(payload[9]) == ROWS[9][2].encode()
    assert payload[0] is None and bytes(payload[20]) == b"x" * 1000
    # the same rows in another layout give the same bytes
    assert warc.write(df.repartition(4).orderBy("html"), two, roll_bytes=300) == manifest
    assert all(files.get(one, name) == files.get(two, name) for name, _, _ in manifest)


def test_changed_files_are_found(spark):
    folder = new_path(spark, "warc")
    (name, *_), *_ = warc.write(spark.createDataFrame([(1, "u", "some payload")], "page_id long, url string, html string"), folder)
    data = gzip.decompress(files.get(folder, name))
    with pytest.raises(warc.Malformed):
        list(warc.records(gzip.compress(data.replace(b"some payload", b"same payload"))))
    with pytest.raises(warc.Malformed):
        list(warc.records(gzip.compress(data[:-9])))


def test_empty_table(spark):
    folder = new_path(spark, "warc")
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder) == []
    assert warc.read(spark, folder).collect() == []


def test_query(spark, sf_dir):
    out = sorted(tuple(r) for r in queries.op6_warc(spark, sf_dir).collect())
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert out == brute(rows)


def test_query_writes_every_row(spark, tmp_path):
    """By the rules of OP6_SQL: ids that repeat or are null have a record for each row."""
    rows = [*ROWS, (4, "http://a/4", "other"), (5, "u", "x" * 1000), (20, "v", "x" * 1000), (None, None, "x" * 1000), (None, None, "x" * 1000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    last, want = {}, []
    for k, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if k is None else k)
    for k, _, t in rows:
        data = (t or "").encode()
        again = k is not None and len(data) >= 1000 and last[t or ""] != k
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[t or ""] if again else None))
    out = [tuple(r) for r in queries.op6_warc(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted(want, key=str)
    folder = new_path(spark, "warc")
    manifest = warc.write(spark.read.parquet(str(tmp_path / "pages.parquet")), folder, every=True)
    heads = [h for name, _, _ in manifest for h, _ in warc.records(files.get(folder, name)) if h["warc-type"] != "warcinfo"]
    full = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert len({h["warc-record-id"] for h in heads}) == len(rows)
    assert {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"} <= full
