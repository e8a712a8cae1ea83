"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by their id over ranges, so that shard files hold consecutive ids. Range bounds come from Spark's sample:
the same input gives the same files, but on large tables another layout of the same rows may cut them elsewhere. A shard
rolls to a new file when its compressed size passes ``ROLL_BYTES``. Every record is a gzip member of its own with regenerated
headers: record id, date, lengths and SHA-1 digests follow from the record alone, so its bytes are the same in any file. A
payload of at least ``LEAST`` bytes that equals another's is stored once, in the record of largest id; the others become
revisit records that refer to it. A file is written under a temporary name and renamed; files that aren't in the manifest,
which is written last, don't belong to the archive.

Which records are revisits is settled by grouping (length, SHA-1, SHA-256) digests, so a hot payload is a sum of partial
maxima, never a gathered group. Results for odd input: a null payload is empty; a null url is ``urn:record:<id>``. With
``every`` each row has a record: those of one id differ by url, digest and a number in their record ids, and rows without
an id are full records without a key; very long payloads are one record each; of equal payloads the one of the greatest id
is stored; an empty table gives an archive without files; other columns, whatever their names, are not read. Otherwise rows
of one id keep one record, of the greatest url and then SHA-1, and rows without an id are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import files
from cohortlens.llm.common import in_arrow, slices

LEAST, ROLL_BYTES = 1000, 64 << 20
#: Records have no capture time of their own, and the writer's clock would make files differ.
DATE = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:record")


def record_id(key: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(key))}>"


def occurrence(key: int | None, url: str | None, sha1: str, number: int = 0) -> str:
    """Names one of several records of a key, or of none."""
    return f"{'' if key is None else key}/{sha1}/{number}/{'' if url is None else 'u' + url}"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def target(key: int | str, url: str | None) -> str:
    return "".join(c for c in url if c > " ") if url and url.strip() else f"urn:record:{key}"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, number: int | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record. ``number`` counts equal rows where each has a record."""
    sha1 = hashlib.sha1(payload).hexdigest() if number is not None else ""
    name, referred = (key, refers_to) if number is None else (occurrence(key, url, sha1, number), occurrence(refers_to, refers_url, sha1))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), ("WARC-Target-URI", target(sha1 if key is None else key, url)), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), *([] if key is None else [("X-Record-Key", str(key))]), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(referred)), ("WARC-Refers-To-Target-URI", target(refers_to, refers_url)), ("WARC-Refers-To-Date", DATE), ("WARC-Profile", PROFILE), ("X-Refers-To-Key", str(refers_to))]
    return _member([*headers, ("Content-Type", "application/http; msgtype=response")], block)


def _rows(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.col(payload_col) if dict(df.dtypes)[payload_col] == "binary" else F.encode(F.col(payload_col).cast("string"), "utf-8")
    return df.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))


def judged(rows: DataFrame, least: int = LEAST, every: bool = False) -> DataFrame:
    """key, url, sha1, and of revisits refers_to and refers_url: one row for each key, without payloads; with ``every`` one
    for all equal rows."""
    told = rows.select("key", "url", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha2"))
    told = told.distinct() if every else told.groupBy("key").agg(F.max(F.struct("url", "sha1", "size", "sha2")).alias("r")).select("key", "r.*")
    by = ["size", "sha1", "sha2"]
    groups = told.where(F.col("size") >= least).groupBy(by).agg(F.max(F.struct("key", "url")).alias("last"), F.count("*").alias("n")).where("n > 1")
    found = told.join(groups.select(*by, "last"), by, "left")
    revisit = F.col("last.key") > F.col("key")
    return found.select("key", "url", "sha1", F.when(revisit, F.col("last.key")).alias("refers_to"), F.when(revisit, F.col("last.url")).alias("refers_url"))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES, least: int = LEAST, every: bool = False) -> list[tuple[str, int, int]]:
    """Writes the shard files and returns the manifest: (file, records, bytes), in the order of the ids.

    Payloads move once: the small table of verdicts takes part in the range sort, each verdict before its payload."""
    rows = _rows(df, id_col, url_col, payload_col)
    rows = rows if every else rows.where("key is not null")
    verdicts = judged(rows, least, every).select("key", F.lit(0).alias("kind"), "url", "sha1", "refers_to", "refers_url", F.lit(None).cast("binary").alias("payload"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("sha1", "string"), ("refers_to", "long"), ("refers_url", "string"))]
    nothing[0] = F.sha1("payload").alias("sha1") if every else nothing[0]
    by = ["key", "url", "sha1"] if every else ["key"]
    both = verdicts.unionByName(rows.select("key", F.lit(1).alias("kind"), "url", *nothing, "payload"))
    ordered = both.repartitionByRange(*by).sortWithinPartitions(*by, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, done, count, verdict, number = TaskContext.get().partitionId(), None, [], 0, None, 0
        for whole in batches:
            for batch in slices(whole, "payload", 8 << 20):
                for key, kind, url, sha1, refers_to, refers_url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == 0:
                        verdict, number = (key, url, sha1, refers_to, refers_url), 0
                        continue
                    if every:
                        if verdict[:3] != (key, url, sha1):
                            raise RuntimeError(f"no verdict for a row of {key}")
                    elif verdict is None or verdict[:2] != (key, url) or verdict[2] != hashlib.sha1(payload).hexdigest():
                        continue  # another row of this key has been kept
                    if out is None:
                        name = f"shard-{task:06d}-{len(done):05d}.warc.gz"
                        out, count = files.Committed(folder, name), 0
                        out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(record(key, url, payload, *verdict[3:], number if every else None))
                    verdict, number = verdict if every else None, number + 1
                    count += 1
                    if out.size >= roll_bytes:
                        out.commit()
                        done.append((name, count, out.size))
                        out = None
        if out is not None:
            out.commit()
            done.append((name, count, out.size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "records", "bytes"])

    manifest = sorted(tuple(r) for r in in_arrow(ordered, run, "file string, records long, bytes long").collect())
    files.put(folder, "manifest.tsv", "".join(f"{a}\t{b}\t{c}\n" for a, b, c in manifest).encode())
    return manifest


class Malformed(ValueError):
    """A record that doesn't follow the format, or whose digest doesn't hold."""


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file; digests of blocks are checked."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise Malformed(f"no record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise Malformed("a record is cut short")
        if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
            raise Malformed("a block was changed")
        yield headers, block


RECORD = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record in the files of the manifest. ``payload_digest`` is SHA-1 in lower-case
    hex; a revisit's payload is null here, and its size and digest are those of the full payload."""
    names = [(line.split("\t")[0],) for line in files.get(folder, "manifest.tsv").decode().splitlines()]
    if not names:
        return spark.createDataFrame([], RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

        def full(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in RECORD.split(", ")])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in records(files.get(folder, name)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and _sha1(payload) != headers["warc-payload-digest"]:
                        raise Malformed(f"{name}: a payload was changed")
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = len(payload) if payload is not None else int(headers["x-payload-length"])
                    key, refers = headers.get("x-record-key"), headers.get("x-refers-to-key")
                    rows.append((int(key) if key else None, headers["warc-target-uri"], kind, size, digest, int(refers) if refers else None, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield full(rows)
                        rows, held = [], 0
                if rows:
                    yield full(rows)

    return in_arrow(spark.createDataFrame(names, "file string").repartition(len(names)), run, RECORD)
