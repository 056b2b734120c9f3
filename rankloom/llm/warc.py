"""WARC archives: writing, reading, and capture histories by external index merge.

Each task writes its pages as one gzip-compressed WARC 1.1 file, a member for each record, and sorts what it wrote by URL
key and time into a run of index rows.  Runs are dealt out by ranges of the key; each range merges its pieces of all runs
with a tree of losers, so that the ranges in order are the captures of all archives in order.  Archives go to the shared
folder under names of their own, and only those that the written index names are read: a task that is lost or runs twice
leaves a file that nothing refers to.

A payload of at least ``LEAST`` bytes that several pages share is stored once, with the smallest page_id; the others are
revisit records that refer to it.
Rules for odd rows: null html is an empty payload; a null url is the empty one; null page_ids are larger than all others;
rows that repeat the smallest page_id are responses all; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import column
from .runtime import fresh_dir, parts, prepare, written

LEAST = 100
LEVEL = 1
SALTS = 16
#: Captures without a time of their own lie a second apart from here on, in the order of their ids.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_INDEX = "url_key string, captured string, page_id {kind}, archive string, offset long, length long, record_type string, refers_to {kind}, payload_digest string, payload_bytes long"


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, lower case, without scheme, www. or fragment, so that hosts sort together."""
    try:
        p = urlsplit(url.strip())
        host = (p.hostname or "").removeprefix("www.")
        port = f":{p.port}" if p.port not in (None, 80, 443) else ""
        return f"{','.join(reversed(host.split('.')))}{port}){(p.path or '/').lower()}{'?' + p.query.lower() if p.query else ''}"
    except ValueError:
        return url.strip().lower()


def record(kind: str, uri: str, date: str, digest: str, payload: bytes, record_id: str, refers_to: str | None = None) -> bytes:
    """One WARC record: headers, an HTTP head, and the payload unless it is a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(uri.split())}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def merge(runs: list[Iterator]) -> Iterator:
    """The items of sorted runs in order, by a tree of losers: each item costs log2(number of runs) comparisons, and ties
    go to the earlier run.  Only one item of each run is held."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # a place not yet filled wins, and moves up until it meets a run
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k

    def replay(run: int) -> int:
        node = (run + k) // 2
        while node:
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        return run

    winner = -1
    for run in range(k - 1, -1, -1):
        winner = replay(run)
    while heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        winner = replay(winner)


def with_kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, refers_to (null for responses).

    Only digests are grouped, with partial sums; the digests that repeat come back by a join in which a digest that many
    pages share is salted."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    again = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first")).where("_n > 1")
    copies = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("payload_digest", "_first", "_salt")
    joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(copies, ["payload_digest", "_salt"], "left")
    revisit = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Writes the archives into the folder and returns the index rows, a sorted run for each archive."""
    prepare(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        name, out, at, rows = f"{uuid.uuid4().hex}.warc.gz", None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    packed = _member(record("warcinfo", "", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ"), hashlib.sha256(b"").hexdigest(), b"", f"<urn:archive:{name}>"), level)
                    out.write(packed)
                    at = len(packed)
                payload = (r["html"] or "").encode()
                date = (EPOCH + timedelta(seconds=(r["page_id"] or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                what = "response" if r["refers_to"] is None else "revisit"
                to = None if r["refers_to"] is None else _record_id(r["refers_to"])
                packed = _member(record(what, r["url"], date, r["payload_digest"], payload, _record_id(r["page_id"]), to), level)
                out.write(packed)
                rows.append((url_key(r["url"]), date, r["page_id"], name, at, len(packed), what, r["refers_to"], r["payload_digest"], len(payload)))
                at += len(packed)
        if out is not None:
            out.close()
        rows.sort(key=lambda x: (x[0], x[1], x[4]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (2, 7) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], names=_names(kind))

    return pages.mapInArrow(run, _INDEX.format(kind=kind))


def _names(kind: str) -> list[str]:
    return [x.split()[0] for x in _INDEX.format(kind=kind).split(", ")]


def _member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def histories(index: DataFrame) -> DataFrame:
    """The index in global order of (url_key, captured), with ``shard`` and ``position``: ranges of the key, each merged
    from its pieces of all runs.  The order is that of (shard, position)."""
    names = index.columns
    ranged = index.repartitionByRange(parts(index.sparkSession), "url_key", "captured", "archive")

    def run(batches):
        from pyspark import TaskContext

        runs: dict[str, list] = {}
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                row = dict(zip(names, r))
                runs.setdefault(row["archive"], []).append(((row["url_key"], row["captured"], row["archive"], row["offset"]), r))
        for pieces in runs.values():
            pieces.sort(key=lambda x: x[0])  # blocks of a run can arrive out of turn; in order this is one pass
        merged = [x[1] for x in merge([iter(p) for _, p in sorted(runs.items())])]
        shard = TaskContext.get().partitionId()
        for i in range(0, len(merged), 10_000):
            some = merged[i : i + 10_000]
            arrays = [pa.array(c, t) for c, t in zip(zip(*some), types)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([shard] * len(some), pa.int32()), pa.array(range(i, i + len(some)), pa.int64())], names=[*names, "shard", "position"])

    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()] for f in index.schema.fields]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)
    return ranged.mapInArrow(run, f"{kinds}, shard int, position long")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Reads the records that the index names, in its order, and what their bytes say: page_id, url_key, captured,
    record_type, refers_to, payload_digest and payload_bytes (of a revisit: those of the record it refers to), payload."""
    prepare(index.sparkSession)
    kind = index.schema["page_id"].dataType.simpleString()

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        for batch in batches:
            rows, files = [], {}
            want = sorted(batch.to_pylist(), key=lambda r: (r["archive"], r["offset"]))
            for r in want:
                if r["archive"] not in files:
                    files = {r["archive"]: fs.open_input_file(f"{base}/{r['archive']}")}
                f = files[r["archive"]]
                f.seek(r["offset"])
                fields, payload = parse(zlib.decompress(f.read(r["length"]), 31))
                what = fields["WARC-Type"]
                if what == "response" and hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
                    raise ValueError(f"record {fields['WARC-Record-ID']} of {r['archive']} is damaged")
                to = fields.get("WARC-Refers-To")
                rows.append((r["page_id"], r["url_key"], r["captured"], what, int(to[10:-1]) if to else None, fields["WARC-Payload-Digest"].removeprefix("sha256:"), r["payload_bytes"] if what == "revisit" else len(payload), r["shard"], r["position"]))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url_key", "captured", "record_type", "refers_to", "payload_digest", "payload_bytes", "shard", "position"])

    # Each task opens the archives whose records it is dealt; records of one archive stay together.
    return index.repartition(parts(index.sparkSession), "archive", F.floor(F.col("offset") / (8 << 20))).mapInArrow(run, f"page_id {kind}, url_key string, captured string, record_type string, refers_to {kind}, payload_digest string, payload_bytes long, shard int, position long")


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, merges the index, reads all back: a row for each page."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    runs = written(write(with_kinds(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")), folder), "runs")
    return read(written(histories(runs), "captures"), folder)


ORACLE = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > f THEN f END AS refers_to FROM f
"""
