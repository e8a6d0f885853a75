"""WARC archives with a two-level capture index.

Writing: every task writes one archive of gzip members (a record each) to the
shared folder under a name of its own attempt; what the successful attempts
report is staged, so files of lost attempts are never read.

Index: the capture lines, keyed by reversed-host URL, are range-partitioned and
sorted. Each shard holds compressed blocks of BLOCK lines and a sparse directory
(the first key and place of every block). The driver keeps one line a shard.

Lookup: keys go to their shards by binary search over the shards' first keys,
a task searches its shard's directory, reads that block alone, searches it, and
the records are then read by range, in order of file and offset.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.llm.blocked_bloom import with_maybe
from hitlens.llm.common import shared_path, sliced, stage
from hitlens.llm.url_filter import host_and_rest

BLOCK = 1000
LEVEL = 4
#: Payloads below this size are always stored in full.
LEAST_REVISIT = 1000
DATE = "2026-01-01T00:00:00Z"


def capture_key(url: Column) -> Column:
    """Reversed-host key: com,example,www)/path?query, without scheme and fragment.
    Control characters and blanks become _; a URL without host has the key )."""
    host, rest = host_and_rest(url)
    name = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.regexp_replace(F.concat(name, F.lit(")"), F.regexp_extract(rest, r"^[^#]*", 0)), r"[\x00-\x20\x7F]", "_")


def _open(path: str):
    """The file system and the path on it of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record; its digest and size are those of the stored
    payload, or for a revisit those it states."""
    raw = gzip.decompress(member)
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.split(b"\r\n\r\n", 1)[1]
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged record of {fields['WARC-Target-URI']}")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
        "url": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
    }


def _with_copies(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, winner); winner: the page_id whose record holds
    the payload, where several pages have it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = rows.filter(F.octet_length("html") >= LEAST_REVISIT)
    copies = stage(large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 AND winner IS NOT NULL").select("digest", "winner"), "copies")
    # pages without a copy are not shuffled
    probed = with_maybe(rows, "digest", copies.select("digest"), "maybe")
    joined = probed.filter("maybe").join(copies, "digest", "left").select("page_id", "url", "html", "digest", "winner")
    return probed.filter("NOT maybe").select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("winner")).unionByName(joined)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives in
    folder; (key, page_id, file, at, size) of each record, staged.

    Of records with equal payloads of LEAST_REVISIT bytes or more the one with
    the largest page_id is the response (repeated rows of that page_id all
    are), the others revisit it. A null html is an empty payload, a null url an
    empty one; a null page_id never is the largest.
    """

    def run(batches):
        files, folder_at = _open(folder)
        files.create_dir(folder_at, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in sliced(batches, 200):
            places = []
            for page_id, url, html, digest, winner in zip(*(c.to_pylist() for c in batch.columns[1:])):
                kind = "response" if winner is None or winner == page_id else "revisit"
                member = record(page_id, url, html.encode(), digest, kind, winner)
                if out is None:
                    out = files.open_output_stream(f"{folder_at}/{name}", compression=None)
                out.write(member)
                places.append((at, len(member)))
                at += len(member)
            ats, sizes = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([name] * len(ats), pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())],
                names=["key", "page_id", "file", "at", "size"],
            )
        if out is not None:
            out.close()

    rows = _with_copies(pages).select(capture_key(F.col("url")).alias("key"), "page_id", "url", "html", "digest", "winner")
    return stage(rows.mapInArrow(run, "key string, page_id long, file string, at long, size long"), "captures")


def build_index(captures: DataFrame, folder: str, shards: int | None = None, block: int = BLOCK) -> list[tuple[str, str]]:
    """Write the index of captures to folder; (first key, file) of each shard in
    order of key. A key may go on in the next shard."""
    spark = captures.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        files, folder_at = _open(folder)
        files.create_dir(folder_at, recursive=True)
        name, out, at, directory, lines, first = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], None

        def flush():
            nonlocal out, at, lines
            if out is None:
                out = files.open_output_stream(f"{folder_at}/{name}", compression=None)
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            directory.append((json.loads(lines[0])[0], at, len(packed)))
            at, lines = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                first = row[0] if first is None else first
                lines.append(json.dumps(row))
                if len(lines) == block:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{folder_at}/{name}.dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "file"])

    # strings are compared by their UTF-8 bytes, here and in the searches below
    ordered = captures.select("key", "file", "at", "size").repartitionByRange(shards, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    return sorted(((r.first, r.file) for r in ordered.mapInArrow(run, "first string, file string").collect()), key=lambda s: s[0].encode())


def find(keys: DataFrame, index: list[tuple[str, str]], folder: str) -> DataFrame:
    """The places (key, file, at, size) of all captures of the distinct keys (key)."""
    spark = keys.sparkSession
    firsts = [k.encode() for k, _ in index]

    def send(batches):
        for batch in batches:
            found, shard = [], []
            for key in batch.column(0).to_pylist():
                low = max(bisect.bisect_left(firsts, key.encode()) - 1, 0)
                for s in range(low, bisect.bisect_right(firsts, key.encode())):
                    found.append(key)
                    shard.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(shard, pa.int32())], names=["key", "shard"])

    def table_of(out):
        columns = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "at", "size"])

    def search(batches):
        files, folder_at = _open(folder)
        out: list[list] = []
        at_shard, directory, starts, source, at_block, lines, line_keys = None, [], [], None, None, [], []
        for batch in sliced(batches, 2000):
            for key, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at_shard:
                    path = f"{folder_at}/{index[shard][1]}"
                    with files.open_input_file(path + ".dir") as d:
                        directory = json.loads(zlib.decompress(d.read()))
                    starts, source, at_shard, at_block = [d[0].encode() for d in directory], files.open_input_file(path), shard, None
                wanted = key.encode()
                for b in range(max(bisect.bisect_left(starts, wanted) - 1, 0), bisect.bisect_right(starts, wanted)):
                    if b != at_block:
                        lines = [json.loads(x) for x in zlib.decompress(source.read_at(directory[b][2], directory[b][1])).decode().split("\n")]
                        line_keys, at_block = [x[0].encode() for x in lines], b
                    out += lines[bisect.bisect_left(line_keys, wanted) : bisect.bisect_right(line_keys, wanted)]
                    # a hot key has many blocks: what is held is one of them
                    if len(out) >= BLOCK:
                        yield table_of(out)
                        out = []
        yield table_of(out)

    sent = keys.select("key").filter("key IS NOT NULL").distinct().mapInArrow(send, "key string, shard int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(tasks, "shard").sortWithinPartitions("shard", "key").mapInArrow(search, "key string, file string, at long, size long")


def read_records(places: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at places (file, at, size), read by range: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url, and the payload."""
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 6 + payloads]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        files, folder_at = _open(folder)
        name, source = None, None
        for batch in sliced(batches, 1000):
            rows = []
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, source = file, files.open_input_file(f"{folder_at}/{file}")
                rows.append(parse(source.read_at(size, at)))
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types)], names=fields)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    # runs of 4 MB of a file are a task's work, so that one large archive is shared out
    run_of = F.floor(F.col("at") / (4 << 20))
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.select("file", "at", "size").repartition(tasks, "file", run_of).sortWithinPartitions("file", "at").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archive all pages, index them, and read every page back by its URL's key:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of pages, repeated rows included; an empty table gives
    none. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = shared_path(spark, "warc")
    index = build_index(write_archives(pages, folder), folder)
    keys = pages.select(capture_key(F.col("url").cast("string")).alias("key"))
    places = stage(find(keys, index, folder), "places")
    return read_records(places, folder).drop("url")
