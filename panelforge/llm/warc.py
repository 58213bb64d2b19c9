"""Operator 3: WARC archives with a two-level capture index.

Writing: payloads get a SHA-1 digest; of the records with one digest the one
with the largest page_id is the response, the others revisit it without a
payload. Each task writes one archive of gzip members and reports every
record's place. Indexing: captures are sorted by reversed-host URL key over
range partitions; each partition becomes an index file of compressed blocks
with a sparse directory (first key, offset and length of each block) at its
end, and a top directory has one row a file. Lookup: binary search in the top
directory, in the file's directory and in one or two blocks, then a range read
of the record.

Scale: the top directory has a row for each index file; files grow with the
number of captures, so that it never has more than ``TOP`` rows. Lookups are
dealt by index file and range reads by archive, in pieces of bounded size, so a
hot host or archive is not one task. Payloads stay where they are as long as
the digests that repeat are few (a checked size). Archives, index and tables of
places lie in the shared folder; a task that runs again writes under a new name,
and only names that a finished task reported are used.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.llm.common import fresh_path, materialize, read

#: Captures in an index block and least in an index file, index files at most, captures looked up and records read by a task at once, repeated digests that are broadcast.
BLOCK = 512
FILE = 20_000
TOP = 100_000
PIECE = 2_000
BROADCAST = 100_000
#: Payloads of at least this many bytes are deduplicated.
LEAST_PAYLOAD = 0
VERSION = "WARC/1.1"
PLACES = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, without scheme, ``www.``, port 80 or 443, user and fragment.

    What can't be parsed as a URL is its own key; null is the empty URL.
    """
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


@F.pandas_udf(T.StringType())
def surt_of(urls: pd.Series) -> pd.Series:
    return urls.map(surt)


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(kind: str, page: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, a gzip member of its own; a header line can't hold line breaks, so those are percent-encoded."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            places, digests = [], []
            for page, url, digest, kind, refers, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "record_type", "refers_to", "payload")), strict=True):
                digests.append(base32(digest))
                data = record(kind, page, url, digests[-1], payload or b"", refers)
                out.write(data)
                places.append((at, len(data)))
                at += len(data)
            n = batch.num_rows
            cols = [batch.column("page_id"), batch.column("url"), pa.array(digests, pa.string()), batch.column("record_type"), batch.column("refers_to"), pa.array([name] * n, pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)``; returns the places of the records.

    Null html is an empty payload, a null url an empty target. Rows that repeat
    a ``page_id`` are written each. A row whose ``page_id`` is null revisits any
    other record of its payload; where all those are null too, each is a
    response. Payloads of fewer than ``least`` bytes are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    newest = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).where("copies > 1 and newest is not null").select("digest", "newest")
    newest = materialize(newest, "warc-newest")
    joined = rows.join(F.broadcast(newest) if newest.count() <= BROADCAST else newest, "digest", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("page_id"))
    typed = joined.select("page_id", "url", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    # the places are written before anything reads them: they name exactly the archives of the tasks that finished
    return materialize(typed.mapInArrow(_write(folder), PLACES), "warc-places")


def page_key(page: Column) -> Column:
    """A page's id as text for the index; null is the empty text."""
    return F.coalesce(page.cast("string"), F.lit(""))


def _index(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at, directory, held = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(r) for r in held).encode())
            out.write(data)
            directory.append((held[0][0], held[0][1], at, len(data)))
            at += len(data)
            held.clear()

        for frame in frames:
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            for key, page, file, offset, length in zip(frame["key"], frame["page"], frame["file"], frame["offset"], frame["length"], strict=True):
                held.append((key, page, file, int(offset), int(length)))
                if len(held) >= BLOCK:
                    flush()
        if out:
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
            out.close()
            yield pd.DataFrame([(directory[0][0], directory[0][1], name, at, len(tail))], columns=["key", "page", "index_file", "offset", "length"])

    return run


def build_index(places: DataFrame, folder: str) -> DataFrame:
    """Write the index of the given places; returns the top directory, one row for each index file."""
    keyed = places.select(surt_of("url").alias("key"), page_key(F.col("page_id")).alias("page"), "file", "offset", "length")
    files = min(TOP, max(1, places.count() // FILE))
    ranged = keyed.repartitionByRange(files, "key", "page").sortWithinPartitions("key", "page", "file", "offset")
    return materialize(ranged.mapInPandas(_index(folder), "key string, page string, index_file string, offset long, length long"), "warc-top")


def _search(folder: str):
    """Binary search in an index file's directory and blocks for the captures wanted of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['index_file']}") as source:
                    directory = json.loads(zlib.decompress(source.read_at(row["length"], row["offset"])))
                    firsts = [tuple(d[:2]) for d in directory]
                    blocks: dict[int, list] = {}
                    found = []
                    for want in sorted({(w["key"], w["page"]) for w in row["wanted"]}):
                        at = max(0, bisect.bisect_left(firsts, want) - 1)
                        while at < len(firsts) and firsts[at] <= want:
                            if at not in blocks:
                                blocks = {at: [tuple(x) for x in map(json.loads, zlib.decompress(source.read_at(directory[at][3], directory[at][2])).decode().split("\n"))]}
                            block = blocks[at]
                            i = bisect.bisect_left(block, want)
                            while i < len(block) and block[i][:2] == want:
                                found.append(block[i])
                                i += 1
                            at += 1
                if found:
                    key, page, file, offset, length = zip(*found, strict=True)
                    pages = pa.array([int(p) if p else None for p in page], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pages, pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["key", "page_id", "file", "offset", "length"])

    return run


def lookup(wanted: DataFrame, top: DataFrame, folder: str) -> DataFrame:
    """``(key, page_id, file, offset, length)`` of the captures named by ``wanted(key, page_id)``, through the index.

    Repeated wishes are one; what the index lacks gives no row.
    """
    spark = wanted.sparkSession
    rows = top.orderBy("key", "page").collect()  # at most TOP rows
    firsts = [(r["key"], r["page"]) for r in rows]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pages = batch.column("key").to_pylist(), batch.column("page").to_pylist()
            at = [max(0, bisect.bisect_right(firsts, (k, p)) - 1) for k, p in zip(keys, pages, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page"), pa.array(at, pa.int32())], ["key", "page", "part"])

    if not rows:
        return spark.createDataFrame([], "key string, page_id long, file string, offset long, length long")
    dealt = wanted.select("key", page_key(F.col("page_id")).alias("page")).mapInArrow(deal, "key string, page string, part int")
    dealt = materialize(dealt, "warc-wanted")
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most TOP rows
    cut = [(i, r["index_file"], r["offset"], r["length"], math.ceil(counts[i] / PIECE)) for i, r in enumerate(rows) if i in counts]
    files = spark.createDataFrame(cut, "part int, index_file string, offset long, length long, pieces long")
    split = dealt.join(F.broadcast(files), "part").withColumn("piece", F.pmod(F.xxhash64("key", "page"), F.col("pieces")))
    jobs = split.groupBy("part", "piece").agg(*[F.first(c).alias(c) for c in ("index_file", "offset", "length")], F.collect_list(F.struct("key", "page")).alias("wanted"))
    # a job is small in bytes and slow: dealt to a stated number of tasks, which Spark does not merge
    tasks = max(1, math.ceil(sum(counts.values()) / PIECE))
    return jobs.select("index_file", "offset", "length", "wanted").repartition(tasks).mapInArrow(_search(folder), "key string, page_id long, file string, offset long, length long")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    for place in sorted(row["places"], key=lambda p: p["offset"]):
                        fields, payload = parse(source.read_at(place["length"], place["offset"]))
                        refers = fields.get("WARC-Refers-To")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                        out.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], digest, len(payload), refers and page_of(refers), payload))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "record_type", "payload_digest", "length", "refers_to", "payload"])

    return run


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """Records by range reads: ``(page_id, record_type, payload_digest, length, refers_to, payload)``; a revisit's payload is empty."""
    tasks = max(1, math.ceil(found.count() / PIECE))
    piece = F.floor(F.col("offset") / (1 << 20)).alias("piece")
    pieces = found.select("file", piece, "offset", "length").repartition(tasks, "file", "piece").groupBy("file", "piece").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    return pieces.select("file", "places").mapInArrow(_read(folder), "page_id long, record_type string, payload_digest string, length long, refers_to long, payload binary")


def described(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: a revisit has the size of the payload that it refers to."""
    kept = materialize(records.drop("payload"), "warc-records")
    referred = kept.where("record_type = 'revisit'").select(F.col("refers_to").alias("of_page"), F.col("payload_digest").alias("of_digest")).distinct()
    of = (F.col("page_id") == F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest"))
    sizes = kept.where("record_type = 'response'").join(referred, of).groupBy("of_page", "of_digest").agg(F.max("length").alias("of_length"))
    full = kept.join(sizes, (F.col("refers_to") == F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return full.select("page_id", F.coalesce("of_length", "length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives, found through the index and read back.

    Null html is an empty payload; null page ids and repeated rows give a record
    each and come back as they are; an empty table gives none.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives, index = fresh_path(spark, "warc-archives"), fresh_path(spark, "warc-index")
    places = write_archives(pages, archives)
    top = build_index(places, index)
    found = materialize(lookup(pages.select(surt_of("url").alias("key"), "page_id"), top, index), "warc-found")
    return described(read_records(found, archives))
