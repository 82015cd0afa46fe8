"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is written as three records: the request, the response (or, where an equal payload has a response
already, a revisit that refers to it) and metadata. Request and metadata name the response or revisit in
WARC-Concurrent-To. Reading turns files into one row a record; assembly joins the records of a capture through
those identifiers, all that a record names and in either direction, and gives one nested row a capture, whatever the
order and the files of its records.

Each record is a gzip member of its own. A task writes files under its attempt's names, and only files in the
written manifest are read. Storage is whatever pyarrow.fs reaches from a URI.

Defined results: null html is an empty payload, null url an empty target; among equal payloads those with the
largest page_id are responses (all of them if the row repeats), a null page_id counts as smallest; an
empty table writes no file and reads as no rows; other columns are not read. Payloads below ``min_bytes`` are
always responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, limit_batches, shared_dir
from .joins import join_counted

#: A file is closed beyond so many bytes.
FILE_BYTES = 64 << 20
#: The capture time written when a table has none, and the revisit profile of the WARC standard.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, record_id string, type string, concurrent_to array<string>, target string, refers_to string, payload_bytes long, payload_digest string, fields map<string,string>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, level: int = 3) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def response_id(page_id: object, payload_digest: str) -> str:
    """The identifier of the response that revisits of a payload refer to."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{payload_digest}").urn


def capture(page_id: int | None, url: str | None, html: str | None, winner: tuple | None, taken: set[str]) -> bytes:
    """The three records of a page. winner: (page_id,) of its payload's response, or None if none shares it."""
    payload, target = (html or "").encode(), (url or "").translate({13: None, 10: None})
    name = digest(payload)
    revisit = winner is not None and winner[0] != page_id
    own = response_id(page_id, name)
    if revisit or own in taken:
        own = uuid.uuid4().urn
    taken.add(own)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{name}"), ("Content-Type", "application/http;msgtype=response")]
    refers = [("WARC-Refers-To", f"<{response_id(winner[0], name)}>"), ("WARC-Profile", PROFILE)] if revisit else []
    about = "" if page_id is None else f"page-id: {page_id}\r\n"
    about += f"refers-to-page: {winner[0]}\r\n" if revisit and winner[0] is not None else ""
    path = "/" + target.partition("://")[2].partition("/")[2]
    return b"".join(
        [
            record("request", uuid.uuid4().urn, [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\n\r\n".encode()),
            record("revisit" if revisit else "response", own, [*common, *refers], http + (b"" if revisit else payload)),
            record("metadata", uuid.uuid4().urn, [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/warc-fields")], about.encode()),
        ]
    )


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record in an uncompressed stream. Values of a repeated header are joined by a line break."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            headers[name] = f"{headers[name]}\n{value.strip()}" if name in headers else value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def fields(block: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def row(path: str, headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A record's row: the schema RECORD, and the payload if asked for."""
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    kind, size, name, payload, more = headers.get("warc-type"), None, None, None, {}
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        said = fields(head)
        if kind == "response":
            size, name = len(payload), digest(payload)
            if (told := headers.get("warc-payload-digest", "").removeprefix("sha1:")) and told != name:
                raise ValueError(f"{path}: the payload of {bare('warc-record-id')} has digest {name}, not {told}")
        else:  # the HTTP head of a revisit keeps the length of what it stands for
            size, name, payload = int(said.get("content-length", 0)), headers.get("warc-payload-digest", "").removeprefix("sha1:"), None
    elif kind == "metadata":
        more = fields(block)
    found = (path, bare("warc-record-id"), kind, [x.strip("<>") for x in headers.get("warc-concurrent-to", "").split("\n") if x], headers.get("warc-target-uri"), bare("warc-refers-to"), size, name, list(more.items()))
    return (*found, payload) if with_payload else found


def write(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a capture per row; returns the manifest (path, captures)."""
    spark = pages.sparkSession
    limit_batches(spark)
    folder = folder or shared_dir(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.encode("html", "utf-8"))))
    # one small row a shared payload; payloads of one page need none
    shared = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.select("sha", "n", F.struct("winner").alias("winner")), "warc-shared")
    placed = join_counted(rows, shared, "sha", pages.count()).select("page_id", "url", "html", F.col("winner.winner").alias("winner"), F.col("winner").isNotNull().alias("is_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out, taken, held, n, name = [], None, set(), 0, 0, ""
        for b in batches:
            for page, url, text, winner, is_shared in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name, held, n, taken = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, set()
                    store, at = fs.FileSystem.from_uri(name)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    # compressed here record by record, so not by the stream as the name suggests
                    out = store.open_output_stream(at, compression=None)
                data = capture(page, url, text, (winner,) if is_shared else None, taken)
                out.write(data)
                held, n = held + len(data), n + 1
                if held >= FILE_BYTES:
                    out.close()
                    made.append((name, n))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "captures"])

    return cut(placed.mapInArrow(run, "path string, captures long"), "warc-manifest")


def read(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row a record of the files in paths (path): the schema RECORD, and payload binary if asked for."""
    limit_batches(paths.sparkSession)
    kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_payload
    names = ["path", "record_id", "type", "concurrent_to", "target", "refers_to", "payload_bytes", "payload_digest", "fields"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 18) as stream:
                    for headers, block in parse(stream):
                        rows.append(row(path, headers, block, with_payload))
                        held += 200 + len(block) * with_payload
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(tasks, "path").mapInArrow(run, RECORD + ", payload binary" * with_payload)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, request, response, metadata).

    A response or revisit is a capture by its record id; requests and metadata join each capture that they name in
    concurrent_to, or that names them. A part that is missing is null; of several parts of a kind the first by record
    id stays. Records that concern no capture (warcinfo, conversions, parts whose response is missing) give no row.
    """
    records = cut(records, "warc-records")
    parts = ["record_id", "type", "target", "refers_to", "payload_bytes", "payload_digest", "fields", *["payload"] * ("payload" in records.columns)]
    is_response = F.col("type").isin("response", "revisit")
    part = F.struct(*parts).alias("part")
    others = records.where(F.col("type").isin("request", "metadata"))
    keyed = records.where(is_response).select(F.col("record_id").alias("capture_id"), part).union(others.select(F.explode(F.array_distinct("concurrent_to")).alias("capture_id"), part))
    named = records.where(is_response & (F.size("concurrent_to") > 0)).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("named")).distinct()
    if not named.isEmpty():
        keyed = keyed.union(named.join(others.select("record_id", part), F.col("named") == F.col("record_id")).select("capture_id", "part"))
    of = lambda *kinds: F.min_by("part", F.when(F.col("part.type").isin(*kinds), F.col("part.record_id")))
    joined = keyed.groupBy("capture_id").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
    return joined.where("response is not null")


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from the archives."""
    found = transactions(read(write(pages)))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("metadata.fields")["page-id"].cast(kind).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.fields")["refers-to-page"].cast(kind).alias("refers_to"),
    )
