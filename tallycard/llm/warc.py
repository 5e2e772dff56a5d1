"""WARC archives: written from page rows, read back by byte ranges."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard.llm.common import docs_of, query, settled
from tallycard.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
RECORD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("http_length", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])
MANIFEST = "path string, bytes long, records long"


def _filesystem(uri: str):
    """The store behind a URI or plain path; hdfs, s3 and gs work as well as file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", value)


def _member(page_id, url, payload: bytes, digest: str, refers_to, level: int) -> bytes:
    """One gzip member that holds one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else "WARC-Record-ID: <urn:page:>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, level: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = out = None
        path, size, records = "", 0, 0
        for rows in batches:
            for page_id, url, payload, digest, refers_to in zip(rows["id"], rows["url"], rows["payload"], rows["digest"], rows["refers_to"]):
                if out is None:  # each attempt of a task has a file of its own; the manifest names the one that counts
                    store, root = _filesystem(folder)
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)  # the members are gzip already
                url = None if pd.isna(url) else url
                data = _member(None if pd.isna(page_id) else page_id, url, payload, digest, None if pd.isna(refers_to) else refers_to, level)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "bytes": [size], "records": [records]})

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least: int = 1000, level: int = 4) -> DataFrame:
    """Write one record per row to gzip archives in ``folder``, one archive per partition; returns the manifest.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses and the others
    revisit it; with repeated rows the largest id may occur more than once. A null id is smaller than any other; a group
    with null ids only has responses only. A null payload is empty. The manifest (path, bytes, records) is written before
    it is returned: archives of failed attempts stay in the folder but are not in it. An empty table gives an empty
    manifest.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).cast("long").alias("num"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    shared = (
        rows.filter(large).groupBy("digest").agg(F.max("num").alias("newest"), F.count("*").alias("n"))
        .filter("n > 1 and newest is not null").select("digest", "newest")
    )
    # settled, so its size is known: broadcast when small, else a join whose hot digests Spark can split
    shared = settled(shared)
    marked = rows.join(shared, "digest", "left").select(
        "id", "url", "payload", "digest",
        F.when(large & F.col("newest").isNotNull() & ~F.col("num").eqNullSafe(F.col("newest")), F.col("newest").cast("string")).alias("refers_to"),
    )
    return settled(marked.mapInPandas(_writer(folder, level), MANIFEST))


def _head(block: bytes) -> tuple[dict[str, str], int]:
    end = block.find(b"\r\n\r\n")
    lines = block[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def _is_member(head: bytes) -> bool:
    """Whether these bytes inflate to the start of a record; a magic number inside other data does not."""
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _inner(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", name or "")
    return (found[1] or None) if found else (name or None)


def _record(path: str, offset: int, length: int, data: bytes) -> tuple:
    head, at = _head(data)
    block = data[at: at + int(head.get("content-length", 0))]
    http, body = _head(block) if head.get("content-type", "").startswith("application/http") else ({}, 0)
    kind = head.get("warc-type")
    return (
        path, offset, length, kind, _inner(head.get("warc-record-id")), head.get("warc-target-uri"), _inner(head.get("warc-refers-to")),
        head.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(http.get("content-length", len(block) - body)),
        None if kind == "revisit" else block[body:],
    )


def _scan(source, path: str, start: int, end: int, piece: int) -> Iterator[tuple]:
    """Records whose members start in [start, end). The last one is read on beyond the end."""
    size = source.size()
    known, base, data = False, start, b""  # data holds the bytes from base on
    at = start
    while at < min(end, size):
        if len(data) - (at - base) < 1024 and base + len(data) < size:
            data = data[at - base:] + source.read_at(min(piece, size - base - len(data)), base + len(data))
            base = at
        if not known:
            hit = data.find(MAGIC, at - base)
            if hit < 0:
                at = max(at, base + len(data) - 2) if base + len(data) < size else size
                continue
            if base + hit >= end:
                return
            at = base + hit
            if len(data) - hit < 1024 and base + len(data) < size:
                continue
        if not _is_member(data[at - base: at - base + 1024]):
            known, at = False, at + 1
            continue
        unpacker, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof:
                if fed - base >= len(data):
                    if base + len(data) >= size:
                        break
                    data = data[at - base:] + source.read_at(min(piece, size - base - len(data)), base + len(data))
                    base = at
                parts.append(unpacker.decompress(data[fed - base:]))
                fed = base + len(data)
        except zlib.error:
            unpacker = None
        if unpacker is None or not unpacker.eof:  # damaged or cut off: go on with the next magic number
            known, at = False, at + 1
            continue
        stop = fed - len(unpacker.unused_data)
        yield _record(path, at, stop - at, b"".join(parts))
        known, at = True, stop


def _reader(piece: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for splits in batches:
            for path, start, end in zip(splits["path"], splits["start"], splits["end"]):
                store, name = _filesystem(path)
                rows, held = [], 0
                with store.open_input_file(name) as source:
                    for row in _scan(source, path, start, end, piece):
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                        if held > 4_000_000:
                            yield pd.DataFrame(rows, columns=RECORD.names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=RECORD.names)

    return read


def read_archives(files: DataFrame, split_bytes: int = 4 << 20, piece: int = 1 << 18) -> DataFrame:
    """Records of gzip archives, read by byte ranges of ``split_bytes``.

    ``files`` has path and bytes. A task looks for the gzip magic number in its range, accepts a candidate only if it
    inflates to a record's header, and owns the records that start inside the range, the last of which it reads to its
    end. Members that cannot be inflated are passed over. One row per record: its place, headers, and the payload
    (null for a revisit); ``http_length`` is the payload length that the HTTP header states.
    """
    splits = files.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.col("start") + split_bytes)
    spread = splits.repartition(max(1, splits.count() // 2), "path", "start")
    return spread.mapInPandas(_reader(piece), RECORD)


def list_archives(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """path and bytes of the archives below ``folder``, for ``read_archives``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def check_complete(records: DataFrame, manifest: DataFrame) -> None:
    """Fail unless ``records`` has as many rows of every path as the manifest states; names up to five archives that differ."""
    read = records.groupBy("path").agg(F.count("*").alias("n_read"))
    both = manifest.join(read, "path", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
    bad = both.filter(F.col("n_read") != F.col("records")).select("path", "records", "n_read").limit(5).collect()
    if bad:
        raise ValueError("archives are damaged or cut short: " + "; ".join(f"{r['path']} has {r['n_read']} of {r['records']} records" for r in bad))


@query("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as archives, read them back, and report each page's record; fails when any record is missing."""
    manifest = write_archives(docs_of(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    records = read_archives(manifest)
    response = F.col("payload").isNotNull()
    out = settled(records.select(
        "path",
        F.col("record_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    ))
    check_complete(out, manifest)
    return out.drop("path")
