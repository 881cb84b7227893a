"""A WARC writer with compression dictionaries, and its reader.

Each archive begins with a skippable frame that holds a Zstandard dictionary, trained on records of
that archive; every record follows as a frame of its own, compressed with it. Of the records with
equal payloads of at least REVISIT_BYTES, the one with the largest id is stored as a response and the
others as revisits that refer to it.

Tasks write whole archives under names of their own and report them; only reported archives exist for
the reader, so what an attempt left behind that was lost or ran twice is never read. Files go through
pyarrow's file systems: the folder may be any that driver and executors share and pyarrow can open.

Defined cases: a null payload is empty; a null url becomes about:blank; null ids are written without an
id and are responses; rows that repeat the largest id of equal payloads are all responses; a very long
payload is one record, written and read in one task's memory; an empty table gives no archive and an
empty result; other columns of the input are not archived.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, shared_dir, stash, table

REVISIT_BYTES = 1000
#: Payload bytes in an archive, at which the next one is begun.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
#: Record bytes, spread over the archive, from which its dictionary is trained.
SAMPLE_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page/{page}') if page is not None else uuid.uuid4()}>"


def _clean(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c) & 255:02X}" for c in url) if url else "about:blank"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """A response, or a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {_clean(refers_url)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on records spread evenly; where they are too few to train on, their beginnings as they are."""
    step = max(1, sum(map(len, records)) // sample)
    some = records[::step]
    try:
        return zstandard.train_dictionary(size, some, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:1024] for r in some[:8])[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    d = dictionary(records)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
    leading = d.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(leading)), leading, *(pack.compress(r) for r in records)])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an open archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    d = zstandard.ZstdCompressionDict(stream.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=d).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a record")
        head = {}
        while line := plain.readline().strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        yield head, plain.read(int(head["content-length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end")


def write_archives(pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Writes the archives below folder and returns one row each: path, n_records, n_bytes."""
    whole = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), whole.alias("payload")).withColumn("digest", F.sha1("payload"))
    equal = rows.filter(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("id", "url")).alias("last"), F.count(F.lit(1)).alias("n"))
    equal = stash(equal.filter("n > 1 AND last.id IS NOT NULL").select(F.col("digest").alias("same"), "last"), "warc-equal")
    other = F.when(F.col("id") != F.col("last.id"), F.col("last"))
    ready = rows.join(equal, F.col("digest") == F.col("same"), "left").select("id", "url", "payload", "digest", other["id"].alias("to"), other["url"].alias("to_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)

        def put(made: list[bytes]) -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            data = archive(made)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(made)], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "n_records", "n_bytes"])

        made, size = [], 0
        for batch in batches:
            for columns in zip(*batch.columns, strict=True):
                made.append(record(*(x.as_py() for x in columns)))
                size += len(made[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(made)
                    made, size = [], 0
        if made:
            yield put(made)

    return stash(ready.mapInArrow(lean(write), "path string, n_records long, n_bytes long"), "warc-list")


def read_archives(written: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row a record of the listed archives; digest and length are taken anew where there is a payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{path}") as f:
                    for head, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = head["warc-type"] == "response"
                        length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
                        digest = hashlib.sha1(payload).hexdigest() if response else head["warc-payload-digest"].partition(":")[2]
                        if response and (len(payload) != length or head["warc-payload-digest"] != f"sha1:{digest}"):
                            raise ValueError(f"a payload in {path} isn't what was archived")
                        page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((page and int(page), head["warc-target-uri"], length, digest, head["warc-type"], to and int(to), payload if response and with_payload else None))
                        if len(rows) == 256:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    # by number, so that Spark doesn't join tasks whose rows are short: an archive a task, or several where there are many
    listed = written.select("path").repartition(max(1, min(written.count(), int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return listed.mapInArrow(lean(read), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(written, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, octet_length(b) AS payload_bytes, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to FROM g"""
