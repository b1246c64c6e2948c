"""Dictionary-compressed WARC archives (.warc.zst).

Each task writes the archives of its partition: a skippable frame that holds a
Zstandard dictionary built from a bounded sample of the archive's own records, then
one frame per record. An archive gets its final name by a rename once it is whole,
so a task that is tried again cannot leave a torn one. Reading back goes archive by
archive, record by record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

#: Magic number of the skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 64 << 10
#: Records and bytes that the dictionary of an archive is built from.
SAMPLE_RECORDS = 500
SAMPLE_BYTES = 8 << 20
#: Records of an archive before the task starts the next one.
ARCHIVE_RECORDS = 20_000
#: Pages that a task holds outside their Arrow batch.
ROWS = 64
#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100
READ = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, target_uri string, archive string"


def record(page, url, payload: bytes, digest: str, size: int, first) -> bytes:
    """One WARC/1.1 record; a revisit of page ``first`` where that is set.

    Its id names the page, so rows that repeat a page id repeat it; a null id gets a random one.
    """
    kind = "response" if first is None else "revisit"
    own = f"urn:uuid:{uuid.uuid4()}" if page is None else f"urn:page:{page}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def train(records: list[bytes]) -> bytes:
    """Dictionary of the records; their first bytes as a raw one where too few can be learned from."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICT_BYTES]


class Archive:
    """An archive in the making: the dictionary's sample is held, everything after it streams."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.held: list[bytes] | None = []
        self.size = self.count = 0

    def add(self, raw: bytes) -> None:
        self.count += 1
        if self.held is None:
            self.out.write(self.press.compress(raw))
            return
        self.held.append(raw)
        self.size += len(raw)
        if len(self.held) >= SAMPLE_RECORDS or self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        data = train(self.held)
        self.out.write(struct.pack("<II", DICT_MAGIC, len(data)) + data)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data))
        for raw in self.held:
            self.out.write(self.press.compress(raw))
        self.held = None

    def close(self) -> str:
        if self.held is not None:
            self.start()
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.final


def read_archive(stream) -> Iterator[bytes]:
    """The raw records of one archive, in order."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    unzip, rest = reader.decompressobj(), b""
    parts: list[bytes] = []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        parts.append(unzip.decompress(data))
        rest = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = reader.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def _write(folder: str, most: int = ARCHIVE_RECORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, ROWS) for r in batch.slice(at, ROWS).to_pylist()):
                archive = archive or Archive(folder, f"{uuid.uuid4().hex}.warc.zst")
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                archive.add(record(row["page_id"], row["url"], payload, row["digest"], len(payload), row["first_id"]))
                if archive.count >= most:
                    done.append((archive.close(), archive.count))
                    archive = None
        if archive:
            done.append((archive.close(), archive.count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return run


def _read(folder: str, number: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive"]
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        page = lambda urn: m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", urn)) else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for raw in read_archive(stream):
                        head, payload = parse(raw)
                        if fresh := head["WARC-Type"] == "response":
                            size, digest, first = len(payload), hashlib.sha256(payload).hexdigest(), None
                        else:
                            size, digest, first = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].split(":")[1], page(head["WARC-Refers-To"])
                        rows.append((page(head["WARC-Record-ID"]), size, digest, "response" if fresh else "revisit", first, head.get("WARC-Target-URI"), path))
                        if len(rows) == 5000:
                            yield _batch(rows, names, number)
                            rows = []
                    if rows:
                        yield _batch(rows, names, number)

    return run


def _batch(rows: list[tuple], names: list[str], number: pa.DataType) -> pa.RecordBatch:
    kinds = [None, pa.int64(), pa.string(), pa.string(), None, pa.string(), pa.string()]  # None: a page's number
    cols = [pa.array(c, k) if k else pa.array(c, pa.string()).cast(number) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(cols, names)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in folder; returns the list (archive, records) of those the job committed.

    The list is written beside them and is what readers follow: files of task
    attempts that were lost are not in it. Nulls, repeats and empty tables are as in
    roundtrip(); other columns are left out.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    size = F.octet_length("html")
    first = (
        rows.where(size >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1).select(F.col("digest").alias("f_digest"), "first")
    )
    first.write.parquet(f"{folder}/repeats")
    repeats = pages.sparkSession.read.schema(first.schema).parquet(f"{folder}/repeats")
    revisits = rows.join(repeats, (rows.digest == repeats.f_digest) & (size >= REVISIT_BYTES), "left")
    revisits = revisits.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("first_id"))
    made = revisits.mapInArrow(_write(f"{folder}/archives"), "archive string, records long")
    made.write.parquet(f"{folder}/list")
    return pages.sparkSession.read.schema("archive string, records long").parquet(f"{folder}/list")


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives, digests and sizes taken from what was read."""
    spread = listed.select("archive").repartition(max(1, min(10_000, listed.count())))
    return spread.mapInArrow(_read(f"{folder}/archives", pa.int64()), READ.format(kind="long"))


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back.

    Null html is the empty payload, a null url leaves the target out, null ids come
    back null. Of equal payloads of REVISIT_BYTES or more the least id is the
    response; rows that repeat one id are responses each. An empty table gives an
    empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col), folder)
