"""Web pages as dictionary-compressed WARC archives, written and read back.

A Zstandard dictionary is built from some of the records to be archived.  It
opens every archive, in a skippable frame of its own (magic number
0x184D2A5D), and every record after it is compressed by itself against it, so a record can be
read with nothing but the dictionary and its offset.  Pages whose payload
repeats are written as revisit records that name the page that holds it.

Scale: payloads are compared by digest, so only digests are grouped; pages then
meet the few digests that repeat.  Each task writes archives of a bounded
size under names of its own and lists them only when they are complete, so a
lost executor or a second attempt leaves files that no manifest names.  The
dictionary is trained on at most `sample` records, SAMPLE_PAGE bytes of each and `sample_bytes` bytes in all, the
first by hash of the page (a documented, fixed bound); it only affects
sizes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, session_dir, small_batches

# Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8 << 20, 112 << 10
#: Bytes of a page's payload that the dictionary may learn from.
SAMPLE_PAGE = 16 << 10
FILE_BYTES = 512 << 20
READ_BYTES = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"


def _id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _line(value: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One WARC record: a response with the payload, or a revisit of refers_to with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url) if url else f"urn:page:{page}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page is None else str(page)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
        fields += [("WARC-Refers-To-Target-URI", _line(refers_url))] if refers_url else []
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the records; plain content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


class Writer:
    """An archive on a binary file: the dictionary's frame, then one frame for each record."""

    def __init__(self, out, dictionary: bytes, level: int = LEVEL):
        self.out, self.size = out, 0
        self._box = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self._put(DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed)

    def _put(self, raw: bytes) -> tuple[int, int]:
        self.out.write(raw)
        at, self.size = self.size, self.size + len(raw)
        return at, len(raw)

    def add(self, raw: bytes) -> tuple[int, int]:
        """Offset and length of the record's frame."""
        return self._put(self._box.compress(raw))


def read_dictionary(source) -> bytes:
    """The dictionary from the leading frame of an archive, which is left at its first record."""
    if source.read(4) != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    raw = source.read(int.from_bytes(source.read(4), "little"))
    return zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, one record in memory at a time."""
    box = zstandard.ZstdDecompressor(dict_data=_dictionary(read_dictionary(source)))
    ahead = source.read(READ_BYTES)
    while ahead:
        frame, parts = box.decompressobj(), []
        while not frame.eof:
            if not ahead:
                raise ValueError("a record is cut short")
            parts.append(frame.decompress(ahead))
            ahead = frame.unused_data if frame.eof else source.read(READ_BYTES)
        yield _parsed(b"".join(parts))
        ahead = ahead or source.read(READ_BYTES)


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, dictionary: bytes, file_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        files, path = _open(folder)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        writer, out, name, n, number = None, None, "", 0, 0

        def done():
            out.close()
            files.move(f"{path}/{name}.open", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([writer.size])], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name, n, number = f"{stem}-{number:04d}.warc.zst", 0, number + 1
                    out = files.open_output_stream(f"{path}/{name}.open", compression=None)
                    writer = Writer(out, dictionary)
                writer.add(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["refers_url"]))
                n += 1
                if writer.size >= file_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return run


def _payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))


def with_revisits(pages: DataFrame, *, least: int = LEAST_REVISIT, **columns) -> DataFrame:
    """page_id, url, payload, and refers_to and refers_url for pages whose payload a page with a larger id holds."""
    rows = _payloads(pages, **columns)
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    # written, so that the join reads two plain tables and the optimizer splits what a very common payload makes skewed
    seen = cut(rows.where("same is not null").groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1 and last.page_id is not null").select("same", "last"))
    # short payloads have no digest here and would meet in one task
    rows = rows.withColumn("same", F.coalesce("same", F.concat(F.lit("page "), F.coalesce("page_id", F.xxhash64("url", "payload")).cast("string"))))
    later = F.coalesce(F.col("page_id") < F.col("last.page_id"), F.col("last.page_id").isNotNull())
    return rows.join(seen, "same", "left").select("page_id", "url", "payload", F.when(later, F.col("last.page_id")).alias("refers_to"), F.when(later, F.col("last.url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str | None = None, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, file_bytes: int = FILE_BYTES, **columns) -> DataFrame:
    """Write a record for each page into archives under the folder (shared by all executors; by default a temporary one of the session) and return their manifest: archive, n_records, n_bytes.

    Null html is an empty payload; of records with equal payloads of at least 1000
    bytes that with the largest page_id is the response and the others revisit it; rows that share
    this largest id are all responses; a null page_id counts as smaller than any.
    A null url is replaced by one made from the page id.  Other columns are ignored; an empty table
    gives no archives.
    """
    small_batches(pages)
    spark = pages.sparkSession
    rows = with_revisits(pages, **columns)
    folder = folder or f"{session_dir(spark)}/warc-{uuid.uuid4().hex}"
    picked, total = [], 0
    # ids first: only the payloads of so many pages are looked up
    plain = _payloads(pages, **columns)
    by_hash = [F.xxhash64("page_id"), F.col("page_id")]
    first = plain.select("page_id").distinct().orderBy(*by_hash).limit(sample)
    plain = plain.withColumn("payload", F.substring("payload", 1, SAMPLE_PAGE))
    for r in plain.join(F.broadcast(first), "page_id", "left_semi").orderBy(*by_hash, "url").limit(sample).toLocalIterator():
        if total < sample_bytes:
            picked.append(record(r["page_id"], r["url"], bytes(r["payload"])))
            total += len(picked[-1])
    dictionary = train(picked)
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    return cut(rows.mapInArrow(_writer(folder, dictionary, file_bytes), "archive string, n_records long, n_bytes long"))


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = _open(archive)
                with files.open_input_stream(path, compression=None) as source:
                    for fields, block in read_records(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        response = fields["WARC-Type"] == "response"
                        if response and (len(payload) != length or hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest):
                            raise ValueError(f"damaged record in {archive}")
                        refers = fields.get("Refers-To-Page-ID")
                        page = fields["Page-ID"]
                        rows.append((int(page) if page else None, length, digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"], payload if with_payload and response else None))
                        size += len(block) * with_payload + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_archives(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (responses only).

    Lengths and digests of responses are checked against what was read.
    """
    # one archive to a task, dealt out by name
    names = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return names.mapInArrow(_reader(with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
