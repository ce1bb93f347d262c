"""Dictionary-compressed WARC writer and reader (.warc.zst).

A Zstandard dictionary is trained on a bounded sample of the records.  Every archive begins
with a skippable frame that holds the dictionary; each record is a frame of its own, so one
record can be read without the others.  Each Spark task streams its rows into archives of
bounded size under the shared folder and reports them in a manifest, which Spark commits:
an archive of a lost or repeated task is in no manifest and is never read.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the
smallest page id is the response, the others are revisits that refer to it.

Defined cases: null html is an empty payload; a null id takes no part as the smallest and
is never referred to; if all rows with a payload lack an id, or a row repeats the smallest
id, each of these is a response; line breaks in a url are percent-encoded, a null url gives
a record without target; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import small_batches

MIN_REVISIT = 100  # bytes
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 16384  # the dictionary's sample: records, and bytes of each
DICT_BYTES = 65536
ARCHIVE_BYTES = 64 << 20  # payload bytes after which an archive is closed
LEVEL = 6
SKIPPABLE = 0x184D2A5D  # fixed value of the format: the dictionary's frame
DATE = "1970-01-01T00:00:00Z"
BROADCAST_ROWS = 200_000  # repeated payloads, some 100 bytes each
READ_CHUNK = 1 << 16
MANIFEST = "path string, records long, payload_bytes long, archive_bytes long"


def _open_fs(path: str):
    """File system and path of a shared folder, by its URI."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, n, refers_to: which record answers for which payload.
    Only digests are shuffled as long as the repeated ones are few; else pages are, once."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    repeated = base.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    repeated = cut_lineage(repeated, "warc-repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    return base.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def train_dictionary(recs: DataFrame, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES,
                     dict_bytes: int = DICT_BYTES) -> bytes:
    """A dictionary from the distinct response payloads with the smallest digests (at most
    ``sample_records``, of each at most ``sample_bytes``).  Too few of them: their bytes serve
    as they are."""
    import zstandard as zstd

    # some four times the sample can be among the smallest digests; the others are left out
    # before any task sends its smallest ones.  Distinct digests are counted (a sketch does):
    # repeated payloads would make the wanted share of digests too small
    own = recs.where("n > 0 and refers_to is null")
    kinds = own.agg(F.approx_count_distinct("digest")).first()[0]
    share = min(1.0, 4 * sample_records / max(kinds, 1))
    first = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    rows = own.where(first < int(share * (1 << 32))).select("digest", F.substring("payload", 1, sample_bytes).alias("p"))
    rows = rows.dropDuplicates(["digest"]).orderBy("digest").limit(sample_records)
    sample = [bytes(r["p"]) for r in rows.collect()]
    if not sample:
        return b""
    try:
        return zstd.train_dictionary(min(dict_bytes, max(256, sum(map(len, sample)) // 8)), sample).as_bytes()
    except zstd.ZstdError:
        return b"".join(sample)[:dict_bytes]


def _header(rec_type: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {rec_type}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("X-Page-ID", page_id)]
    if refers_to is None:
        return _header("response", [*fields, ("Content-Type", "text/html")], len(payload)) + payload + b"\r\n\r\n"
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    return _header("revisit", fields, 0) + b"\r\n\r\n"


def _write_task(folder: str, dictionary: bytes, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        filesystem, root = _open_fs(folder)
        shared = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        # a raw dictionary has no id of its own; the reader takes it from the archive's first frame
        packer = zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        attempt, done, out, seen, size = uuid.uuid4().hex, [], None, 0, 0

        def close():
            done.append((f"{folder}/{name}", seen, size, out.tell()))
            out.close()

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    name, seen, size = f"{attempt}-{len(done):05d}.warc.zst", 0, 0
                    out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    info = b"software: tuneshelf\r\nformat: WARC File Format 1.1\r\n"
                    out.write(packer.compress(_header("warcinfo", [("WARC-Record-ID", _record_id(attempt, str(len(done)))),
                                                                   ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                                                      len(info)) + info + b"\r\n\r\n"))
                row = [c[i].as_py() for c in cols]
                out.write(packer.compress(_record(*row)))
                seen, size = seen + 1, size + len(row[2])
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*done) if done else [[]] * 4,
                                                  (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            ["path", "records", "payload_bytes", "archive_bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **cols) -> DataFrame:
    """Write one record per row; returns the manifest: path, records, payload_bytes, archive_bytes."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    if folder is None:
        folder = scratch_path(spark, "warc")
    filesystem, root = _open_fs(folder)
    filesystem.create_dir(root, recursive=True)
    recs = records(pages, **cols)
    dictionary = train_dictionary(recs)
    recs = recs.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest",
                       F.col("refers_to").cast("string").alias("refers_to"))
    return cut_lineage(recs.mapInArrow(_write_task(folder, dictionary, archive_bytes), MANIFEST), "warc-manifest")


def iter_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive in order, one in memory at a time."""
    import zstandard as zstd

    filesystem, root = _open_fs(path)
    with filesystem.open_input_stream(root, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        dictionary = f.read(n)
        unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
        rest = b""
        while rest or (rest := f.read(READ_CHUNK)):
            frame, parts = unpacker.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := f.read(READ_CHUNK)):
                    raise ValueError(f"{path}: ends within a record")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            raw = b"".join(parts)
            at = raw.index(b"\r\n\r\n")
            version, *lines = raw[:at].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines) | {"version": version}
            yield head, raw[at + 4: at + 4 + int(head["Content-Length"])]


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names)

    for batch in batches:
        for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
            rows = []
            for head, payload in iter_records(path):
                if head["WARC-Type"] == "warcinfo":
                    continue
                digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, n):
                    raise ValueError(f"{path}: payload of {head['WARC-Record-ID']} is damaged")
                rows.append((head.get("X-Page-ID"), head.get("WARC-Target-URI"), n, digest, head["WARC-Type"], head.get("X-Refers-To-Page-ID")))
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in
    the manifest's archives; a response whose bytes do not match its digest is an error."""
    tasks = max(1, min(manifest.count(), 20_000))
    out = manifest.select("path").repartition(tasks).mapInArrow(
        _read_task, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
