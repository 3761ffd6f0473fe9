"""WARC archives and the chunked record table.

``write_archives`` writes record rows as WARC/1.1 files, one per task, into a folder of the store that the executors
share; a file is written under a name of its attempt and counts only through the manifest row that a finished task
returns, so lost executors and repeated attempts do no harm. ``read_chunks`` streams archives: a record of any size
comes as rows (record_id, chunk_no) of at most ``chunk_bytes``, each carrying the SHA-1 of the payload up to and
including it, so that neither reader nor writer of digests holds a whole record. ``record_digests`` keeps the
last chunk's row per record.

Defined cases: a null payload is an empty one (one chunk of no bytes); of records with equal payloads of at least
``revisit_bytes`` bytes those with the largest id are responses (rows that repeat this id all are) and the others
revisits without payload; repeated rows give records of their own; null urls are written as empty; empty tables give an
empty manifest and no rows; columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import storage

from .common import fresh_path, materialise, table

DATE = "1970-01-01T00:00:00Z"  # records derive from a table, not from a crawl at some time
CHUNKS = "record_id string, page_id long, record_type string, url string, refers_to long, payload_length long, declared_digest string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def assigned(pages: DataFrame, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): refers_to is null for responses.

    Only payloads that occur more than once go into the table that is joined. It is written first, so that the planner
    sees its size: small, it is broadcast and no payload is shuffled; large, the join is shuffled and skew is split.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    repeated = rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    repeated = materialise(repeated.filter("n > 1").select("sha1", "newest"), "warc-repeated")
    return rows.join(repeated, "sha1", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("newest"), F.col("newest"))).drop("newest")


def write_archives(records: DataFrame, folder: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Writes ``assigned`` rows to gzip-compressed WARC files under ``folder``; the manifest: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        path, out, count = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            for k in range(batch.num_rows):
                page, url, _, sha, refers = (c[k].as_py() if n != 2 else None for n, c in enumerate(cols))
                body = memoryview(cols[2][k].as_buffer())
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                head = {
                    "WARC-Type": "revisit" if refers is not None else "response",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                    "WARC-Date": DATE,
                    "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
                    "WARC-Payload-Digest": "sha1:" + base32_sha1(bytes.fromhex(sha)),
                    "X-Page-Id": "" if page is None else page,
                    "X-Payload-Length": len(body),
                }
                if refers is not None:
                    head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": refers}
                    body = body[:0]
                head |= {"Content-Type": "application/octet-stream", "Content-Length": len(body)}
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member per record
                out.write(pack.compress(("WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head.items()) + "\r\n").encode()))
                for a in range(0, len(body), chunk_bytes):
                    out.write(pack.compress(body[a : a + chunk_bytes]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"]), pa.array([count], pa.int64())], names=["path", "records"])

    return records.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "path string, records long")


def unpacked(stream, block: int = 1 << 18) -> Iterator[bytes]:
    """Decompressed blocks of a file of gzip members."""
    import zlib

    pack = zlib.decompressobj(31)
    while raw := stream.read(block):
        while raw:
            data = pack.decompress(raw, block)
            if data:
                yield data
            if pack.eof:
                raw, pack = pack.unused_data, zlib.decompressobj(31)
            else:
                raw = pack.unconsumed_tail


class Reader:
    """Reads heads and bodies off a stream of blocks, holding one block or head at a time."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def more(self) -> bool:
        got = next(self.blocks, None)
        self.held += got or b""
        return got is not None

    def head(self) -> dict[str, str] | None:
        """Fields of the next record by lower-cased name; None at the end."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            end = self.held.find(b"\r\n\r\n")
            if end >= 0 and self.held:
                lines = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
                del self.held[: end + 4]
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                return {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None

    def body(self, size: int, chunk: int) -> Iterator[bytes]:
        while size:
            want = min(size, chunk)
            while len(self.held) < want:
                if not self.more():
                    raise ValueError("the archive ends within a record")
            data = bytes(self.held[:want])
            del self.held[:want]
            size -= want
            yield data


def read_chunks(manifest: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True, only_last: bool = False) -> DataFrame:
    """The chunked record table of the archives in ``manifest`` (column ``path``); each archive is read by one task.

    ``only_last`` keeps the final chunk of each record, whose digest is that of the whole payload.
    """

    def chunks(path: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        with store.open_input_stream(where, compression=None) as stream:
            reader = Reader(unpacked(stream))
            while (head := reader.head()) is not None:
                size = int(head["content-length"])
                own = (head["warc-record-id"], int(head["x-page-id"]) if head.get("x-page-id") else None, head["warc-type"], head.get("warc-target-uri"), int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None, int(head.get("x-payload-length") or size), head.get("warc-payload-digest", "").rpartition(":")[2])
                sha, done, number = hashlib.sha1(), 0, 0
                for data in reader.body(size, chunk_bytes) if size else (b"",):
                    sha.update(data)
                    done += len(data)
                    if done == size or not only_last:
                        yield (*own, number, data if with_data else None, done, base32_sha1(sha.digest()), done == size)
                    number += 1

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in chunks(path):
                    rows.append(row)
                    held += len(row[8] or b"")
                    if held > 4 * chunk_bytes or len(rows) >= 4096:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return manifest.select("path").mapInArrow(run, CHUNKS)


def record_digests(manifest: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row per record: its payload's length and digest. A response's are those of the bytes read, checked against
    its head; a revisit has no bytes, its head tells those of the payload that it repeats."""
    last = read_chunks(manifest, chunk_bytes, with_data=False, only_last=True)
    revisit = F.col("record_type") == "revisit"
    sound = revisit | ((F.col("declared_digest") == F.col("digest_so_far")) & (F.col("payload_length") == F.col("bytes_so_far")))
    return last.select(
        "record_id", "page_id", "url",
        F.when(sound, F.when(revisit, F.col("payload_length")).otherwise(F.col("bytes_so_far"))).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), "record_id")).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type", "refers_to",
    )


def archive(pages: DataFrame, revisit_bytes: int = 0, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder; the manifest, itself written."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "archives")
    storage.WRITTEN.add(folder)
    manifest = materialise(write_archives(assigned(pages, revisit_bytes), folder, chunk_bytes), "warc-manifest")
    return manifest.repartition(max(1, manifest.count()))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = record_digests(archive(table(spark, sf_dir, "pages")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
