"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

Foreign archives are often one gzip stream over the whole file, so that no record can be reached without inflating all
before it. `normalise` inflates such a stream once, in constant memory but for one record, rewrites every record as a
gzip member of its own and writes a sidecar index: a JSON line with offset, length, id and type for each record.

`archive` writes a record for each page in a whole-file stream, normalises it, and keeps the normalised file and its
index in the folder that driver and executors share. Of records with equal payloads the one with the least page_id is a
response, the others are revisits of it. Files are named by a fresh id for each attempt and listed in a manifest, so a
task that runs again leaves at most an unlisted file.

Defined cases: a null page is an empty payload; rows with the least page_id of their payload are responses, also when
that row is repeated; a null page_id is never the least, and where a payload has no other the record is a response; a
null url is `urn:x-none`; line breaks in an url are escaped; `least_bytes` leaves smaller payloads out of deduplication; a truncated or malformed stream raises an
error that names the record; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import shared

VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
#: Payload bytes after which a new archive is begun.
ARCHIVE_BYTES = 48 << 20
SALTS = 16
#: Tasks at most that read archives back; beyond that many, a task reads several.
READERS = 20_000


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None, known: str | None = None) -> bytes:
    """A response record, or a revisit of the record refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if key is None else key}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%~-._") if url else "urn:x-none"),
        ("WARC-Payload-Digest", "sha1:" + (known or digest(payload))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Content of a gzip file of one or more members, or of a file that isn't compressed."""
    state, first, ended = None, True, False
    for chunk in chunks:
        if first and chunk:
            first = False
            if chunk[:2] != b"\x1f\x8b":
                yield chunk
                yield from chunks
                return
        while chunk:
            if state is None:
                if ended and not chunk.strip(b"\0"):
                    return  # padding after the last member
                state = zlib.decompressobj(31)
            got = state.decompress(chunk, STEP)
            while got:
                yield got
                got = b"" if state.eof else state.decompress(state.unconsumed_tail, STEP)
            if state.eof:
                chunk, state, ended = state.unused_data, None, True
            else:
                chunk = b""
    if state is not None:
        raise ValueError("the gzip stream is truncated")


def records(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Every record's bytes, header (names in lower case) and block."""
    chunks, buf, n = iter(chunks), bytearray(), 0
    while True:
        end = buf.find(b"\r\n\r\n")
        while end < 0:
            more = next(chunks, None)
            if more is None:
                if buf.strip():
                    raise ValueError(f"record {n}: the header is truncated")
                return
            at = max(0, len(buf) - 3)
            buf += more
            end = buf.find(b"\r\n\r\n", at)
        lines = bytes(buf[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"record {n}: it doesn't begin with a WARC version")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            size = int(head["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"record {n}: no valid Content-Length") from None
        start, stop = end + 4, end + 4 + size + 4
        parts, have = [buf], len(buf)
        while have < stop:
            more = next(chunks, None)
            if more is None:
                raise ValueError(f"record {n}: the block is truncated")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts) if len(parts) > 1 else bytes(buf)
        if whole[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"record {n}: the block's end is missing")
        yield whole[:stop], head, whole[start : stop - 4]
        buf = bytearray(whole[stop:])
        n += 1


def _chunks(file) -> Iterator[bytes]:
    while got := file.read(STEP):
        yield got


def normalise(source, target, index) -> int:
    """Rewrite the records of one file object as members of another; the number of records."""
    at = n = 0
    for raw, head, _ in records(inflate(_chunks(source))):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        target.write(member)
        row = {"offset": at, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "uri": head.get("warc-target-uri")}
        index.write(json.dumps(row).encode() + b"\n")
        at += len(member)
        n += 1
    return n


def member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header and block of the one record at an offset."""
    file.seek(offset)
    ((_, head, block),) = records(inflate([file.read(length)]))
    return head, block


def monolithic(parts: Iterable[bytes], file) -> None:
    """Write all parts as one gzip stream."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    for p in parts:
        file.write(z.compress(p))
    file.write(z.flush())


def _page_id(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" or not text else int(text)


def marked(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, its hex SHA-1 and the page_id of its first holder, if there are several."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    shared_by = narrow.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    # a payload with very many holders is dealt over SALTS tasks
    shared_by = shared_by.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("sha", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(shared_by.hint("shuffle_hash"), ["sha", "salt"], "left").select("page_id", "url", "payload", "sha", "first")


def archive(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of pages (page_id, url, html) into folder; the manifest (path, index, n_records), stored."""

    def run(batches):
        import tempfile

        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)

        def close(spool):
            spool.seek(0)
            name = f"{at}/{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(name, compression=None) as target, store.open_output_stream(f"{name}.idx", compression=None) as index:
                n = normalise(spool, target, index)
            spool.close()
            return pa.RecordBatch.from_pydict({"path": [name], "index": [f"{name}.idx"], "n_records": pa.array([n], pa.int64())})

        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield [b.column(c)[i].as_py() for c in range(5)]

        spool, size, z = None, 0, None
        for page, url, payload, sha, first in rows():
            if spool is None:
                # a foreign archive's shape: one gzip stream over all records; it never outlives the task
                spool, size, z = tempfile.SpooledTemporaryFile(max_size=64 << 20), 0, zlib.compressobj(1, zlib.DEFLATED, 31)
            again = first if first is not None and first != page else None
            spool.write(z.compress(record(page, url, payload, again, base64.b32encode(bytes.fromhex(sha)).decode())))
            size += len(payload)
            if size >= archive_bytes:
                spool.write(z.flush())
                yield close(spool)
                spool = None
        if spool is not None:
            spool.write(z.flush())
            yield close(spool)

    return shared.stored(marked(pages, least_bytes).mapInArrow(run, "path string, index string, n_records long"), "warc-manifest")


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record of the manifest's archives."""
    spec = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as file, store.open_input_stream(index, compression=None) as lines:
                    places = [json.loads(x) for x in lines.read().splitlines()]
                    for k in range(0, len(places), 1024):
                        rows = []
                        for p in places[k : k + 1024]:
                            head, block = member(file, p["offset"], p["length"])
                            http, _, payload = block.partition(b"\r\n\r\n")
                            told = head["warc-payload-digest"].removeprefix("sha1:")
                            if head["warc-type"] == "response":
                                size = len(payload)
                                if digest(payload) != told:
                                    raise ValueError(f"{path}: the payload of {p['id']} isn't what its header says")
                            else:
                                size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                            rows.append((_page_id(head["warc-record-id"]), head["warc-target-uri"], size, told, head["warc-type"], _page_id(head.get("warc-refers-to"))))
                        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [s.split()[0] for s in spec.split(", ")])

    # a number of its own: by size, adaptive execution would put the paths of all archives into one task
    return manifest.select("path", "index").repartition(max(1, min(manifest.count(), READERS)), "path").mapInArrow(run, spec)
