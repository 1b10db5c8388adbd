"""WARC: monolithic gzip normaliser with a sidecar offset index, and revisit records for repeated payloads.

1. `capture` writes each run of rows as one WARC file compressed as a single gzip stream (no record can be reached
   without inflating what stands before it) and returns a narrow row a record: file, order, page, digest, length.
2. The digests are grouped on Spark: of equal payloads of at least `least` bytes the largest page_id stays a response,
   the others become revisits. Pages never move; only these narrow rows are shuffled.
3. `normalise` takes one monolithic file a group: inflates the stream once in bounded pieces, rewrites every record as
   its own gzip member (a revisit without its payload), writes a sidecar index (page, offset, length) and removes the
   monolithic file.
4. `read_back` opens members through the index and returns what their headers and payloads say.

Files go to the shared folder through pyarrow's file systems. A retried task writes under a name of its own attempt
first and then moves the file, so a lost executor leaves no half file behind a final name.

Edge cases: null html is an empty payload; rows with a null page_id go, of rows that repeat a page_id the least stays;
an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean, shared_dir, stored

_PIECE = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id: int, url: str, payload: bytes, payload_digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the full payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream that comes in pieces."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        for piece in chunks:
            held.extend(piece)
            return True
        ended = True
        return False

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if cut < 0:
            if held.strip():
                raise ValueError("the stream ends inside a record's headers")
            return
        head = parse(bytes(held[:cut]))
        size = int(head["content-length"])
        while len(held) < cut + 8 + size and more():
            pass
        if len(held) < cut + 8 + size:
            raise ValueError("the stream ends inside a record")
        yield head, bytes(held[cut + 4 : cut + 4 + size])
        del held[: cut + 8 + size]


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip stream of any number of members, in pieces."""
    engine = zlib.decompressobj(31)
    while raw := stream.read(_PIECE):
        while raw:
            yield engine.decompress(raw, _PIECE)
            raw = engine.unconsumed_tail
            if engine.eof:
                raw = engine.unused_data + raw
                engine = zlib.decompressobj(31)
    yield engine.flush()


_RAW = "file string, seq long, page_id long, digest string, size long"


def _capture(folder: str, file_bytes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        out = engine = None
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            out.write(engine.flush())
            out.close()
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "seq", "page_id", "digest", "size"])

        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url"), batch.column("html"), strict=True):
                if out is None:
                    name, rows, written = f"raw-{uuid.uuid4().hex}.warc.gz", [], 0
                    out, engine = system.open_output_stream(f"{root}/{name}.part", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = (html.as_py() or "").encode()
                mark = digest(payload)
                out.write(engine.compress(record("response", page, url.as_py() or "", payload, mark, len(payload))))
                rows.append((name, len(rows), page, mark, len(payload)))
                written += len(payload)
                if written >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


_INDEX = "file string, page_id long, offset long, length long"


def _normalise(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        system, root = _file_system(folder)
        raw = group.file.iloc[0]
        name = raw.replace("raw-", "page-", 1)
        refers = {p: (None if pd.isna(r) else int(r)) for p, r in zip(group.page_id, group.refers_to, strict=True)}
        index, at = [], 0
        part = f"{root}/{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as out, system.open_input_stream(f"{root}/{raw}", compression=None) as stream:
            for head, block in records(inflate(stream)):
                page = int(head["warc-record-id"][10:-1])
                payload = block.partition(b"\r\n\r\n")[2]
                kind = "response" if refers[page] is None else "revisit"
                engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = engine.compress(record(kind, page, head["warc-target-uri"], payload, head["warc-payload-digest"][5:], len(payload), refers[page])) + engine.flush()
                out.write(member)
                index.append((name, page, at, len(member)))
                at += len(member)
        system.move(part, f"{root}/{name}")
        with system.open_output_stream(f"{part}.idx", compression=None) as out:
            out.write("".join(f"{p}\t{o}\t{n}\n" for _, p, o, n in index).encode())
        system.move(f"{part}.idx", f"{root}/{name}.idx")
        return pd.DataFrame(index, columns=["file", "page_id", "offset", "length"])

    return run


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _read(folder: str, with_payload: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        opened = (None, None)
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if opened[0] != file:
                    opened = (file, system.open_input_file(f"{root}/{file}"))
                opened[1].seek(offset)
                ((head, block),) = records(iter([zlib.decompress(opened[1].read(length), 31)]))
                http, _, payload = block.partition(b"\r\n\r\n")
                response = head["warc-type"] == "response"
                size, mark = int(parse(http)["content-length"]), head["warc-payload-digest"][5:]
                if response and (size != len(payload) or mark != digest(payload)):
                    raise ValueError(f"{file}, {offset}: the payload doesn't agree with its headers")
                rows.append((int(head["warc-record-id"][10:-1]), size, mark, head["warc-type"], None if response else int(head["warc-refers-to"][10:-1]), payload.decode() if with_payload and response else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as normalised archives with sidecar indexes below folder; returns the index."""
    rows = keyed(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html")
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    raw = stored(rows.mapInArrow(_capture(folder, file_bytes), _RAW), "captured")
    top = raw.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    linked = raw.join(top, "digest", "left").withColumn("refers_to", F.when((F.col("size") >= least) & (F.col("top") != F.col("page_id")), F.col("top")))
    # The rows are narrow, the work behind them isn't: a partition a file, as the given number isn't merged into fewer.
    dealt = linked.select("file", "page_id", "refers_to").repartition(_files(raw), "file")
    index = stored(dealt.groupBy("file").applyInPandas(_normalise(folder), _INDEX), "index")
    system, root = _file_system(folder)
    for found in system.get_file_info(__import__("pyarrow.fs").fs.FileSelector(root)):  # file names, not rows
        if found.base_name.startswith("raw-"):
            system.delete_file(found.path)
    return index


def _files(rows: DataFrame) -> int:
    return max(1, rows.select("file").distinct().count())


def read_back(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record, read through the index; payload is given for responses if asked for."""
    return index.repartition(_files(index), "file").sortWithinPartitions("file", "offset").mapInArrow(_read(folder, with_payload), _READ)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, as its archive gives it back."""
    folder = f"{shared_dir(pages.sparkSession)}/tidemark-{uuid.uuid4().hex}/warc"
    return read_back(write_archives(pages, folder, least), folder).drop("payload")
