"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame.

Defined results: a null payload is empty; a null url has no WARC-Target-URI; an empty table gives no archive; of records
with equal payloads all rows that share the smallest id are responses; a null id is never the smallest (a payload that
only null ids have is a response each time). Control characters and blanks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terncube.llm.runtime import Scratch

#: Fixed values of the formats.
SKIPPABLE_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:terncube:page:"
FIELDS = "archive string, record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary, headers map<string,string>, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, url: str | None, payload: bytes, first: str | None) -> bytes:
    """One record: a response, or a revisit of the record with key first; a revisit's block has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{key}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        safe = "".join(c if "\x20" < c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dict_bytes: int, level: int) -> bytes:
    """The archive of some records; the dictionary is trained on the first few hundred of them."""
    try:
        trained = zstandard.train_dictionary(dict_bytes, [r[:8192] for r in records[:256]])
    except zstandard.ZstdError:  # too few or too uniform samples
        trained = None
    out = [] if trained is None else [struct.pack("<II", SKIPPABLE_MAGIC, len(trained.as_bytes())), trained.as_bytes()]
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    return b"".join([*out, *map(packer.compress, records)])


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one after the other; the dictionary may itself be compressed."""
    view, at, loaded = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE_MAGIC:
        n = struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8 : 8 + n])
        if len(raw) != n:
            raise ValueError("the dictionary frame is cut off")
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        loaded, at = zstandard.ZstdCompressionDict(raw), 8 + n
    unpacker = zstandard.ZstdDecompressor(dict_data=loaded)
    while at < len(view):
        one, out = unpacker.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("a frame is cut off")
            piece = view[at : at + 65536]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """The fields of a decoded record; error says what is wrong with it, or is None."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        headers[name.strip().lower() if colon else line] = value.strip()
    named = lambda k: headers.get(k, "").strip("<>") or None
    out = {"record_type": headers.get("warc-type"), "record_id": named("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "payload_digest": None, "refers_to": named("warc-refers-to"), "payload_bytes": None, "payload": None, "headers": headers, "error": None}
    length = headers.get("content-length", "")
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"error": "no WARC header"}
    if not length.isdigit() or int(length) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "Content-Length does not fit the record"}
    block = rest[:-4]
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        return out | {"error": "block digest differs"}
    out["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
        out["payload_bytes"] = len(payload) if told is None else told
        if out["record_type"] == "revisit":
            return out | {"error": None if out["refers_to"] else "revisit without WARC-Refers-To"}
        if told is not None and told != len(payload):
            return out | {"error": "HTTP Content-Length differs"}
    else:
        payload = block
        out["payload_bytes"] = len(payload)
    out["payload"] = payload
    if out["payload_digest"] and out["payload_digest"] != digest(payload):
        return out | {"error": "payload digest differs"}
    return out


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, archive_bytes: int = 8 << 20, dict_bytes: int = 32768, level: int = 3) -> DataFrame:
    """Archives (archive, content) with a record for every row. Of equal payloads of at least least_bytes bytes, those
    with the smallest key are responses and the others revisit them. Each task closes an archive when it has
    archive_bytes of records, so no archive and no task holds more than that and one record."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sum", F.unhex(F.sha1("payload")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sum").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = rows.join(first, "sum", "left").select(F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("key"), "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("first"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n, part = [], 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{n:04d}.warc.zst"], "content": [archive(held, dict_bytes, level)]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for k, u, p, f in zip(*(batch.column(c) for c in ("key", "url", "payload", "first")), strict=True):
                held.append(record(k.as_py(), u.as_py(), p.as_py(), f.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, n = [], 0, n + 1
        if held:
            yield close()

    return told.mapInArrow(pack, "archive string, content binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (archive, content), in FIELDS; a record that fails a check has its error in a column.
    For .warc.zst files: spark.read.format("binaryFile"), with path and content."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload", "headers", "error"]
        types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.string()]
        schema = pa.schema(list(zip(names, types, strict=True)))

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "headers" else r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], schema=schema)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for data in frames(content.as_buffer() if content.is_valid else b""):
                        rows.append(parse(data) | {"archive": name.as_py()})
                        size += len(data)
                        if not payloads:
                            rows[-1] |= {"payload": None, "headers": {}}
                        if size > 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as x:
                    rows.append(dict.fromkeys(names) | {"archive": name.as_py(), "headers": {}, "error": f"archive: {x}"})
                if rows:
                    yield made(rows)

    return archives.select("archive", "content").mapInArrow(unpack, FIELDS)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    archives = scratch.cut(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    back = read_archives(archives, payloads=False)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), "error"))).otherwise(F.col("record_type"))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), number("refers_to").alias("refers_to"))
