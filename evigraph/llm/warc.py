"""WARC archives in Zstandard: one frame per record, dictionary in a leading skippable frame.

Writing. Each task writes ``.warc.zst`` files of bounded size into a shared folder. A file
opens with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then every
record is one Zstandard frame. Records whose payload of ``MIN_REVISIT`` or more bytes
equals another's are ``revisit`` records that refer to the ``response`` of the smallest
page id and carry the HTTP headers only.

Reading. A file is streamed: the dictionary is loaded from its skippable frame, each frame
is decoded alone, and the record is checked (version line, required fields, lengths of
block and payload, digest of every payload present). A record that fails raises
``WarcError`` with the file and offset.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.runtime import bound_batches, delete_path, hash_sample, materialize, scratch_path, shuffle_width, spread_join

MIN_REVISIT = 100
DICTIONARY_MAGIC = 0x184D2A5D
#: The dictionary only helps compression; it is fitted on this many pages at most.
DICTIONARY_PAGES, DICTIONARY_PAGE_CHARS, DICTIONARY_BYTES = 512, 8192, 32768
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:evigraph:page:([^>]*)>")


class WarcError(ValueError):
    """A file or record that breaks the format."""


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary, or b"" where there is too little to learn from."""
    samples = [s for s in samples if s]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def _uri(page: object) -> str:
    return f"<urn:evigraph:page:{'' if page is None else page}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """The bytes of one record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else _uri(page)[1:-1]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; raises ``WarcError`` if it is malformed."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {fields['content-length']}")
    block, kind = rest[:-4], fields["warc-type"]
    out = {"record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind in ("response", "revisit"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP header block")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        digest = re.fullmatch(r"sha256:([0-9a-f]{64})", fields.get("warc-payload-digest", ""))
        if not length or not digest:
            raise WarcError("no payload length or digest")
        out |= {"payload_bytes": int(length[1]), "payload_digest": digest[1]}
        if kind == "response":
            if len(payload) != int(length[1]) or hashlib.sha256(payload).hexdigest() != digest[1]:
                raise WarcError("payload differs from its length or digest")
            out["payload"] = payload
        elif payload or not out["refers_to"]:
            raise WarcError("revisit with a payload or without a reference")
    return out


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """``(offset, record bytes)`` per frame of a ``.warc.zst`` stream, decoded one at a time."""
    offset, held = 0, stream.read(CHUNK)
    dictionary = None

    def fill(n: int) -> None:
        nonlocal held
        while len(held) < n and (more := stream.read(CHUNK)):
            held += more
        if len(held) < n:
            raise WarcError(f"truncated at offset {offset}")

    while held or (held := stream.read(CHUNK)):
        fill(4)
        magic = struct.unpack("<I", held[:4])[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            fill(8)
            size = struct.unpack("<I", held[4:8])[0]
            fill(8 + size)
            if magic == DICTIONARY_MAGIC and not offset:
                data = held[8 : 8 + size]
                if data[:4] == struct.pack("<I", 0xFD2FB528):  # a dictionary may itself be compressed
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                dictionary = zstandard.ZstdCompressionDict(data)
            held, offset = held[8 + size :], offset + 8 + size
            continue
        if magic != 0xFD2FB528:
            raise WarcError(f"no frame at offset {offset}")
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, taken = [], 0
        while True:
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as error:
                raise WarcError(f"frame at offset {offset}: {error}") from error
            if frame.eof:
                taken += len(held) - len(frame.unused_data)
                held = frame.unused_data
                break
            taken += len(held)
            held = stream.read(CHUNK)
            if not held:
                raise WarcError(f"truncated frame at offset {offset}")
        yield offset, b"".join(parts)
        offset += taken


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row under ``folder``; returns ``(path, records, bytes)`` per file.

    Null html is an empty payload, a null url is replaced by the record's own URN, null ids
    are kept. Of rows that repeat the smallest id each is a response. File names hold the
    task attempt, so a repeated attempt never meets the files of a lost one; the returned
    list, written once, names the files that count.
    """
    spark = pages.sparkSession
    bound_batches(spark, 256)
    narrow = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    )
    chosen = hash_sample(narrow.select("page_id"), ["page_id"], DICTIONARY_PAGES).distinct()
    room = F.greatest(F.length("html") - DICTIONARY_PAGE_CHARS, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("html"), room) + 1).cast("int")  # a stretch from anywhere in the page
    kept = narrow.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min(F.substring("html", start, F.lit(DICTIONARY_PAGE_CHARS))).alias("html"))
    dictionary = fit_dictionary([r.html.encode("utf-8", "surrogatepass") for r in kept.orderBy("page_id").collect()])

    marks = narrow.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).where(f"n >= {MIN_REVISIT}")
    marks = materialize(marks.select("page_id", "digest"), "warc-marks", compact=True)
    firsts = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = spread_join(marks, materialize(firsts, "warc-firsts", compact=True), ["digest"], "copies").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    # a repeated id may have several payloads, so the digest is part of the key
    ready = narrow.withColumn("digest", F.sha2("html", 256)).join(revisits, ["page_id", "digest"], "left")
    ready = ready.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "digest", "refers_to")
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        made, out, squeeze = [], None, None
        for batch in batches:
            for page, link, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.zst"
                    out = store.open_output_stream(path)
                    out.write(dictionary_frame(dictionary))
                    made.append([path, 0, 0])
                    squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
                raw = squeeze.compress(record(page, link, payload, digest, refers, refers is not None))
                out.write(raw)
                made[-1][1] += 1
                made[-1][2] += len(raw)
                if made[-1][2] >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "records", "bytes"])

    return materialize(ready.mapInArrow(run, "path string, records long, bytes long"), "warc-files", compact=True)


def read_archives(spark: SparkSession, files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One checked row per record of the listed files (column ``path``, within ``folder``'s store)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        names = ["path", "offset", "record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
        if with_payload:
            names, kinds = [*names, "payload"], [*kinds, pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for offset, raw in frames(stream):
                        try:
                            rows.append({"path": path, "offset": offset, **parse_record(raw)})
                        except (WarcError, UnicodeDecodeError) as error:
                            raise WarcError(f"{path}, offset {offset}: {error}") from error
                        held += len(raw) if with_payload else 0
                        if len(rows) >= 1000 or held > CHUNK * 16:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    shape = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"
    return files.select("path").repartition(shuffle_width(spark)).mapInArrow(run, shape + ", payload binary" * with_payload)


def page_of(uri: str, kind: str) -> F.Column:
    text = F.regexp_extract(uri, _ID.pattern, 1)
    return F.when(text == "", F.lit(None)).otherwise(text).cast(kind)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page, read the archives back, and return what was read.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. One row per page:
    null html is an empty payload, repeated ids keep a row each, and of equal payloads all
    with a null id stay responses (a revisit could not say which it refers to). Other columns
    are ignored. Revisits take
    length and digest from their own headers, checked against the response they refer to;
    a mismatch or a missing response raises an error.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    files = write_archives(pages, folder)
    read = materialize(
        read_archives(spark, files, folder).select(
            page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to", kind).alias("refers_to")
        ),
        "warc-records",
        compact=True,
    )
    delete_path(spark, folder)  # everything that was in the archives has been read and checked
    responses = read.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")
    ).distinct()
    revisits = read.where("record_type = 'revisit'").join(responses.withColumnRenamed("d", "payload_digest"), ["refers_to", "payload_digest"], "left")
    checked = revisits.select(
        "page_id",
        F.when(F.col("n") == F.col("payload_bytes"), F.col("payload_bytes"))
        .otherwise(F.raise_error(F.lit("a revisit differs from its response")).cast("long"))
        .alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
    return read.where("record_type = 'response'").unionByName(checked)
