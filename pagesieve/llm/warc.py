"""WARC archives compressed record by record with a dictionary of their own.

An archive is a file that begins with a skippable frame holding a Zstandard dictionary,
followed by one frame for each record. The dictionary is built from a bounded sample of
the records that are archived. Any record can be read alone: with the dictionary, and
the offset that the index has for it.

A record whose payload was archived before is a revisit: it has no payload, and names
the record that has it. Which records are equal is found by digest: one small row for
each digest after partial sums. Digests of more than a thousandth of the repeated payloads
are fewer than a thousand; they are broadcast, and their pages stay where they are. All
others are joined to ids and digests without the payloads, and what is found goes to the
pages by id and digest, which no more than that thousandth share.

A revisit is read by looking up the response that it names.

Tasks write archives under names that no other attempt uses, and only archives named by
a finished task are in the index, so a lost executor leaves at most a stray file.

Defined results
    null payload             empty
    null url                 a record without a target
    null page_id             a record without an id; after all ids when the first of
                             equal payloads is looked for
    equal page_ids           all rows with the smallest id are responses
    equal short payloads     all are responses
    long payloads            whole; an archive is closed once it is large enough
    columns of other names   not read
    empty table              no archives, and no rows
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm.storage import fresh_path, stored

#: Fixed values of the format: the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D

#: Parameters: payloads from here on are looked for again; bytes of an archive; the
#: sample and the size of a dictionary; the bytes of one read.
LEAST_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE_RECORDS = 500
SAMPLE_BYTES = 4 << 20
#: A key of more than one in so many rows is hot.
SHARE = 1000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

INDEX = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
_ID = "urn:page:"


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of ``uri`` and the path on it, for URIs as Spark writes them.

    ``file:/path`` and plain paths are local files, ``s3a`` and ``s3n`` are ``s3``.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def hot_and_usual(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counted (..., n)`` in two: fewer than ``SHARE`` rows with more than their share of
    the sum of ``n``, to be broadcast, and all others."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * SHARE > total
    return F.broadcast(counted.filter(hot).drop("n")), counted.filter(~hot).drop("n")


def record_kinds(pages: DataFrame) -> DataFrame:
    """``pages (page_id, url, payload)`` with ``digest``, ``refers_to`` and ``revisit``."""
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT_BYTES
    again = (
        rows.filter(long)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull())
    )
    hot, usual = hot_and_usual(stored(again, "warc-repeated"))
    first, page_id = F.col("first"), F.col("page_id")
    names = ("page_id", "url", "payload", "digest", "refers_to")
    of_hot = rows.join(hot, "digest").withColumn("refers_to", F.when(~first.eqNullSafe(page_id), first))
    others = rows.join(hot, "digest", "left_anti")
    revisits = (
        others.filter(long)
        .select("page_id", "digest")
        .join(usual, "digest")
        .filter(~first.eqNullSafe(page_id))
        .select(page_id.alias("id"), F.col("digest").alias("of"), first.alias("refers_to"))
        .distinct()
    )
    same = page_id.eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    found = of_hot.select(*names).union(others.join(revisits, same, "left").select(*names))
    return found.withColumn("revisit", F.col("refers_to").isNotNull())


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. ``refers_to`` makes it a revisit without a payload."""
    revisit = refers_to is not None
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    )
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{_ID}{page_id}>")
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_ID}{refers_to}>",
        ]
    body = block if revisit else block + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def sample_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from ``SAMPLE_RECORDS`` records, chosen by the hash of their digests.

    The sample bounds what comes to the driver, and only decides how well archives are
    compressed. Each record gives its beginning, so that all have no more than ``SAMPLE_BYTES``.
    """
    beginning = F.substring("payload", 1, SAMPLE_BYTES // SAMPLE_RECORDS)
    picked = (
        pages.filter(F.octet_length("payload") > 0)
        .select("page_id", "url", beginning.alias("payload"), "digest")
        .orderBy(F.xxhash64("digest", "page_id"))
        .limit(SAMPLE_RECORDS)
    )
    samples, size = [], 0
    for r in picked.toLocalIterator():
        if size >= SAMPLE_BYTES:
            break
        samples.append(record_bytes(r.page_id, r.url, bytes(r.payload), r.digest, None))
        size += len(samples[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // 8, 256)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short; any bytes will do
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages (page_id, url, payload)`` below ``folder``; returns the index.

    The index has ``archive, offset, length`` for each record, and is stored.
    """
    kinds = record_kinds(pages)
    dictionary = sample_dictionary(pages.withColumn("digest", F.sha2("payload", 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        known = _dictionary(dictionary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        out = name = None
        at = 0
        for batch in batches:
            names, offsets, lengths = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))
            for record in zip(*columns, strict=True):
                if out is not None and at >= archive_bytes:
                    out.close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    at = out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                frame = packer.compress(record_bytes(*record))
                out.write(frame)
                names.append(name)
                offsets.append(at)
                lengths.append(len(frame))
                at += len(frame)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=INDEX.fieldNames(),
            )
        if out is not None:
            out.close()

    rows = kinds.select("page_id", "url", "payload", "digest", "refers_to")
    return stored(rows.mapInArrow(run, INDEX), "warc-index")


RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("sound", T.BooleanType()),
    ]
)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records at the places of ``index``, read from the archives below ``folder``.

    ``sound`` says that a response's payload has the length and digest of its header, and
    that a revisit names a response with its own. Length and digest are those of the payload
    that was read. The index is cut into runs of neighbouring records, so an archive is not
    one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        opened: tuple = (None, None, None)
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in INDEX.fieldNames())
            for name, offset, length in zip(*columns, strict=True):
                if opened[0] != name:
                    source = files.open_input_file(f"{path}/{name}")
                    magic, size = struct.unpack("<II", source.read_at(8, 0))
                    if magic != DICTIONARY_FRAME:
                        raise ValueError(f"{name} does not begin with a dictionary")
                    known = _dictionary(source.read_at(size, 8))
                    opened = (name, source, zstandard.ZstdDecompressor(dict_data=known))
                fields, payload = parse_record(opened[2].decompress(opened[1].read_at(length, offset)))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                size, revisit = int(fields["x-payload-bytes"]), fields["warc-type"] == "revisit"
                if not revisit:
                    found = hashlib.sha256(payload).hexdigest()
                    sound = found == digest and len(payload) == size
                    digest, size = found, len(payload)
                out.append(
                    {
                        "page_id": _page_id(fields.get("warc-record-id")),
                        "payload_bytes": size,
                        "payload_digest": digest,
                        "record_type": fields["warc-type"],
                        "refers_to": _page_id(fields.get("warc-refers-to")),
                        "sound": None if revisit else sound,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    runs = index.select(*INDEX.fieldNames())
    return _resolved(stored(runs.mapInArrow(run, RECORDS), "warc-records"))


def _resolved(records: DataFrame) -> DataFrame:
    """``records`` with length, digest and ``sound`` of revisits from the responses they name."""
    revisit = F.col("record_type") == "revisit"
    keys = ["refers_to", "payload_digest"]
    names = records.filter(revisit).groupBy(*keys).agg(F.count("*").alias("n"))
    responses = records.filter(~revisit & F.col("sound")).select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("found")
    )
    # Rows of one id with one payload are the same response.
    hot, usual = hot_and_usual(stored(names.join(responses.distinct(), keys), "warc-named"))
    rows = records.filter(revisit)
    looked_up = rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(usual, keys, "left"))
    size = F.coalesce("found", "payload_bytes")
    sound = F.col("found").eqNullSafe(F.col("payload_bytes"))
    done = looked_up.select(
        "page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", sound.alias("sound")
    )
    return records.filter(~revisit).unionByName(done)


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("sound", pa.bool_()),
    ]
)


def _page_id(value: str | None) -> int | None:
    return None if value is None else int(value.removeprefix(f"<{_ID}").removesuffix(">"))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages (page_id, url, html)`` to archives and read all records back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    return read_archives(write_archives(rows, folder), folder)
