"""WARC archives in seekable Zstandard bundles, with an index of frame-relative offsets."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 100
#: A frame closes at so many bytes of records, a bundle at so many compressed bytes.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Frames whose records one task reads together.
FRAMES_TOGETHER = 64

# Fixed values of the seekable format: a skippable frame with the sizes of all frames, and a footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
_ENTRY, _HEAD, _FOOTER = struct.Struct("<II"), struct.Struct("<II"), struct.Struct("<IBI")

_INDEX = "page_id long, bundle string, frame int, offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, declared_digest string, payload binary"


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) for every page.

    The payload is the html in UTF-8, a null is empty. Of equal payloads of at least
    100 bytes the one with the smallest page_id is a response, the others are
    revisits that refer to it; shorter ones are all responses. Rows that share id
    and payload are alike. A page without an id is a revisit if a page with an id
    has its payload, else a response. Only ids and digests are grouped, so a
    payload that fills a third of the table folds to one row per task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    repeated = base.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1 and first is not null").select("digest", "first")
    joined = base.join(repeated, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    return joined.select("page_id", "url", "payload", "digest", kind.alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


# ---- records as bytes


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restore(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def to_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit carries no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if kind == "revisit" else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def from_bytes(record: bytes) -> tuple[int | None, str | None, str, int | None, str, bytes]:
    """(page_id, url, record type, refers_to, digest in the header, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in lines)
    size = int(named["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not have the length that its header states")
    number = lambda key: int(named[key]) if key in named else None
    url = _restore(named["WARC-Target-URI"]) if "WARC-Target-URI" in named else None
    return number("Page-ID"), url, named["WARC-Type"], number("Refers-To-Page-ID"), named["WARC-Payload-Digest"].removeprefix("sha256:"), rest[:size]


# ---- bundles


class Bundle:
    """Writes one seekable file: independent frames, then the table of their sizes."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        self.path, self.sizes, self.written = path, [], 0
        self._out = files.open_output_stream(path, compression=None)
        self._compressor = zstandard.ZstdCompressor(level=3)

    def add(self, frame: bytes) -> None:
        packed = self._compressor.compress(frame)
        self._out.write(packed)
        self.sizes.append((len(packed), len(frame)))
        self.written += len(packed)

    def close(self) -> None:
        table = b"".join(_ENTRY.pack(*s) for s in self.sizes)
        self._out.write(_HEAD.pack(SKIPPABLE, len(table) + _FOOTER.size) + table + _FOOTER.pack(len(self.sizes), 0, SEEKABLE))
        self._out.close()


class BundleReader:
    """Reads single frames of a seekable file by the table at its end."""

    def __init__(self, path: str) -> None:
        files, inner = fs.FileSystem.from_uri(path)
        self._in = files.open_input_file(inner)
        end = self._in.size()
        count, flags, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = _ENTRY.size + (4 if flags & 0x80 else 0)
        table = self._at(end - _FOOTER.size - count * width, count * width)
        self._frames, place = [], 0
        for k in range(count):
            packed, size = _ENTRY.unpack_from(table, k * width)
            self._frames.append((place, packed, size))
            place += packed

    def _at(self, place: int, size: int) -> bytes:
        self._in.seek(place)
        return self._in.read(size)

    def frame(self, number: int) -> bytes:
        place, packed, size = self._frames[number]
        return zstandard.ZstdDecompressor().decompress(self._at(place, packed), max_output_size=size)

    def close(self) -> None:
        self._in.close()


def write(found: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write records, as ``records`` gives them, below ``folder``; one index row for each.

    The index names the bundle, the frame in it, and the place and length in the
    decompressed frame. ``folder`` is a URI that all executors reach. Every attempt
    of a task writes files under names of its own, and only the index of the attempt
    that counts is kept, so lost executors leave files that nobody reads but no wrong
    ones. The result is lazy: store it once, as each run writes the files again. A
    task holds one frame; an empty table gives an empty index.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        out: Bundle | None = None
        name, index, held, size = "", [], [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = Bundle(files, f"{inner}/{name}")
                record = to_bytes(*(v.as_py() for v in row), date)
                index.append((row[0].as_py(), f"{folder}/{name}", len(out.sizes), size, len(record)))
                held.append(record)
                size += len(record)
                if size >= FRAME_BYTES:
                    out.add(b"".join(held))
                    held, size = [], 0
                    if out.written >= BUNDLE_BYTES:
                        out.close()
                        out = None
                        yield _batch(index, schema)
                        index = []
        if out is not None:
            if held:
                out.add(b"".join(held))
            out.close()
            yield _batch(index, schema)

    return found.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(bundle, _INDEX)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read(index: DataFrame) -> DataFrame:
    """The records that index rows point at; all of an archive or a few of its records alike.

    Rows of near frames meet in one task, which fetches and decompresses each frame
    once, by the seek table, and cuts the records out. A null payload does not occur;
    that of a revisit is empty.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary())])
        reader, opened, number, frame = None, None, None, b""
        rows, size = [], 0
        for batch in batches:
            for bundle, at, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != opened:
                    if reader is not None:
                        reader.close()
                    reader, opened, number = BundleReader(bundle), bundle, None
                if at != number:
                    frame, number = reader.frame(at), at
                rows.append(from_bytes(frame[offset : offset + length]))
                size += length
                if size >= 1 << 23:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)
        if reader is not None:
            reader.close()

    places = index.select("bundle", "frame", "offset", "length").repartition("bundle", F.floor(F.col("frame") / FRAMES_TOGETHER))
    return places.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(fetch, _RECORD)


def resolve(read_back: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), revisits with the figures of what they refer to.

    Sizes and digests are taken from the payloads that were read. A revisit is
    matched by the page it refers to and the digest in its header.
    """
    taken = read_back.select("page_id", "record_type", "refers_to", "declared_digest", F.octet_length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest"))
    responses = taken.where("record_type = 'response'")
    full = responses.select(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("declared_digest"), F.col("own_bytes").alias("payload_bytes")).distinct()
    revisits = taken.where("record_type = 'revisit'").join(full, ["refers_to", "declared_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = responses.select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    return first.unionByName(revisits.withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("declared_digest"))).select(*columns))
