"""WARC archives with a two-level capture index.

Pages are written as WARC records, each a gzip member of its own, so that any record can
be read by its place alone. Of records with equal payloads one is a response, the others
revisit it. A task writes its own files; only files named in the written table of
captures count, so that what a lost or repeated task leaves behind is never read.

The index sorts captures by their URL with the host reversed (``com,example,www)/path``),
compresses the sorted lines in blocks, and keeps a sparse directory with the first and last key of
each block. A lookup finds by binary search in the directory the blocks that can hold
a key, opens only those, and reads the captures' byte ranges from the archives.

Archives lie below the shared folder of the session and are read and written with
``pyarrow.fs``.

Defined results: a null html is an empty payload; a null url has the key ``""`` and no
target in its record; control characters and spaces in urls are percent-encoded. A null
``page_id`` is never referred to, but may revisit. Rows that repeat a page's id and
payload are all responses if the id is the smallest. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import only
from lexicarta.session import materialize, scratch_path

#: Payloads of fewer bytes are never revisited.
LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Bytes of an archive whose ranges one task reads.
RANGE_BYTES = 8 << 20
#: Lines of the index in a compressed block.
BLOCK_LINES = 1024
#: Pages carry no capture time; the records need one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = (
    "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint,"
    " refers_to_url string, payload binary"
)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder or file."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def url_key(url: str | None) -> str:
    """The url with its host reversed, without scheme and fragment."""
    if not url:
        return ""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", url.split("#", 1)[0])
    if not rest.startswith("//"):
        return rest
    host, slash, path = rest[2:].partition("/")
    host, question, query = host.partition("?")
    host = host.rsplit("@", 1)[-1].lower()
    name, _, port = host.partition(":")
    reversed_host = ",".join(reversed(name.split(".")))
    return reversed_host + (f":{port}" if port not in ("", "80", "443") else "") + ")/" + question + query + path


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}').urn}>"


def record_bytes(row: dict) -> bytes:
    """One WARC record of a page."""
    revisit = row["record_type"] == "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_record_id(row['page_id'], row['url'])}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['url'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {_record_id(row['refers_to'], row['refers_to_url'])}",
            f"X-Refers-To-Page-Id: {row['refers_to']}",
        ]
        if row["refers_to_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(row['refers_to_url'])}")
    block = HTTP_HEAD if revisit else HTTP_HEAD + row["payload"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of ``RECORD`` from the bytes of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    return {
        "page_id": number("X-Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "refers_to": number("X-Refers-To-Page-Id"),
        "refers_to_url": fields.get("WARC-Refers-To-Target-URI"),
        "payload": None if kind == "revisit" else block.partition(b"\r\n\r\n")[2],
    }


def capture_rows(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, record type and what they refer to."""
    rows = only(pages, page_id="bigint", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = (
        rows.where(F.col("size") >= LEAST_PAYLOAD)
        .groupBy("payload_digest", "size")
        .agg(first.alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("payload_digest", "size", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    groups = materialize(groups, "payload-groups")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(groups, ["payload_digest", "size"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(again, F.col("first_url")).alias("refers_to_url"),
    )


def written(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives and returns the table of captures ``(key, page_id, file, offset, length)``."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if sink is None:
                    name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record_bytes(row)) + packer.flush()
                sink.write(data)
                rows.append((url_key(row["url"]), row["page_id"], f"{folder}/{name}", at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["key", "page_id", "file", "offset", "length"],
                )
        if sink is not None:
            sink.close()

    found = capture_rows(pages).mapInArrow(
        run, "key string, page_id bigint, file string, offset bigint, length bigint"
    )
    return materialize(found, "captures")


def _batch(records: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in records], k) for n, k in zip(names, kinds)], names=names
    )


def _batches(records: Iterator[dict], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record["payload"] or b"") + 512
        if size >= limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def members(stream, chunk: int = 1 << 17) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one after the other."""
    data, packer, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(packer.decompress(data))
        data = b""
        if packer.eof:
            yield b"".join(parts)
            data, packer, parts = packer.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("an archive ends within a record")


def read(captures: DataFrame) -> DataFrame:
    """All records of the archives that captures name, each archive read from start to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            for batch in batches:
                for file in batch.column("file").to_pylist():
                    system, path = opened(file)
                    with system.open_input_stream(path, compression=None) as stream:
                        yield from map(parse_record, members(stream))

        yield from _batches(records())

    files = captures.select("file").distinct()
    return files.repartition(_tasks(captures), "file").mapInArrow(run, RECORD)


def _tasks(captures: DataFrame) -> int:
    """A fixed number of tasks for the archives of captures, however few bytes their names are."""
    n = captures.agg(F.count_distinct("file")).first()[0]
    return max(1, min(n, max(n // 16, 2 * captures.sparkSession.sparkContext.defaultParallelism)))


def index(captures: DataFrame) -> DataFrame:
    """``(part, block, first_key, last_key, lines, data)``: sorted captures in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, block = TaskContext.get().partitionId(), [], 0

        def packed(lines: list[tuple], number: int) -> pa.RecordBatch:
            data = "\n".join("\t".join(("" if v is None else str(v)) for v in line) for line in lines)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part,
                        "block": number,
                        "first_key": lines[0][0],
                        "last_key": lines[-1][0],
                        "lines": len(lines),
                        "data": zlib.compress(data.encode()),
                    }
                ],
                pa.schema(
                    [("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()),
                     ("lines", pa.int32()), ("data", pa.binary())]
                ),
            )

        for batch in batches:
            held += zip(*(batch.column(n).to_pylist() for n in ("key", "page_id", "file", "offset", "length")))
            while len(held) >= BLOCK_LINES:
                yield packed(held[:BLOCK_LINES], block)
                held, block = held[BLOCK_LINES:], block + 1
        if held:
            yield packed(held, block)

    # Keys are one line of an index without tabs.
    rows = captures.withColumn("key", F.regexp_replace("key", r"[\t\r\n]", "%20"))
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "offset"]
    return materialize(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
            run, "part int, block int, first_key string, last_key string, lines int, data binary"
        ),
        "index",
    )


def located(indexed: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, page_id, file, offset, length)`` of all captures with one of ``keys(key)``.

    The directory of an index partition and the keys that fall into it meet in one task
    and are matched by binary search; then only blocks that can hold a key are opened.
    """
    import pandas as pd

    spans = [
        (r["low"], r["high"], r["part"])
        for r in indexed.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    ]  # one row per index partition
    spans.sort(key=lambda s: (s[0], s[1]))
    highs, lows = [s[1] for s in spans], [s[0] for s in spans]

    def parts_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = []
            for key in column.to_pylist():
                begin, end = bisect.bisect_left(highs, key), bisect.bisect_right(lows, key)
                found.append([spans[i][2] for i in range(begin, end)])
            yield pa.array(found, pa.list_(pa.int32()))

    parts_of.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}

    def blocks_of(wanted: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        directory = directory.sort_values("block")
        firsts, lasts = directory["first_key"].tolist(), directory["last_key"].tolist()
        numbers, rows = directory["block"].tolist(), []
        for part, key in zip(wanted["part"], wanted["key"]):
            for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                rows.append((part, numbers[i], key))
        return pd.DataFrame(rows, columns=["part", "block", "key"]).astype({"part": "int32", "block": "int32"})

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, wanted in zip(batch.column("data").to_pylist(), batch.column("keys").to_pylist()):
                lines = [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
                only_keys = [line[0] for line in lines]
                for key in wanted:
                    for i in range(bisect.bisect_left(only_keys, key), bisect.bisect_right(only_keys, key)):
                        _, page_id, file, offset, length = lines[i]
                        rows.append((key, int(page_id) if page_id else None, file, int(offset), int(length)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "page_id", "file", "offset", "length"]
            )

    wanted = keys.select(F.regexp_replace("key", r"[\t\r\n]", "%20").alias("key")).distinct()
    wanted = wanted.select("key", F.explode(F.arrow_udf(parts_of, "array<int>")("key")).alias("part"))
    touched = (
        wanted.groupBy("part")
        .cogroup(indexed.select("part", "block", "first_key", "last_key").groupBy("part"))
        .applyInPandas(blocks_of, "part int, block int, key string")
    )
    # A block's keys are at most its lines.
    by_block = touched.groupBy("part", "block").agg(F.collect_list("key").alias("keys"))
    return (
        by_block.join(indexed.select("part", "block", "data"), ["part", "block"])
        .select("keys", "data")
        .mapInArrow(lines_of, "key string, page_id bigint, file string, offset bigint, length bigint")
    )


def ranges(captures: DataFrame) -> DataFrame:
    """The records at the captures' places, each read by its byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            name, source = None, None
            for batch in batches:
                for file, offset, length in zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length"))):
                    if file != name:
                        if source is not None:
                            source.close()
                        system, path = opened(file)
                        name, source = file, system.open_input_file(path)
                    source.seek(offset)
                    yield parse_record(zlib.decompress(source.read(length), 31))
            if source is not None:
                source.close()

        yield from _batches(records())

    placed = captures.select("file", "offset", "length")
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / RANGE_BYTES)  # an archive that is much asked for is shared
    return (
        placed.repartition(parts, "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)
    )


def url_keys(url: Column) -> Column:
    """The index key of a url column."""

    def keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([url_key(u) for u in column.to_pylist()], pa.string())

    keys.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(keys, "string")(url)


def resolved(records: DataFrame, indexed: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` and ``payload_digest`` of their full payloads.

    A response's are counted from its payload. A revisit's are those of the response it
    refers to, which is looked up in the index once and read by its range; ``payload_bytes``
    is null where that response is missing or has another payload.
    """
    told = materialize(
        records.select(
            "page_id",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
            "record_type",
            "refers_to",
            "refers_to_url",
        ),
        "records",
    )  # the archives are read once
    own = told.where("record_type = 'response'").drop("refers_to_url")
    again = told.where("record_type = 'revisit'").drop("payload_bytes", "record_type")
    wanted = again.select("refers_to", "refers_to_url").distinct().withColumn("key", url_keys(F.col("refers_to_url")))
    wanted = materialize(wanted, "wanted")
    places = located(indexed, wanted.select("key")).join(
        wanted.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi"
    )
    targets = (
        ranges(places)
        .where("record_type = 'response'")
        .select(
            F.col("page_id").alias("refers_to"),
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        )
        .distinct()
    )
    return own.unionByName(
        again.join(materialize(targets, "targets"), ["refers_to", "payload_digest"], "left").select(
            "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"
        )
    )
