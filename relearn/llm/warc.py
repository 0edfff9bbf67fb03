"""WARC archives: writing, normalising monolithic gzip files, reading back by offset.

Archives are written by Spark's text writer, whose gzip output is one stream over a whole file. The
normaliser inflates such a stream once, in pieces, writes every record as a gzip member of its own
and lists the members' places in a sidecar index. Records can then be read alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relearn.llm.common import map_rows, new_folder, pin, sent_if_small

END = b"\r\n\r\n"
PIECE = 1 << 20
#: Payload bytes written into one archive, about.
ARCHIVE_BYTES = 32_000_000


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, record (WARC text) of every page, its payload the html in UTF-8 (null: empty).

    Of equal payloads of ``least`` bytes or more the smallest page_id is the response; pages with
    other ids are revisits, which name it and carry no payload. Rows without page_id, and rows that
    repeat the response's id, are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html")
    ).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2(F.encode("html", "UTF-8"), 256)})
    firsts = (
        rows.where((F.col("size") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last")
        .select("digest", "first")
    )
    joined = rows.join(sent_if_small(pin(firsts, "firsts")), "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    clean = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(again, "0").otherwise(F.col("size").cast("string"))),
    )
    return joined.select("page_id", "size", F.concat(head, F.lit("\r\n\r\n"), F.when(again, "").otherwise(F.col("html"))).alias("record"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """gzip archives of about ``archive_bytes`` payload each at most; ``records``: page_id, size, record.

    Tasks write what they read, without a shuffle, and begin a new archive after a number of
    records that their mean size gives.
    """
    mean = records.agg(F.avg("size")).first()[0] or 0
    most = max(1, int(archive_bytes // max(mean, 1)))
    writer = records.select("record").write.option("compression", "gzip").option("lineSep", END.decode())
    writer.option("maxRecordsPerFile", most).text(folder)


def inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members."""
    tool, at = zlib.decompressobj(31), 0
    while at < len(data) or tool.unconsumed_tail:
        rest = tool.unconsumed_tail
        if not rest:
            rest, at = data[at : at + PIECE], min(at + PIECE, len(data))
        yield tool.decompress(rest, PIECE)
        if tool.eof:
            at -= len(tool.unused_data)
            if at >= len(data):
                return
            tool = zlib.decompressobj(31)


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and bytes of each record of a stream; only the current record is held."""
    held = bytearray()

    def fill(need: int) -> bool:
        while len(held) < need:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        end, seen = held.find(END), 0
        while end < 0:
            seen = max(0, len(held) - len(END))
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
            end = held.find(END, seen)
        fields = header_fields(bytes(held[:end]))
        size = end + len(END) + int(fields["content-length"]) + len(END)
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[:size])
        del held[:size]


def member(record: bytes, level: int = 3) -> bytes:
    tool = zlib.compressobj(level, zlib.DEFLATED, 31)
    return tool.compress(record) + tool.flush()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or absolute path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives of ``source`` into ``target``; archive, offset, length, type, record_id of each record.

    Each archive becomes <name>.warc.gz with <name>.idx beside it (offset, length, type, record id).
    A file is written under a name of its own and then moved, so a task may run twice. The folder must
    be reachable by its URI from all executors.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("archive", "offset", "length", "type", "record_id")}
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = f"{target}/{PurePosixPath(path).name.split('.')[0]}.warc.gz"
            system, place = opened(name)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            own = f"{place}.{uuid.uuid4().hex[:12]}.part"
            offset, lines = 0, []
            with system.open_output_stream(own) as stream:
                for fields, record in records_in(inflated(content.as_py())):
                    data = member(record)
                    stream.write(data)
                    row = (name, offset, len(data), fields.get("warc-type"), fields.get("warc-record-id"))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    lines.append("\t".join(map(str, row[1:])))
                    offset += len(data)
            with system.open_output_stream(f"{own}.idx") as stream:
                stream.write("".join(f"{x}\n" for x in lines).encode())
            system.move(own, place)
            system.move(f"{own}.idx", place.removesuffix(".warc.gz") + ".idx")
        return out

    # The offsets are part of the result: written once, so no later pass rewrites archives.
    return pin(map_rows(files, work, "archive string, offset long, length long, type string, record_id string", rows=1), "index")


def read_back(index: DataFrame) -> DataFrame:
    """One row a record, read by its place: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are those of the bytes read, and must equal its header; a revisit's
    are those of the header, as the payload lies in the record it refers to.
    """

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
        for archive in dict.fromkeys(r[0] for r in rows):
            system, place = opened(archive)
            with system.open_input_file(place) as f:
                for _, offset, length in (r for r in rows if r[0] == archive):
                    ((fields, record),) = records_in(iter([zlib.decompress(f.read_at(length, offset), 31)]))
                    at = record.index(END) + len(END)
                    body = record[at : at + int(fields["content-length"])]
                    size, said = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response" and (hashlib.sha256(body).hexdigest(), len(body)) != (said, size):
                        raise ValueError(f"{archive}: record at {offset} does not match its digest")
                    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
                    row = (number(fields["warc-record-id"]), size, said, fields["warc-type"], number(fields.get("warc-refers-to")))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
        return out

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_rows(index.select("archive", "offset", "length"), work, schema)


def page_archives(pages: DataFrame, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write pages as archives in the shared folder, normalise them, read them back: (records, index).

    Null and empty html are empty payloads; an empty table gives no row. Other columns than page_id,
    url and html are not read. Jobs run when this is called.
    """
    spark = pages.sparkSession
    raw, normal = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    write_archives(page_records(pages, least), raw, archive_bytes)
    index = normalise(spark, raw, normal)
    return read_back(index), index
