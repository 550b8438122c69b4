"""Web archives: ARC files of both versions, and their conversion to WARC.

Archives are files in the cluster's shared folder. A task that is run again writes new
files; a table that is staged after each step names the files of finished tasks, and
only those are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import matched, staged, work_dir

#: An archive is closed after so many bytes of payload or so many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 2_000
#: The field names of both ARC versions, as the formats' descriptions have them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _write(path: str, data: bytes) -> None:
    """Writes beside the place and moves there, so that no reader sees half a file."""
    system, name = _at(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    beside = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside, compression=None) as out:
        out.write(data)
    system.move(beside, name)


def _read(path: str) -> bytes:
    system, name = _at(path)
    with system.open_input_stream(name, compression=None) as file:
        return file.read()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked."""
    while data:
        opener = zlib.decompressobj(31)
        yield opener.decompress(data) + opener.flush()
        data = opener.unused_data


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, name: str, offset: int) -> bytes:
    """One ARC record: a line of the version's fields, the body of the declared length, a newline."""
    fields = [url, "0.0.0.0", date, kind]
    if version == 2:
        fields += ["200", hashlib.md5(body).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_file(version: int, name: str, date: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file of (url, content type, body) records, each a gzip member of its own."""
    body = f"{version} 0 threadloom\n{ARC_FIELDS[version]}\n".encode()
    out = bytearray(_member(arc_record(1, f"filedesc://{name}", date, "text/plain", body, name, 0)))
    for url, kind, content in records:
        out += _member(arc_record(version, url, date, kind, content, name, len(out)))
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, packed or not, as field names of its version, and ``body``.

    The version block at the start says the version and names the fields of the lines
    that follow. A body is as long as its line declares, whatever is in it.
    """
    blocks = _members(data) if data[:2] == b"\x1f\x8b" else iter([data])
    names = ARC_FIELDS[1].split(" ")
    for block in blocks:
        at = 0
        while at < len(block):
            if block[at:at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = block.index(b"\n", at)
            # a url may hold blanks, the fields after it don't
            values = block[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
            first = values[0].startswith("filedesc://")
            if first:
                values = block[at:end].decode().rsplit(" ", 4)
            size = int(values[-1])
            body = block[end + 1:end + 1 + size]
            if len(body) < size:
                raise ValueError("an ARC record is shorter than it declares")
            at = end + 1 + size
            if first:
                lines = body.decode().split("\n")
                version = int(lines[0].split(" ")[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"ARC version {version} is not known")
                names = lines[1].strip().split(" ")
            else:
                yield dict(zip(names, values)) | {"body": body}


def http(payload: bytes, page_id: int | None) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse_http(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, payload


def record_id(archive: str, number: int) -> str:
    """The same identifier whenever a record of an archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert(record: dict, archive: str, number: int, first: tuple[str, int, str] | None) -> bytes:
    """The WARC record of an ARC record.

    ``first`` names an earlier record with the same payload (archive, number, url);
    then the result is a revisit of that one and holds the HTTP head only.
    """
    stamp = record["Archive-date"].ljust(14, "0")
    head, payload = parse_http(record["body"])
    headers = {
        "WARC-Type": "revisit" if first else "response",
        "WARC-Record-ID": record_id(archive, number),
        "WARC-Date": f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z",
        "WARC-Target-URI": record["URL"],
        "WARC-IP-Address": record["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    block = record["body"]
    if first:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    "WARC-Refers-To": record_id(first[0], first[1]),
                    "WARC-Refers-To-Target-URI": first[2]}
        block = block[:len(block) - len(payload)]
    headers["WARC-Block-Digest"] = f"sha1:{digest(block)}"
    return warc_record(headers, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for member in _members(data):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode("utf-8", "replace").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            size = int(headers["Content-Length"])
            yield headers, member[end + 4:end + 4 + size]
            at = end + 8 + size


def write_arcs(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """Writes ``page_id``, ``url`` and ``html`` (null: empty) as ARC files; returns their paths.

    Files are of either version. Blanks in urls are percent-encoded, a null url is ``-``. A null
    page_id has no header of its own and is read back as null.
    """
    folder = work_dir(pages.sparkSession, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, name = [], 0, xxhash.xxh3_128()
            paths = []
            for one, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-")
                held.append((url, "text/html", http(payload, one)))
                name.update(url.encode("utf-8", "surrogatepass") + b" " + held[-1][2])
                size += len(payload)
                if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    paths.append(close(held, name.hexdigest()))
                    held, size, name = [], 0, xxhash.xxh3_128()
            if held:
                paths.append(close(held, name.hexdigest()))
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    def close(held: list, name: str) -> str:
        path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.arc.gz"
        _write(path, arc_file(1 + int(name[0], 16) % 2, f"{name}.arc.gz", date, held))
        return path

    source = pages.select(F.col("page_id").cast("long"), "url", "html")
    return staged(source.mapInArrow(write, "path string"), "arcs")


def _each(files: DataFrame, function: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(function(row)), schema=fields)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))])
    return files.mapInArrow(run, schema)


def convert_arcs(arcs: DataFrame, least: int = 0) -> DataFrame:
    """Converts ARC files to WARC files of the same names; returns their paths.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest
    page_id (null last, then by place) becomes a response and the others revisits of it.
    Files are read once for the digests, which alone are compared across files, and
    once to convert them.
    """
    folder = work_dir(arcs.sparkSession, "warc")

    def digests(row: dict) -> Iterator[dict]:
        for number, record in enumerate(parse_arc(_read(row["path"]))):
            head, payload = parse_http(record["body"])
            yield {"path": row["path"], "number": number, "url": record["URL"],
                   "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
                   "size": len(payload), "digest": digest(payload)}

    def write(row: dict) -> Iterator[dict]:
        firsts = {r["number"]: (r["first"], r["first_number"], r["first_url"])
                  for r in row["revisits"] or ()}
        out = b"".join(_member(convert(record, row["path"], number, firsts.get(number)))
                       for number, record in enumerate(parse_arc(_read(row["path"]))))
        path = f"{folder}/{row['path'].rsplit('/', 1)[1].removesuffix('.arc.gz')}.warc.gz"
        _write(path, out)
        yield {"path": path}

    spread = arcs.repartition(max(arcs.sparkSession.sparkContext.defaultParallelism * 2, 2), "path")
    found = staged(_each(spread, digests, "path string, number int, url string, page_id long, "
                                          "size long, digest string"), "digests")
    large = found.where(F.col("size") >= least)
    place = F.struct(F.col("page_id").isNull(), "page_id", "path", "number", "url")
    first = large.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    revisits = (matched(large, first.where("n > 1"), ["digest"], "n", found.count())
                .where((F.col("path") != F.col("first.path")) | (F.col("number") != F.col("first.number")))
                .groupBy("path").agg(F.collect_list(F.struct(
                    "number", F.col("first.path").alias("first"),
                    F.col("first.number").alias("first_number"),
                    F.col("first.url").alias("first_url"))).alias("revisits")))
    # one entry per record of an archive, of which an archive has a bounded number
    return staged(_each(spread.join(revisits, "path", "left"), write, "path string"), "warcs")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """The records of WARC files: page_id, sizes and digests of full payloads, type, what they refer to.

    A revisit's payload size is that of its kept HTTP head. ``refers_id`` is the
    identifier of the record that a revisit refers to.
    """
    def read(row: dict) -> Iterator[dict]:
        for headers, block in parse_warc(_read(row["path"])):
            head, payload = parse_http(block)
            size = int(head.get("content-length", len(payload)))
            if headers["WARC-Type"] == "response" and digest(payload) != headers[
                    "WARC-Payload-Digest"].removeprefix("sha1:"):
                raise ValueError("a WARC record's payload doesn't have its digest")
            yield {"page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
                   "payload_bytes": size, "record_type": headers["WARC-Type"],
                   "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                   "record_id": headers["WARC-Record-ID"], "refers_id": headers.get("WARC-Refers-To")}

    return _each(warcs, read, "page_id long, payload_bytes long, payload_digest string, "
                              "record_type string, record_id string, refers_id string")


def through_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written as ARC files, converted to WARC, and read back with ``refers_to``.

    ``refers_to`` is the page_id of the response that a revisit refers to. Every row of
    ``pages`` gives a record, repeated ones and those with a null page_id too; an empty table
    gives none. A record is held as a whole, however long. Further columns are ignored,
    whatever their names.
    """
    records = staged(read_warcs(convert_arcs(write_arcs(pages), least)), "records")
    named = (records.where("refers_id is not null").groupBy("refers_id").agg(F.count("*").alias("n"))
             .join(records.select(F.col("record_id").alias("refers_id"),
                                  F.col("page_id").alias("refers_to")), "refers_id"))
    revisits = matched(records.where("refers_id is not null"), named, ["refers_id"], "n",
                       records.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return revisits.select(columns).unionByName(records.where("refers_id is null").withColumn(
        "refers_to", F.lit(None).cast("long")).select(columns))
