"""WARC archives: monolithic gzip files normalised to one member a record, with a sidecar offset index.

Archives are often one gzip stream over all records, which no reader can enter in the middle. The normaliser inflates such a
file once, as a stream, deflates every record again as a gzip member of its own, and writes an index line for each member:
file, offset, length, type, record id, target URI and payload digest. From then on any part of the archive can be read alone.

Files live in the shared folder and are written under a name of the attempt, then renamed, so a lost executor leaves nothing
half written. What a lost attempt finished is left out by name, or is the same as its repetition writes. One record is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, checkpoint, filesystem, settle, table, work_dir, written

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
#: Bytes of payload after which a writer begins the next file, and of an archive that one reading task takes.
FILE_BYTES, READ_BYTES = 256 << 20, 64 << 20
LEVEL, READ = 6, 1 << 20


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to, refers_url: str | None, revisit: bool) -> bytes:
    """A page as a response, or as a revisit that has the HTTP head but not the payload."""
    fields = [("WARC-Record-ID", f"<{RECORD_ID}{named(page_id)}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", plain(url)))
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{named(refers_to)}>")]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", plain(refers_url)))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", fields, head if revisit else head + payload)


def plain(uri: str) -> str:
    """A URI without what would break a header line."""
    return "".join(c for c in uri if c.isprintable())


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one member or many, in pieces of at most ``READ``."""
    z, begun, data = zlib.decompressobj(31), False, b""
    while True:
        data = data or stream.read(READ)
        if z.eof:
            if not data:
                return
            z = zlib.decompressobj(31)
        begun = begun or bool(data)
        # At most so much comes out at once, however well it was packed; the rest waits in the stream's own state.
        piece, ended = z.decompress(data, READ), not data
        if piece:
            yield piece
        data = z.unused_data if z.eof else z.unconsumed_tail
        if ended and not piece and not z.eof:
            break
    if begun:
        raise ValueError("the gzip stream ends early")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of each record of a gzip stream; header names are in lower case. One record is held, and a piece beyond it."""
    pieces, held = inflated(stream), bytearray()

    def more() -> bool:
        for piece in pieces:
            held.extend(piece)
            return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        header = parse_header(bytes(held[:end]))
        size = end + 4 + int(header["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield header, bytes(held[:size])
        del held[:size]


def parse_header(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}


class Output:
    """A file of the shared folder that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.part, self.path = attempt_name(root, name), f"{root}/{name}"
        self.stream, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.stream.close()
        settle(self.fs, self.part, self.path)


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows(page_id, url, payload, revisit, refers_to, refers_url)``; (file, n_records) of the files made.

    Every file is a single gzip stream over all of its records, a warcinfo first. Its name has the attempt of the task that wrote it, and only
    the files listed count: rows may come to a second attempt in another order, and so in other files.
    """
    run_id = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, out = TaskContext.get(), [], None
        part = f"{task.partitionId():06d}-{run_id}-{task.taskAttemptId()}"
        for b in batches:
            for row in zip(*(c for c in b.columns)):
                page_id, url, payload, revisit, refers_to, refers_url = (x.as_py() for x in row)
                if out is None:
                    name, n, size = f"{part}-{len(made):04d}.warc.gz", 0, 0
                    out, z = Output(folder, name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(z.compress(record("warcinfo", [("WARC-Filename", name)], b"format: WARC File Format 1.1\r\n")))
                out.write(z.compress(page_record(page_id, url, payload or b"", refers_to, refers_url, bool(revisit))))
                n, size = n + 1, size + len(payload or b"")
                if size >= FILE_BYTES:
                    out.write(z.flush())
                    out.done()
                    made.append((name, n))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.done()
            made.append((name, n))
        yield listing(made)

    columns = ["page_id", "url", "payload", "revisit", "refers_to", "refers_url"]
    return checkpoint(rows.select(*columns).mapInArrow(run, "file string, n_records long"))


def listing(made: list[tuple[str, int]]) -> pa.RecordBatch:
    names, counts = [m[0] for m in made], [m[1] for m in made]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "n_records"])


def normalise(files: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite the gzip archives ``files(file)`` of ``source`` into ``folder``; (file, n_records) of each.

    Every record becomes a gzip member of its own, and ``<file>.cdxj`` lists the members. A file that is normal already comes
    out with the same records. As a file's bytes decide all that is written, a second attempt writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(source)
        for b in batches:
            made = []
            for name in b.column(0).to_pylist():
                out, index, n = Output(folder, name), Output(folder, name + ".cdxj"), 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for header, whole in records(stream):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        keys = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest")
                        line = {"file": name, "offset": out.size, "length": len(member)}
                        line |= {k: header[k] for k in keys if k in header}
                        index.write(json.dumps(line).encode() + b"\n")
                        out.write(member)
                        n += 1
                out.done()
                index.done()
                made.append((name, n))
            yield listing(made)

    n = max(1, files.count())
    return checkpoint(files.select("file").repartition(n).mapInArrow(run, "file string, n_records long"))


def read_members(spark, folder: str) -> DataFrame:
    """The page records of normalised archives, by their index: page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest (base32 SHA-1), record_type and refers_to. Ids are strings. A payload that does not have its digest is an error."""
    schema = "file string, offset long, length long, `warc-type` string"
    index = spark.read.schema(schema).option("pathGlobFilter", "*.cdxj").json(folder)
    index = index.where(F.col("`warc-type`").isin("response", "revisit"))
    piece = F.expr(f"offset div {READ_BYTES}").alias("piece")
    index = index.select("file", piece, "offset", "length").repartition("file", "piece").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, stream = None, None
        for b in batches:
            rows = []
            for file, _, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{root}/{file}")
                stream.seek(offset)
                rows.append(page_of(zlib.decompress(stream.read(length), 31)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=PAGE)
        if stream:
            stream.close()

    return index.mapInArrow(run, SCHEMA)


PAGE = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
#: The name of a page without an id; a page whose id reads so has it in another spelling.
NO_ID = "None"


def named(page_id: str | None) -> str:
    """A page's id as the end of a URI."""
    if page_id is None:
        return NO_ID
    shown = str(page_id)
    return "%" if not shown else urllib.parse.quote(shown, safe="") if shown != NO_ID else "%4Eone"


def id_of(name: str) -> str | None:
    return None if name == NO_ID else "" if name == "%" else urllib.parse.unquote(name)


def page_of(whole: bytes) -> tuple:
    """A row of ``PAGE`` from a response or revisit record."""
    end = whole.index(b"\r\n\r\n")
    header, block = parse_header(whole[:end]), whole[end + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest, kind = header["warc-payload-digest"].removeprefix("sha1:"), header["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {header['warc-record-id']} does not have its digest")

    def id_in(field: str) -> str | None:
        return id_of(header[field].strip("<>").removeprefix(RECORD_ID)) if field in header else None

    body = payload if kind == "response" else None
    return id_in("warc-record-id"), header.get("warc-target-uri"), body, size, digest, kind, id_in("warc-refers-to")


def with_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` as rows for ``write_monolithic``: of equal payloads of at least ``least`` bytes the largest id responds.

    A null html is an empty payload. Rows of equal payload and id all respond; null ids come last. Ids of any type that can be ordered and cast to
    a string and back: the rows have them as strings. Payloads are equal if their SHA-1, which the archive names them by, and length are.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("__sha1", F.sha1("payload")).withColumn("__size", F.length("payload"))
    groups = rows.groupBy("__sha1", "__size").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    # Written first, so that its size is known: Spark broadcasts it up to its own threshold, and else shuffles the pages.
    groups = written(groups.where((F.col("n") > 1) & (F.col("__size") >= least)).drop("n"), "copies")
    rows = rows.join(groups, ["__sha1", "__size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "payload",
        revisit.alias("revisit"),
        F.when(revisit, F.col("first.page_id").cast("string")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to normalised archives below ``folder``/warc and read them back: rows of ``PAGE``.

    Rows with a null id, url or html are written too; repeated rows are written each. Ids keep their type. Other columns are not read, and
    may have any name. Of no rows come no files and no rows.
    """
    raw, normal = f"{folder}/raw", f"{folder}/warc"
    made = normalise(write_monolithic(with_revisits(pages, least), raw), raw, normal)
    fs, root = filesystem(folder)
    fs.create_dir(f"{root}/warc", recursive=True)
    if made.count():
        fs.delete_dir(f"{root}/raw")  # all of it has been rewritten, and what is read below needs only that
    kind = pages.schema["page_id"].dataType
    found = read_members(pages.sparkSession, normal)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the archives."""
    found = archive(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP7_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT rid, i, list_reduce(list_transform(range(0, 5), lambda k:
           ((strpos('0123456789abcdef', substr(h, ((5 * i + k) // 4 + 1)::INT, 1)) - 1) >> (3 - (5 * i + k) % 4)::INT) & 1),
           lambda a, x: 2 * a + x) AS v
         FROM (SELECT rid, h, unnest(range(0, 32)) AS i FROM p)),
d AS (SELECT rid, string_agg(substr('{_ALPHABET}', (v + 1)::INT, 1), '' ORDER BY i) AS digest FROM bits GROUP BY rid),
m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m JOIN d USING (rid)
"""
