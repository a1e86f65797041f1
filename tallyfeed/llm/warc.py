"""WARC archives: writing pages, normalising monolithic gzip files, reading records back by offset.

``write_archives`` writes records as Spark writes text: a file per task, the whole
file one gzip stream, records ended by two line ends. Such a file can't be entered in
the middle. ``normalise`` inflates each file once, as a stream, rewrites every record
as a gzip member of its own, and writes beside it a sidecar of offsets (a JSON object
a line). ``read_archives`` enters the members at the sidecar's offsets, so that one
large archive is many tasks' work. Memory is bounded by a piece of a stream: neither
an archive nor a payload is held whole (but for a payload that is asked for).

Records with equal payloads of at least ``least`` bytes are told once: the one of the
largest page_id is a ``response``, the others are ``revisit`` records, which name it,
carry its digest and length and no payload. Equality is by SHA-256; the digest in a
record is SHA-1, as archives have it.

Files are opened through pyarrow (local and shared file systems, HDFS, S3, GCS), are
written under a name of the attempt and renamed when whole: an executor that is lost
leaves nothing that is read.

Defined cases: a null html is empty; a null url is left out; line ends in a url are
percent-encoded; a null page_id is the smallest; of rows with equal page_id and equal
payload one is the response, and rows of the same id otherwise are records of their
own; equal payloads that hold a third of all rows are counted before they are
shuffled, and only their keys meet; other columns, of any name, are ignored; an empty
table makes archives without records, which read back as no rows. ``normalise`` takes
archives of several members too, skips line ends between records, and fails, naming
the file, on one that is cut off or is no WARC.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import open_path
from .common import Plain, materialize, produce

VERSION, EOL, GAP = "WARC/1.1", "\r\n", "\r\n\r\n"
#: Equal payloads of fewer bytes are all written out.
LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a stream in memory at once, and of an archive that a reading task takes.
PIECE, PART = 1 << 20, 64 << 20
#: The longest header block of a record; a stream without an end of header within it is no WARC.
HEADER_LIMIT = 1 << 20
SIDECAR = ".cdxj"


# --- records of pages ---


def plan_records(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, bytes, sha1, sha256, type, refers_to (a page_id): a row per record to write."""
    plain = Plain(pages)
    rows = plain.df.select(F.col(plain[page_id]).alias("page_id"), F.col(plain[url]).alias("url"), F.coalesce(F.col(plain[html]), F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("bigint"), "sha256": F.sha2("html", 256), "sha1": F.sha1("html")})
    # copies are counted where they lie; ids of equal payloads, not the payloads, meet
    ids = rows.where(F.col("bytes") >= least).groupBy("sha256", "page_id").agg(F.count("*").alias("n"))
    groups = ids.groupBy("sha256").agg(F.max(F.struct("page_id", "n")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    groups = materialize(groups.select("sha256", F.col("first.page_id").alias("first"), F.col("first.n").alias("equal"), F.lit(True).alias("many")), "warc-groups")
    told = rows.join(groups, "sha256", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(F.col("many").isNull() | (is_first & (F.col("equal") == 1)), "response").when(~is_first, "revisit")
    columns = ["page_id", "url", "html", "bytes", "sha1", "sha256", "type", F.when(F.col("type") == "revisit", F.col("first")).alias("refers_to")]
    told = told.withColumn("type", kind)
    records = told.where("type IS NOT NULL").select(*columns)
    if groups.where("equal > 1").isEmpty():
        return records
    # rows of equal page_id and payload: one of them, of the least url, is the response
    same = told.where("type IS NULL").groupBy("sha256", "page_id", "bytes", "sha1", "first", "url").agg(F.count("*").alias("n"), F.first("html").alias("html"))
    lead = same.groupBy("sha256", "page_id", "bytes", "sha1", "first").agg(F.min(F.struct("url", "n")).alias("least"), F.first("html").alias("html"))
    responses = lead.withColumns({"type": F.lit("response"), "url": F.col("least.url")}).select(*columns)
    others = same.drop("html").join(lead.select("sha256", F.col("least.url").alias("least")), "sha256")
    left = F.col("n") - F.col("url").eqNullSafe(F.col("least")).cast("int")
    others = others.withColumn("again", F.explode(F.array_repeat(F.lit(0), left.cast("int")))).withColumns({"type": F.lit("revisit"), "html": F.lit("")})
    return records.unionByName(responses).unionByName(others.select(*columns))


def _encoded(x: Column) -> Column:
    """An id within a header: percent-encoded; a lone percent sign for null."""
    return F.coalesce(F.url_encode(x.cast("string")), F.lit("%"))


def _decoded(x: Column, kind: str) -> Column:
    return F.when(x != "%", F.url_decode(x)).cast(kind)


def render(records: DataFrame, date: str = DATE, least: int = LEAST) -> DataFrame:
    """One column, value: each record of ``plan_records`` as WARC text without the two line ends after it."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x, F.lit(EOL))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(GAP))
    revisit = F.col("type") == "revisit"
    # a payload has one response, so its hash names it; where payloads repeat, a name of its own does
    name = lambda: F.when((F.col("type") == "response") & (F.col("bytes") >= least), F.concat(F.lit("<urn:sha256:"), "sha256", F.lit(">"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", name()),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(IDENTICAL)), line("WARC-Refers-To", F.concat(F.lit("<urn:sha256:"), "sha256", F.lit(">"))), line("Page-Refers-To", _encoded(F.col("refers_to"))))).otherwise(""),
        line("Page-ID", _encoded(F.col("page_id"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(EOL),
    )
    return records.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(records: DataFrame, folder: str, date: str = DATE, least: int = LEAST) -> str:
    """Monolithic gzip archives of the records, one a task, in the folder; ``least`` as they were planned with."""
    render(records, date, least).write.option("lineSep", GAP).option("compression", "gzip").text(folder)
    return folder


# --- streams ---


class Inflated:
    """The bytes of a gzip stream of one member or several, inflated a piece at a time."""

    def __init__(self, raw):
        self.raw, self.left, self.held, self.whole = raw, b"", bytearray(), True
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        """Inflate a little more; False at the end."""
        while True:
            if not self.left:
                self.left = self.raw.read(PIECE)
                if not self.left:
                    if not self.whole:
                        raise ValueError("the gzip stream is cut off")
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.whole = False
            made = self.inflate.decompress(self.left, PIECE)
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.whole = self.inflate.eof
            if made:
                self.held += made
                return True

    def until(self, mark: bytes, skip: bool = False) -> bytes | None:
        """Up to the mark and with it; None at the end of the stream. ``skip``: without line ends before it begins."""
        seen = 0
        while True:
            if skip and not seen:
                del self.held[: len(self.held) - len(self.held.lstrip(b"\r\n"))]
            at = self.held.find(mark, max(0, seen - len(mark)))
            if at >= 0:
                found = bytes(self.held[: at + len(mark)])
                del self.held[: at + len(mark)]
                return found
            seen = len(self.held)
            if seen > HEADER_LIMIT:
                raise ValueError("a record's header has no end")
            if not self._more():
                if self.held:
                    raise ValueError("the last record is cut off")
                return None

    def exactly(self, n: int):
        """n bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("a record is shorter than its length")
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    """A header block's fields, names in lower case; continued lines are joined."""
    lines = head.decode("utf-8", "replace").split(EOL)
    if not lines[0].startswith(("WARC/", "HTTP/")):
        raise ValueError(f"no header of a WARC record: {lines[0][:40]!r}")
    found: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def _rewrite(source, target, level: int):
    """Records of a gzip stream, each as a member of its own: yields a sidecar entry each."""
    stream, at = Inflated(source), 0
    while (head := stream.until(GAP.encode(), skip=True)) is not None:
        told = fields(head)
        length = told.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise ValueError(f"a record's length is {length!r}")
        pack, began = zlib.compressobj(level, zlib.DEFLATED, 31), at
        at += target.write(pack.compress(head))
        for part in stream.exactly(int(length)):
            at += target.write(pack.compress(part))
        at += target.write(pack.compress(GAP.encode()) + pack.flush())
        yield {"offset": began, "length": at - began, "type": told.get("warc-type"), "id": told.get("warc-record-id"), "uri": told.get("warc-target-uri")}


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives (``*.gz``) of a folder, each beside a sidecar of its offsets: path, records, bytes of each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source).select("path")
    n = files.count()
    store, there = open_path(target)
    store.create_dir(there, recursive=True)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = open_path(path)
                out, folder = open_path(target)
                # two sources may share a last name
                base = f"{folder}/{name.rsplit('/', 1)[-1].split('.')[0]}-{hashlib.sha1(name.encode()).hexdigest()[:8]}"
                part = f"{folder}/_{uuid.uuid4().hex}"
                records = 0
                try:
                    with fs.open_input_stream(name, compression=None) as raw, out.open_output_stream(part + ".gz", compression=None) as made, out.open_output_stream(part + SIDECAR, compression=None) as side:
                        for entry in _rewrite(raw, made, level):
                            side.write(json.dumps(entry).encode() + b"\n")
                            records += 1
                        size = made.tell()
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                out.move(part + ".gz", base + ".warc.gz")
                out.move(part + SIDECAR, base + SIDECAR)
                yield {"path": [base + ".warc.gz"], "records": [records], "bytes": [size]}

    return materialize(produce(files.repartition(max(1, min(n, 20_000))), run, "path string, records bigint, bytes bigint"), "warc-normalised")


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records of normalised archives, found by their sidecars.

    record_id, type, uri, refers_to (record id), page_id, page_refers_to (as encoded), payload_bytes, payload_digest
    (bare hex), and with ``payload`` the bytes of what is no revisit. A response's digest and length are those of the
    bytes that were read, and must be the ones that it claims; a revisit's are what it says of the payload it repeats.
    """
    names = "record_id string, type string, uri string, refers_to string, page_id string, page_refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payload
    index = spark.read.schema("offset bigint, length bigint").option("pathGlobFilter", f"*{SIDECAR}").json(folder)
    index = index.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.cdxj\z", ".warc.gz").alias("path"), "offset", "length")
    total = index.agg(F.sum("length")).first()[0] or 0
    # a task's members lie side by side
    parts = index.repartition(min(total // PART + 1, 100_000), "path", F.floor(F.col("offset") / PART)).sortWithinPartitions("path", "offset")

    def run(batches):
        out = {n.split()[0]: [] for n in names.split(", ")}
        opened, raw, held = None, None, 0
        for b in batches:
            for path, offset, length in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if path != opened:
                    fs, name = open_path(path)
                    opened, raw = path, fs.open_input_file(name)
                raw.seek(offset)
                row = _record(Inflated(_Part(raw, length)), payload)
                for k in out:
                    out[k].append(row.get(k))
                held += len(row.get("payload") or b"")
                if len(out["type"]) >= 2000 or held > 32 << 20:
                    yield out
                    out, held = {k: [] for k in out}, 0
        yield out

    return produce(parts, run, names)


class _Part:
    """So many bytes of an open file."""

    def __init__(self, raw, length: int):
        self.raw, self.left = raw, length

    def read(self, n: int) -> bytes:
        data = self.raw.read(min(n, self.left))
        self.left -= len(data)
        return data


def _record(stream: Inflated, payload: bool) -> dict:
    told = fields(stream.until(GAP.encode()))
    kind, left = told.get("warc-type"), int(told["content-length"])
    row = {"record_id": told.get("warc-record-id"), "type": kind, "uri": told.get("warc-target-uri"), "refers_to": told.get("warc-refers-to"), "page_id": told.get("page-id"), "page_refers_to": told.get("page-refers-to")}
    claimed = told.get("warc-payload-digest", "").removeprefix("sha1:").lower()
    if told.get("content-type", "").startswith("application/http"):
        head = stream.until(GAP.encode())
        left -= len(head)
        said = fields(head).get("content-length")
        row["payload_bytes"] = int(said) if said else None
    if kind == "revisit":
        return row | {"payload_digest": claimed}
    digest, size, kept = hashlib.sha1(), 0, bytearray()
    for part in stream.exactly(left):
        digest.update(part)
        size += len(part)
        if payload:
            kept += part
    if claimed and claimed != digest.hexdigest() and len(claimed) == 40:
        raise ValueError(f"record {row['record_id']} holds {digest.hexdigest()}, not {claimed}")
    return row | {"payload_bytes": size, "payload_digest": digest.hexdigest()} | ({"payload": bytes(kept)} if payload else {})


def archived_pages(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of records read back."""
    return records.select(_decoded(F.col("page_id"), id_type).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), _decoded(F.col("page_refers_to"), id_type).alias("refers_to"))
