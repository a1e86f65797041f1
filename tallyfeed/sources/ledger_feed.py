"""``format("ledger_feed")``: a feed by byte range, pruned by seq, as a batch or a stream; and its transactional writer.

    spark.dataSource.register(LedgerFeed)
    spark.read.format("ledger_feed").option("zones", zones).load(path).where("seq <= 1000")
    spark.readStream.format("ledger_feed").load(path)
    append_batch(events, path, batch_id="2026-01-01")

A path is one file, or a folder of segment files that follow each other by name. Rows
are lines: segment, offset, line (without its line feed), terminated, and seq, read
from the tail of a line as canonical records have it (null elsewhere), so that seq
can be filtered on before any line is parsed.

*Batch.* Files are read in blocks of ``blockBytes``, several to a task if they are small;
a line belongs to the block it begins in. ``write_zones`` keeps the least and greatest seq of every block; a reader
that is told where drops blocks that can't meet the filters on seq. A block that has
grown since is read. Filters are still evaluated after the scan. Pruning is for what
reads a verified feed: ``plans.verify`` reads everything, as a break after seq V makes
the feed unreadable at V too.

*Stream.* An offset is (file, byte, seq, head): where the last whole record ends, its
seq and its line's hash. A batch is the blocks between two offsets. Each block checks
every record in it, and its first one against the record before the block, which it
looks up; so a stream hands out a verified chain, however it is split, or fails with
the sequence number at fault. Lines after the last record wait for the next one.

*Writer.* A chain is sequential: many tasks make a batch's lines but for their links,
one task links and writes them, beginning with the head that the driver found, as a segment under a name of its attempt; the driver notes the
batch id with the head that the batch leads to and commits by linking the segment to
the name of its first seq, which fails if that is taken. A batch counts as committed
if that segment ends in its head: a replay is a no-op, a writer that lost a race to
another is refused, and nothing of its batch can be seen.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.canon import CanonError, decode, encode, sha256_hex
from ..functions.schema import flat
from ..store import open_path
from .feed import GENESIS, ChainError, FeedNotFound, MissingIdentity, classified, classify, fault

ROWS = flat("segment string, offset bigint, line binary, terminated boolean, seq bigint")
BLOCK_BYTES = 64 << 20
PIECE = 4 << 20
#: Tasks that a batch read of small blocks is dealt to.
TASKS = 64
_INT64 = 1 << 63


class LostRace(RuntimeError):
    """Another writer has appended to the feed since this batch was begun."""


# --- files ---


def segments(path: str) -> list[tuple[str, int]]:
    """(path within its file system, bytes) of a feed's files, in order."""
    from pyarrow import fs

    store, name = open_path(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FeedNotFound(f"there is no feed at {path}")
    if info.type == fs.FileType.File:
        return [(name, info.size)]
    found = store.get_file_info(fs.FileSelector(name))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def read_lines_of(raw, start: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, terminated) of the lines that begin in [start, end) of an open file."""
    at, rest = start, b""
    if start:  # the line that holds the byte before start is another block's
        raw.seek(start - 1)
        at -= 1
    skipping = bool(start)
    while skipping or at < end:
        piece = raw.read(PIECE)
        if not piece:
            if rest and not skipping:
                yield at, rest, False
            return
        parts = (rest + piece).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if skipping:
                skipping = False
            elif at >= end:
                return
            else:
                yield at, line, True
            at += len(line) + 1
        if skipping:  # still inside that line
            at += len(rest)
            rest = b""


def seq_of(line: bytes) -> int | None:
    """The seq in the tail of a canonical record."""
    at = line.rfind(b'"seq":')
    if at < 0:
        return None
    digits = line[at + 6 : line.find(b",", at)]
    if not digits.removeprefix(b"-").isdigit() or len(digits) > 20:
        return None
    value = int(digits)
    return value if -_INT64 <= value < _INT64 else None


def last_record(store, files: list[tuple[str, int]], upto: int, byte: int, terminated: bool = False) -> dict | None:
    """The offset just after the last record that begins before ``byte`` of file ``upto``: file, byte, seq, head.

    ``terminated``: leave out an unfinished last line. Looks back from the end, a growing piece at a time.
    """
    while upto >= 0:
        name, size = files[upto]
        end = min(byte, size)
        back = 1 << 16
        with store.open_input_file(name) as raw:
            while end > 0:
                start = max(0, end - back)
                found = None
                for offset, line, whole in read_lines_of(raw, start, end):
                    over = offset + len(line) + whole
                    row = classify(line + b"\n" * whole)
                    if row["class"] in ("record", "hard") and (whole or not terminated):
                        found = {"file": name, "byte": over, "seq": row["seq"], "head": row["line_hash"] or ""}
                if found:
                    return found
                if start == 0:
                    break
                back *= 4
        upto, byte = upto - 1, _INT64
    return None


# --- batch ---


@dataclass
class Block(InputPartition):
    path: str
    name: str
    start: int
    end: int

    def __hash__(self):
        return hash((self.name, self.start))


def blocks_of(path: str, block_bytes: int, files: list[tuple[str, int]] | None = None) -> list[Block]:
    return [Block(path, name, lo, min(lo + block_bytes, size)) for name, size in (segments(path) if files is None else files) for lo in range(0, size, block_bytes)]


def _rows(name: str, lines) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, cols, size = to_arrow_schema(ROWS), ([], [], [], [], []), 0
    for offset, line, terminated in lines:
        for col, x in zip(cols, (name, offset, line, terminated, seq_of(line)), strict=True):
            col.append(x)
        size += len(line)
        if size > PIECE or len(cols[0]) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            cols, size = ([], [], [], [], []), 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def packed(blocks: list[Block], most: int = TASKS) -> list[Block]:
    """Blocks that follow each other as one task's work, so that small blocks don't make a task each: some ``most`` tasks, or as many as ``BLOCK_BYTES`` need."""
    share = min(BLOCK_BYTES, -(-sum(b.end - b.start for b in blocks) // most))
    out: list[Block] = []
    for b in blocks:
        last = out[-1] if out else None
        if last and (last.name, last.end) == (b.name, b.start) and last.end - last.start < share:
            out[-1] = Block(b.path, b.name, last.start, b.end)
        else:
            out.append(b)
    return out


class FeedReader(DataSourceReader):
    def __init__(self, path: str, block_bytes: int):
        self.path, self.block_bytes = path, block_bytes

    def partitions(self):
        return packed(blocks_of(self.path, self.block_bytes)) or [Block(self.path, "", 0, 0)]

    def read(self, block: Block):
        if not block.name:
            return iter(())
        store, _ = open_path(block.path)
        return self._lines(store, block)

    @staticmethod
    def _lines(store, block: Block):
        with store.open_input_file(block.name) as raw:
            yield from _rows(block.name, read_lines_of(raw, block.start, block.end))


class ZonedReader(FeedReader):
    """Of blocks that may hold what the filters on seq ask for; Spark must be told to push them (``read_feed`` does)."""

    def __init__(self, path: str, block_bytes: int, zones: str):
        super().__init__(path, block_bytes)
        self.zones, self.low, self.high = zones, -_INT64, _INT64 - 1

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("seq",):
                if isinstance(f, EqualTo):
                    self._within(f.value, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self._within(None, f.value)
                elif isinstance(f, LessThan):
                    self._within(None, f.value - 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self._within(f.value, None)
                elif isinstance(f, GreaterThan):
                    self._within(f.value + 1, None)
                elif isinstance(f, In) and f.value:
                    self._within(min(f.value), max(f.value))
            yield f  # blocks are dropped, rows are Spark's to filter

    def _within(self, low, high):
        self.low = max(self.low, self.low if low is None else low)
        self.high = min(self.high, self.high if high is None else high)

    def partitions(self):
        blocks = blocks_of(self.path, self.block_bytes)
        if (self.low, self.high) != (-_INT64, _INT64 - 1):
            known = read_zones(self.zones)
            blocks = [b for b in blocks if _meets(known.get((b.name, b.start, b.end)), self.low, self.high)]
        return packed(blocks) or [Block(self.path, "", 0, 0)]


def _meets(zone: tuple | None, low: int, high: int) -> bool:
    """Whether a block of that (least, greatest) seq may hold one in [low, high]; one without any record holds none."""
    return zone is None or (zone[0] is not None and zone[0] <= high and zone[1] >= low)


def write_zones(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> str:
    """Least and greatest seq of each block of the feed, as Parquet beside it; the path, for option ``zones``."""
    spark.dataSource.register(LedgerFeed)
    blocks = blocks_of(path, block_bytes)
    ends = spark.createDataFrame([(b.name, b.start, b.end) for b in blocks], "name string, start bigint, end bigint")
    lines = spark.read.format("ledger_feed").option("blockBytes", block_bytes).load(path)
    seen = lines.groupBy(F.col("segment").alias("name"), (F.floor(F.col("offset") / block_bytes) * block_bytes).alias("start")).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    one_file = [name for name, _ in segments(path)] == [open_path(path)[1]]
    target = f"{path}.zones" if one_file else f"{path.rstrip('/')}/_zones"
    ends.join(seen, ["name", "start"], "left").coalesce(1).write.mode("overwrite").parquet(target)
    return target


def read_zones(path: str) -> dict[tuple[str, int, int], tuple]:
    """(name, start, end) -> (low, high): a row per block of the feed."""
    import pyarrow.parquet as pq

    store, name = open_path(path)
    rows = pq.read_table(name, filesystem=store).to_pydict()
    return {(n, s, e): (lo, hi) for n, s, e, lo, hi in zip(*[rows[c] for c in ("name", "start", "end", "low", "high")], strict=True)}


# --- stream ---


@dataclass
class Stretch(Block):
    """A block of a stream's batch; ``before``: the (seq, head) that its first record follows, or None to look it up."""

    before: tuple | None = None
    upto: int = 0

    __hash__ = Block.__hash__


class FeedStream(DataSourceStreamReader):
    def __init__(self, path: str, block_bytes: int):
        self.path, self.block_bytes = path, block_bytes

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0, "seq": 0, "head": GENESIS}

    def latestOffset(self) -> dict:
        files = segments(self.path)
        return last_record(open_path(self.path)[0], files, len(files) - 1, _INT64, terminated=True) or self.initialOffset()

    def partitions(self, start: dict, end: dict):
        out: list[Stretch] = []
        for i, (name, _) in enumerate(segments(self.path)):
            if start["file"] <= name <= end["file"]:
                lo, hi = start["byte"] if name == start["file"] else 0, end["byte"] if name == end["file"] else segments(self.path)[i][1]
                out += [Stretch(self.path, name, x, min(x + self.block_bytes, hi), upto=i) for x in range(lo, hi, self.block_bytes)]
        if out:
            out[0].before = (start["seq"], start["head"])
        return out

    def read(self, block: Stretch):
        store, _ = open_path(block.path)
        return self._checked(store, block)

    @staticmethod
    def _checked(store, block: Stretch):
        before = block.before
        if before is None:
            found = last_record(store, segments(block.path), block.upto, block.start)
            before = (found["seq"], found["head"]) if found else (0, GENESIS)

        def lines(raw):
            seq, head = before
            for offset, line, whole in read_lines_of(raw, block.start, block.end):
                row = classify(line + b"\n" * whole)
                if row["class"] in ("record", "hard"):
                    if why := fault(row, seq, head):
                        raise ChainError(row["seq"], why)
                    seq, head = row["seq"], row["line_hash"]
                yield offset, line, whole

        with store.open_input_file(block.name) as raw:
            yield from _rows(block.name, lines(raw))


# --- writer ---

#: What a batch holds: payload is JSON text of an object.
EVENTS = "type string, id string, effective string, payload string"


def _around(columns: list[str]):
    """Canonical lines of events but for what a chain adds: ``left`` ends where the hash before begins, ``right`` begins after seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for kind, name, effective, text in zip(*[b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("type", "id", "effective", "payload")], strict=True):
                if not kind or not name:
                    raise MissingIdentity(f"an event needs a type and an id, not {kind!r} and {name!r}")
                payload = decode(text) if text is not None else {}
                if not isinstance(payload, dict):
                    raise CanonError(f"the payload of {name} is no object")
                left.append(encode({"effective": effective or "", "id": name, "payload": payload})[:-1] + b',"prev":"')
                right.append(b"," + encode({"type": kind})[1:])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), *[b.column(c) for c in columns]], names=["left", "right", *columns])

    return run


@dataclass
class Written(WriterCommitMessage):
    part: str
    count: int
    head: str


class FeedWriter(DataSourceArrowWriter):
    """One batch: see ``append_batch``."""

    def __init__(self, path: str, batch_id: str, seq: int, head: str, columns: list[str]):
        self.path, self.batch_id, self.seq, self.head, self.columns = path, batch_id, seq, head, columns

    def write(self, iterator):
        store, folder = open_path(self.path)
        part = f"{folder}/_{self.batch_id}-{uuid.uuid4().hex}"
        try:
            with store.open_output_stream(part) as out:
                return self._chain(iterator, out, part)
        except BaseException:
            store.delete_file(part)
            raise

    def _chain(self, iterator, out, part: str) -> Written:
        seq, head = self.seq, self.head
        for batch in iterator:
            lines = []
            for left, right in zip(*[batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("left", "right")], strict=True):
                seq += 1
                line = b'%b%b","seq":%d%b' % (left, head.encode(), seq, right)
                lines.append(line)
                head = sha256_hex(line)
            if lines:
                out.write(b"\n".join(lines) + b"\n")
        return Written(part, seq - self.seq, head)

    def commit(self, messages):
        told = [m for m in messages if m and m.count]
        if len(told) > 1:
            raise ValueError("a batch of a chain is written by one task: use append_batch")
        store, folder = open_path(self.path)
        for m in messages:
            if m and not m.count:
                store.delete_file(m.part)
        if not told:
            return
        try:
            note(store, folder, self.batch_id, self.seq + 1, told[0].count, told[0].head)
            if not put_if_absent(store, told[0].part, segment_name(folder, self.seq + 1)) and not committed(self.path, self.batch_id):
                raise LostRace(f"seq {self.seq + 1} is another batch's")
        finally:
            store.delete_file(told[0].part)

    def abort(self, messages):
        store, _ = open_path(self.path)
        for m in messages:
            if m and store.get_file_info(m.part).is_file:
                store.delete_file(m.part)


def segment_name(folder: str, first: int) -> str:
    return f"{folder}/{first:020d}.jsonl"


def put_if_absent(store, part: str, name: str) -> bool:
    """Make ``part`` visible as ``name``; False if there is one: decided by one atomic link."""
    from pyarrow import fs

    if not isinstance(store, fs.LocalFileSystem):
        raise NotImplementedError("appending needs a file system whose link refuses an existing name; here that is a local or mounted one")
    try:
        os.link(part, name)
    except FileExistsError:
        return False
    return True


def note(store, folder: str, batch_id: str, first: int, count: int, head: str) -> None:
    """What the batch is about to commit. It counts only if the segment of that first seq ends in that head."""
    store.create_dir(f"{folder}/_batches")
    part = f"{folder}/_batches/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps({"first": first, "count": count, "head": head}).encode())
    store.move(part, f"{folder}/_batches/{batch_id}")


def committed(path: str, batch_id: str) -> dict | None:
    """first, count and head of a batch that the feed holds."""
    store, folder = open_path(path)
    if not store.get_file_info(f"{folder}/_batches/{batch_id}").is_file:
        return None
    with store.open_input_stream(f"{folder}/_batches/{batch_id}") as raw:
        told = json.loads(raw.read())
    name = segment_name(folder, told["first"])
    info = store.get_file_info(name)
    found = info.is_file and last_record(store, [(name, info.size)], 0, _INT64)
    return told if found and found["head"] == told["head"] else None


def append_batch(events: DataFrame, path: str, batch_id: str, order: list[str] | None = None) -> bool:
    """Append a batch of ``EVENTS`` (ordered by ``order``) to a feed folder; False if the batch id was appended before."""
    spark = events.sparkSession
    spark.dataSource.register(LedgerFeed)
    store, folder = open_path(path)
    store.create_dir(folder, recursive=True)
    if "/" in batch_id or not batch_id:
        raise ValueError(f"no batch id: {batch_id!r}")
    if committed(path, batch_id):
        return False
    files = segments(path)
    last = last_record(store, files, len(files) - 1, _INT64) or {"seq": 0, "head": GENESIS}
    # all but the hashes is many tasks' work, each row's own; one task links them
    keys = [f"_order{i}" for i in range(len(order or []))]
    rows = events.select("type", "id", "effective", "payload", *[F.col(c).alias(k) for c, k in zip(order or [], keys, strict=True)])
    kept = [f for f in rows.schema if f.name in keys]
    rows = rows.mapInArrow(_around(keys), StructType([StructField("left", BinaryType()), StructField("right", BinaryType()), *kept]))
    rows = rows.repartition(1).sortWithinPartitions(*keys) if order else rows.coalesce(1)
    rows.select("left", "right").write.format("ledger_feed").option("batchId", batch_id).option("seq", last["seq"]).option("head", last["head"]).mode("append").save(path)
    return True


class LedgerFeed(DataSource):
    """Options: blockBytes, zones (reading); batchId, seq, head (writing, set by ``append_batch``)."""

    @classmethod
    def name(cls) -> str:
        return "ledger_feed"

    def schema(self):
        return ROWS

    def _block(self) -> int:
        return int(self.options.get("blockBytes", BLOCK_BYTES))

    def reader(self, schema) -> FeedReader:
        zones = self.options.get("zones")
        return ZonedReader(self.options["path"], self._block(), zones) if zones else FeedReader(self.options["path"], self._block())

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options["path"], self._block())

    def writer(self, schema, overwrite: bool) -> FeedWriter:
        if overwrite:
            raise ValueError("a feed is appended to, never overwritten")
        return FeedWriter(self.options["path"], self.options["batchId"], int(self.options["seq"]), self.options["head"], schema.names)


def read_feed(spark: SparkSession, path: str, zones: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The feed's lines through the source, with filters on seq pushed to its blocks."""
    spark.dataSource.register(LedgerFeed)
    if zones:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("ledger_feed").option("blockBytes", block_bytes)
    return (reader.option("zones", zones) if zones else reader).load(path)


def records_of(lines: DataFrame) -> DataFrame:
    """Rows of the source as classified lines (``feed.LINES``), line_no being the offset."""
    return classified(lines.select("segment", F.col("offset").alias("line_no"), "line", "terminated"))
