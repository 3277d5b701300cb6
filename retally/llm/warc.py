"""WARC archives: writing pages as records, and reading archives whose payloads may hold anything.

Reading does not trust the magic of a record: tasks look through blocks of files and emit for
each candidate where its record would end, its successor. Inside a block such links are
followed at once, which leaves one link from each candidate to the first one behind the block.
Pointer jumping from the start of each file (links are squared in every round) then tells which
candidates lie on the chain; magic inside payloads is never reached.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retally.llm.common import file_system, written
from retally.session import shared_folder

#: Size at which a task begins another file, and size of the blocks that readers look through.
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
#: Bytes read at first for a header; where it does not end in them, more are read.
HEADER_BYTES = 64 << 10
MAGIC, END = b"WARC/1.", b"\r\n\r\n"
#: Bodies of at least so many bytes are written once, their repetitions as revisits.
REVISIT_BYTES = 0
# Fixed value: profile of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_bytes bigint, n_records bigint"


def _line(value: str | None) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "")


def _record(kind: str, record_id: str, date: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{name}: {value}" for name, value in headers]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit, which keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    headers = [("WARC-Target-URI", _line(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return _record("response", own, date, http + payload, headers)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return _record("revisit", own, date, http, headers)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null html: empty) and ``refers_to``: for a page whose
    payload of at least ``least`` bytes occurs under a smaller ``page_id``, the smallest such.

    Rows that repeat the smallest id are responses too; a null id never is referred to, and
    counts as larger than any other. Payloads are equal if their SHA-256 is.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    several = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # As a table of known size: if few payloads repeat, Spark sends it to the pages, not these to it.
    several = written(several.where("n > 1").select("key", "first"), "warc-repeated")
    joined = rows.join(several, "key", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of ``pages`` (``page_id``, ``url``, ``html``) in ``folder``; returns the manifest.

    Each task writes files under names of its own; only those of tasks that ended well are in
    the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = file_system(folder)
        fs.create_dir(where, recursive=True)
        sink, made = None, []

        def close() -> None:
            sink.close()
            made.append((f"{folder}/{name}", size, count))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)) if batch.nbytes < 1 << 24 else _slowly(batch):
                record = page_record(*row, date)
                if sink and size + len(record) > file_bytes:
                    close()
                    sink = None
                if sink is None:
                    name = f"pages-{uuid.uuid4().hex}.warc"
                    sink, size, count = fs.open_output_stream(f"{where}/{name}"), 0, 0
                    head = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])
                    sink.write(head)
                    size += len(head)
                    count += 1
                sink.write(record)
                size += len(record)
                count += 1
        if sink:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["path", "n_bytes", "n_records"])

    return written(with_revisits(pages).mapInArrow(run, MANIFEST), "warc-manifest")


def _slowly(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a large batch, a few at a time."""
    for at in range(0, batch.num_rows, 64):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))


class _File:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, where = file_system(path)
        self.file = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, stop - start))

    def read_on(self, start: int, data: bytes) -> bytes:
        """``data``, which was read from ``start``, with as much again as it has, or with nothing
        more at the file's end."""
        return data + self.read(start + len(data), start + 2 * len(data) + HEADER_BYTES)

    def close(self) -> None:
        self.file.close()


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Header fields of a record at ``at``, where its block starts, and the block's length; None
    if what stands there is no header."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    end = data.find(END, at)
    if end < 0:
        return None
    version, *lines = data[at:end].split(b"\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(rb"WARC/1\.\d", version) or not re.fullmatch(r"\d{1,18}", length, re.ASCII):
        return None
    return fields, end + 4, int(length)


def _blocks(manifest: DataFrame, block: int) -> DataFrame:
    """``path``, ``start``, ``stop`` of all blocks of all files."""
    cut = manifest.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.expr(f"sequence(0L, n_bytes - 1, {block}L)")).alias("start"))
    return cut.select("path", "start", F.least("n_bytes", F.col("start") + block).alias("stop"))


#: Blocks that a task looks through.
TASK_BLOCKS = 8


def _dealt(manifest: DataFrame, blocks: DataFrame, block: int, *by: str) -> DataFrame:
    """Rows of blocks in as many partitions as their reading, not their own size, asks for."""
    n = (manifest.agg(F.sum(F.ceil(F.col("n_bytes") / block))).first()[0] or 0) / TASK_BLOCKS
    least = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(max(math.ceil(n), least), *by)


def candidates(manifest: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Every place that looks like a record: ``path``, ``at``, ``successor``, ``leaves``, the first
    place behind its block that the chain from here comes to (null if the chain breaks off
    inside the block), and ``steps``, the records of the chain inside the block. Headers may
    end behind the block, however far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                file = _File(path)
                data = file.read(start, stop + HEADER_BYTES)
                next_of, at, header = {}, data.find(MAGIC), _Headers()
                while 0 <= at < stop - start:
                    if _VERSION.match(data, at):
                        while data.find(END, max(at, header.end)) < 0 and header.end <= at:
                            more = file.read_on(start, data)
                            if len(more) == len(data):
                                break
                            data = more
                        if found := header.at(data, at):
                            next_of[start + at] = start + found[0] + found[1] + 4
                    at = data.find(MAGIC, at + 1)
                file.close()
                leaves, steps = {}, {}
                for place in reversed(next_of):
                    after = next_of[place]
                    leaves[place] = after if after >= stop else leaves.get(after)
                    steps[place] = 1 + steps.get(after, 0)
                if next_of:
                    columns = [pa.array([path] * len(next_of)), pa.array(list(next_of)), pa.array(list(next_of.values()))]
                    columns += [pa.array([x[p] for p in next_of], pa.int64()) for x in (leaves, steps)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "at", "successor", "leaves", "steps"])

    return _dealt(manifest, _blocks(manifest, block), block, "path", "start").mapInArrow(run, "path string, at bigint, successor bigint, leaves bigint, steps bigint")


_VERSION, _LENGTH = re.compile(rb"WARC/1\.\d\r\n"), re.compile(rb"\s*content-length\s*:\s*(.*?)\s*", re.IGNORECASE | re.DOTALL)


class _Headers:
    """What ``parse_header`` says of places in one block's data, in order. Places before the same
    header's end share its lines, each of which is looked at once, so many places before a
    distant end cost no more than few."""

    def __init__(self):
        self.end = self.seen = 0  # places before the end, down to where its lines were seen
        self.lines: list[tuple[int, bytes]] = []  # lengths, the last line first
        self.bad = 0  # start of the last line without a colon

    def at(self, data: bytes, at: int) -> tuple[int, int] | None:
        """Where the block of a record at ``at`` starts, and its length."""
        if at >= self.end:
            self.end = data.find(END, at)
            if self.end < 0:
                self.end = 0
                return None
            self.lines, self.bad, stop = [], -1, self.end
            while stop > at:
                start = data.rfind(b"\r\n", at, stop) + 2
                if start < 2:
                    break
                line = data[start:stop]
                if b":" not in line:
                    self.bad = start
                    break
                if found := _LENGTH.fullmatch(line):
                    self.lines.append((start, found[1]))
                stop = start - 2
        first = data.find(b"\r\n", at) + 2
        if first <= self.bad or first > self.end or not self.lines or self.lines[0][0] < first:
            return None
        length = self.lines[0][1]
        return (self.end + 4, int(length)) if re.fullmatch(rb"\d{1,18}", length) else None


def entries(found: DataFrame, most_blocks: int) -> DataFrame:
    """Places where the chains from the files' starts enter blocks: ``path``, ``at``.

    Only candidates that another one leads to, or the start, can be entries. In round k their
    links span 2**k blocks, so the rounds follow the logarithm of the blocks in a file.
    """
    start = found.where("at = 0").select("path", "at")
    targets = found.where("leaves IS NOT NULL").select("path", F.col("leaves").alias("at")).distinct()
    links = found.where("leaves IS NOT NULL").select("path", "at", "leaves")
    links = written(links.join(targets.unionByName(start).distinct(), ["path", "at"], "left_semi"), "warc-links")
    reached = start
    for k in range(max(1, math.ceil(math.log2(max(most_blocks, 2))))):
        ahead = reached.join(links, ["path", "at"]).select("path", F.col("leaves").alias("at"))
        reached = written(reached.unionByName(ahead).distinct(), f"warc-reached-{k}")
        then = links.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        links = written(links.join(then, ["path", "leaves"]).select("path", "at", F.col("further").alias("leaves")), f"warc-links-{k}")
    return reached


RECORDS = "path string, at bigint, kind string, record_id string, headers map<string,string>, content binary"


def read(manifest: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """All records of archives: ``path``, ``at``, ``kind``, ``record_id``, ``headers``, ``content``.

    ``manifest`` has ``path`` and ``n_bytes``; paths are URIs or plain paths every executor
    reaches. A chain that breaks off (a damaged file) ends there; with ``n_records`` in the
    manifest, a file with another number of records fails.
    """
    strict = "n_records" in manifest.columns
    most = manifest.agg(F.max("n_bytes")).first()[0] or 0
    found = written(candidates(manifest, block), "warc-candidates")
    reached = entries(found, math.ceil(most / block))
    if strict:
        counted = reached.join(found, ["path", "at"]).groupBy("path").agg(F.sum("steps").alias("n"))
        wrong = manifest.join(counted, "path", "left").where(F.coalesce("n", F.lit(0)) != F.col("n_records")).first()
        if wrong:
            raise ValueError(f"{wrong['path']} has {wrong['n'] or 0} records that can be read, not {wrong['n_records']}")
    starts = reached.withColumn("start", F.floor(F.col("at") / block) * block)
    dealt = _blocks(manifest, block).join(starts, ["path", "start"]).select("path", "at", "stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, stop in zip(*(c.to_pylist() for c in batch.columns)):
                file, rows, size = _File(path), [], 0
                while at < stop:
                    head = file.read(at, at + HEADER_BYTES)
                    while _VERSION.match(head) and END not in head and len(more := file.read_on(at, head)) > len(head):
                        head = more
                    parsed = parse_header(head, 0)
                    if parsed is None:
                        if strict:
                            raise ValueError(f"no record at {at} of {path}")
                        break
                    fields, begins, length = parsed
                    content = head[begins : begins + length] if begins + length <= len(head) else file.read(at + begins, at + begins + length)
                    rows.append((path, at, fields.get("warc-type"), fields.get("warc-record-id"), list(fields.items()), content))
                    at += begins + length + 4
                    size += length
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                file.close()
                if rows:
                    yield _batch(rows)

    return _dealt(manifest, dealt, block, "path", "at").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "at", "kind", "record_id", "headers", "content"])


def page_rows(records: DataFrame) -> DataFrame:
    """Per page record: id, size and digest of the full payload, type, the page it refers to.

    A response's digest is computed from its payload as read; a revisit has its header's.
    """

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, record_id, headers, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fields = dict(headers)
                http, _, payload = content.partition(b"\r\n\r\n")
                if kind == "response":
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                rows.append((number(record_id), size, digest, kind, number(fields.get("warc-refers-to"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    pages = records.where("kind IN ('response', 'revisit')").select("kind", "record_id", "headers", "content")
    return pages.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives below the shared folder and reads them back."""
    return page_rows(read(write(pages, f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}")))


_BITS = "(instr('0123456789abcdef', substr(hex, 5*i//4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, 5*i//4 + 2, 1)) - 1"

ORACLE = f"""
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM pages_)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((({_BITS})::INT) >> (3 - (5*i % 4))::INT) & 31) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
