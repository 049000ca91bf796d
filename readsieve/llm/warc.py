"""WARC archives as a Spark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition a file. Predicates on the record type and on other header columns are pushed down: a record's headers
are parsed first, and the block of one that isn't wanted is skipped, by a seek where the archive is plain or carries gzip
skip lengths, else by inflating without decoding. Payloads are only kept with the option ``payload`` (true by default).

Writing gives each task files of its own, rolled over at a size, one gzip member a record with its skip lengths. Files get their
names when the job commits; those of failed or repeated tasks are removed, so executors may be lost at any time. Paths are those
that pyarrow.fs opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from readsieve.llm.common import Scratch

SCHEMA = "warc_type string, record_id string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string,string>, payload binary"
#: Columns that are headers, and the header of each.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
COLUMNS = [*HEADERS, "headers", "payload"]
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at once, rows and bytes of a batch, bytes after which a task begins another file.
CHUNK, BATCH_ROWS, BATCH_BYTES, FILE_BYTES = 1 << 20, 1_000, 8 << 20, 256 << 20
LEVEL = 3


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Plain:
    """Blocks of an archive that isn't compressed."""

    def __init__(self, file, start: bytes):
        self.file, self.buffer = file, start
        self.left = 0

    def record(self) -> bytes | None:
        """Header bytes of the next record, the block of the last one being skipped."""
        self._skip(self.left)
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            end = self.buffer.find(b"\r\n\r\n")
            if end >= 0:
                head, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
                self.left = _length(head)
                return head
            more = self.file.read(CHUNK)
            if not more:
                return None
            self.buffer += more

    def _skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""
        self.left = 0

    def block(self) -> bytes:
        if self.left > len(self.buffer):
            self.buffer += self.file.read(self.left - len(self.buffer))
            if self.left > len(self.buffer):
                raise ValueError("the archive ends inside a block")
        block, self.buffer, self.left = self.buffer[: self.left], self.buffer[self.left :], 0
        return block


class _Gzip:
    """Records in gzip members, one each or several. A member's skip lengths, if given, serve to pass over its last record's block."""

    def __init__(self, file, start: bytes):
        self.file, self.buffer = file, start
        self.inflater, self.plain, self.left = None, b"", 0

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.file.read(CHUNK)
            if not more:
                return False
            self.buffer += more
        return True

    def _open(self) -> bool:
        """Begins the next member; False at the end of the archive."""
        if not self._fill(1):
            return False
        if not self._fill(18) or self.buffer[:2] != b"\x1f\x8b":
            raise ValueError("neither a gzip member nor the end of the archive")
        self.skip = self.whole = None
        if self.buffer[3] & 4 and self.buffer[12:14] == b"sl" and struct.unpack_from("<H", self.buffer, 14)[0] == 8 and self._fill(24):
            self.skip, self.whole = struct.unpack_from("<II", self.buffer, 16)
        self.inflater, self.taken, self.given = zlib.decompressobj(31), 0, 0
        return True

    def _inflate(self, most: int) -> bytes | None:
        """Up to ``most`` bytes; None at the end of the member."""
        if self.inflater.eof:
            return None
        if not self._fill(1):
            raise ValueError("the archive ends inside a gzip member")
        size = len(self.buffer)
        out = self.inflater.decompress(self.buffer, most)
        self.buffer = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        self.taken += size - len(self.buffer)
        self.given += len(out)
        return out

    def record(self) -> bytes | None:
        self._pass()
        while True:
            self.plain = self.plain.lstrip(b"\r\n")
            if b"\r\n\r\n" in self.plain:
                break
            if self.inflater is None:
                if not self._open():
                    if self.plain:
                        raise ValueError("the archive ends inside a record's header")
                    return None
            elif (more := self._inflate(16_384)) is not None:
                self.plain += more
            else:
                self.inflater = None
        head, _, self.plain = self.plain.partition(b"\r\n\r\n")
        self.left = _length(head)
        return head

    def _pass(self) -> None:
        """Goes behind the block, by a seek if the member ends there."""
        if not self.left:
            return
        if self.skip and not self.inflater.eof and self.given - len(self.plain) + self.left + 4 == self.whole and self.skip >= self.taken:
            ahead = self.skip - self.taken
            if ahead <= len(self.buffer):
                self.buffer = self.buffer[ahead:]
            else:
                self.file.seek(self.file.tell() + ahead - len(self.buffer))
                self.buffer = b""
            self.inflater, self.plain, self.left = None, b"", 0
        while self.left > len(self.plain):
            self.left -= len(self.plain)
            self.plain = self._more(CHUNK)
        self.plain, self.left = self.plain[self.left :], 0

    def _more(self, most: int) -> bytes:
        more = self._inflate(most)
        if more is None:
            raise ValueError("a gzip member ends inside a block")
        return more

    def block(self) -> bytes:
        parts, size = [self.plain], len(self.plain)
        while size < self.left:
            parts.append(self._more(max(1, self.left - size)))
            size += len(parts[-1])
        whole = b"".join(parts)
        block, self.plain, self.left = whole[: self.left], whole[self.left :], 0
        return block


def _length(head: bytes) -> int:
    return int(_fields(head).get("content-length", ("", "0"))[1] or 0)


def _fields(head: bytes) -> dict[str, tuple[str, str]]:
    """Header lines by their name in lower case, as (name, value); continued lines are joined."""
    out: dict[str, tuple[str, str]] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] = (out[last][0], f"{out[last][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = (name.strip(), value.strip())
    return out


def hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a labelled digest, whether base 32 or hex."""
    if not value:
        return None
    bare = value.rpartition(":")[2]
    try:
        return base64.b32decode(bare).hex() if len(bare) % 8 == 0 and bare == bare.upper() and len(bare) != 40 else bare.lower()
    except ValueError:
        return bare.lower()


def records(file, wanted=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """Rows of one archive, of the columns of SCHEMA. ``wanted`` sees the header columns alone."""
    start = file.read(CHUNK)
    reader = _Gzip(file, start) if start[:2] == b"\x1f\x8b" else _Plain(file, start)
    while (head := reader.record()) is not None:
        fields = _fields(head)
        if not head.startswith(b"WARC/"):
            continue
        row = {column: fields[name.lower()][1] if name.lower() in fields else None for column, name in HEADERS.items()}
        row["content_length"] = int(row["content_length"] or 0)
        if wanted(row):
            row["headers"] = list(dict(fields.values()).items())
            row["payload"] = reader.block() if payload else None
            yield row


def _meets(value, test) -> bool:
    kind, want, no = test
    if kind == "null":
        return (value is None) != no
    if value is None:
        return kind == "same" and (want is None) != no
    got = {"same": lambda: value == want, "eq": lambda: value == want, "in": lambda: value in want, "gt": lambda: value > want, "ge": lambda: value >= want, "lt": lambda: value < want, "le": lambda: value <= want, "starts": lambda: value.startswith(want), "ends": lambda: value.endswith(want), "has": lambda: want in value}[kind]()
    return got != no


class WarcReader(DataSourceReader):
    KINDS = {EqualTo: "eq", EqualNullSafe: "same", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}

    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], str(options.get("payload", "true")).lower() != "false", []

    def pushFilters(self, filters):
        for f in filters:
            no, inner = (True, f.child) if isinstance(f, Not) else (False, f)
            column = getattr(inner, "attribute", ("",))
            if len(column) == 1 and column[0] in HEADERS and isinstance(inner, IsNull | IsNotNull):
                self.tests.append((column[0], ("null", None, no != isinstance(inner, IsNotNull))))
            elif len(column) == 1 and column[0] in HEADERS and type(inner) in self.KINDS and not (no and isinstance(inner, EqualNullSafe)):
                self.tests.append((column[0], (self.KINDS[type(inner)], getattr(inner, "value", None), no)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _fs(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
        files = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root) :] and "/." not in x.path[len(root) :])
        return [InputPartition(x) for x in files] or [InputPartition(None)]

    def read(self, partition):
        schema = pa.schema([*[(c, pa.int64() if c == "content_length" else pa.string()) for c in HEADERS], ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        if partition.value is None:
            return
        system, _ = _fs(self.path)
        wanted = lambda row: all(_meets(row[c], t) for c, t in self.tests)
        rows, size = [], 0
        with system.open_input_file(partition.value) as file:
            for row in records(file, wanted, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


def member(head: list[tuple[str, str]], block: bytes, compress: bool, level: int = LEVEL) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in head), f"Content-Length: {len(block)}"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return plain
    deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflater.compress(plain) + deflater.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Rows of the columns of SCHEMA, any of them missing; ``headers`` are written after those that have columns of their own."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.compress = options.get("compression", "gzip") != "none"
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.token = uuid.uuid4().hex

    def write(self, iterator):
        system, root = _fs(self.path)
        system.create_dir(f"{root}/_{self.token}", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            names = batch.schema.names
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                head = [(name, str(row[c])) for c, name in HEADERS.items() if c != "content_length" and row.get(c) is not None]
                head += [(k, v) for k, v in (row.get("headers") or []) if v is not None]
                if out is None or size >= self.file_bytes:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                    out, size = system.open_output_stream(f"{root}/_{self.token}/{files[-1]}", compression=None), 0
                data = member(head, row.get("payload") or b"", self.compress)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages):
        system, root = _fs(self.path)
        from pyarrow import fs

        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")):
                    system.delete_file(x.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{root}/_{self.token}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*_fs(self.path))

    def _clear(self, system, root) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_{self.token}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.token}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1_000) -> DataFrame:
    """Pages as rows of an archive. Of pages with equal payloads of ``least`` bytes or more that with the largest key is a response and
    the others are revisits of it, without a block. Equal means equal SHA-1. Null html is an empty payload; rows with a null key and
    rows that repeat the largest key are responses. Other columns play no part."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b"")).alias("p"))
    rows = rows.withColumn("n", F.octet_length("p").cast("long")).withColumn("d", F.sha1("p"))
    equal = rows.where(F.col("n") >= least).groupBy("d").agg(F.max("k").alias("kept"), F.count("*").alias("c")).where("c > 1")
    kept = scratch.table(equal.select(F.col("d").alias("dd"), "kept"), "equal")
    rows = rows.join(kept, F.col("d") == F.col("dd"), "left")
    again = (F.col("k") != F.col("kept")) & (F.col("n") >= least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.coalesce(again, F.lit(False))
    extra = F.map_filter(F.create_map(F.lit("X-Payload-Length"), F.col("n").cast("string"), F.lit("WARC-Profile"), F.when(revisit, F.lit(REVISIT_PROFILE))), lambda _, v: v.isNotNull())
    return rows.select(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("warc_type"), name(F.col("k")).alias("record_id"), F.col("u").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit("text/html").alias("content_type"), F.lit(None).cast("long").alias("content_length"), F.concat(F.lit("sha1:"), F.col("d")).alias("payload_digest"), F.when(revisit, name(F.col("kept"))).alias("refers_to"), extra.alias("headers"), F.when(~revisit, F.col("p")).alias("payload"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record that page_records() gave. Those of responses
    come from the payload read back, those of revisits, which have none, from their headers."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 11, length({c}) - 11) as bigint)")
    read = spark.read.format("warc").load(path).where(F.col("warc_type").isin("response", "revisit"))
    whole = F.col("warc_type") == "response"
    return read.select(number("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["X-Payload-Length"].cast("long")).alias("payload_bytes"), F.when(whole, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    page_records(pages, scratch).write.format("warc").mode("append").save(scratch.path("archive"))
    return read_pages(spark, scratch.path("archive"))


OP9_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages
), kept as (
  select d, max(page_id) as k from p where n >= 1000 group by d
)
select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest, case when page_id <> k then 'revisit' else 'response' end as record_type,
  case when page_id <> k then k end as refers_to
from p left join kept on p.d = kept.d and n >= 1000
"""
