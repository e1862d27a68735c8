"""``tag_drops``: a streaming source over a folder of gzip drops, one line a row.

| step | where |
| --- | --- |
| list the folder, note the new files | driver, ``latestOffset`` |
| share them out | driver, ``partitions`` |
| read each file twice: to its end without keeping anything, then line by line | tasks, ``read`` |
| forget (or archive) what is done | driver, ``commit`` |

**Offsets.** An offset is the number of the last entry of a file log that lies in
the query's checkpoint folder (``state``).  An entry names the files of one step
with their sizes and is written in one move before its offset is returned, so a
restarted query finds exactly the files its checkpoint speaks of.  Entries of
finished steps are folded into one list of the files that are still in the folder,
so the log's size follows the folder, not the history.

**Partitions.** A file is never cut (gzip has no inner starts).  Files from
``PACK_BYTES`` on are a partition each; smaller ones are packed together up to that
size, so five thousand small drops are not five thousand tasks.

**Whole files only.** A file counts only if it can be read to its end: the first
pass decompresses it in pieces of 1 MiB and keeps nothing, the second one emits its
lines in batches, so a file may be larger than the worker's memory.  A file that
fails gives one row with a ``problem`` and no line.  A line longer than ``max_line``
bytes is a ``problem`` of its own (its beginning is kept) and the file goes on.

Rows: ``file``, ``line``, ``problem``.  Blank lines are no rows.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tagscope.sources.shared_files import exists, open_folder, read_json, write_json

FORMAT = "tag_drops"
SCHEMA = "file string, line string, problem string"
ARROW = pa.schema([("file", pa.string()), ("line", pa.string()), ("problem", pa.string())])
UNREADABLE, TOO_LONG = "unreadable file", "oversized line"
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
PACK_BYTES = 8 << 20
MAX_FILES = 1000
MAX_LINE = 64 << 20
KEPT_OF_LONG = 1000


# ---- one file ---------------------------------------------------------------------

def unpacked(source) -> Iterator[bytes]:
    """Pieces of a gzip stream; raises ``zlib.error`` or ``EOFError`` unless every
    member is whole.  Members may follow each other."""
    reader, members = None, 0
    while True:
        data = source.read(READ_BYTES)
        if not data:
            break
        while data:
            if reader is None:
                reader = zlib.decompressobj(31)
            piece = reader.decompress(data, READ_BYTES)
            if piece:
                yield piece
            data = reader.unconsumed_tail
            if reader.eof:
                data, reader, members = reader.unused_data, None, members + 1
    while reader is not None and not reader.eof:          # what the last piece still holds back
        piece = reader.decompress(reader.unconsumed_tail, READ_BYTES)
        if not piece:
            break
        yield piece
    if members == 0 and (reader is None or not reader.eof) or reader is not None and not reader.eof:
        raise EOFError("the gzip stream ends before its end mark")


def is_whole(fs: pafs.FileSystem, path: str) -> bool:
    try:
        with fs.open_input_stream(path, compression=None) as source:
            for _ in unpacked(source):
                pass
        return True
    except (zlib.error, EOFError, OSError):
        return False


def lines_of(fs: pafs.FileSystem, path: str, max_line: int = MAX_LINE) -> Iterator[tuple[str | None, str | None]]:
    """(line, problem) of every line that is not blank."""
    held = bytearray()
    over = False                       # inside a line that is too long: its beginning was given already
    with fs.open_input_stream(path, compression=None) as source:
        for piece in unpacked(source):
            *ended, rest = piece.split(b"\n")
            for part in ended:
                if not over:
                    held += part
                    if held.strip():
                        yield held.decode("utf-8", "replace").rstrip("\r"), None
                held, over = bytearray(), False
            if over:
                continue
            held += rest
            if len(held) > max_line:
                yield held[:KEPT_OF_LONG].decode("utf-8", "replace"), TOO_LONG
                held, over = bytearray(), True
        if held.strip():
            yield held.decode("utf-8", "replace").rstrip("\r"), None


def read_files(folder: str, files: Sequence[tuple[str, int]], max_line: int) -> Iterator[pa.RecordBatch]:
    fs, base = open_folder(folder)
    rows: list[tuple] = []
    held = 0
    for name, _ in files:
        path = f"{base}/{name}"
        found = lines_of(fs, path, max_line) if is_whole(fs, path) else [(None, UNREADABLE)]
        for line, problem in found:
            rows.append((path, line, problem))
            held += len(line or "") + len(path)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=ARROW)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=ARROW)


# ---- the folder and its log -----------------------------------------------------------

def listed(fs: pafs.FileSystem, base: str, patterns: Sequence[str]) -> list[tuple[str, int]]:
    """(name, bytes) of the folder's drops, oldest first."""
    if not exists(fs, base):
        return []
    found = [i for i in fs.get_file_info(pafs.FileSelector(base))
             if i.type == pafs.FileType.File and any(fnmatch.fnmatchcase(i.base_name, p) for p in patterns)]
    return [(i.base_name, i.size) for i in sorted(found, key=lambda i: (i.mtime_ns or 0, i.base_name))]


def packed(files: Sequence[tuple[str, int]], limit: int = PACK_BYTES) -> list[list[tuple[str, int]]]:
    """Files shared out: large ones alone, small ones together up to ``limit`` bytes."""
    out: list[list[tuple[str, int]]] = [[f] for f in files if f[1] >= limit]
    group: list[tuple[str, int]] = []
    size = 0
    for f in (f for f in files if f[1] < limit):
        if group and size + f[1] > limit:
            out.append(group)
            group, size = [], 0
        group.append(f)
        size += f[1]
    return out + ([group] if group else [])


@dataclass
class DropPart(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class FileLog:
    """Entries 1, 2, ... of new files, and ``done.json``: the last folded entry with
    the files of it and of earlier ones that are still in the folder."""

    def __init__(self, state: str):
        self.fs, self.base = open_folder(state)

    def _path(self, n: int) -> str:
        return f"{self.base}/{n}.json"

    def done(self) -> tuple[int, list[str]]:
        path = f"{self.base}/done.json"
        return tuple(read_json(self.fs, path)) if exists(self.fs, path) else (0, [])

    def entry(self, n: int) -> list[tuple[str, int]]:
        return [tuple(f) for f in read_json(self.fs, self._path(n))]

    def last(self) -> int:
        n = self.done()[0]
        while exists(self.fs, self._path(n + 1)):
            n += 1
        return n

    def known(self) -> set[str]:
        n, names = self.done()
        return set(names) | {f for i in range(n + 1, self.last() + 1) for f, _ in self.entry(i)}

    def add(self, files: Sequence[tuple[str, int]]) -> int:
        self.fs.create_dir(self.base, recursive=True)
        n = self.last() + 1
        write_json(self.fs, self._path(n), list(files))
        return n

    def fold(self, upto: int, present: set[str]) -> list[str]:
        """Mark all entries up to ``upto`` as done; returns the names they held."""
        n, names = self.done()
        new = [f for i in range(n + 1, upto + 1) for f, _ in self.entry(i)]
        if upto > n:
            write_json(self.fs, f"{self.base}/done.json", [upto, [f for f in [*names, *new] if f in present]])
            for i in range(n + 1, upto + 1):
                self.fs.delete_file(self._path(i))
        return new


class TagDrops(DataSource):
    """Options: ``path`` (the folder), ``patterns`` (comma list of name patterns),
    ``state`` (log folder, streaming only), ``maxFiles`` per step, ``maxLine`` bytes,
    ``archive`` (folder that finished drops move to; else they stay)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "DropReader":
        return DropReader(self.options)

    def streamReader(self, schema: StructType) -> "DropStreamReader":
        return DropStreamReader(self.options)


class DropReader(DataSourceReader):
    """The folder's drops as they are now (batch)."""

    def __init__(self, options):
        self.folder, self.max_line = options["path"], int(options.get("maxLine", MAX_LINE))
        self.patterns = options.get("patterns", "*").split(",")

    def partitions(self) -> Sequence[InputPartition]:
        return [DropPart(files) for files in packed(listed(*open_folder(self.folder), self.patterns))] or [DropPart([])]

    def read(self, partition: DropPart) -> Iterator[pa.RecordBatch]:
        return read_files(self.folder, partition.files, self.max_line)


class DropStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.state = options["path"], options["state"]
        self.patterns = options.get("patterns", "*").split(",")
        self.max_files, self.max_line = int(options.get("maxFiles", MAX_FILES)), int(options.get("maxLine", MAX_LINE))
        self.archive = options.get("archive")

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        log = FileLog(self.state)
        known = log.known()
        new = [f for f in listed(*open_folder(self.folder), self.patterns) if f[0] not in known]
        return {"entry": log.add(new[:self.max_files]) if new else log.last()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        log = FileLog(self.state)
        files = [f for n in range(start["entry"] + 1, end["entry"] + 1) for f in log.entry(n)]
        return [DropPart(part) for part in packed(files)]

    def read(self, partition: DropPart) -> Iterator[pa.RecordBatch]:
        return read_files(self.folder, partition.files, self.max_line)

    def commit(self, end: dict) -> None:
        fs, base = open_folder(self.folder)
        log = FileLog(self.state)
        if self.archive:
            afs, archive = open_folder(self.archive)
            afs.create_dir(archive, recursive=True)
            first = log.done()[0] + 1
            for name in [f for n in range(first, end["entry"] + 1) for f, _ in log.entry(n)]:
                if exists(fs, f"{base}/{name}"):
                    fs.move(f"{base}/{name}", f"{archive}/{name}")
        log.fold(end["entry"], {f for f, _ in listed(fs, base, self.patterns)})


def read_drop_lines(spark: SparkSession, folder: str, patterns: Sequence[str], max_line: int = MAX_LINE) -> DataFrame:
    """(file, line, problem) of the drops that are in the folder now."""
    spark.dataSource.register(TagDrops)
    return (spark.read.format(FORMAT).option("path", folder).option("patterns", ",".join(patterns))
            .option("maxLine", str(max_line)).load())


def stream_drop_lines(spark: SparkSession, folder: str, patterns: Sequence[str], state: str, max_files: int = MAX_FILES,
                      archive: str | None = None, max_line: int = MAX_LINE) -> DataFrame:
    """(file, line, problem) of every new drop, each file once."""
    spark.dataSource.register(TagDrops)
    reader = (spark.readStream.format(FORMAT).option("path", folder).option("patterns", ",".join(patterns)).option("state", state)
              .option("maxFiles", str(max_files)).option("maxLine", str(max_line)))
    return (reader.option("archive", archive) if archive else reader).load()
