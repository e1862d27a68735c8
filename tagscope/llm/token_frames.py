"""Token ids in binary files that can be read in part: operator 13.

A data set is a folder of files and a manifest.  A file holds the ids of its
documents one after another, as little-endian unsigned 32-bit integers, cut
into independent zstandard frames:

| part | content |
| --- | --- |
| frames | ``frame_ids`` ids each (the last may be shorter) |
| index | skippable frame: header, then the zstandard-compressed columns doc_id, null mark and number of ids |
| seek table | skippable frame: compressed size, content size and checksum of every frame, then the footer |

The seek table follows the public Zstandard seekable format, so a file is also
a valid .zst stream.  Checksums are the low 32 bits of XXH64 over a frame's
content (the index: over its payload) and are verified whenever a frame is read.
A reader takes footer, seek table and index from a file's end and decompresses
only the frames that hold the asked documents.

The manifest (``_manifest.json``) names the files in order with their number of
documents and ids and their least and largest doc_id; it is written once, by the
commit, so files of failed or repeated attempts are never part of a data set.
Its size is that of the file list (one entry per partition).

Documents lie in ascending doc_id order (null first) over all files.  Rows that
repeat an id lie side by side in no promised order; each is a document of its
own.  Null text counts as empty: such a document holds the end id only.  An empty
table gives a data set without files.  Columns other than id and text are never
read, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "token_frames"
FRAME_IDS = 1 << 16
LEVEL = 1
MANIFEST = "_manifest.json"
SUFFIX = ".ids.zst"
BATCH_BYTES = 4 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
ARROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

# Numbers of the zstandard frame and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
HEADER, ENTRY, FOOTER, INDEX_HEADER = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<QI")


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder every executor can reach."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


# ---- one file ---------------------------------------------------------------------

class FrameWriter:
    """Writes documents to one file; holds one frame of ids and the index."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.sink, self.frame_bytes, self.frame_ids = sink, 4 * frame_ids, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.held = bytearray()
        self.entries: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids) -> None:
        """``ids``: the ids' bytes."""
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held += ids
        at = 0
        while len(self.held) - at >= self.frame_bytes:
            self._frame(bytes(self.held[at:at + self.frame_bytes]))
            at += self.frame_bytes
        del self.held[:at]

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.sink.write(packed)
        self.entries.append(ENTRY.pack(len(packed), len(content), checksum(content)))

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        none = np.array([d is None for d in self.doc_ids], np.uint8)
        doc_ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        payload = INDEX_HEADER.pack(len(none), self.frame_ids) + self.compressor.compress(
            doc_ids.tobytes() + none.tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.sink.write(HEADER.pack(SKIPPABLE_INDEX, len(payload)) + payload)
        self.entries.append(ENTRY.pack(HEADER.size + len(payload), 0, checksum(payload)))
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE)
        self.sink.write(HEADER.pack(SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads documents of one open file by position, one frame held at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("not a file of token frames: no seek table at its end")
        table = np.frombuffer(self._at(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.stop = np.cumsum(table[:, 0])
        self.start, self.sums = self.stop - table[:, 0], table[:, 2]
        if self.stop[-1] + HEADER.size + n * ENTRY.size + FOOTER.size != size:
            raise ValueError("token frames: the seek table does not fit the file")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.frames_read = 0
        payload = self._checked(n - 1, self._at(self.start[-1], self.stop[-1] - self.start[-1])[HEADER.size:])
        docs, self.frame_ids = INDEX_HEADER.unpack_from(payload)
        columns = self.unpack(payload[INDEX_HEADER.size:], max_output_size=17 * docs)
        self.doc_ids = np.frombuffer(columns, "<i8", docs)
        self.none = np.frombuffer(columns, np.uint8, docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(columns, "<i8", docs, 9 * docs)
        self.first = np.cumsum(self.sizes) - self.sizes      # of each document's ids, in the file
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(length))

    def _checked(self, i: int, content: bytes) -> bytes:
        if checksum(content) != self.sums[i]:
            raise ValueError(f"token frames: checksum of frame {i} differs")
        return content

    def frame(self, i: int) -> bytes:
        if self._held[0] != i:
            packed = self._at(self.start[i], self.stop[i] - self.start[i])
            self._held = i, self._checked(i, self.unpack(packed, max_output_size=4 * self.frame_ids))
            self.frames_read += 1
        return self._held[1]

    def ids(self, doc: int) -> bytes:
        """The ids' bytes of the file's document number ``doc``."""
        lo, hi = int(self.first[doc]), int(self.first[doc] + self.sizes[doc])
        parts = []
        while lo < hi:
            i, at = divmod(lo, self.frame_ids)
            stop = min(hi, (i + 1) * self.frame_ids)
            parts.append(self.frame(i)[4 * at:4 * (stop - i * self.frame_ids)])
            lo = stop
        return b"".join(parts)


# ---- the data source --------------------------------------------------------------

@dataclass
class FileEntry(WriterCommitMessage):
    """One file of a data set; ``part`` orders the files."""
    part: int
    name: str
    docs: int
    ids: int
    least: int | None = None
    largest: int | None = None
    has_null: bool = False


@dataclass
class FilePart(InputPartition):
    name: str
    start: int                          # ids in all files before
    wanted: list[int] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(self.name)


class TokenFrames(DataSource):
    """``token_frames``: writes (doc_id long, ids binary), or (doc_id long, text) with a
    tokenizer, whose rows lie in order over the partitions and inside them; reads
    doc_id, start, n_tokens, ids.

    Options: ``path``; writing: ``tokenizer`` (its file; texts are encoded where they
    are written) and ``end_id``, ``frame_ids``, ``level``; reading: ``doc_ids`` (a
    comma list: only these documents, and only the frames that hold them).  A data
    set is written whole: mode append needs an empty folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "TokenFramesReader":
        return TokenFramesReader(self.options["path"], self.options.get("doc_ids"))

    def writer(self, schema: StructType, overwrite: bool) -> "TokenFramesWriter":
        tokenizer = self.options.get("tokenizer")
        if schema.fieldNames() != ["doc_id", "text" if tokenizer else "ids"]:
            raise ValueError(f"token frames take the columns doc_id and ids, or doc_id and text with a tokenizer, not {schema.fieldNames()}")
        return TokenFramesWriter(self.options["path"], overwrite, int(self.options.get("frame_ids", FRAME_IDS)),
                                 int(self.options.get("level", LEVEL)), tokenizer, int(self.options.get("end_id", 0)))


class TokenFramesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, frame_ids: int, level: int, tokenizer: str | None, end_id: int):
        self.path, self.overwrite, self.frame_ids, self.level = path, overwrite, frame_ids, level
        self.tokenizer, self.end = tokenizer, struct.pack("<I", end_id)
        fs, folder = open_folder(path)
        if not overwrite and fs.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} already holds a data set of token frames")

    def _documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids' bytes) of the rows; null texts, or ids, count as empty."""
        for batch in batches:
            if self.tokenizer is None:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc_id, ids.as_buffer() if ids.is_valid else b""
                continue
            code = encoder(self.tokenizer).encode
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc_id, ids in zip(part.column(0).to_pylist(), code([t or "" for t in part.column(1).to_pylist()])):
                    yield doc_id, ids + self.end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FileEntry:
        fs, folder = open_folder(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}{SUFFIX}"
        sink = writer = None
        try:
            for doc_id, ids in self._documents(iterator):
                if sink is None:            # partitions without rows write no file
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = FrameWriter(sink, self.frame_ids, self.level)
                writer.add(doc_id, ids)
            if sink is None:
                return FileEntry(part, "", 0, 0)
            writer.close()
        finally:
            if sink is not None:
                sink.close()
        known = [d for d in writer.doc_ids if d is not None]
        return FileEntry(part, name, len(writer.sizes), sum(writer.sizes), min(known, default=None), max(known, default=None),
                         len(known) < len(writer.sizes))

    def commit(self, messages: list[FileEntry | None]) -> None:
        fs, folder = open_folder(self.path)
        files = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps([vars(m) for m in files]).encode())
        if fs.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{folder}/{MANIFEST}")
        fs.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")
        self._drop_files(fs, folder, {m.name for m in files})

    def abort(self, messages: list[FileEntry | None]) -> None:
        fs, folder = open_folder(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{folder}/{m.name}")

    @staticmethod
    def _drop_files(fs: pafs.FileSystem, folder: str, kept: set[str]) -> None:
        """Delete files of earlier data sets and of attempts that were not committed."""
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.endswith(SUFFIX) and info.base_name not in kept:
                fs.delete_file(info.path)


class TokenFramesReader(DataSourceReader):
    def __init__(self, path: str, doc_ids: str | None):
        self.path = path
        self.wanted = None if doc_ids is None else sorted({int(i) for i in doc_ids.split(",") if i.strip()})

    def partitions(self) -> list[FilePart]:
        fs, folder = open_folder(self.path)
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as src:
            files = [FileEntry(**m) for m in json.loads(src.read())]
        parts, start = [], 0
        for f in files:
            inside = [] if self.wanted is None else [i for i in self.wanted if f.least is not None and f.least <= i <= f.largest]
            if self.wanted is None or inside:
                parts.append(FilePart(f.name, start, inside))
            start += f.ids
        return parts or [FilePart("", 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = open_folder(self.path)
        with fs.open_input_file(f"{folder}/{partition.name}") as source:
            file = FrameReader(source)
            docs = np.arange(len(file.sizes))
            if self.wanted is not None:
                docs = docs[np.isin(file.doc_ids, partition.wanted) & ~file.none]
            held = 4 * np.cumsum(file.sizes[docs])
            while len(docs):
                n = max(1, int(np.searchsorted(held, BATCH_BYTES + held[0])))
                some = docs[:n]
                yield pa.RecordBatch.from_arrays([
                    pa.array(file.doc_ids[some], mask=file.none[some]), pa.array(partition.start + file.first[some]),
                    pa.array(file.sizes[some]), pa.array([file.ids(d) for d in some], pa.binary())], schema=ARROW_SCHEMA)
                docs, held = docs[n:], held[n:] - held[n - 1]


def read_frames(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (bytes) of a data set; with ``doc_ids`` of these only."""
    spark.dataSource.register(TokenFrames)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader if doc_ids is None else reader.option("doc_ids", ",".join(map(str, doc_ids)))).load()


def write_frames(rows: DataFrame, path: str, tokenizer: str | None = None, mode: str = "append", frame_ids: int = FRAME_IDS,
                 end_id: int = 0) -> None:
    """Write (doc_id, ids binary), or (doc_id, text) with a tokenizer's file, already in
    ascending order, as a data set."""
    rows.sparkSession.dataSource.register(TokenFrames)
    out = rows.select("doc_id", "text" if tokenizer else "ids").write.format(FORMAT).option("path", path).option("frame_ids", str(frame_ids))
    if tokenizer:
        out = out.option("tokenizer", tokenizer).option("end_id", str(end_id))
    out.mode(mode).save()


# ---- encoding ---------------------------------------------------------------------

class Encoder:
    """A tokenizer file with a cache of short pieces.

    A byte-level pre-tokenizer always cuts before a single blank or line end that
    stands between two characters which are neither, between such a line end and what
    follows, and between a letter and a punctuation mark that ends a piece.  So a
    text's ids are those of its pieces, joined: pieces seen before come from the
    cache, others go to the library; letters with or without a blank before them are
    one token of the pre-tokenizer and go straight to the library's model.

    A piece is named without its blank (``x`` stands for `` x``, ``\\nx`` for itself)
    and kept when it is met again, short ones at once: most long pieces of a corpus
    occur once."""

    CACHED = 1_000_000      # about 120 MB
    SHORT = 7
    LONGEST = 64
    # Some characters that are no blanks, letters, and marks that follow them.
    SOLID, LETTER, MARK = "!-~À-ɏ", "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
    CUTS = re.compile(f"(?<=[{SOLID}])(?=[ \n][{SOLID}])")
    PARTS = re.compile(f"(\\n?)([{LETTER}]+)([{MARK}]?)")
    WORD = re.compile(f"[{LETTER}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        pre = rules["pre_tokenizer"] or {}
        self.cuts = (rules["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space")
                     and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
                     and not any(re.search(f"\\s|[{self.MARK}]", c) or self.WORD.search(c) is None or self.WORD.fullmatch(c)
                                 for c in (t["content"] for t in rules["added_tokens"])))
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in shown else next(hidden)) for b in range(256)}
        self.solid = {chr(c) for c in range(0x250) if re.fullmatch(f"[{self.SOLID}]", chr(c))}
        self.pieces: dict[str, bytes] = {}
        self.met = bytearray(1 << 23)       # hashes of pieces met once

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not in the cache."""
        merge, alphabet, parts = self.tokenizer.model.tokenize, self.alphabet, self.PARTS.fullmatch
        line, *marks = self._library(["\n", *self.MARK])
        after = dict(zip(self.MARK, marks))
        known, met, places, blank = self.pieces, self.met, len(self.met) - 1, alphabet[32]
        got, others = {}, []
        for piece in missing:
            if piece.isascii() and piece.isalpha():         # most pieces
                end, word, mark = "", piece, ""
            else:
                found = parts(piece)
                if found is None:
                    others.append(piece)
                    continue
                end, word, mark = found.groups()
            ids = known.get(word) if mark and not end else None
            if ids is None:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(alphabet)
                ids = array("I", [x.id for x in merge(shown if end else blank + shown)]).tobytes()
            if end:
                ids = line + ids
            if mark:
                ids += after[mark]
            got[piece] = ids
            at = hash(piece) & places
            if met[at] or len(piece) <= self.SHORT:
                known[piece] = ids
            else:
                met[at] = 1
        for piece, ids in zip(others, self._library([p if p[0] == "\n" else " " + p for p in others])):
            got[piece] = ids
            at = hash(piece) & places
            if not met[at]:
                met[at] = 1
            elif len(piece) <= self.LONGEST and self._whole(piece):   # only such are cut out again without a look at their ends
                known[piece] = ids
        if len(known) > self.CACHED:
            known.clear()
            met[:] = bytes(len(met))
        return got

    def _whole(self, piece: str) -> bool:
        """Does a piece (with a line end before it or not) begin and end solid?"""
        solid = self.solid
        return piece[-1:] in solid and (piece[0] in solid or piece[0] == "\n" and piece[1:2] in solid)

    def _cut(self, text: str) -> tuple[str, list[str], list, list[int]]:
        """Head, pieces, their ids as far as known, and the places of the others."""
        head, *pieces = text.replace("\n", " \n").split(" ")
        ids = list(map(self.pieces.get, pieces))
        open_ = list(compress(range(len(ids)), map(not_, ids)))
        if pieces and head[-1:] not in self.solid or not all([self._whole(pieces[i]) for i in open_]):
            head, *units = self.CUTS.split(text)       # other blanks: cut only where it is certain
            pieces = [u[1:] if u[0] == " " else u for u in units]
            ids = list(map(self.pieces.get, pieces))
            open_ = list(compress(range(len(ids)), map(not_, ids)))
        return head, pieces, ids, open_

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids' bytes of each text."""
        if not self.cuts:
            return self._library(texts)
        cut = [self._cut(t) for t in texts]
        got = self._learn({pieces[i] for _, pieces, _, open_ in cut for i in open_})
        heads = self._library([c[0] for c in cut])
        out = []
        for head, (_, pieces, ids, open_) in zip(heads, cut):
            for i in open_:
                ids[i] = got[pieces[i]]
            out.append(head + b"".join(ids))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of a file, once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ordered_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in ascending doc_id order over the partitions and inside them;
    null texts are empty.  Rows of one id may spread over several partitions: the
    text's hash and the row's place cut them further."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    key = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")


def documents_to_frames(docs: DataFrame, path: str, tokenizer_path: str, mode: str = "append", frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` where they are written below ``path``, each with the end id 0
    behind it, and return what the files hold."""
    write_frames(ordered_texts(docs), path, tokenizer_path, mode, frame_ids)
    return read_frames(docs.sparkSession, path)
