"""One ordered document per tag, written by many tasks (EXP3, EXP5, EXP7).

A chart series, a tag's time map or an XML export is one well-formed document: a
head, pieces in time order with a separator between them, and a foot.  Its length
follows the history, so it is never a row, and no group of a shuffle:

1. The pieces are range-partitioned by (document, time) and sorted, so a tag that
   holds a third of the data spreads over a third of the partitions.
2. Every task streams the pieces of each document it holds into a part file of its
   own and reports (document, part, file, pieces).  The reports are written as a
   table, so only those of tasks that counted exist; a repeated or lost attempt
   leaves a file that nothing names.
3. One task per document streams its part files, in order, into the final file and
   moves it to its name.  It holds one buffer.

The result lists the files.  Writing again into the same folder replaces documents
of the same name.
"""

from __future__ import annotations

import shutil
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.sources.shared_files import open_folder

REPORT = "doc string, part int, file string, pieces long"
WRITTEN = "doc string, file string, pieces long, bytes long"
BUFFER = 1 << 20


def file_name(doc: str, suffix: str) -> str:
    """A file name for any document name."""
    return urllib.parse.quote(doc, safe="") + suffix


def _write_parts(folder: str, separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        reports: list[tuple] = []
        now, out, pieces = None, None, 0

        def close():
            if out is not None:
                out.close()
                reports.append((now, part, path, pieces))

        for batch in batches:
            for doc, piece in zip(batch.column("doc").to_pylist(), batch.column("piece").to_pylist()):
                if out is None or doc != now:
                    close()
                    now, pieces = doc, 0
                    path = f"{base}/{part:06d}-{attempt}-{len(reports)}.part"
                    out = fs.open_output_stream(path, compression=None, buffer_size=BUFFER)
                if pieces:
                    out.write(separator)
                out.write(piece.encode())
                pieces += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reports) if reports else [()] * 4,
                                                                        (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                         names=["doc", "part", "file", "pieces"])

    return run


def _join_parts(folder: str, separator: bytes, foot: bytes, suffix: str):
    def run(table: pa.Table) -> pa.Table:
        fs, base = open_folder(folder)
        parts = sorted(table.select(["part", "file", "pieces", "doc", "head"]).to_pylist(), key=lambda r: r["part"])
        held = f"{base}/_{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(held, compression=None, buffer_size=BUFFER) as out:
            out.write(parts[0]["head"].encode())
            for i, p in enumerate(parts):
                if i:
                    out.write(separator)
                with fs.open_input_stream(p["file"], compression=None) as src:
                    shutil.copyfileobj(src, out, BUFFER)
            out.write(foot)
        name = f"{base}/{file_name(parts[0]['doc'], suffix)}"
        size = fs.get_file_info(held).size
        fs.move(held, name)
        return pa.table({"doc": [parts[0]["doc"]], "file": [name], "pieces": pa.array([sum(p["pieces"] for p in parts)], pa.int64()),
                         "bytes": pa.array([size], pa.int64())})

    return run


def write_documents(pieces: DataFrame, path: str, head: F.Column, separator: str, foot: str, suffix: str) -> DataFrame:
    """Write (doc, at, piece) as one document per ``doc`` below ``path``: ``head`` (a
    column over ``doc``), the pieces by ``at`` (ties by the piece's text), ``foot``.
    Returns (doc, file, pieces, bytes) of what was written."""
    spark = pieces.sparkSession
    fs, base = open_folder(path)
    parts = f"{path.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    pfs, plain = open_folder(parts)
    pfs.create_dir(f"{plain}/data", recursive=True)
    key = ["doc", "at", "piece"]
    ordered = pieces.filter(F.col("doc").isNotNull()).select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.select("doc", "piece").mapInArrow(_write_parts(f"{parts}/data", separator.encode()), REPORT).write.parquet(f"{parts}/reports")
    reports = spark.read.schema(REPORT).parquet(f"{parts}/reports").withColumn("head", head)
    done = reports.groupBy("doc").applyInArrow(_join_parts(path, separator.encode(), foot.encode(), suffix), WRITTEN)
    done.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_written")
    pfs.delete_dir(plain)
    return spark.read.schema(WRITTEN).parquet(f"{path.rstrip('/')}/_written")
