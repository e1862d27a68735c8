"""Files in a folder that the driver and all executors reach, by URI or plain path."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow.fs as pafs


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    fs, plain = pafs.FileSystem.from_uri(path)
    return fs, plain.rstrip("/")


def exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def read_json(fs: pafs.FileSystem, path: str):
    with fs.open_input_stream(path, compression=None) as src:
        return json.loads(src.read())


def write_json(fs: pafs.FileSystem, path: str, value) -> None:
    """Write a small file in one step: under another name first, then moved."""
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(held, compression=None) as out:
        out.write(json.dumps(value).encode())
    fs.move(held, path)
