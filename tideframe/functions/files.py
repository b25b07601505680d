"""Files by path or URI, through pyarrow's file systems, so that folders may be anywhere that driver and executors reach."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = str(path)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def join(root: str, *parts: str) -> str:
    return "/".join([str(root).rstrip("/"), *parts])


def name_of(path: str) -> str:
    return str(path).rstrip("/").rsplit("/", 1)[-1]


def exists(path: str) -> bool:
    fs, own = at(path)
    return fs.get_file_info(own).type != pafs.FileType.NotFound


def read(path: str) -> bytes:
    fs, own = at(path)
    with fs.open_input_stream(own) as f:
        return f.read()


def move(source: str, target: str) -> None:
    fs, own = at(source)
    fs.move(own, at(target)[1])


def delete(path: str) -> None:
    """Deletes a file; one that isn't there is no fault."""
    fs, own = at(path)
    if fs.get_file_info(own).type != pafs.FileType.NotFound:
        fs.delete_file(own)


def write(path: str, payload: bytes) -> None:
    """A file that appears whole or not at all."""
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    fs, own = at(partial)
    fs.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(own) as f:
        f.write(payload)
    move(partial, path)


def names(folder: str, suffix: str = "") -> list[str]:
    """Names of the files of a folder, sorted; none where there is no folder."""
    fs, own = at(folder)
    if fs.get_file_info(own).type == pafs.FileType.NotFound:
        return []
    found = fs.get_file_info(pafs.FileSelector(own))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(suffix))
