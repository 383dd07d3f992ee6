"""Files by path or URI: plain paths, and whatever store pyarrow's file systems reach (file, hdfs, s3, gs, abfs).

Driver and tasks open them alike, so a path has to name the same file on all machines.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyarrow import fs

CHUNK = 1 << 22


def local_path(path: str) -> str:
    return path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith("file:") else path


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it."""
    path = local_path(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def open_input(path: str):
    """A file for reading at any place."""
    store, inner = store_of(path)
    return store.open_input_file(inner)


def create(path: str):
    store, inner = store_of(path)
    return store.open_output_stream(inner)


def exists(path: str) -> bool:
    store, inner = store_of(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def size(path: str) -> int:
    store, inner = store_of(path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return found.size


def move(old: str, new: str) -> None:
    store, inner = store_of(old)
    store.move(inner, store_of(new)[1])


def make_folder(path: str) -> None:
    store, inner = store_of(path)
    store.create_dir(inner, recursive=True)


def remove_folder(path: str) -> None:
    store, inner = store_of(path)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)


def matching(path: str) -> list[str]:
    """The files of a folder that a pattern in the last part of the path matches, in order (numbers by value: _999, _1000); the path itself if none."""
    path = local_path(path)
    folder, slash, name = path.rpartition("/")
    if not any(c in name for c in "*?["):
        return [path]
    store, inner = store_of(folder or (slash or "."))
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    names = [x.base_name for x in found if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, name)]
    names.sort(key=lambda n: ([int(x) if k % 2 else x for k, x in enumerate(re.split(r"([0-9]+)", n))], n))
    return [f"{folder}{slash}{n}" for n in names] or [path]


def chunks(path: str, first: int, end: int) -> Iterator[bytes]:
    """The bytes from ``first`` to ``end``, a few MB at a time."""
    with open_input(path) as f:
        f.seek(first)
        while first < end and (got := f.read(min(CHUNK, end - first))):
            yield got
            first += len(got)
