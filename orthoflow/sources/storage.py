"""Files of matrix streams on any store that pyarrow opens (mounted paths, HDFS, object stores).

Data source code runs in Python workers, which have no gateway to the JVM and so none to Hadoop's
file API; pyarrow's file systems are the same store seen from there.
"""

from __future__ import annotations

import fnmatch
import posixpath
from dataclasses import dataclass

from pyarrow import fs

# Scheme names of Hadoop's connectors and their names in pyarrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfss": "abfss", "abfs": "abfs", "s3": "s3"}
_WILD = set("*?[")


@dataclass
class Entry:
    """A file: its name as given to :func:`open_read`, size in bytes, change time in nanoseconds."""

    path: str
    size: int
    time: int


def resolve(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path inside it, prefix that makes such a path a full one again)."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path, ""
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), ""
    if scheme not in _SCHEMES:
        raise ValueError(f"no file system for {scheme}: ({path})")
    system, inside = fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest}")
    head = path[: len(path) - len(inside.lstrip("/"))] if path.endswith(inside.lstrip("/")) else f"{scheme}://"
    return system, inside, head


def _entry(info: fs.FileInfo, head: str) -> Entry:
    path = head + info.path.lstrip("/") if head else info.path
    return Entry(path, info.size, info.mtime_ns or 0)


def stat(path: str) -> Entry | None:
    """The file at a path, None where there is none."""
    system, inside, head = resolve(path)
    info = system.get_file_info(inside)
    return _entry(info, head) if info.type == fs.FileType.File else None


def is_folder(path: str) -> bool:
    system, inside, _ = resolve(path)
    return system.get_file_info(inside).type == fs.FileType.Directory


def walk(path: str, recursive: bool = True) -> list[Entry]:
    """Files below a folder, by name; hidden ones and folders that begin with a dot or an underscore
    are left out."""
    system, inside, head = resolve(path)
    found = system.get_file_info(fs.FileSelector(inside, recursive=recursive, allow_not_found=True))
    base = inside.rstrip("/")
    out = []
    for info in found:
        parts = info.path[len(base) :].strip("/").split("/")
        if info.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in parts):
            out.append(_entry(info, head))
    return sorted(out, key=lambda e: e.path)


def expand(pattern: str) -> list[Entry]:
    """Files that match a glob; ``*`` stays within one name, ``**`` does not."""
    first = min(pattern.index(c) for c in _WILD if c in pattern)
    folder = pattern[:first].rsplit("/", 1)[0] if "/" in pattern[:first] else "."
    deep = "**" in pattern
    depth = pattern.count("/")
    return [e for e in walk(folder or "/") if fnmatch.fnmatchcase(e.path, pattern) and (deep or e.path.count("/") == depth)]


def has_wildcard(path: str) -> bool:
    return any(c in path for c in _WILD)


def open_read(path: str):
    """A file for reads at any place."""
    system, inside, _ = resolve(path)
    return system.open_input_file(inside)


def open_write(path: str):
    system, inside, _ = resolve(path)
    return system.open_output_stream(inside)


def make_folder(path: str) -> None:
    system, inside, _ = resolve(path)
    system.create_dir(inside, recursive=True)


def read_small(path: str) -> bytes | None:
    """Content of a small file, None where there is none."""
    try:
        with open_read(path) as fh:
            return fh.read()
    except FileNotFoundError:
        return None


def publish(path: str, content: bytes) -> None:
    """Write a small file that is seen whole or not at all: under a draft's name and renamed to a name
    that was not there, or, on an object store, in one put."""
    system, inside, _ = resolve(path)
    if isinstance(system, (fs.LocalFileSystem, fs.HadoopFileSystem)):
        draft = posixpath.join(posixpath.dirname(inside), f".{posixpath.basename(inside)}.draft")
        with system.open_output_stream(draft) as out:
            out.write(content)
        system.move(draft, inside)
    else:
        with system.open_output_stream(inside) as out:
            out.write(content)


def names(path: str, kind: fs.FileType = fs.FileType.File) -> list[str]:
    """Names of what a folder holds, hidden ones too."""
    system, inside, _ = resolve(path)
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted(posixpath.basename(i.path) for i in found if i.type == kind)


def folders(path: str) -> list[str]:
    return names(path, fs.FileType.Directory)


def anything_in(path: str) -> bool:
    system, inside, _ = resolve(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.Directory:
        return bool(system.get_file_info(fs.FileSelector(inside)))
    return info.type == fs.FileType.File


def remove_folder(path: str) -> None:
    system, inside, _ = resolve(path)
    if system.get_file_info(inside).type == fs.FileType.Directory:
        system.delete_dir(inside)


def remove_file(path: str) -> None:
    system, inside, _ = resolve(path)
    if system.get_file_info(inside).type == fs.FileType.File:
        system.delete_file(inside)


def join(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])
