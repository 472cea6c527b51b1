"""Files of any store that Arrow reaches, for readers that need pieces of a file."""

from __future__ import annotations

import uuid
from fnmatch import fnmatch

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a plain local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str) -> list[str]:
    """Sorted files below a folder whose names match, or the file itself, as paths that ``opened`` takes."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(path.rstrip("/") + f.path[len(at.rstrip("/")) :] for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob))


def piece(path: str, start: int, size: int) -> bytes:
    store, at = opened(path)
    with store.open_input_file(at) as f:
        return f.read_at(min(size, max(0, f.size() - start)), start)


def put(path: str, content: bytes) -> None:
    """Write a file under another name and move it into place, so that a repeated task does no harm."""
    store, at = opened(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, at)
