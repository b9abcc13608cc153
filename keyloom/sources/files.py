"""Files in any store that executors share, by URI or plain path."""

from __future__ import annotations

import posixpath
import struct
import uuid


class Layout:
    """A fixed binary layout that, unlike ``struct.Struct``, can be pickled."""

    def __init__(self, form: str) -> None:
        self.form, self.size = form, struct.calcsize(form)

    def pack(self, *values) -> bytes:
        return struct.pack(self.form, *values)

    def unpack(self, data: bytes) -> tuple:
        return struct.unpack(self.form, data)

    def unpack_from(self, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.form, data, at)


def open_store(uri: str):
    """pyarrow file system and path."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri[5:] if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file whole: under another name first, so readers and lost tasks never see a part."""
    store, path = open_store(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{uuid.uuid4().hex}")
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, path)


def listed(uri: str) -> list[str]:
    """The file itself, or those of a folder, by name; hidden ones left out."""
    from pyarrow import fs

    store, path = open_store(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(uri)
    found = store.get_file_info(fs.FileSelector(path))
    return [posixpath.join(uri, x.base_name) for x in sorted(found, key=lambda x: x.base_name) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]


def read_range(uri: str, start: int, size: int | None = None) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def size_of(uri: str) -> int:
    store, path = open_store(uri)
    return store.get_file_info(path).size
