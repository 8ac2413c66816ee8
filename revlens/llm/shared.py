"""Files in the shared work folder that tasks write once and other tasks map into memory.

A task writes under a name nobody used before and returns that name as a row, so the
file of a task that is run again simply has no reader. Executors open files by address:
a folder mounted everywhere is mapped in place, any other store is copied to an unlinked
temporary file of the reading task first.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without argument cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Seed of the 64-bit digests; the JVM function ``xxhash64`` uses the same one.
SEED = 42


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def fresh(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def sink(path: str):
    """Output stream at an address; missing folders are made."""
    store, inner = _store(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner, compression=None)


def source(path: str):
    """Sequential input stream at an address."""
    store, inner = _store(path)
    return store.open_input_stream(inner, compression=None)


def remove(path: str) -> None:
    store, inner = _store(path)
    store.delete_file(inner)


def mapped(path: str) -> memoryview:
    """The bytes of a file, mapped into memory."""
    store, inner = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        with open(inner, "rb") as f:
            return _map(f)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(inner, compression=None) as stream:
        while chunk := stream.read(1 << 22):
            copy.write(chunk)
        copy.flush()
        return _map(copy)


def _map(f) -> memoryview:
    size = os.fstat(f.fileno()).st_size
    return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)) if size else memoryview(b"")


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Several arrays in one file: a line of names, types and lengths, then each array on an 8-byte border."""
    head = ",".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode() + b"\n"
    with sink(path) as out:
        out.write(head)
        at = len(head)
        for v in arrays.values():
            pad = -at % 8
            out.write(b"\0" * pad)
            out.write(np.ascontiguousarray(v).data.cast("B") if len(v) else b"")
            at += pad + v.nbytes


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of ``write_arrays``, still in the mapped file."""
    view = mapped(path)
    head = bytes(view[: 1 << 16]).split(b"\n", 1)[0]
    out, at = {}, len(head) + 1
    for part in head.decode().split(","):
        name, kind, n = part.split(":")
        at += -at % 8
        dtype = np.dtype(kind)
        out[name] = np.frombuffer(view, dtype, int(n), at) if int(n) else np.empty(0, dtype)
        at += dtype.itemsize * int(n)
    return out


def free(df, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
