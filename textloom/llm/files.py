"""Files that tasks write to and read from the shared folder, by URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


@contextmanager
def writer(uri: str) -> Iterator[pa.NativeFile]:
    """A file that appears whole or not at all, so that a lost or repeated task leaves no part of one."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(partial) as out:
        yield out
    try:
        store.move(partial, path)
    except OSError:  # some stores don't move over a file that an earlier attempt has left
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_file(path)
        store.move(partial, path)


def open_file(uri: str) -> pa.NativeFile:
    """A local file memory-mapped, any other for random access."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path)
    return store.open_input_file(path)
