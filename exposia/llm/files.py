"""Binary files that tasks write to and read from the shared folder.

A file gets a new name for every task attempt and is known only through the row its task returns,
so an attempt that is lost or repeated leaves nothing that is read. The folder may be a path or any
address that pyarrow's file systems open.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):  # file:/x and file:///x
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def new_name(folder: str, label: str, suffix: str) -> str:
    return f"{folder}/{label}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writer(path: str):
    system, name = _open(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None, buffer_size=1 << 20) as out:
        yield out


def reader(path: str):
    """A file for reads of byte ranges: ``read_at(length, offset)``."""
    system, name = _open(path)
    return system.open_input_file(name)
