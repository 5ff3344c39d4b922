"""Whole files in the shared folder, written and read by executors (any scheme pyarrow knows)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write under a name of this attempt's own, so that a repeated task never touches another's file."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(f"{path}/{own}", compression=None) as out:
        out.write(data)
    return f"{folder}/{own}"


def read_file(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()
