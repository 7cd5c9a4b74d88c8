"""Files in the shared folder, opened from executors by URI.

A task writes each file under a name of its own attempt and reports it in its rows. Only files that a
finished task reported are ever read, so a lost or repeated attempt leaves at most an unread file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def attempt() -> str:
    """A part of a file name that no other attempt has."""
    return uuid.uuid4().hex


def write_file(uri: str, parts: list[bytes]) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def open_file(uri: str):
    """A seekable file, for range reads."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
