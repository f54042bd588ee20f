"""Binary files in the shared folder, written and read by tasks through whatever file system the folder's URL names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(url: str) -> tuple[fs.FileSystem, str]:
    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:/") and not url.startswith("file://"):
        url = "file://" + url[len("file:"):]
    return fs.FileSystem.from_uri(url)


def new_file(folder: str, partition: int, suffix: str) -> str:
    """A name of its own for each attempt: a retried or doubled task never writes another's file, and only the files
    that successful tasks report are read."""
    return f"{folder}/part-{partition:05d}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writing(url: str):
    system, path = _at(url)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
        yield out


@contextmanager
def reading(url: str):
    system, path = _at(url)
    with system.open_input_file(path) as source:
        yield source
