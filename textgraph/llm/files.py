"""Files in the shared folder, written and read from Python tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that a lost or repeated task leaves no half file."""
    system, path = _open(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def create(uri: str):
    """A stream that writes a new file; its name should be the writer's own, as a lost task leaves what it wrote."""
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def get(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def ranges(uri: str, spans: list[tuple[int, int]]):
    """The bytes of each (offset, length), from one open file."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        for offset, length in spans:
            yield f.read_at(length, offset)
