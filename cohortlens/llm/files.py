"""Files in the shared folder: committed by renaming, so that a repeated task leaves one whole file."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class Committed:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.system, path = opened(folder)
        self.system.create_dir(path, recursive=True)
        self.final, self.temporary = f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.system.move(self.temporary, self.final)


def put(folder: str, name: str, data: bytes) -> None:
    out = Committed(folder, name)
    out.write(data)
    out.commit()


def get(folder: str, name: str) -> bytes:
    system, path = opened(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
        return stream.read()
