"""Binary files in the shared folder, through Arrow's filesystems.

Paths are URIs (``file://``, ``hdfs://``, ``s3://``, ...) or plain local paths.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = resolve(uri)
    fs.create_dir(path, recursive=True)


def list_files(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path as URI, size) of the files right below a folder, sorted by name."""
    fs, path = resolve(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(
        (f"{uri.rstrip('/')}/{f.base_name}", f.size)
        for f in found
        if f.type == pafs.FileType.File and f.base_name.endswith(suffix)
    )


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


class AtomicFile:
    """Write to a name of this attempt, then rename: a lost or doubled task leaves no
    half-written file under the final name, and a retry simply writes it again."""

    def __init__(self, uri: str):
        self.fs, self.path = resolve(uri)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.attempt)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.attempt, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.attempt)
