"""Files read by byte ranges, from where tasks run: what a request needs and no more."""

from __future__ import annotations

import re

from pyarrow import fs as arrow_fs

from kmerloom.model import EngineError


def locate(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it of a URI as Hadoop or a user writes it."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    try:
        return arrow_fs.FileSystem.from_uri(uri)
    except (OSError, ValueError) as e:
        raise EngineError(f"{uri} can't be read by ranges: {e}") from None


class Ranges:
    """A file, or bytes, as ranges; `requests` and `bytes_read` say what has been asked for."""

    def __init__(self, source: str | bytes):
        self.requests = self.bytes_read = 0
        if isinstance(source, bytes):
            self._file, self._data, self.size = None, source, len(source)
        else:
            files, path = locate(source)
            self._file, self._data = files.open_input_file(path), b""
            self.size = self._file.size()

    def read(self, at: int, size: int) -> bytes:
        """Up to `size` bytes from `at` on: fewer where the file ends."""
        size = max(0, min(size, self.size - at))
        self.requests, self.bytes_read = self.requests + 1, self.bytes_read + size
        return self._file.read_at(size, at) if self._file is not None else self._data[at : at + size]

    def exact(self, at: int, size: int, what: str) -> bytes:
        data = self.read(at, size)
        if len(data) < size:
            raise EngineError(f"The file ends inside {what}.")
        return data

    def close(self) -> None:
        if self._file is not None:
            self._file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def files_under(uri: str) -> list[tuple[str, int]]:
    """URI and size of a file, or of the files in a folder that aren't hidden, by name."""
    files, path = locate(uri)
    info = files.get_file_info(path)
    root = re.sub(r"^file:/+", "file:///", uri)
    if info.type == arrow_fs.FileType.File:
        return [(root, info.size)]
    if info.type != arrow_fs.FileType.Directory:
        raise EngineError(f"{uri} doesn't exist.")
    inside = (x for x in files.get_file_info(arrow_fs.FileSelector(path)) if x.type == arrow_fs.FileType.File and x.base_name[0] not in "._")
    return sorted((f"{root.rstrip('/')}/{x.base_name}", x.size) for x in inside)
