"""Byte streams on the file system that a URI names, for code that runs in Python workers. Bytes are passed as they are, whatever the name ends in."""

from __future__ import annotations

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.LocalFileSystem() if uri.startswith("/") else None, uri


def open_input(uri: str):
    system, path = _resolve(uri)
    if system is None:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def open_output(uri: str):
    system, path = _resolve(uri)
    if system is None:
        system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)
