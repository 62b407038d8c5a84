"""Files in the shared folder, by URI (file://, hdfs://, s3://, ...)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def split(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def unique(folder: str, name: str, suffix: str) -> str:
    """A new name: a retried or speculative task never touches another attempt's file."""
    return f"{folder}/{name}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    fs, path = split(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_random(uri: str):
    fs, path = split(uri)
    return fs.open_input_file(path)


def read_range(f, offset: int, length: int) -> bytes:
    return f.read_at(length, offset)
