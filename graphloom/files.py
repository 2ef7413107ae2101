"""Small files and folders by path or URI, through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import json
import os
import re
import uuid


def is_uri(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def full(path: str) -> str:
    """A URI as it is, a path as an absolute one."""
    path = re.sub(r"^file:/+", "file:///", str(path))
    return path if is_uri(path) else os.path.abspath(path)


def for_spark(path: str) -> str:
    """The same place for Spark, whose bare paths may belong to another file system."""
    return full(path) if is_uri(path) else f"file://{full(path)}"


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(full(path))
    return fs, base.rstrip("/")


def exists(path: str) -> bool:
    from pyarrow.fs import FileType

    fs, base = opened(path)
    return fs.get_file_info(base).type != FileType.NotFound


def read_bytes(path: str) -> bytes:
    fs, base = opened(path)
    with fs.open_input_stream(base) as f:
        return f.read()


def write_json(path: str, value) -> None:
    """Written beside the file and moved there, so a reader never sees half of it."""
    fs, base = opened(path)
    fs.create_dir(os.path.dirname(base), recursive=True)
    beside = f"{base}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False).encode("utf-8"))
    fs.move(beside, base)


def create_json(path: str, value) -> bool:
    """Makes a file that isn't there yet, whole or not at all; false if it is there.

    Locally a link to the finished file is made, which the system refuses where the name is taken; HDFS refuses such a move.
    On stores without either, the content is read back: the writer whose own isn't there has lost.
    """
    fs, base = opened(path)
    fs.create_dir(os.path.dirname(base), recursive=True)
    if exists(path):
        return False
    text, beside = json.dumps(value, indent=2, ensure_ascii=False).encode("utf-8"), f"{base}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(text)
    if fs.type_name == "local":
        try:
            os.link(beside, base)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete_file(beside)
    try:
        fs.move(beside, base)
    except OSError:
        if not exists(path):
            raise
        fs.delete_file(beside)
        return False
    return read_bytes(path) == text


def names(folder: str) -> list[str]:
    """Names of the entries of a folder; none where it isn't there."""
    from pyarrow.fs import FileSelector

    fs, base = opened(folder)
    return sorted(os.path.basename(i.path) for i in fs.get_file_info(FileSelector(base, allow_not_found=True)))


def delete_file(path: str) -> None:
    if exists(path):
        fs, base = opened(path)
        fs.delete_file(base)


def delete(path: str) -> None:
    if exists(path):
        fs, base = opened(path)
        fs.delete_dir(base)
