"""Files in the shared folder, written and read by tasks through Arrow's file systems.

A file is written under a name of its attempt and then renamed, so a repeated or lost
task leaves either the whole file or none; a repeat writes the same bytes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import NativeFile, fs


@contextlib.contextmanager
def written(uri: str) -> Iterator[NativeFile]:
    """A stream whose bytes appear at ``uri`` when the block ends well."""
    system, path = fs.FileSystem.from_uri(_uri(uri))
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def opened(uri: str) -> NativeFile:
    system, path = fs.FileSystem.from_uri(_uri(uri))
    return system.open_input_file(path)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def exists(path: str) -> bool:
    system, at = fs.FileSystem.from_uri(_uri(path))
    return system.get_file_info(at).type != fs.FileType.NotFound


def folders(path: str, marked: bool = False) -> list[str]:
    """Names of the folders in a folder, sorted (with ``marked`` those that a finished job has marked); none if it isn't there."""
    system, at = fs.FileSystem.from_uri(_uri(path))
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
    return [n for n in names if system.get_file_info(f"{at}/{n}/_SUCCESS").type == fs.FileType.File] if marked else names


def remove(path: str) -> None:
    """Deletes a folder of the shared folder, if it is there; a path without scheme is local."""
    system, at = fs.FileSystem.from_uri(_uri(path))
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)
