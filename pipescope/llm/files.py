"""Byte files in the shared folder, reached from tasks through Arrow's file systems (file, hdfs, s3, ...)."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; Hadoop writes `file:/x` where a URI would be `file:///x`."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def create_folder(uri: str) -> None:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)


def open_output(uri: str):
    system, path = file_system(uri)
    return system.open_output_stream(path, compression=None)  # else a name in .gz has Arrow compress it


def open_input(uri: str):
    system, path = file_system(uri)
    return system.open_input_file(path)


def listing(uri: str) -> list[str]:
    """Names of the files in a folder, sorted."""
    system, path = file_system(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(x.base_name for x in found if x.type == fs.FileType.File)


def remove(uri: str) -> None:
    system, path = file_system(uri)
    system.delete_file(path)


def size(uri: str) -> int:
    system, path = file_system(uri)
    return system.get_file_info(path).size
