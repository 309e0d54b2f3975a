"""Files by URI: file systems, existence, removal and small side inputs."""

from __future__ import annotations

import functools
import json
import re
from typing import Any


@functools.cache
def _system(scheme: str, host: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def open_store(uri: str):
    """File system and plain path of a URI or path: local, and what the installed connectors read; r2 goes by the s3 connector."""
    from pyarrow import fs

    found = re.match(r"^([a-z0-9]+)://([^/]*)(.*)$", str(uri))
    if not found:
        return fs.LocalFileSystem(), str(uri).removeprefix("file:")
    scheme, host, rest = found.groups()
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    scheme = {"r2": "s3", "s3a": "s3", "gs": "gs"}.get(scheme, scheme)
    return _system(scheme, host), (host + rest if scheme in ("s3", "gs") else rest)


def exists(path: str) -> bool:
    """Whether there is such a file or folder."""
    from pyarrow import fs

    store, at = open_store(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def rm(path: str, recursive: bool = False, maxdepth: int | None = None) -> None:
    """Delete a file, or a folder if recursive; with maxdepth only files so many levels down (1: those right in it).

    What does not exist gives FileNotFoundError, a folder without recursive IsADirectoryError.
    """
    from pyarrow import fs

    store, at = open_store(path)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == fs.FileType.File:
        store.delete_file(at)
    elif not recursive:
        raise IsADirectoryError(f"{path} is a folder; set recursive")
    elif maxdepth is None:
        store.delete_dir(at)
    else:
        base = at.rstrip("/").count("/")
        for info in store.get_file_info(fs.FileSelector(at, recursive=True)):
            if info.type == fs.FileType.File and info.path.count("/") - base <= maxdepth:
                store.delete_file(info.path)


def read_text(path: str) -> str:
    """A small text file, whole, as UTF-8."""
    store, at = open_store(path)
    with store.open_input_stream(at) as f:
        return f.read().decode()


def read_yaml(path: str) -> Any:
    """A small YAML file; an empty or malformed one gives a ValueError that names it."""
    import yaml

    try:
        found = yaml.safe_load(read_text(path))
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is no YAML: {e}") from e
    if found is None:
        raise ValueError(f"{path} is empty")
    return found


def read_json(path: str) -> Any:
    """A small JSON file; an empty or malformed one gives a ValueError that names it."""
    text = read_text(path)
    if not text.strip():
        raise ValueError(f"{path} is empty")
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
