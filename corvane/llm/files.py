"""Files in a shared folder, written and read by tasks through the folder's own file system."""

from __future__ import annotations

import uuid

from ..sources.files import open_store

__all__ = ["fresh_name", "open_store"]


def fresh_name(folder: str, stem: str, suffix: str) -> str:
    """A name of its own for each attempt of a task; the manifest names the attempt that counts."""
    return f"{folder}/{stem}-{uuid.uuid4().hex[:10]}{suffix}"
