"""Files of the shared folder as Python tasks see them: any file system pyarrow can open by its URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def attempt_name(prefix: str, part: int, suffix: str) -> str:
    """A file name that no other attempt of the same task can have."""
    return f"{prefix}-{part:06d}-{uuid.uuid4().hex}{suffix}"
