"""Binary files that tasks write to and read from the shared folder, on any file system."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A file that appears under its name when whole; a repeated task replaces it by the same."""
    fs, path = _fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(draft) as out:
            yield out
        fs.move(draft, path)
    except BaseException:
        try:
            fs.delete_file(draft)
        except OSError:
            pass
        raise


def opened(uri: str):
    """A seekable file."""
    fs, path = _fs(uri)
    return fs.open_input_file(path)
