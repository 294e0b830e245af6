"""Pages that were answered once are not asked for again: a log of answers by address, below a folder that all tasks share."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


def file_system(folder: str):
    """(file system, path) of an address with its scheme, for use inside tasks."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def put_down(folder: str, name: str, text: str) -> None:
    """One file, complete or not there: written under a hidden name, then renamed."""
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    hidden = f"{path}/_{uuid.uuid4().hex}"
    with files.open_output_stream(hidden) as f:
        f.write(text.encode())
    files.move(hidden, f"{path}/{name}")


@dataclass
class Logged:
    """A fetch that keeps each answer and gives kept ones without asking. Failures are not kept.

    Addresses carry all that an answer depends on (venue, dates, cursor); keys of
    APIs go in headers and are never written.
    """

    fetch: Callable[[str], dict[str, Any]]
    folder: str

    def __call__(self, url: str) -> dict[str, Any]:
        from pyarrow.fs import FileType

        digest = hashlib.sha256(url.encode()).hexdigest()
        folder, name = f"{self.folder}/{digest[:2]}", f"{digest}.json"
        files, path = file_system(folder)
        if files.get_file_info(f"{path}/{name}").type == FileType.File:
            with files.open_input_stream(f"{path}/{name}") as f:
                return json.loads(f.read())["answer"]
        answer = self.fetch(url)
        put_down(folder, name, json.dumps({"url": url, "answer": answer}, ensure_ascii=False))
        return answer
