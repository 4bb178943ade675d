"""Files that tasks write and read themselves, on the file systems that a cluster names by URI."""

from __future__ import annotations

import uuid

from veriframe.sources.files import filesystem


class AtomicFile:
    """A file that appears under its name once it is whole, so a repeated task replaces its own file."""

    def __init__(self, path: str):
        self.fs, self.final = filesystem(path)
        self.fs.create_dir(self.final.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.final}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)
