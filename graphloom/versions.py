"""Versioned values: a folder of small files, one for each version, each made once and never changed.

A version is committed by making its file, which fails where another writer has made it first. So of two writers that
start from one version one wins, and the other learns of it; nobody overwrites what they haven't seen.
"""

from __future__ import annotations

import json
import re

from . import files


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class VersionLog:
    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:12]) for n in files.names(self.folder) if re.fullmatch(r"\d{12}\.json", n))

    def read(self, version: int):
        return json.loads(files.read_bytes(self._path(version)))

    def latest(self) -> tuple[int, dict | None]:
        """The highest version and its value; 0 and nothing where there is none."""
        for _ in range(5):
            every = self.versions()
            if not every:
                return 0, None
            try:
                return every[-1], self.read(every[-1])
            except FileNotFoundError:  # cleaned up meanwhile, as newer ones came
                continue
        raise Conflict(f"{self.folder} changes too fast to be read")

    def commit(self, version: int, value) -> None:
        """Makes this version, or raises Conflict if it is there; versions follow each other without gaps."""
        last = max(self.versions(), default=0)
        if version != last + 1 or not files.create_json(self._path(version), value):
            raise Conflict(f"version {version} of {self.folder} can't be made; the last one is {max(self.versions(), default=0)}")

    def forget(self, version: int) -> None:
        """Takes off a version that is not the last."""
        if version != max(self.versions(), default=0):
            files.delete_file(self._path(version))
