"""Model manifest: local files of named models, with pinned checksums."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


REQUIRED = ("repo_id", "revision", "license", "local_dir")


@dataclass(frozen=True)
class Model:
    name: str
    folder: str
    license: str
    revision: str
    optional: bool
    files: tuple[tuple[str, str], ...]  # (relative path, sha256 or empty)

    @property
    def pinned(self) -> bool:
        """A revision is pinned if it is a full commit id, not a branch or a tag."""
        return re.fullmatch("[0-9a-f]{40}", self.revision) is not None


class Registry:
    """Models by name, read from one JSON file below ``root``; nothing is ever fetched."""

    def __init__(self, root: str, manifest: str = "manifest.lock"):
        self.root = root
        with open(os.path.join(root, manifest), encoding="utf-8") as f:
            told = json.load(f).get("models", {})
        lacking = {n: absent for n, m in told.items() if (absent := [k for k in REQUIRED if k not in m])}
        if lacking:
            raise ValueError(f"incomplete manifest: {lacking}")
        self._models = {
            n: Model(n, m["local_dir"], m["license"], m["revision"], bool(m.get("optional")), tuple((x["path"], x.get("sha256") or "") for x in m.get("files", ())))
            for n, m in told.items()
        }

    def __iter__(self) -> Iterator[Model]:
        yield from self._models.values()

    def __contains__(self, name: str) -> bool:
        return name in self._models

    def model(self, name: str) -> Model:
        if (m := self._models.get(name)) is None:
            raise KeyError(f"unknown model {name!r}; known: {', '.join(sorted(self._models))}")
        return m

    def _at(self, name: str, file: str = "") -> str:
        return os.path.join(self.root, self.model(name).folder, file)

    def fetched(self, name: str) -> bool:
        return all(os.path.exists(self._at(name, p)) for p in ("", *(p for p, _ in self.model(name).files)))

    def path(self, name: str) -> str:
        """The model's folder; raises where its files aren't there."""
        if not self.fetched(name):
            raise FileNotFoundError(f"{name} isn't below {self.root}")
        return self._at(name)

    def wrong_files(self, name: str) -> list[str]:
        """Files that are missing or whose content isn't what the manifest pins."""
        told = self.model(name).files
        return [p for p, want in told if not os.path.exists(self._at(name, p)) or want and _digest(self._at(name, p)) != want]

    def table(self, spark: SparkSession) -> DataFrame:
        """(model, license, optional, pinned) for the licence audit."""
        return spark.createDataFrame([(m.name, m.license, m.optional, m.pinned) for m in self], "model string, license string, optional boolean, pinned boolean")


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()
