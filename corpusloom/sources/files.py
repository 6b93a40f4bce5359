"""Driver-side file helpers: hashes, fingerprints, text input and report bundles."""

from __future__ import annotations

import hashlib
import sys
import zipfile
from pathlib import Path


def sha256_file(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def fingerprint(folder: str, names: list[str] | None = None) -> str:
    """One hash of several files: their names, each ended by a null byte, and contents, in the order of the names."""
    base = Path(folder)
    chosen = sorted(names or [p.relative_to(base).as_posix() for p in base.rglob("*") if p.is_file()])
    digest = hashlib.sha256()
    for name in chosen:
        digest.update(name.encode() + b"\0")
        with (base / name).open("rb") as file:
            while piece := file.read(1 << 20):
                digest.update(piece)
    return digest.hexdigest()


def read_input_text(text: str | None = None, path: str | None = None) -> str:
    """The given text, else the file's, else standard input; blank input is an error."""
    found = text if text is not None else Path(path).read_text(encoding="utf-8") if path else sys.stdin.read()
    if not found.strip():
        raise ValueError("the input text is blank")
    return found.strip()


def bundle(folder: str, names: list[str], target: str) -> list[str]:
    """Those of the named files that are there, as a ZIP; returns their names."""
    there = [n for n in names if (Path(folder) / n).is_file()]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in there:
            archive.write(Path(folder) / name, name)
    return there


def unbundle(archive: str, names: list[str], folder: str) -> None:
    """The named members of a ZIP into a folder; all must be there."""
    with zipfile.ZipFile(archive) as source:
        missing = set(names) - set(source.namelist())
        if missing:
            raise FileNotFoundError(f"{archive} lacks {sorted(missing)}")
        for name in names:
            source.extract(name, folder)
