"""ZIP archives of packets: packing with a checksum beside, and extraction that trusts no name in the archive.

Archives are how packets leave or enter the cluster; they are files of the driver's machine.
"""

from __future__ import annotations

import hashlib
import shutil
import zipfile
from collections import Counter
from pathlib import Path, PurePosixPath


def checksum(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def pack(folder: str, archive: str) -> str:
    """All files of a folder in name order, with fixed times, so equal folders give equal archives; the SHA-256 goes
    into a file beside the archive and is returned."""
    root, target = Path(folder), Path(archive)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(p for p in root.rglob("*") if p.is_file()):
            entry = zipfile.ZipInfo(f.relative_to(root).as_posix())
            entry.compress_type = zipfile.ZIP_DEFLATED
            with open(f, "rb") as source, z.open(entry, "w") as to:
                shutil.copyfileobj(source, to)
    digest = checksum(target)
    Path(f"{target}.sha256").write_text(f"{digest}  {target.name}\n")
    return digest


def problems(archive: str, expected: dict[str, str] | None = None) -> list[str]:
    """What forbids extraction: a wrong checksum beside the archive, names that leave the target folder or come twice,
    damaged members, and, given the SHA-256 of the expected files, any other set or content."""
    path, found = Path(archive), []
    beside = Path(f"{path}.sha256")
    if beside.exists() and beside.read_text().split()[:1] != [checksum(path)]:
        found.append("the archive does not have the checksum beside it")
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        found += [f"{n} comes {k} times" for n, k in Counter(names).items() if k > 1]
        for n in names:
            parts = PurePosixPath(n)
            if parts.is_absolute() or ".." in parts.parts or set(n) & set("\\:\0"):
                found.append(f"{n!r} is no plain relative name")
        if found:
            return found
        if (bad := z.testzip()) is not None:
            return [f"{bad} is damaged"]
        if expected is not None:
            held = {n for n in names if not n.endswith("/")}
            found += [f"{n} is not expected" for n in sorted(held - expected.keys())] + [f"{n} is missing" for n in sorted(expected.keys() - held)]
            for n in sorted(held & expected.keys()):
                with z.open(n) as f:
                    if hashlib.file_digest(f, "sha256").hexdigest() != expected[n]:
                        found.append(f"{n} has another content")
    return found


def extract(archive: str, folder: str, expected: dict[str, str] | None = None) -> None:
    """Extracts into a new folder, which appears only when complete; anything that problems() finds raises a ValueError."""
    target = Path(folder)
    if target.exists():
        raise FileExistsError(folder)
    if found := problems(archive, expected):
        raise ValueError("; ".join(found[:5]))
    temporary = target.with_name(f"{target.name}.partial")
    shutil.rmtree(temporary, ignore_errors=True)
    with zipfile.ZipFile(archive) as z:
        z.extractall(temporary)
    temporary.rename(target)
