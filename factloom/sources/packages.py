"""Packages: archives that carry a manifest and files, read without trusting either. Whatever is wrong with one is a row, never an error.

Files come as rows (path, content), as Spark's binaryFile source gives them from any store, so that a task holds one archive at a time.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import stat
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bounds of an archive: bytes, files, bytes of one unpacked and of all; what is beyond them is not unpacked.
ARCHIVE_BYTES, FILES, FILE_BYTES, TOTAL_BYTES = 256 << 20, 10_000, 64 << 20, 1 << 30
# Names inside an archive, and what each entry of the manifest says.
MANIFEST, FOLDER = "manifest.json", "files/"
LISTED = ("path", "size", "sha256")

ENTRY = T.StructType([T.StructField("package", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("issue", T.StringType()), T.StructField("content", T.BinaryType())])

#: Names that some systems take for devices.
_DEVICE = re.compile(r"(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\.|$)")


def path_issue(path: object) -> str | None:
    """Why a path cannot be trusted to stay below the folder that it is meant for, on any system."""
    if not isinstance(path, str) or not path:
        return "path_empty"
    parts = path.split("/")
    if path[0] == "/" or "\\" in path or ":" in parts[0]:
        return "path_absolute"
    if any(p in ("", ".", "..") for p in parts):
        return "path_climbs"
    if any(ord(c) < 32 or c in '<>"|?*:' for c in path) or any(p[-1] in ". " for p in parts) or any(_DEVICE.match(p.lower()) for p in parts):
        return "path_name"
    return None


def folded(path: str) -> str:
    """What two paths have in common that some system takes for one."""
    return unicodedata.normalize("NFKC", path).casefold()


class Repeated(ValueError):
    pass


def strict_json(raw: bytes) -> object:
    """JSON without repeated keys and without numbers that are none."""

    def pairs(found: list[tuple[str, object]]) -> dict:
        out = dict(found)
        if len(out) < len(found):
            names = [k for k, _ in found]
            raise Repeated(next(k for k in names if names.count(k) > 1))
        return out

    def refuse(x: str) -> None:
        raise ValueError(x)

    return json.loads(raw.decode("utf-8"), object_pairs_hook=pairs, parse_constant=refuse)


def _collisions(paths: list[str]) -> set[str]:
    """Paths that some system takes for another of the list, or for a folder of another."""
    by, out = {}, set()
    for p in paths:
        by.setdefault(folded(p), []).append(p)
    for low, same in by.items():
        if len(same) > 1:
            out |= set(same)
        parts = low.split("/")
        for k in range(1, len(parts)):
            above = "/".join(parts[:k])
            if above in by:
                out |= {*same, *by[above]}
    return out


def entries(raw: bytes | None) -> Iterator[tuple[str | None, int | None, str | None, str | None, bytes | None]]:
    """(path, size, sha256, issue, content) of a package: a row for each file that the manifest lists and for each that it does not; a row without a path for what concerns the whole."""
    if not raw or len(raw) > ARCHIVE_BYTES:
        yield None, None, None, "archive_empty" if not raw else "archive_size", None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from _read(z)
    except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, EOFError, UnicodeError, zlib.error, KeyError, OSError):
        yield None, None, None, "archive_corrupt", None


def _read(z: zipfile.ZipFile) -> Iterator[tuple]:
    found = z.infolist()
    if len(found) > FILES + 1:
        yield None, None, None, "file_count", None
        return
    names = [e.filename for e in found]
    clash = _collisions(names)
    bad = {}
    total = 0
    for e in found:
        mode = e.external_attr >> 16
        total += e.file_size
        issue = path_issue(e.filename) or ("path_collision" if e.filename in clash else None)
        if issue is None and (e.is_dir() or stat.S_IFMT(mode) not in (0, stat.S_IFREG)):
            issue = "not_a_file"
        if issue is None and (e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
            issue = "encoding"
        if issue is None and e.file_size > FILE_BYTES:
            issue = "file_size"
        if issue:
            bad[e.filename] = issue
    if total > TOTAL_BYTES:
        yield None, None, None, "total_size", None
        return
    if MANIFEST not in names or MANIFEST in bad:
        yield None, None, None, "manifest_missing", None
        return
    try:
        manifest = strict_json(z.read(MANIFEST))
    except Repeated:
        yield None, None, None, "manifest_repeated_key", None
        return
    except ValueError:
        yield None, None, None, "manifest_unreadable", None
        return
    listed = manifest.get("files") if isinstance(manifest, dict) else None
    if not isinstance(listed, list):
        yield None, None, None, "manifest_shape", None
        return
    wanted = [i["path"] for i in listed if isinstance(i, dict) and isinstance(i.get("path"), str)]
    clash, expected = _collisions(wanted), {MANIFEST}
    for item in listed:
        if not isinstance(item, dict) or set(item) != set(LISTED) or type(item["size"]) is not int or item["size"] < 0 or not re.fullmatch("[0-9a-f]{64}", str(item["sha256"])):
            yield (item.get("path") if isinstance(item, dict) and isinstance(item.get("path"), str) else None), None, None, "entry_shape", None
            continue
        path, size, digest = (item[k] for k in LISTED)
        name = f"{FOLDER}{path}"
        expected.add(name)
        issue = path_issue(path) or ("path_collision" if path in clash else None) or ("file_missing" if name not in names else bad.get(name))
        content = None
        if issue is None and z.getinfo(name).file_size != size:
            issue = "file_changed"
        if issue is None:
            content = z.read(name)
            if hashlib.sha256(content).hexdigest() != digest:
                issue, content = "file_changed", None
        yield path, size, digest, issue, content
    for name in dict.fromkeys(names):
        if name not in expected:
            yield name, None, None, bad.get(name, "unlisted"), None


def read(files: DataFrame) -> DataFrame:
    """(package, path, size, sha256, issue, content) of files (path, content): content where nothing is wrong with it. A null or broken archive is one row with an issue."""

    def each(batches):
        for pdf in batches:
            for package, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(package, *r) for r in entries(raw)]
                yield pd.DataFrame(rows, columns=ENTRY.names).astype({"size": "Int64"})

    return files.select("path", "content").mapInPandas(each, ENTRY)


def packed(files: dict[str, bytes], manifest: bytes | None = None, stored: dict[str, bytes] | None = None) -> bytes:
    """A package of files; manifest and stored files (by their names in the archive) in place of the right ones make broken ones. The same files give the same bytes."""
    out = io.BytesIO()
    if manifest is None:
        listed = [{"path": p, "size": len(x), "sha256": hashlib.sha256(x).hexdigest()} for p, x in sorted(files.items())]
        manifest = json.dumps({"files": listed}, sort_keys=True).encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, x in [*([(MANIFEST, manifest)] if manifest else []), *sorted((stored if stored is not None else {f"{FOLDER}{p}": x for p, x in files.items()}).items())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), x, zipfile.ZIP_DEFLATED)
    return out.getvalue()
