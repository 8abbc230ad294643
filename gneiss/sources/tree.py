"""Source trees as a table: listing with ignore files, bounded reads, stable hashes.

Spark's own file sources drop names that begin with ``_`` or ``.`` and follow links, so
trees have a data source of their own. The listing runs on the driver; reading is dealt
over the executors, which must see the tree at the same path.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gneiss.operators.classify import EXTENSIONS, INTERNAL, MAX_FILE_BYTES

SCHEMA = "path string, size long, is_symlink boolean, is_file boolean, content binary, content_hash string"
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass
class ScanOptions:
    include_hidden: bool = False
    max_file_bytes: int = MAX_FILE_BYTES
    languages: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    excluded_roots: list[str] = field(default_factory=list)


class IgnoreRules:
    """Patterns of one ignore file, for paths relative to its folder; the last match decides."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            self.rules.append((keep, only_dirs, anchored, line.lstrip("/")))

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept after all, None: no rule matches."""
        out = None
        for keep, only_dirs, anchored, pattern in self.rules:
            if only_dirs and not is_dir:
                continue
            name = path if anchored else path.rsplit("/", 1)[-1]
            if _matches(name, pattern):
                out = not keep
        return out


def _matches(name: str, pattern: str) -> bool:
    if "**" not in pattern:
        parts, globs = name.split("/"), pattern.split("/")
        return len(parts) == len(globs) and all(fnmatch.fnmatchcase(p, g) for p, g in zip(parts, globs, strict=True))

    def walk(parts: list[str], globs: list[str]) -> bool:
        if not globs:
            return not parts
        if globs[0] == "**":
            return any(walk(parts[i:], globs[1:]) for i in range(len(parts) + 1))
        return bool(parts) and fnmatch.fnmatchcase(parts[0], globs[0]) and walk(parts[1:], globs[1:])

    return walk(name.split("/"), pattern.split("/"))


def list_files(root: str, options: ScanOptions | None = None) -> list[str]:
    """Sorted relative paths; links are listed but not followed, ignored folders are not entered."""
    options, found = options or ScanOptions(), []

    def walk(folder: str, rules: list[tuple[str, IgnoreRules]]) -> None:
        full = os.path.join(root, folder)
        names = sorted(os.listdir(full))
        for name in IGNORE_FILES:
            if name in names and os.path.isfile(os.path.join(full, name)):
                with open(os.path.join(full, name), encoding="utf-8", errors="replace") as f:
                    rules = [*rules, (folder, IgnoreRules(f.read()))]
        for name in names:
            path = f"{folder}/{name}" if folder else name
            if not options.include_hidden and name.startswith("."):
                continue
            if (not folder and name in INTERNAL) or any(path == x or path.startswith(x.rstrip("/") + "/") for x in options.excluded_roots):
                continue
            here = os.path.join(root, path)
            is_dir = os.path.isdir(here) and not os.path.islink(here)
            ignored = False
            for base, r in rules:
                said = r.decide(path[len(base) + 1 :] if base else path, is_dir)
                ignored = ignored if said is None else said
            if ignored:
                continue
            if is_dir:
                walk(path, rules)
            else:
                found.append(path)

    walk("", [])
    return sorted(found)


def read_file(root: str, path: str, most: int) -> tuple:
    """One row; a file that changes while it is read is an error, one above the bound is hashed in pieces."""
    full = os.path.join(root, path)
    before = os.lstat(full)
    if stat.S_ISLNK(before.st_mode):
        return path, before.st_size, True, False, None, ""
    if not stat.S_ISREG(before.st_mode):
        return path, before.st_size, False, False, None, ""
    digest, content = hashlib.sha256(), bytearray()
    with open(full, "rb") as f:
        while piece := f.read(1 << 16):
            digest.update(piece)
            if before.st_size <= most:
                content += piece
    after = os.lstat(full)
    if (before.st_ino, before.st_size, before.st_mtime_ns) != (after.st_ino, after.st_size, after.st_mtime_ns):
        raise OSError(f"{path} changed while it was read")
    return path, before.st_size, False, True, bytes(content) if before.st_size <= most else None, digest.hexdigest()


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str, most: int, hidden: bool, excluded: list[str], files: int):
        self.root, self.most, self.files = root, most, files
        self.options = ScanOptions(hidden, most, excluded_roots=excluded)

    def partitions(self) -> list[InputPartition]:
        paths = list_files(self.root, self.options)
        return [Paths(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [Paths([])]

    def read(self, partition: Paths):
        for path in partition.paths:
            yield read_file(self.root, path, self.most)


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        excluded = [x for x in o.get("excludedroots", "").split("\n") if x]
        return TreeReader(o["path"], int(o.get("maxfilebytes", MAX_FILE_BYTES)), o.get("includehidden", "false") == "true", excluded, int(o.get("filesperpartition", 256)))


def read_tree(spark: SparkSession, root: str, options: ScanOptions | None = None) -> DataFrame:
    options = options or ScanOptions()
    spark.dataSource.register(TreeSource)
    read = spark.read.format("source_tree").option("maxFileBytes", options.max_file_bytes).option("includeHidden", str(options.include_hidden).lower())
    return read.option("excludedRoots", "\n".join(options.excluded_roots)).load(root)
