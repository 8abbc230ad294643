"""Configuration files: TOML of bounded size, unknown fields rejected, values in range."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from gneiss.operators.classify import EXTENSIONS
from gneiss.sources.tree import ScanOptions

MOST_BYTES = 1 << 20
MOST_FILE_BYTES = 64 << 20


@dataclass
class OutputOptions:
    directory: str = "knowledge"
    locale: str = "en"


@dataclass
class VerifyOptions:
    minimum_coverage: float = 0.0
    strict: bool = False


@dataclass
class Config:
    schema: int = 1
    scan: ScanOptions = field(default_factory=ScanOptions)
    output: OutputOptions = field(default_factory=OutputOptions)
    verify: VerifyOptions = field(default_factory=VerifyOptions)


def _section(kind: type, values: dict, name: str):
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown field {name}.{unknown[0]}")
    return kind(**values)


def load_config(path: str) -> Config:
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError("configuration is too large")
    with open(path, "rb") as f:
        data = tomllib.load(f)
    kinds = {"scan": ScanOptions, "output": OutputOptions, "verify": VerifyOptions}
    if unknown := sorted(set(data) - {"schema", *kinds}):
        raise ValueError(f"unknown field {unknown[0]}")
    config = Config(data.get("schema", 1), **{k: _section(v, data.get(k, {}), k) for k, v in kinds.items()})
    if config.schema != 1:
        raise ValueError("unknown schema")
    if not 0 < config.scan.max_file_bytes <= MOST_FILE_BYTES:
        raise ValueError("scan.max_file_bytes is out of range")
    if unknown := sorted(set(config.scan.languages) - set(EXTENSIONS)):
        raise ValueError(f"unknown language {unknown[0]}")
    if config.output.locale not in ("en", "ja"):
        raise ValueError("unknown locale")
    if not 0 <= config.verify.minimum_coverage <= 1:
        raise ValueError("verify.minimum_coverage is out of range")
    return config
