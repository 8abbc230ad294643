"""Nothing outside the subpackage of corpus operators imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for path in (ROOT / "gneiss").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "gneiss").parts:
            assert not re.search(r"gneiss\.llm|from gneiss import llm", path.read_text()), path
