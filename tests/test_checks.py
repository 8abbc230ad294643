"""Checks of documents, excerpts of evidence, written states, and the command line."""

import datetime
import hashlib
import json
import os
import urllib.parse

from pyspark.sql import functions as F

from gneiss import __main__ as cli
from gneiss.operators import checks, excerpts
from gneiss.plans import scan, state
from gneiss.sources.config import Config, OutputOptions
from gneiss.sources.tree import ScanOptions


def found(df):
    return sorted((r.code, r.severity, r.document) for r in df.collect())


def test_links(spark):
    docs = spark.createDataFrame([("index.md",), ("a/one.md",), ("a/b/index.md",), ("a/two words.md",), ("pic.png",)], "document string")
    fine = ["one.md", "one", "b", "./b/../one.md#part", "/index", "/", "two%20words.md", "../pic.png", "http://x.example/y", "mailto:a@b", "#top", "//host/x", "?q", "b\\index.md"]
    broken = ["none.md", "../index.html", "b/one", "two+words.md"]
    escapes = ["../../x.md", "/../x", "%2e%2e/%2E%2E/y"]
    links = spark.createDataFrame([("a/one.md", x) for x in fine + broken + escapes], "document string, target string")
    assert found(checks.link_issues(links.where(F.col("target").isin(fine)), docs)) == []
    assert found(checks.link_issues(links, docs)) == [("broken-link", "warning", "a/one.md")] * len(broken) + [("path-traversal", "error", "a/one.md")] * len(escapes)
    assert {x[1] for x in found(checks.link_issues(links.where("target = 'none.md'"), docs, "error"))} == {"error"}
    texts = ["a%20b+c", "100%", "%zz", "é%C3%A9", "a%2Fb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(checks.percent_decoded(F.col("t")).alias("d")).collect()] == [urllib.parse.unquote(t) for t in texts]


def test_resources(spark):
    evidence = spark.createDataFrame([("e1", "src/a b.py", 7), ("e2", "src/c.py", None)], "id string, path string, line long")
    rows = [("ok", "repo:src/a%20b.py#L7", "e1"), ("also", "repo:src\\c.py", "e2"), ("other", "http://x", "e1"), ("path", "repo:src/x.py#L7", "e1"), ("line", "repo:src/a%20b.py#L8", "e1"), ("none", "repo:src/a%20b.py", "e1"), ("odd", "repo:src/a%20b.py#7", "e1")]
    got = found(checks.resource_issues(spark.createDataFrame(rows, "document string, resource string, evidence_id string"), evidence))
    assert got == [("evidence-line-mismatch", "error", "line"), ("evidence-line-mismatch", "error", "none"), ("evidence-line-mismatch", "error", "odd"), ("evidence-resource-mismatch", "error", "path")]


def test_dates_and_locales(spark):
    day = datetime.date
    docs = spark.createDataFrame([("old", day(2024, 1, 1), None, None, "en"), ("today", day(2024, 5, 1), day(2024, 2, 1), day(2024, 1, 1), "ja"), ("new", day(2024, 5, 2), day(2024, 1, 1), day(2024, 1, 1), "xx"), ("never", None, None, None, None)], "document string, stale_after date, window_from date, window_to date, locale string")
    today = F.lit("2024-05-01").cast("date")
    assert found(checks.stale_issues(docs, today)) == [("stale-document", "warning", "old"), ("stale-document", "warning", "today")]
    sources = spark.createDataFrame([("old", 3, None, None), ("new", 3, None, None), ("never", None, None, None), ("never", 2, day(2024, 3, 1), day(2024, 2, 1))], "document string, usage_count long, window_from date, window_to date")
    assert found(checks.usage_issues(docs, sources)) == [("invalid-usage-window", "error", "never"), ("invalid-usage-window", "error", "today"), ("usage-count-without-window", "warning", "old")]
    assert found(checks.locale_issues(docs)) == [("invalid-output-locale", "error", "new")]
    assert found(checks.locale_issues(docs, "en")) == [("invalid-output-locale", "error", "new"), ("missing-output-locale", "error", "never"), ("missing-output-locale", "error", "new"), ("output-locale-mismatch", "error", "today")]
    logs = spark.createDataFrame([("good.md", "# Log\n## 2024-02-29\ntext\n### x\n"), ("bad.md", "## 2023-02-29\n## soon\n"), ("matter.md", "---\na: 1\n---\n## 2024-01-01\n")], "document string, text string")
    assert found(checks.log_issues(logs)) == [("invalid-log-date", "error", "bad.md"), ("invalid-log-date", "error", "bad.md"), ("log-frontmatter", "error", "matter.md")]


def test_predicates(spark):
    names = {"human:ann": (True, True), "process: build": (True, True), "human: ": (False, False), "tool/1.2": (True, False), "tool/": (False, False), "/1": (False, False), "someone": (False, False)}
    df = spark.createDataFrame([(x,) for x in names], "a string")
    assert {r.a: (r.i, r.v) for r in df.select("a", checks.names_identity(df.a).alias("i"), checks.is_independent(df.a).alias("v")).collect()} == names
    texts = {"plain": (False, True), "a\nb": (True, False), "tab\t": (True, False), "a.b:c-1_": (False, True), "sp ace": (False, False), "": (False, False)}
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert {r.t: (r.b, r.f) for r in df.select("t", checks.has_break_or_control(df.t).alias("b"), checks.is_footnote_id(df.t).alias("f")).collect()} == texts


def excerpts_by_hand(spans, files, most, each, total, sources):
    out, seen, used, at = [], 0, 0, (None, None)
    for i, path, a, b, h in sorted(spans, key=lambda x: (x[1], x[2], x[3], x[0]))[:most]:
        content, own = files[path]
        if own != h:
            continue
        if at[0] != path:
            at = (path, len(content) <= sources - seen)
            seen += len(content) if at[1] else 0
        if not at[1] or a > b or b > len(content) or used >= total:
            continue
        end = min(b, a + min(each, total - used))
        while end > a and content[a:end].decode("utf-8", "replace").count("\ufffd"):
            end -= 1
        cut = content[a:end].decode()
        used += len(cut.encode())
        out.append((i, cut, len(cut.encode()) < b - a))
    return out


def test_excerpts_match_plain_budgets(spark):
    import hashlib

    files = {f"f{i}": ("äöü line é " * (5 + i)).encode() for i in range(6)}
    held = {p: (c, hashlib.sha256(c).hexdigest()) for p, c in files.items()}
    spans = [(f"e{i}{a}", p, a, b, held[p][1] if i != 3 else "changed") for i, p in enumerate(files) for a, b in ((0, 11), (2, 40), (14, 15), (30, 500), (0, len(files[p])))]
    evidence = spark.createDataFrame([(i, p, 1, 1, a, b, h) for i, p, a, b, h in spans], "id string, path string, start_line long, end_line long, start_byte long, end_byte long, content_hash string")
    table = spark.createDataFrame([(p, bytearray(c), h) for p, (c, h) in held.items()], "path string, content binary, content_hash string")
    for most, each, total, sources in ((100, 1000, 10_000, 10_000), (100, 33, 150, 10_000), (9, 20, 90, 10_000), (100, 50, 10_000, 260)):
        got = [(r.evidence_id, r.text, r.truncated) for r in excerpts.excerpts(evidence, table, most, each, total, sources).collect()]
        assert got and got == excerpts_by_hand(spans, held, most, each, total, sources)


TREE = {"m.py": "def a():\n    return b()\n\n\ndef b():\n    return gone()\n", "notes.md": "# Notes\n", "data.txt": "x"}


def write(root, files):
    for path, text in files.items():
        with open(os.path.join(root, path), "w") as f:
            f.write(text)


def test_state_round_trip(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    write(root, TREE)
    ir, folder, config = scan.scan(spark, str(root)), f"file://{tmp_path}/state", Config()
    assert state.read_state(spark, folder) is None
    told = state.write_state(ir, folder, config)
    back, again = state.read_state(spark, folder)
    assert again == told and state.differences(ir, back).count() == 0 and state.fingerprint(back) == told["fingerprint"]
    assert not state.needs_rebuild(told, config) and state.needs_rebuild(told, Config(scan=ScanOptions(include_hidden=True))) and state.needs_rebuild(told | {"schema": 0}, config)
    assert not state.needs_rebuild(told, Config(output=OutputOptions(locale="ja")))
    assert [r.id for r in state.in_order(ir, "entities").collect()] == sorted(r.id for r in ir.entities.collect())
    write(root, {"notes.md": "# Other\n"})
    other = scan.scan(spark, str(root))
    assert {r.relation for r in state.differences(ir, other).collect()} >= {"files", "evidence", "entities", "claims"} and state.fingerprint(other) != told["fingerprint"]
    assert state.summary(ir).startswith("scanned 3 files, ")
    assert [(r.kind, r.subject) for r in state.unresolved(ir).collect()] == [("file", "data.txt")]
    assert {r.classification for r in state.classification(ir).collect()} == {"included", "unresolved"}
    kinds = {r.kind: r["count"] for r in state.inventory(ir).groupBy("kind").count().collect()}
    assert kinds["entity"] == ir.entities.count() and kinds["resolved_reference"] == 1


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    root.mkdir()
    write(root, TREE)
    call = lambda *a: cli.main([*a], spark)
    said = lambda: capsys.readouterr().out
    assert call("nonsense") == 2 and call("init", str(root)) == 0 and call("init", str(root)) == 1
    said()
    assert call("scan", str(root)) == 0 and said().startswith("scanned 4 files")
    assert call("coverage", str(root)) == 0
    counts = json.loads(said())
    assert counts["unresolved"] == 2 and {"data.txt", "gneiss.toml"} == {x["subject"] for x in counts["unresolved_items"]}
    assert call("compile", str(root)) == 0 and call("verify", str(root)) == 0
    assert json.loads(said().splitlines()[-1])["valid"]
    write(root, {"notes.md": "# Other\n", "new.md": "# New\n"})
    assert call("verify", str(root)) == 1
    assert "stale-document" in {x["code"] for x in json.loads(said().splitlines()[-1])["issues"]}
    assert call("update", str(root)) == 0
    assert json.loads(said().splitlines()[-1]) == {"added": 1, "modified": 1, "unchanged": 3}
    assert call("verify", str(root)) == 0 and call("doctor", str(root)) == 0
    assert call("scan", str(root), "--config", str(tmp_path / "missing.toml")) == 1


def test_contents_behind_excerpts_are_not_shuffled(spark):
    files = spark.createDataFrame([(f"f{i}", f"line {i}\n", hashlib.sha256(f"line {i}\n".encode()).hexdigest()) for i in range(5)], "path string, content string, content_hash string").repartition(3)
    spans = files.select(F.col("path").alias("id"), "path", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.lit(0).cast("long").alias("start_byte"), F.lit(4).cast("long").alias("end_byte"), "content_hash")
    df = excerpts.excerpts(spans, files, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Coalesce" not in plan
    assert sorted((r.evidence_id, r.text) for r in df.collect()) == [("f0", "line"), ("f1", "line")]
