"""Documents and reviews."""

import os

from gneiss import catalogue
from gneiss.operators import documents
from gneiss.plans import review, scan


def test_front_matter_and_links(spark):
    text = "---\ntitle: x\n---\nSee [a](one.md) and `[b](no.md)`.\n```\n[c](no.md)\n```\n    [d](no.md)\n[e]: <two.md>\nNote[^n1].\n"
    df = spark.createDataFrame([(1, text), (2, "no front matter"), (3, "---\r\na: 1\r\n---\r\nrest")], "id long, text string")
    got = {r.id: (r.f, r.b) for r in df.select("id", documents.front_matter(df.text).alias("f"), documents.body(df.text).alias("b")).collect()}
    assert got[1][0] == "title: x" and got[2] == ("", "no front matter") and got[3] == ("a: 1", "rest")
    assert sorted(r.target for r in documents.links(df, "id", "text").collect()) == ["one.md", "two.md"]
    assert [r.id for r in documents.footnotes(df.withColumnRenamed("id", "key"), "key", "text").collect()] == ["n1"]


def test_path_problems(spark):
    want = {"": "empty", "/a": "absolute", "C:x": "absolute", "a/../b": "unsafe", "a.": "unsafe", "a//b": "unsafe", 'a"b': "unsafe", "x/CON.md": "reserved", "index": "reserved", "ok/file.md": None}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.x for r in df.select("p", documents.path_problem(df.p).alias("x")).collect()} == want


def test_review(spark, tmp_path):
    with open(os.path.join(tmp_path, "m.py"), "w") as f:
        f.write("def a():\n    return b()\n\n\ndef b():\n    return 1\n\n\ndef c():\n    return 2\n")
    ir = scan.scan(spark, str(tmp_path))
    asked = review.request(ir)
    assert all(r.complete for r in asked["scope"].where("relation = 'entities'").collect()) and asked["entities"].count() == 4
    known = ir.evidence.first().id
    claims = spark.createDataFrame([("1", "fine", [known]), ("2", "", [known]), ("3", "x", []), ("4", "x", ["nope"]), ("5", "x", [known, known]), ("5", "y", [known])], "id string, text string, evidence_ids array<string>")
    assert {(r.code, r.subject) for r in review.check_claims(claims, ir.evidence).collect()} == {("empty-claim", "2"), ("claim-without-evidence", "3"), ("unknown-evidence", "4"), ("repeated-citation", "5"), ("duplicate-claim", "5")}
    ids = {r.name: r.id for r in ir.entities.collect()}
    call = ir.relationships.where("kind = 'calls'").first().id
    good = ("g", "Pair", [ids["a"], ids["b"]], [call])
    rows = [good, ("h", "Apart", [ids["c"], "nope"], []), ("i", "Empty", [], ["made-up"]), ("k", "Shares", [ids["a"]], [call])]
    concepts = spark.createDataFrame(rows, "id string, title string, member_ids array<string>, edge_ids array<string>")
    found = {(r.code, r.subject) for r in review.check_concepts(concepts, ir).collect()}
    assert found == {("unknown-member", "h"), ("concept-not-connected", "h"), ("concept-without-members", "i"), ("unsupported-edge", "i"), ("shared-member", ids["a"]), ("edge-outside-concept", "k")}
    assert review.check_concepts(concepts.where("id = 'g'"), ir).count() == 0
    done = review.accept_concepts(concepts.where("id = 'g'"), ir).first()
    assert done.status == "draft" and len(done.evidence_ids) == 1 and done.id.startswith("concept:")
    old = spark.createDataFrame([("d", "t", [known], None, "verified"), ("p", "t", [known], "earlier", "draft")], "id string, text string, evidence_ids array<string>, provider string, status string")
    kept = review.accept_claims(old, claims.where("id = '1'"), "someone").collect()
    assert {r.provider for r in kept} == {None, "someone"} and all(r.status == "draft" for r in kept if r.provider)


def test_url_normalize_folds_parent_parts(spark, tmp_path):
    paths = ["/a/b", "/a/../b", "/a/./b//c/../../d", "/../a", "/a/../../b", "/a/b/..", "/a/../", ""]
    spark.createDataFrame([(i, f"http://x.example{p}?q=/../#f") for i, p in enumerate(paths)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))

    def fold(path):
        out = []
        for x in path.split("/"):
            if x == ".." and not out:
                return None
            out = out[:-1] if x == ".." else out + [x] * (x not in ("", "."))
        return "/".join(out)

    got = {r.page_id: (r.host, r.path) for r in catalogue.queries()["url_normalize"](spark, str(tmp_path)).collect()}
    assert got == {i: ("x.example", fold(p)) for i, p in enumerate(paths)}


def test_agent_responses_are_decoded_strictly():
    import json

    from gneiss.plans import agent

    good = {"claims": [{"text": "t", "evidence_ids": ["e"]}], "concepts": []}
    assert agent.decode(json.dumps(good)) == (good, [])
    bad = {
        "{": "invalid-json",
        "[]": "not-an-object",
        '{"claims": [], "concepts": [], "more": 1}': "unknown-field",
        '{"claims": []}': "missing-field",
        '{"claims": {}, "concepts": []}': "wrong-type",
        '{"claims": [1], "concepts": []}': "wrong-type",
        '{"claims": [{"text": "t", "evidence_ids": [1]}], "concepts": []}': "wrong-type",
        '{"claims": [{"text": "t", "evidence_ids": [], "status": "verified"}], "concepts": []}': "unknown-field",
        '{"claims": [], "concepts": [{"title": "t", "member_ids": []}]}': "missing-field",
    }
    for text, code in bad.items():
        response, issues = agent.decode(text)
        assert [x[0] for x in issues] == [code] and response == {"claims": [], "concepts": []}


def test_agent_programs_are_bounded(tmp_path):
    import sys

    import pytest

    from gneiss.plans import agent

    run = lambda code, **more: agent.run_program([sys.executable, "-c", code], "hello", str(tmp_path), **more)
    assert run("import sys; print(sys.stdin.read().upper(), end='')") == "HELLO"
    for code, more, said in (("import time; time.sleep(9)", {"seconds": 1}, "took more"), ("print('x' * 99)", {"most": 50}, "wrote more"), ("import sys; sys.exit('bad luck')", {}, "bad luck"), ("", {"seconds": 0}, "out of range")):
        with pytest.raises(ValueError, match=said):
            run(code, **more)
    ready = agent.Probe("a", "/bin/a", None, True, True, True, True)
    other = agent.Probe("b", "/bin/b", True, True, True, True, True)
    unsafe = agent.Probe("c", "/bin/c", True, True, True, False, True)
    assert agent.choose([unsafe, ready, other]) is ready and agent.choose([ready, other], exclude="a") is other and agent.choose([ready, other], "b") is other
    assert agent.choose([unsafe], "c") is None and agent.choose([ready], "off") is None and agent.choose([agent.Probe("d", None)]) is None


def test_agent_loop_repairs_and_gives_up(spark, tmp_path):
    import json

    from gneiss.plans import agent

    with open(os.path.join(tmp_path, "m.py"), "w") as f:
        f.write("import os\n\n\ndef a():\n    return b()\n\n\ndef b():\n    return os.getcwd()\n")
    ir = scan.scan(spark, str(tmp_path))
    ids, known = {r.name: r.id for r in ir.entities.collect()}, ir.evidence.first().id
    call = ir.relationships.where("kind = 'calls'").first()
    good = {"claims": [{"text": "fine", "evidence_ids": [known]}], "concepts": [{"title": "Pair", "member_ids": [ids["a"], ids["b"]], "edge_ids": [call.id]}]}
    wrong = {"claims": [{"text": "fine", "evidence_ids": ["nope"]}], "concepts": [{"title": "Pair", "member_ids": [ids["a"]], "edge_ids": ["made-up"]}]}
    asked = []

    def ask(request, issues):
        asked.append(issues)
        return ["not json", json.dumps(wrong), json.dumps(good)][min(len(asked) - 1, 2)]

    done = agent.enrich(ir, ask, "someone", 2)
    assert done.accepted and done.attempts == 3 and [[c for c, _ in x] for x in asked] == [[], ["invalid-json"], ["edge-not-supplied", "unknown-evidence", "unsupported-edge"]] and done.repaired == 4
    assert [(r.provider, r.status) for r in done.claims.collect()] == [("someone", "draft")] and done.concepts.first().status == "draft"
    asked.clear()
    failed = agent.enrich(ir, ask, "someone", 1)
    assert not failed.accepted and failed.attempts == 2 and failed.claims is None and ("unknown-evidence", "claims[0]") in failed.issues
    ref = {r.status: r.ref_id for r in ir.references.collect()}
    contains = ir.relationships.where("kind = 'contains'").first().id
    rows = spark.createDataFrame([(x,) for x in (call.id, call.reference_id, contains, "nope", ref["unresolved"])], "id string")
    assert {r.asked: (r.edge_id, r.problem) for r in agent.edge_lookup(rows, ir).collect()} == {call.id: (call.id, None), call.reference_id: (call.id, None), contains: (None, "not-semantic"), "nope": (None, "unknown"), ref["unresolved"]: (None, "unresolved")}
    required = spark.createDataFrame([("x", ["b", "a", "c"]), ("y", ["a"]), ("z", ["q"])], "id string, evidence_ids array<string>")
    cited = spark.createDataFrame([("x", ["a"]), ("y", ["a", "b"])], "id string, evidence_ids array<string>")
    assert {r.id: r.missing for r in agent.missing_citations(required, cited).collect()} == {"x": ["b", "c"], "z": ["q"]}
