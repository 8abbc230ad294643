"""Claims and concepts proposed from outside: bounded requests, validation, acceptance.

What a reviewer, human or program, may see is bounded; what comes back is checked row by row and never
counts as verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.ids import stable_id
from gneiss.operators import graph, rollup
from gneiss.plans.scan import Ir

#: Rows of a request, and rows, members and lengths of a response.
MOST_ENTITIES, MOST_REFERENCES, MOST_EDGES, MOST_EVIDENCE = 2048, 4096, 4096, 512
MOST_CLAIMS, MOST_CITED, MOST_CONCEPTS, MOST_MEMBERS, MOST_TEXT = 512, 32, 64, 64, 4000


def request(ir: Ir) -> dict[str, DataFrame]:
    """An owner-closed, bounded part of a scan, with how much of each relation it has."""
    entities = rollup.top_k(ir.entities, ["id"], MOST_ENTITIES)
    entities = graph.owner_closed(entities, entities.select("id"))
    ids = entities.select("id")
    inside = lambda t, c: t.join(ids.withColumnRenamed("id", c), c, "left_semi")
    refs = rollup.top_k(inside(inside(ir.references.where("status = 'resolved'"), "scope_id"), "target"), ["ref_id"], MOST_REFERENCES)
    edges = inside(inside(ir.relationships, "source"), "target")
    edges = edges.where("reference_id IS NULL").unionByName(edges.join(refs.select(F.col("ref_id").alias("reference_id")), "reference_id", "left_semi").select(*edges.columns))
    edges = rollup.top_k(edges, ["id"], MOST_EDGES)
    out = {"entities": entities, "references": refs, "relationships": edges, "evidence": rollup.top_k(ir.evidence, ["path", "start_line", "end_line", "id"], MOST_EVIDENCE)}
    size = lambda t, name, kind: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), F.lit(kind).alias("of"), "n")
    scope = None
    for name, t in out.items():
        one = size(t, name, "supplied").unionByName(size(getattr(ir, name), name, "total"))
        scope = one if scope is None else scope.unionByName(one)
    return out | {"scope": scope.groupBy("relation").pivot("of", ["supplied", "total"]).agg(F.first("n")).withColumn("complete", F.col("supplied") == F.col("total"))}


def _issue(rows: DataFrame, code: str, subject: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), subject.alias("subject"))


def check_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(code, subject) of every rule that proposed claims (id, text, evidence_ids) break."""
    cited = claims.select("id", F.explode("evidence_ids").alias("evidence_id"))
    unknown = cited.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")
    n = F.size("evidence_ids")
    out = _issue(claims.groupBy("id").count().where("count > 1"), "duplicate-claim", F.col("id"))
    for rows, code in (
        (claims.where((F.trim("text") == "") | F.col("text").isNull()), "empty-claim"),
        (claims.where(F.length("text") > MOST_TEXT), "claim-too-long"),
        (claims.where(n == 0), "claim-without-evidence"),
        (claims.where(n > MOST_CITED), "too-many-citations"),
        (claims.where(F.size(F.array_distinct("evidence_ids")) < n), "repeated-citation"),
        (unknown, "unknown-evidence"),
    ):
        out = out.unionByName(_issue(rows, code, F.col("id")))
    total = claims.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_CLAIMS)
    return out.unionByName(_issue(total, "too-many-claims", F.col("n").cast("string"))).distinct()


def check_concepts(concepts: DataFrame, ir: Ir) -> DataFrame:
    """(code, subject) of every rule that proposed concepts (id, title, member_ids, edge_ids) break."""
    members = concepts.select("id", F.explode("member_ids").alias("member"))
    unknown = members.join(ir.entities.select(F.col("id").alias("member")), "member", "left_anti")
    shared = graph.overlapping(members, "id", "member")
    support = concepts.select("id", F.explode("edge_ids").alias("edge"))
    semantic = ir.relationships.where("kind <> 'contains'").select(F.col("id").alias("edge"), "source", "target")
    invented = support.join(semantic, "edge", "left_anti")
    ends = support.join(semantic, "edge")
    side = lambda c: members.select("id", F.col("member").alias(c))
    outside = ends.join(side("source"), ["id", "source"], "left_anti").select("id").union(ends.join(side("target"), ["id", "target"], "left_anti").select("id")).distinct()
    # nodes named by concept, so that one run finds the components of all of them
    node = lambda c: F.concat_ws("\x1f", "id", c)
    found = graph.components(ends.select(node("source").alias("a"), node("target").alias("b")))
    placed = members.withColumn("node", node("member")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("id").agg(F.countDistinct("root").alias("n")).where("n > 1")
    out = _issue(concepts.groupBy("id").count().where("count > 1"), "duplicate-concept", F.col("id"))
    for rows, code, subject in (
        (concepts.where(F.size("member_ids") == 0), "concept-without-members", "id"),
        (concepts.where(F.size("member_ids") > MOST_MEMBERS), "too-many-members", "id"),
        (unknown, "unknown-member", "id"),
        (shared, "shared-member", "member"),
        (invented, "unsupported-edge", "id"),
        (outside, "edge-outside-concept", "id"),
        (apart, "concept-not-connected", "id"),
    ):
        out = out.unionByName(_issue(rows, code, F.col(subject)))
    total = concepts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_CONCEPTS)
    return out.unionByName(_issue(total, "too-many-concepts", F.col("n").cast("string"))).distinct()


def accept_claims(old: DataFrame, proposed: DataFrame, provider: str) -> DataFrame:
    """Deterministic claims stay, earlier proposals of any provider go, valid new ones are stamped."""
    stamped = proposed.select(stable_id("claim", F.lit("proposed"), F.lit(provider), F.col("text")).alias("id"), "text", "evidence_ids", F.lit(provider).alias("provider"), F.lit("draft").alias("status")).dropDuplicates(["id"])
    return old.where("provider IS NULL").unionByName(stamped)


def accept_concepts(proposed: DataFrame, ir: Ir) -> DataFrame:
    """Concepts with sorted members and edges, an id from both, and their edges' evidence; always drafts."""
    lists = proposed.select("title", F.array_sort(F.array_distinct("member_ids")).alias("member_ids"), F.array_sort(F.array_distinct("edge_ids")).alias("edge_ids"))
    lists = lists.withColumn("id", stable_id("concept", F.col("title"), F.array_join("member_ids", ","), F.array_join("edge_ids", ",")))
    proof = lists.select("id", F.explode("edge_ids").alias("edge")).join(ir.relationships.select(F.col("id").alias("edge"), "evidence_id"), "edge")
    proof = proof.groupBy("id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return lists.join(proof, "id", "left").withColumn("status", F.lit("draft"))
