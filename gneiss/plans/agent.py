"""A reviewer in the loop: a bounded request goes out, the response is decoded strictly, checked, sent back with its issues, or accepted as drafts."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.plans import review
from gneiss.plans.scan import Ir

#: Runs at most, seconds of a run by default and at most, and bytes of its output.
MOST_RUNS, SECONDS, MOST_SECONDS, MOST_BYTES = 6, 600, 3600, 16 << 20

#: What a response holds: its lists, and the fields of their entries, all needed and no others allowed.
RESPONSE = {"claims": {"text": str, "evidence_ids": list}, "concepts": {"title": str, "member_ids": list, "edge_ids": list}}


def decode(text: str) -> tuple[dict[str, list[dict]], list[tuple[str, str]]]:
    """A response and what is wrong with its form: (code, place). Nothing is guessed or dropped: with an issue the response is empty."""
    empty = {k: [] for k in RESPONSE}
    try:
        data = json.loads(text)
    except ValueError as error:
        return empty, [("invalid-json", str(error))]
    if not isinstance(data, dict):
        return empty, [("not-an-object", "response")]
    issues = [("unknown-field", k) for k in sorted(set(data) - set(RESPONSE))] + [("missing-field", k) for k in RESPONSE if k not in data]
    for name, fields in RESPONSE.items():
        rows = data.get(name, [])
        if not isinstance(rows, list):
            issues.append(("wrong-type", name))
            continue
        for i, row in enumerate(rows):
            place = f"{name}[{i}]"
            if not isinstance(row, dict):
                issues.append(("wrong-type", place))
                continue
            issues += [("unknown-field", f"{place}.{k}") for k in sorted(set(row) - set(fields))]
            for k, kind in fields.items():
                if k not in row:
                    issues.append(("missing-field", f"{place}.{k}"))
                elif not isinstance(row[k], kind) or (kind is list and not all(isinstance(x, str) for x in row[k])):
                    issues.append(("wrong-type", f"{place}.{k}"))
    return (empty if issues else data), issues


def tables(ir: Ir, response: dict[str, list[dict]]) -> tuple[DataFrame, DataFrame]:
    """Claims and concepts of a response, named by their place in it."""
    spark = ir.files.sparkSession
    claims = [(f"claims[{i}]", x["text"], x["evidence_ids"]) for i, x in enumerate(response["claims"])]
    concepts = [(f"concepts[{i}]", x["title"], x["member_ids"], x["edge_ids"]) for i, x in enumerate(response["concepts"])]
    return spark.createDataFrame(claims, "id string, text string, evidence_ids array<string>"), spark.createDataFrame(concepts, "id string, title string, member_ids array<string>, edge_ids array<string>")


def edge_lookup(asked: DataFrame, ir: Ir) -> DataFrame:
    """(asked, edge_id, problem): each id, of an edge or of a reference, with the semantic edge that it means, or why there is none."""
    edges = ir.relationships.select(F.col("id").alias("asked"), F.col("id").alias("_own"), F.col("reference_id").alias("_from"))
    made = ir.relationships.where("reference_id IS NOT NULL").groupBy(F.col("reference_id").alias("asked")).agg(F.min("id").alias("_made"))
    refs = ir.references.select(F.col("ref_id").alias("asked"), F.col("status").alias("_status"))
    rows = asked.select(F.col(asked.columns[0]).alias("asked")).distinct().join(edges, "asked", "left").join(refs, "asked", "left").join(made, "asked", "left")
    problem = (
        F.when(F.col("_own").isNotNull(), F.when(F.col("_from").isNull(), "not-semantic"))
        .when(F.col("_status").isNull(), "unknown")
        .when(F.col("_status") != "resolved", F.col("_status"))
        .when(F.col("_made").isNull(), "missing-relationship")
    )
    return rows.select("asked", F.when(problem.isNull(), F.coalesce("_own", "_made")).alias("edge_id"), problem.alias("problem"))


def missing_citations(required: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, missing): evidence that an entry (id, evidence_ids) must cite and does not."""
    named = cited.select("id", F.col("evidence_ids").alias("_cited"))
    left = F.array_sort(F.array_except("evidence_ids", F.coalesce("_cited", F.array().cast("array<string>"))))
    return required.join(named, "id", "left").select("id", left.alias("missing")).where(F.size("missing") > 0)


@dataclass
class Outcome:
    """What came of a review."""

    accepted: bool
    attempts: int
    repaired: int
    issues: list[tuple[str, str]] = field(default_factory=list)
    claims: DataFrame | None = None
    concepts: DataFrame | None = None


def enrich(ir: Ir, ask: Callable[[dict[str, DataFrame], list[tuple[str, str]]], str], provider: str, most_repairs: int = 1) -> Outcome:
    """Ask until a response has no issue, with those of the last one sent back, at most ``most_repairs`` + 1 and ``MOST_RUNS`` times.

    Only evidence and edges of the request may be cited. What is accepted is a draft of ``provider``.
    """
    request, issues, repaired = review.request(ir), [], 0
    attempts = min(most_repairs + 1, MOST_RUNS)
    for attempt in range(1, attempts + 1):
        response, issues = decode(ask(request, issues))
        if not issues:
            claims, concepts = tables(ir, response)
            supplied = request["relationships"].where("kind <> 'contains'").select(F.col("id").alias("edge"))
            outside = concepts.select("id", F.explode("edge_ids").alias("edge")).join(supplied, "edge", "left_anti").select(F.lit("edge-not-supplied").alias("code"), F.col("id").alias("subject"))
            found = review.check_claims(claims, request["evidence"]).unionByName(review.check_concepts(concepts, ir)).unionByName(outside).distinct()
            issues = [(r.code, r.subject) for r in found.orderBy("code", "subject").limit(1024).collect()]
        if not issues:
            nothing = ir.files.sparkSession.createDataFrame([], "id string, text string, evidence_ids array<string>, provider string, status string")
            return Outcome(True, attempt, repaired, [], review.accept_claims(nothing, claims, provider), review.accept_concepts(concepts, ir))
        repaired += len(issues)
    return Outcome(False, attempts, repaired, issues)


def run_program(command: list[str], text: str, folder: str, seconds: int = SECONDS, most: int = MOST_BYTES) -> str:
    """What a program writes for a text, without a shell; ValueError if it fails, takes too long, or writes too much."""
    if not 0 < seconds <= MOST_SECONDS:
        raise ValueError("seconds are out of range")
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        try:
            done = subprocess.run(command, input=text.encode(), stdout=out, stderr=err, cwd=folder, timeout=seconds, check=False)
        except subprocess.TimeoutExpired as error:
            raise ValueError(f"{command[0]} took more than {seconds} s") from error
        if max(out.tell(), err.tell()) > most:
            raise ValueError(f"{command[0]} wrote more than {most} bytes")
        if done.returncode:
            err.seek(max(0, err.tell() - 2000))
            raise ValueError(f"{command[0]} ended with {done.returncode}: {err.read().decode('utf-8', 'replace').strip()}")
        out.seek(0)
        return out.read().decode()


@dataclass
class Probe:
    """What is known of a reviewing program."""

    name: str
    executable: str | None
    signed_in: bool | None = None
    batch: bool = False
    schema: bool = False
    read_only: bool = False
    closed: bool = False

    def safe(self) -> bool:
        """It is there, signed in as far as known, takes a batch and a schema, and can neither write nor reach elsewhere."""
        return bool(self.executable) and self.signed_in is not False and self.batch and self.schema and self.read_only and self.closed


def choose(probes: list[Probe], wanted: str = "auto", exclude: str | None = None) -> Probe | None:
    """The wanted program if it is safe, or the first safe one; none with ``off``."""
    fit = [p for p in probes if p.safe() and p.name != exclude and wanted in ("auto", p.name)]
    return fit[0] if fit and wanted != "off" else None
