"""Scans that outlast a session: relations written as Parquet, read back and compared, with fingerprints that tell when to start anew."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import changes
from gneiss.plans.scan import Ir
from gneiss.sources.config import Config

#: Raised when relations or the rules that make them change.
SCHEMA, EXTRACTOR = 1, "gneiss-1"
RELATIONS = [f.name for f in dataclasses.fields(Ir)]
#: What orders each relation.
KEYS = {"files": ["path"], "evidence": ["id"], "entities": ["id"], "imports": ["path", "specifier", "evidence_id"], "relationships": ["id"], "references": ["ref_id"], "claims": ["id"], "coverage": ["id"]}


def fingerprint(ir: Ir) -> str:
    """A digest of all relations, whatever their order and partitioning."""
    one = {name: changes.digest(getattr(ir, name), sorted(getattr(ir, name).columns)).first()["fingerprint"] for name in RELATIONS}
    return hashlib.sha256(json.dumps(one, sort_keys=True).encode()).hexdigest()


def config_fingerprint(config: Config) -> str:
    """A digest of what decides a scan's facts: prose and thresholds do not."""
    return hashlib.sha256(json.dumps(dataclasses.asdict(config.scan), sort_keys=True).encode()).hexdigest()


def needs_rebuild(old: dict, config: Config) -> bool:
    """Whether a state of another schema, extractor or configuration must be made anew."""
    return (old.get("schema"), old.get("extractor"), old.get("config")) != (SCHEMA, EXTRACTOR, config_fingerprint(config))


def in_order(ir: Ir, name: str) -> DataFrame:
    """A relation in its canonical order; what the key leaves open is ordered by all other columns."""
    df = getattr(ir, name)
    return df.orderBy(*KEYS[name], *[c for c in sorted(df.columns) if c not in KEYS[name]])


def differences(a: Ir, b: Ir) -> DataFrame:
    """(relation, side, n): rows that one of two scans has more often than the other; no row means that they are equal."""
    out = None
    for name in RELATIONS:
        x, y = getattr(a, name), getattr(b, name)
        columns = sorted(x.columns)
        one = changes.bag_difference(x.select(*columns), y.select(*columns)).groupBy("side").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "side", "n")
        out = one if out is None else out.unionByName(one)
    return out


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_state(ir: Ir, folder: str, config: Config) -> dict:
    """Write all relations into a new version of ``folder``, read them back, compare, and only then point to that version."""
    spark = ir.files.sparkSession
    told = {"schema": SCHEMA, "extractor": EXTRACTOR, "config": config_fingerprint(config), "fingerprint": fingerprint(ir)}
    version = f"{folder.rstrip('/')}/{told['fingerprint'][:16]}"
    for name in RELATIONS:
        getattr(ir, name).write.mode("overwrite").parquet(f"{version}/{name}")
    if differences(ir, _relations(spark, version)).limit(1).count():
        raise ValueError("relations differ from what was read back")
    told["version"] = version.rsplit("/", 1)[-1]
    system, pointer = _file(spark, f"{folder.rstrip('/')}/state.json")
    stream = system.create(pointer, True)
    stream.write(bytearray(json.dumps(told, sort_keys=True).encode()))
    stream.close()
    return told


def _relations(spark: SparkSession, version: str) -> Ir:
    return Ir(**{name: spark.read.parquet(f"{version}/{name}") for name in RELATIONS})


def read_state(spark: SparkSession, folder: str) -> tuple[Ir, dict] | None:
    """The last version written, and its manifest; none if there is none."""
    path = f"{folder.rstrip('/')}/state.json"
    system, pointer = _file(spark, path)
    if not system.exists(pointer):
        return None
    told = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    return _relations(spark, f"{folder.rstrip('/')}/{told['version']}"), told


def summary(ir: Ir) -> str:
    """One line about a scan."""
    n = {name: getattr(ir, name).count() for name in ("files", "entities", "imports")}
    return f"scanned {n['files']} files, {n['entities']} entities, {n['imports']} imports"


def unresolved(ir: Ir) -> DataFrame:
    """(kind, subject, reason) of all items that count against coverage."""
    return ir.coverage.where("disposition = 'unresolved'").select("kind", "subject", "reason").orderBy("kind", "subject")


def classification(ir: Ir) -> DataFrame:
    """(id, classification, reason): how documents show coverage items; only exclusions keep their reason."""
    return ir.coverage.select("id", F.col("disposition").alias("classification"), F.when(F.col("disposition") == "excluded", F.col("reason")).alias("reason"))


def inventory(ir: Ir) -> DataFrame:
    """(kind, id): entities, relationships and resolved references that a projection accounts for, each once."""
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")).distinct()
    return part(ir.entities, "entity", "id").unionByName(part(ir.relationships, "relationship", "id")).unionByName(part(ir.references.where("status = 'resolved'"), "resolved_reference", "ref_id"))
