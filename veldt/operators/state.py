"""Manifests, ledgers and the small relational store (R1 to R5, B1 to B9)."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.plans.model import hash_file, hash_params


def stage_manifest(stage: str, inputs: list[str], params: dict, version: str) -> dict:
    """What a stage was made from: file sizes, times and hashes, a hash of the parameters, the tool's version."""
    files = [{"path": p, "size": os.path.getsize(p), "mtime": os.path.getmtime(p), "sha256": hash_file(p)} for p in sorted(inputs)]
    return {"stage": stage, "version": version, "params_sha256": hash_params(params), "inputs": files}


def is_current(manifest: dict | None, stage: str, inputs: list[str], params: dict, version: str) -> bool:
    """Whether the manifest still holds: equal size and time are trusted, otherwise the hash decides."""
    if not manifest or manifest["stage"] != stage or manifest["version"] != version or manifest["params_sha256"] != hash_params(params):
        return False
    known = {f["path"]: f for f in manifest["inputs"]}
    if set(known) != set(inputs) or not all(map(os.path.exists, inputs)):
        return False
    return all((os.path.getsize(p) == f["size"] and os.path.getmtime(p) == f["mtime"]) or hash_file(p) == f["sha256"] for p, f in known.items())


def cached(df: DataFrame, folder: str, params: dict) -> DataFrame:
    """An intermediate table by the hash of its parameters: read if it is there, else written first."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{hash_params(params)}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def decision_manifest(experiment: str, spec: dict, decisions: list[dict], parent: str | None = None) -> dict:
    body = {"experiment_id": experiment, "spec_sha256": hash_params(spec), "decisions": decisions, "parent": parent}
    return body | {"manifest_sha256": hash_params(body)}


def verify_manifest(manifest: dict) -> bool:
    return hash_params({k: v for k, v in manifest.items() if k != "manifest_sha256"}) == manifest.get("manifest_sha256")


def changed_fields(a: dict, b: dict) -> list[str]:
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def fork_index(log: DataFrame) -> DataFrame:
    """An append log (experiment, seq, spec) with each spec's index by first appearance, whether the row replays an earlier one, and its kind."""
    from veldt.functions.order import first_seen_index

    out = first_seen_index(log, "spec", "seq", ["experiment"])
    first = F.row_number().over(Window.partitionBy("experiment", "spec").orderBy("seq")) == 1
    return out.withColumn("replay", ~first).withColumn("kind", F.when(F.col("replay"), "replay").when(F.col("index") == 0, "primary").otherwise("post_hoc_fork"))


def registry_problems(contracts: list[dict]) -> list[str]:
    """Script contracts without a name, a version or outputs, and names given twice."""
    seen, out = set(), []
    for c in contracts:
        name = c.get("script_path")
        out += [f"{name}: no {k}" for k in ("script_path", "contract_version", "success_outputs") if not c.get(k)]
        out += [f"{name}: registered twice"] if name in seen else []
        seen.add(name)
    return out


def capsule(files: dict[str, str]) -> dict:
    """A capsule's list of contents with hashes, under a hash of its own."""
    body = {"files": {k: hash_file(p) for k, p in sorted(files.items())}}
    return body | {"capsule_sha256": hash_params(body)}


def verify_capsule(manifest: dict, files: dict[str, str]) -> list[str]:
    now = {k: hash_file(p) if os.path.exists(p) else None for k, p in files.items()}
    bad = [f"{k}: {'missing' if now.get(k) is None else 'changed'}" for k, v in manifest["files"].items() if now.get(k) != v]
    return bad + ([] if hash_params({"files": manifest["files"]}) == manifest["capsule_sha256"] else ["the list itself was changed"])


def research_crate(run: dict, inputs: list[dict], outputs: list[str], claims: list[dict]) -> dict:
    """A run as RO-Crate 1.1: run (version, commit, ended, seeds), inputs (path, sha256, bytes, format), names of outputs, claims (id, text, tier, card, node). Claims
    without id are left out; a speculative one, by its tier or by a node of the scheme hypothesis, is refused: a crate holds audited claims only."""
    loose = [c.get("id") for c in claims if str(c.get("tier", "")).upper() == "SPECULATIVE" or str(c.get("node", "")).startswith("hypothesis://")]
    if loose:
        raise ValueError(f"speculative claims: {loose}")

    def ref(name: str) -> dict:
        return {"@id": name}

    sources = [{"@id": x["path"], "@type": "File", "sha256": x.get("sha256"), "contentSize": x.get("bytes"), "encodingFormat": x.get("format")} for x in inputs]
    products = [{"@id": name, "@type": "File"} for name in outputs]
    files = [ref(f["@id"]) for f in sources + products]
    about = [{"@id": f"#claim-{c['id']}", "@type": "Claim", "text": c.get("text"), "claimTier": c.get("tier"), "evidenceCard": c.get("card"), "ledgerNode": c.get("node"), "isPartOf": ref("./")} for c in claims if c.get("id")]
    action = {"@id": "#run", "@type": "CreateAction", "instrument": ref("#engine"), "endTime": run.get("ended"), "gitCommit": run.get("commit"), "seeds": run.get("seeds", {}), "object": files[: len(sources)], "result": files[len(sources) :]}
    graph = [
        {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "conformsTo": ref("https://w3id.org/ro/crate/1.1"), "about": ref("./")},
        {"@id": "./", "@type": "Dataset", "datePublished": run.get("ended"), "hasPart": files, "mentions": [ref("#run")] + [ref(c["@id"]) for c in about]},
        {"@id": "#engine", "@type": "SoftwareApplication", "name": "veldt", "version": run.get("version")},
        action,
    ]
    return {"@context": "https://w3id.org/ro/crate/1.1/context", "@graph": graph + sources + products + about}


# the store: parquet tables by key, a new version of a table for each write

SCHEMAS = {
    "wings": ("id", "id string, name string, organism string, genome string, status string, created_at string"),
    "halls": ("id", "id string, wing_id string, modality string, created_at string"),
    "rooms": ("id", "id string, hall_id string, analysis string, created_at string"),
    "findings": ("id", "id string, room_id string, content string, confidence double, is_stale boolean, valid_until string, created_at string"),
    "tunnels": ("id", "id string, wing_id string, from_hall string, to_hall string, entity string, description string, confidence double, created_at string"),
    "decisions": ("id", "id string, wing_id string, checkpoint string, question string, decision string, rationale string, made_by string, made_at string"),
}


class Store:
    """Six tables, each a folder of versions; the newest complete one counts. A write reads the last version, replaces rows by key and writes the next: readers never
    see half a write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, table: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(str(s.getPath()) for s in fs.listStatus(p) if fs.exists(path(s.getPath(), "_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        found = self._versions(table)
        schema = SCHEMAS[table][1]
        return self.spark.read.schema(schema).parquet(found[-1]) if found else self.spark.createDataFrame([], schema)

    def upsert(self, table: str, *rows: dict) -> None:
        key, schema = SCHEMAS[table]
        names = [f.name for f in T._parse_datatype_string(schema).fields]
        now = datetime.now(timezone.utc).isoformat()
        new = [tuple(r.get(n, now if n in ("created_at", "made_at") else False if n == "is_stale" else None) for n in names) for r in rows]
        fresh = self.spark.createDataFrame(new, schema)
        merged = self.read(table).join(fresh.select(key), key, "left_anti").select(*names).unionByName(fresh)
        merged.write.parquet(f"{self.folder}/{table}/{len(self._versions(table)):08d}-{uuid.uuid4().hex[:8]}")

    def invalidate(self, finding_id: str, until: str | None = None) -> None:
        row = self.read("findings").where(F.col("id") == finding_id).first()
        if row:
            self.upsert("findings", row.asDict() | {"is_stale": True, "valid_until": until or datetime.now(timezone.utc).isoformat()})

    def active_findings(self, room_id: str | None = None) -> DataFrame:
        df = self.read("findings").where(~F.coalesce("is_stale", F.lit(False)))
        return df if room_id is None else df.where(F.col("room_id") == room_id)

    def tunnels_of(self, entity: str) -> DataFrame:
        return self.read("tunnels").where(F.lower("entity") == entity.lower())

    def decisions_of(self, wing_id: str) -> DataFrame:
        return self.read("decisions").where(F.col("wing_id") == wing_id).orderBy("made_at", "id")

    def startup_context(self, n: int = 5) -> DataFrame:
        return self.read("wings").orderBy(F.desc("created_at"), F.desc("id")).limit(n)

    def similar_decisions(self, words: list[str], n: int = 5) -> DataFrame:
        """Approved decisions by the number of words that their question shares."""
        tokens = F.split(F.lower("question"), r"[^a-z0-9]+")
        score = F.size(F.array_intersect(tokens, F.array(*(F.lit(w.lower()) for w in words))))
        return self.read("decisions").where(F.lower("decision").rlike("^(approve|accept|yes)")).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("made_at"), "id").limit(n)

    def snapshot(self, wing_id: str) -> dict[str, DataFrame]:
        """All rows under a wing, by semi joins from the top down."""
        wings = self.read("wings").where(F.col("id") == wing_id)
        halls = self.read("halls").join(wings.select(F.col("id").alias("wing_id")), "wing_id", "left_semi")
        rooms = self.read("rooms").join(halls.select(F.col("id").alias("hall_id")), "hall_id", "left_semi")
        findings = self.read("findings").join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
        under = lambda t: self.read(t).join(wings.select(F.col("id").alias("wing_id")), "wing_id", "left_semi")
        return {"wings": wings, "halls": halls, "rooms": rooms, "findings": findings, "tunnels": under("tunnels"), "decisions": under("decisions")}

    def dangling(self) -> DataFrame:
        """Rows whose parent is not there: table, id."""
        from functools import reduce

        pairs = [("halls", "wing_id", "wings"), ("rooms", "hall_id", "halls"), ("findings", "room_id", "rooms"), ("tunnels", "wing_id", "wings"), ("decisions", "wing_id", "wings")]
        return reduce(DataFrame.union, (self.read(t).join(self.read(p).select(F.col("id").alias(c)), c, "left_anti").select(F.lit(t).alias("table"), "id") for t, c, p in pairs))

    def migrate_checkpoints(self) -> DataFrame:
        """Decisions with their checkpoint as text, whatever type an older table gave it."""
        return self.read("decisions").withColumn("checkpoint", F.col("checkpoint").cast("string"))


class Script:
    """A function from parameters to a result under a contract: inputs are checked, the status is added, an exception becomes an error result."""

    registry: dict[str, Script] = {}

    def __init__(self, name: str, fn, version: str, inputs: dict[str, bool], outputs: tuple[str, ...]):
        self.name, self.fn, self.version, self.inputs, self.outputs = name, fn, version, inputs, outputs
        Script.registry[name] = self

    def __call__(self, params: dict) -> dict:
        if missing := [k for k, required in self.inputs.items() if required and params.get(k) is None]:
            return {"status": "error", "error": f"missing inputs {missing}"}
        try:
            out = dict(self.fn(params))
        except Exception as e:  # what a script raises is its result
            return {"status": "error", "error": f"{type(e).__name__}: {e}"}
        out.setdefault("status", "success")
        if out["status"] == "success" and (lacking := [k for k in self.outputs if k not in out]):
            return {"status": "error", "error": f"missing outputs {lacking}"}
        return out


def write_json(path: str, payload: dict) -> None:
    """Whole or not at all: written beside, synced, then renamed; NaN becomes null."""
    from veldt.functions.scalars import json_safe_value

    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "w") as f:
        json.dump(json_safe_value(payload), f, default=str, allow_nan=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
