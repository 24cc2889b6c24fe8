"""Driver profiles: inheritance and fragments, checklists as rows, and how far a driver meets them.

A profile is a JSON object; `extends` names its parent, `fragments` further parts. Lists of a parent
come before those of a fragment, and these before the profile's own; plain values are overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import quality

#: Keys whose lists are joined; checklists keep repeated entries, the others do not.
LISTS = ("source_review_steps", "required_manual_checks", "recommended_tools", "sequence_topics", "caution_topics", "evidence_topics")


def read(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Profiles or fragments of a folder of JSON files, by name."""
    import json

    files = spark.read.option("wholetext", True).text(f"{folder}/*.json").collect()  # settings, not data
    found = [json.loads(r.value) for r in files]
    return {p.get("profile") or p.get("fragment"): p for p in found}


def _joined(base: dict, more: dict) -> dict:
    out = {**base, **{k: v for k, v in more.items() if k not in ("checklist", *LISTS)}}
    out["checklist"] = [*base.get("checklist", ()), *more.get("checklist", ())]
    for k in LISTS:
        out[k] = list(dict.fromkeys(x.strip() for x in (*base.get(k, ()), *more.get(k, ())) if x and x.strip()))
    return out


def resolve(name: str, profiles: dict[str, dict], fragments: dict[str, dict]) -> dict:
    """The profile with all it inherits; a cycle or a missing part is an error."""
    chain, at = [], name
    while at:
        if at in chain:
            raise ValueError(f"profiles extend each other: {' -> '.join([*chain, at])}")
        if at not in profiles:
            raise ValueError(f"no such profile: {at}")
        chain.append(at)
        at = profiles[at].get("extends")
    out: dict = {}
    used: list[str] = []
    for own in reversed([profiles[c] for c in chain]):
        for f in own.get("fragments", ()):
            if f not in used:
                if f not in fragments:
                    raise ValueError(f"no such fragment: {f}")
                out = _joined(out, {k: v for k, v in fragments[f].items() if k in ("checklist", *LISTS)})
                used.append(f)
        out = _joined(out, own)
    return out | {"profile": name, "stack": chain[::-1], "fragments": used}


def checklist(spark: SparkSession, profile: dict) -> DataFrame:
    """Rows (req_id, area, item) of a profile's checklist; ids are A{area}.{item}."""
    rows = [(f"A{i}.{j}", part.get("area", ""), item) for i, part in enumerate(profile.get("checklist", ()), 1) for j, item in enumerate(part.get("items", ()), 1)]
    return spark.createDataFrame(rows, "req_id string, area string, item string")


def compare(items: DataFrame, evidence: DataFrame, lacking: DataFrame) -> DataFrame:
    """Requirements (req_id, area, item) against evidence and admitted gaps (both ev_id, text): one status each.

    A requirement that an admitted gap covers by 70 % or more is missing, whatever the evidence.
    """
    wanted = items.select("req_id", F.col("item").alias("text"))
    best = quality.requirements(wanted, evidence).select("req_id", "coverage", "status")
    gaps = quality.requirements(wanted, lacking).select("req_id", F.col("coverage").alias("gap"))
    met = items.join(best, "req_id", "left").join(gaps, "req_id", "left").fillna(0, ["coverage", "gap"]).fillna("missing_or_not_reported", ["status"])
    return met.select("req_id", "area", "item", "coverage", F.when(F.col("gap") >= 70, "missing").otherwise(F.col("status")).alias("status"))


def completeness(compared: DataFrame) -> DataFrame:
    """Per area: requirements, how many seem implemented, and that share in whole per cent."""
    done = F.count_if(F.col("status") == "implemented_candidate")
    return compared.groupBy("area").agg(F.count("*").alias("requirements"), done.alias("implemented"), F.floor(done * 100.0 / F.count("*") + 0.5).alias("percent"))
