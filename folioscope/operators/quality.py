"""Evidence logs, artifact graphs, health, golden facts, requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.rules import ARTIFACT_NEEDS
from folioscope.functions.text import comparable, half_up, normalize_for_search, tokens

#: Severity of a status, worst last.
SEVERITY = {"ok": 0, "stale": 1, "missing": 2, "broken": 3}


def latest(log: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """The last state of each entry of an append-only log, and how many states it had."""
    order = F.struct(by, *columns)
    return log.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in columns), F.count("*").alias("states"))


def queue(entries: DataFrame, status: str, at: str, ranks: dict[str, int], k: int, keys: list[str]) -> DataFrame:
    """The k entries to look at first: by status rank, the newest first."""
    rank = F.coalesce(*(F.when(F.col(status) == s, F.lit(r)) for s, r in ranks.items()), F.lit(len(ranks)))
    return entries.withColumn("rank", rank).orderBy("rank", F.desc(at), *keys).limit(k)


def needs(spark: SparkSession) -> DataFrame:
    """The artifact graph as edges (artifact, needs)."""
    rows = ", ".join(f"('{a}', '{n}')" for a, ns in ARTIFACT_NEEDS.items() for n in ns)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(artifact, needs)")


def descendants(spark: SparkSession, seeds: list[str]) -> DataFrame:
    """All artifacts that follow, directly or not, from the seeds: by a recursive query over the graph."""
    needs(spark).createOrReplaceTempView("folioscope_needs")
    start = ", ".join(f"('{s}', 0)" for s in seeds)
    sql = f"""WITH RECURSIVE reach(artifact, depth) AS (
      SELECT * FROM VALUES {start} AS t(artifact, depth)
      UNION ALL SELECT n.artifact, r.depth + 1 FROM folioscope_needs n JOIN reach r ON n.needs = r.artifact WHERE r.depth < {len(ARTIFACT_NEEDS)})
    SELECT artifact, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY artifact"""
    found = spark.sql(sql)
    return found.where(~F.col("artifact").isin(*seeds))


def health(artifacts: DataFrame) -> DataFrame:
    """The worst status of the required artifacts (filename, artifact, status, required) of each file."""
    severity = F.coalesce(*(F.when(F.col("status") == s, F.lit(v)) for s, v in SEVERITY.items()), F.lit(3))
    out = artifacts.where("required").groupBy("filename").agg(F.max(severity).alias("severity"), F.count("*").alias("artifacts"))
    return out.withColumn("health", F.coalesce(*(F.when(F.col("severity") == v, F.lit(s)) for s, v in SEVERITY.items())))


def golden(facts: DataFrame, entries: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each expected fact against the entry found for it: missing, differs or passes."""
    met = facts.join(entries.select(*keys, *(F.col(c).alias(f"got_{c}") for c in columns), F.lit(True).alias("there")), keys, "left")
    same = F.lit(True)
    for c in columns:
        same = same & (comparable(F.col(c)) == comparable(F.col(f"got_{c}")))
    return met.withColumn("result", F.when(F.col("there").isNull(), "missing").when(same, "pass").otherwise("fail")).drop("there", *(f"got_{c}" for c in columns))


def requirements(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Best evidence for each requirement (req_id, text) among rows (ev_id, text): by the share of its tokens found.

    Requirements meet evidence through a common token, not as all pairs.
    """
    need = wanted.select("req_id", F.array_distinct(tokens(F.col("text"))).alias("need")).where(F.size("need") > 0)
    token = need.select("req_id", F.size("need").alias("n"), F.explode("need").alias("token"))
    have = evidence.select("ev_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    score = token.join(have, "token").groupBy("req_id", "n", "ev_id").agg(F.count("*").alias("hits")).withColumn("coverage", half_up(F.col("hits") * 100.0 / F.col("n")).cast("int"))
    best = score.groupBy("req_id").agg(F.max(F.struct("coverage", (-F.col("ev_id")).alias("back"))).alias("b"))
    out = need.select("req_id").join(best, "req_id", "left").select("req_id", F.coalesce("b.coverage", F.lit(0)).alias("coverage"), (-F.col("b.back")).alias("ev_id"))
    return out.withColumn("status", F.when(F.col("coverage") >= 60, "implemented_candidate").when(F.col("coverage") >= 35, "unclear").otherwise("missing_or_not_reported"))


def assertions(outputs: DataFrame, must: list[str], must_not: list[str], least: int) -> DataFrame:
    """Eval checks on texts (case_id, text): what they must hold, must not hold, and their least length."""
    flat = normalize_for_search(F.col("text"))
    failed = F.array_compact(F.array(*(F.when(~F.contains(flat, F.lit(m)), F.lit(f"lacks {m}")) for m in must), *(F.when(F.contains(flat, F.lit(m)), F.lit(f"has {m}")) for m in must_not), F.when(F.length("text") < least, F.lit("short"))))
    return outputs.select("case_id", F.size(failed).alias("failed"), F.array_join(failed, "; ").alias("reasons"))


def evict(files: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """The oldest files (folder, updated, bytes) of each folder that must go for the rest to fit the budget."""
    newest = W.partitionBy("folder").orderBy(F.desc("updated"), *keys).rowsBetween(W.unboundedPreceding, 0)
    return files.withColumn("kept_bytes", F.sum("bytes").over(newest)).where(F.col("kept_bytes") > budget)
