"""The step graph: contracts, closures, paths, next steps; and the recovery matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Step, kind, required artifacts, produced artifact, gate.
STEPS = [
    ("ingest", "deterministic", "", "transcript.revision", False),
    ("transcript.confirm", "human", "transcript.revision", "transcript.confirmed", True),
    ("l1.suggest", "model", "transcript.confirmed", "l1.suggestions", False),
    ("l1.coverage", "deterministic", "l1.suggestions transcript.confirmed", "l1.coverage", False),
    ("l1.review", "human", "l1.suggestions l1.coverage", "l1.adjudicated", True),
    ("metadata.derive", "deterministic", "l1.adjudicated", "metadata.draft", False),
    ("metadata.confirm", "human", "metadata.draft", "metadata.confirmed", True),
    ("abstract.derive", "deterministic", "l1.adjudicated metadata.confirmed", "abstract.draft", False),
    ("abstract.confirm", "human", "abstract.draft", "abstract.confirmed", True),
    ("analysis.summarise", "model", "l1.adjudicated", "analysis.draft", False),
    ("analysis.confirm", "human", "analysis.draft", "analysis.confirmed", True),
    ("release.preview", "deterministic", "metadata.confirmed abstract.confirmed l1.adjudicated", "release.preview", False),
    ("release.approve", "human", "release.preview", "release.approved", True),
    ("analysis.approve", "human", "analysis.confirmed", "analysis.approved", True),
    ("analysis.export", "egress", "analysis.approved", "analysis.bundle", False),
    ("export", "egress", "release.approved", "export.bundle", False),
]


def steps(spark: SparkSession) -> DataFrame:
    rows = [(s, k, r.split(), p, g) for s, k, r, p, g in STEPS]
    return spark.createDataFrame(rows, "step string, kind string, requires array<string>, produces string, gate boolean")


def edges(spark: SparkSession) -> DataFrame:
    """source step, target step: the target requires what the source produces."""
    s = steps(spark)
    need = s.select(F.col("step").alias("target"), F.explode("requires").alias("artifact"))
    return need.join(s.select(F.col("step").alias("source"), F.col("produces").alias("artifact")), "artifact").select("source", "target")


def producers() -> dict[str, list[str]]:
    """The steps that produce what each step requires; the graph is a constant, so it is walked in Python."""
    makes = {p: s for s, _, _, p, _ in STEPS}
    return {s: [makes[a] for a in r.split() if a in makes] for s, _, r, _, _ in STEPS}


def upstream(spark: SparkSession) -> DataFrame:
    """step, ancestor: the transitive producers of every step."""
    direct, found = producers(), {}

    def walk(step: str) -> set[str]:
        if step not in found:
            found[step] = {a for d in direct[step] for a in {d, *walk(d)}}
        return found[step]

    return spark.createDataFrame([(s, a) for s in direct for a in sorted(walk(s))], "step string, ancestor string")


def egress_paths(spark: SparkSession) -> DataFrame:
    """model, egress, path, gated: every simple path from a model step to an egress step, and whether a gate is on it."""
    after: dict[str, list[str]] = {}
    for step, before in producers().items():
        for b in before:
            after.setdefault(b, []).append(step)
    kind, gates, out = {s[0]: s[1] for s in STEPS}, {s[0] for s in STEPS if s[4]}, []

    def walk(path: list[str]) -> None:
        if kind[path[-1]] == "egress":
            out.append((path[0], path[-1], ">".join(path), bool(gates & set(path[1:]))))
        for step in after.get(path[-1], []):
            if step not in path:
                walk([*path, step])

    for step, k in kind.items():
        if k == "model":
            walk([step])
    return spark.createDataFrame(out, "model string, egress string, path string, gated boolean")


def next_steps(spark: SparkSession, have: DataFrame) -> DataFrame:
    """record_id, step: all that is required is there, and what it produces is not. ``have``: record_id, artifacts."""
    s = steps(spark)
    ready = (F.size(F.array_except("requires", "artifacts")) == 0) & ~F.array_contains("artifacts", F.col("produces"))
    return have.crossJoin(F.broadcast(s)).where(ready).select("record_id", "step")  # a constant number of steps a record


def recovery(intent, valid, complete, prestate, foreign, written) -> F.Column:
    """The class of an interrupted operation: A to G."""
    return (
        F.when(~intent, "A").when(~valid, "B").when(complete & prestate & ~foreign, "D").when(complete, "G")
        .when(~prestate | foreign, "C").when(written == "none", "F").when(written == "prefix", "E").otherwise("G")
    )
