"""Plans over the step graph: graphs by profile, reachable gates, text roles, handlers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.graph import STEPS


@dataclass(frozen=True)
class Step:
    """A step of the graph; ``confirms`` and ``reads`` are text artifacts."""

    name: str
    kind: str
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    gate: bool = False
    confirms: str | None = None
    reads: str | None = None


CONFIRMED, PSEUDONYMISED = "transcript.confirmed", "transcript.pseudonymised.confirmed"
#: What a gate of the base graph confirms.
CONFIRMS = {"transcript.confirm": "transcript.revision"}
#: The steps of pseudonymisation by a model, and by hand.
MODEL_BLOCK = (
    Step("pii.detect", "model", (CONFIRMED,), ("pii.spans",)),
    Step("pseudonymise", "deterministic", (CONFIRMED, "pii.spans"), ("transcript.pseudonymised.draft", "replacement.report")),
    Step("pseudonymisation.review", "human", ("transcript.pseudonymised.draft", "replacement.report"), (PSEUDONYMISED,), True, "transcript.pseudonymised.draft"),
)
_SOURCE = (CONFIRMED, "transcript.revision")
MANUAL_BLOCK = (
    Step("pii.mark", "human", _SOURCE, ("pii.spans",), True, None, "transcript.revision"),
    Step("pseudonymise", "deterministic", (*_SOURCE, "pii.spans"), ("transcript.pseudonymised.draft",), False, None, "transcript.revision"),
    Step("pseudonymisation.cases", "human", (*_SOURCE, "pii.spans", "transcript.pseudonymised.draft"), ("pseudonymisation.cases",), True, None, "transcript.revision"),
    Step("pseudonymise.finalise", "deterministic", (*_SOURCE, "pii.spans", "pseudonymisation.cases"), ("transcript.pseudonymised.final", "replacement.report"), False, None, "transcript.revision"),
    Step("pseudonymisation.review", "human", (*_SOURCE, "pii.spans", "pseudonymisation.cases", "transcript.pseudonymised.final", "replacement.report"), (PSEUDONYMISED,), True, "transcript.pseudonymised.final", "transcript.revision"),
)
BLOCKS = {"none": (), "model": MODEL_BLOCK, "manual": MANUAL_BLOCK}


def base() -> tuple[Step, ...]:
    return tuple(Step(s, k, tuple(r.split()), (p,), g, CONFIRMS.get(s)) for s, k, r, p, g in STEPS)


def build(profile: str) -> tuple[Step, ...]:
    """The graph of a profile (none, model, manual), in an order in which what a step requires comes first.

    With a block, every other step that would read the confirmed transcript reads the confirmed pseudonymised one: no
    direct way is left. An unknown profile raises.
    """
    block = BLOCKS[profile]
    if not block:
        return ordered(base())
    made = {a for s in block for a in s.produces}
    reads = "transcript.pseudonymised.final" if profile == "manual" else None

    def moved(s: Step) -> Step:
        if CONFIRMED not in s.requires or made & set(s.produces):
            return s
        return replace(s, requires=tuple(PSEUDONYMISED if a == CONFIRMED else a for a in s.requires), reads=reads or s.reads)

    return ordered((*map(moved, base()), *block))


def ordered(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Topological order, stable in the given one; a cycle raises."""
    makes = {a: s.name for s in steps for a in s.produces}
    done, out, left = set(), [], list(steps)
    while left:
        ready = next((s for s in left if all(makes.get(a) in done or a not in makes for a in s.requires)), None)
        if ready is None:
            raise ValueError("a cycle: " + ", ".join(s.name for s in left))
        left.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return tuple(out)


def table(spark: SparkSession, profile: str) -> DataFrame:
    rows = [(profile, n, s.name, s.kind, list(s.requires), list(s.produces), s.gate) for n, s in enumerate(build(profile))]
    return spark.createDataFrame(rows, "profile string, n long, step string, kind string, requires array<string>, produces array<string>, gate boolean")


def plan(have: DataFrame, profile: str) -> DataFrame:
    """record_id, planned, gates, first: everything that can run now without a gate, all gates that are reachable then, and
    the first step that is eligible at once.

    ``have``: record_id, artifacts. A gate holds back only what is behind it. One fold over the graph, which is a constant,
    in its order; records are independent.
    """
    steps = build(profile)
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    graph = F.array(*[F.struct(F.lit(s.name).alias("step"), text(s.requires).alias("requires"), text(s.produces).alias("produces"), F.lit(s.gate).alias("gate")) for s in steps])
    none = F.array().cast("array<string>")
    start = F.struct(F.col("artifacts").cast("array<string>").alias("have"), none.alias("planned"), none.alias("gates"))

    def step(state, s):
        there = F.size(F.array_except(s["produces"], state["have"])) == 0
        able = ~there & (F.size(F.array_except(s["requires"], state["have"])) == 0)
        runs, one = able & ~s["gate"], F.array(s["step"])
        return F.struct(
            F.when(runs, F.array_union(state["have"], s["produces"])).otherwise(state["have"]).alias("have"),
            F.when(runs, F.concat(state["planned"], one)).otherwise(state["planned"]).alias("planned"),
            F.when(able & s["gate"], F.concat(state["gates"], one)).otherwise(state["gates"]).alias("gates"))

    eligible = F.filter(graph, lambda s: (F.size(F.array_except(s["produces"], "artifacts")) > 0) & (F.size(F.array_except(s["requires"], "artifacts")) == 0))
    done = have.withColumn("s", F.aggregate(graph, start, step)).withColumn("first", F.get(eligible, F.lit(0))["step"])
    return done.select("record_id", F.array_join("s.planned", ",").alias("planned"), F.array_join("s.gates", ",").alias("gates"), "first")


def text_role(profile: str, consumer: str) -> tuple[str, str, str]:
    """(gate's artifact, gate, text artifact) of the one confirmed text that a step reads; none or several raise."""
    steps = build(profile)
    mine = next(s for s in steps if s.name == consumer)
    makers = {a: s for s in steps for a in s.produces}
    found = [(a, makers[a]) for a in mine.requires if a in makers and makers[a].confirms is not None and (mine.reads is None or makers[a].confirms == mine.reads)]
    if len(found) != 1:
        raise ValueError(f"{consumer}: {len(found)} confirmed texts")
    artifact, gate = found[0]
    return artifact, gate.name, gate.confirms


def text_roles(spark: SparkSession) -> DataFrame:
    """profile, step, artifact, gate, text for all steps of all profiles that read one confirmed text."""
    rows = []
    for profile in BLOCKS:
        for s in build(profile):
            try:
                rows.append((profile, s.name, *text_role(profile, s.name)))
            except ValueError:
                continue
    return spark.createDataFrame(rows, "profile string, step string, artifact string, gate string, text string")


def handlers_against(handlers: DataFrame, graph: DataFrame) -> DataFrame:
    """step, finding: missing (a step without handler), foreign (a handler without step), mode (RUN for a human's step, GATE
    for another's). Handlers: step, mode (RUN, GATE, INPUT)."""
    g = graph.select("step", F.when(F.col("requires") == F.array().cast("array<string>"), "INPUT").when(F.col("kind") == "human", "GATE").otherwise("RUN").alias("wanted"))
    j = g.join(handlers, "step", "full_outer")
    finding = F.when(F.col("mode").isNull(), "missing").when(F.col("wanted").isNull(), "foreign").when(F.col("mode") != F.col("wanted"), "mode")
    return j.select("step", finding.alias("finding")).where(F.col("finding").isNotNull())
