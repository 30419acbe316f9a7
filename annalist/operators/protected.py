"""Protected acts in replay: what a completed act makes, if all that it was prepared on still holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from annalist.operators.receipts import latest_before
from annalist.operators.timeline import inputs_as_of

#: Kinds of rows, the global input of every basis, and the phase whose result needs no decision.
PRODUCED, CHECKPOINT, PREPARED, COMPLETED = "artifact.produced", "protected.checkpoint", "protected.prepared", "protected.completed"
POLICY, UNDECIDED = "policy", "pseudonymise"
#: The columns of a prepared act beside record_id and seq.
PLAN = ["plan", "phase", "artifact", "sha256", "basis", "actor", "actor_seq", "checkpoint"]


def joined(events: DataFrame, inputs: DataFrame, actors: DataFrame) -> DataFrame:
    """First pass: every completed act with what was prepared under its plan, with the policy and its actor's state before it.

    Plans are found by one join on their key, whichever record prepared them (of a repeated plan the first counts).
    """
    prepared = events.where(F.col("kind") == PREPARED).groupBy("plan").agg(F.min_by(F.struct("record_id", "seq", *PLAN[1:]), "seq").alias("p"))
    done = events.where(F.col("kind") == COMPLETED).select("record_id", "seq", "plan").join(prepared, "plan", "left")
    done = done.select("record_id", "seq", "plan", F.when(F.col("p.seq") < F.col("seq"), F.col("p")).alias("p"))
    states = latest_before(done.withColumn("actor", F.col("p.actor")), actors.select("actor", "seq", "active"), ["actor"], ["seq", "active"])
    states = inputs_as_of(states.select("record_id", "seq", "p", F.col("found").alias("state")), inputs.where(F.col("role") == POLICY), [POLICY])
    return events.join(states, ["record_id", "seq"], "left")


def expand(events: DataFrame, inputs: DataFrame, actors: DataFrame, protected: list[str]) -> DataFrame:
    """record_id, seq, part, kind, artifact, sha256, finding: the events that replay goes by, in order of (seq, part).

    A completed act adds virtual rows (part 1 to 3): its artifact, its receipt and, but for one phase, its decision. They
    count for what comes after. It adds nothing but a finding, the first that fits, if its plan is ``unknown`` or
    another record's, was completed before (``twice``), its ``basis`` moved (a role has other bytes or was made
    again, the policy is another), its ``actor`` isn't active or in another state than when it was prepared, or the
    ``checkpoint`` isn't the last of its phase. Checkpoints go on from the last of their session by one (``order``),
    or begin a session with 1. An artifact of a ``protected`` role made without an act is dropped (``unprotected``).

    Events: record_id, seq, kind, artifact, sha256, plan, phase, basis (array of role, sha256, seq), actor, actor_seq,
    checkpoint, session, revision, previous; a row's columns are null where its kind has none. inputs: role, seq,
    sha256 (role ``policy``); actors: actor, seq, active. Global state is looked up before (``joined``); then each record's sorted rows
    go by once, holding the record's artifacts, plans and checkpoints only.
    """
    rows = joined(events, inputs, actors)

    def verdict(r: dict, made: dict, used: set, points: dict) -> str | None:
        p, state, policy = r["p"], r["state"], r[POLICY]
        if p is None or p["record_id"] != r["record_id"]:
            return "unknown"
        if r["plan"] in used:
            return "twice"
        now = made if policy is None else made | {POLICY: (policy["sha256"], policy["seq"])}
        if any(now.get(b["role"]) != (b["sha256"], b["seq"]) for b in p["basis"] or ()):
            return "basis"
        if state is None or not state["active"] or state["seq"] != p["actor_seq"]:
            return "actor"
        return None if p["checkpoint"] is None or points.get(p["phase"], {}).get("digest") == p["checkpoint"] else "checkpoint"

    def goes_on(r: dict, last: dict | None) -> bool:
        if last is None or last["session"] != r["session"]:
            return r["revision"] == 1 and r["previous"] is None
        return r["revision"] == last["revision"] + 1 and r["previous"] == last["digest"] and r["actor"] == last["actor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, used, points = None, {}, set(), {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["record_id"] != now:
                    now, made, used, points = r["record_id"], {}, set(), {}
                finding, more = None, []
                if r["kind"] == PRODUCED and r["artifact"] in protected:
                    finding = "unprotected"
                elif r["kind"] == PRODUCED:
                    made[r["artifact"]] = (r["sha256"], r["seq"])
                elif r["kind"] == CHECKPOINT:
                    if goes_on(r, points.get(r["phase"])):
                        points[r["phase"]] = {"session": r["session"], "revision": r["revision"], "digest": r["checkpoint"], "actor": r["actor"]}
                    else:
                        finding = "order"
                elif r["kind"] == COMPLETED:
                    finding = verdict(r, made, used, points)
                    if finding is None:
                        p = r["p"]
                        used.add(r["plan"])
                        made[p["artifact"]] = (p["sha256"], r["seq"])
                        more = [PRODUCED, "receipt.recorded"] + ["decision.recorded"] * (p["phase"] != UNDECIDED)
                out.append((r["record_id"], r["seq"], 0, r["kind"], r["artifact"], r["sha256"], finding))
                out += [(r["record_id"], r["seq"], k, kind, r["p"]["artifact"], r["p"]["sha256"], None) for k, kind in enumerate(more, 1)]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["record_id", "seq", "part", "kind", "artifact", "sha256", "finding"])

    kinds = [to_arrow_type(events.schema["record_id"].dataType), pa.int64(), pa.int32(), *[pa.string()] * 4]
    kind = events.schema["record_id"].dataType.simpleString()
    return rows.repartition("record_id").sortWithinPartitions("record_id", "seq").mapInArrow(run, f"record_id {kind}, seq long, part int, kind string, artifact string, sha256 string, finding string")
