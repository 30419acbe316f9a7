"""Replay as a stream: each record's state lives in the state store, and every batch tells what it changed."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annalist.operators import views

#: What an event has for the stream: ``number`` counts a record's events from 1 without a gap.
EVENTS = ["number", "seq", "kind", "artifact", "sha256", "verdict", "undo_of", "human", "outcome"]
_FACTS = "sha256 string, versions long, receipt_for string, decided_sha256 string, verdict string, withdrawal long, outcome string, epoch long"
_NAMES = [x.split()[0] for x in _FACTS.split(", ")]


class Replay(StatefulProcessor):
    """One record: its head (last number and seq, findings) as a value, its artifacts and the bytes each ever had as maps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "number long, seq long, findings long")
        self.facts = handle.getMapState("facts", "artifact string", _FACTS)
        self.history = handle.getMapState("history", "artifact string, sha256 string", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        number, seq, findings = self.head.get() if self.head.exists() else (0, 0, 0)
        now = {k[0]: dict(zip(_NAMES, v, strict=True)) for k, v in self.facts.iterator()}
        touched = set()
        for e in sorted((r.asDict() for r in rows), key=lambda r: r["number"]):
            if e["number"] <= number:
                continue  # told already: a file that came twice
            if e["number"] != number + 1:
                raise ValueError(f"record {key[0]}: event {e['number']} after {number}")
            number, seq = e["number"], max(seq, e["seq"])
            if e["artifact"] is not None:
                touched.add(e["artifact"])
                findings += self.take(e, now.setdefault(e["artifact"], dict.fromkeys(_NAMES) | {"versions": 0}))
        self.head.update((number, seq, findings))
        for artifact in touched:
            self.facts.updateValue((artifact,), tuple(now[artifact][n] for n in _NAMES))
        for a, f in sorted(now.items()):
            yield Row(record_id=key[0], artifact=a, **f, findings=findings, upto=seq)

    def take(self, e: dict, f: dict) -> int:
        """Changes an artifact's facts by one event; 1 if the event breaks a rule (see ``views.finding``)."""
        kind, sha = e["kind"], e["sha256"] if e["sha256"] and re.fullmatch("[0-9a-f]{64}", e["sha256"]) else None
        if kind == views.PRODUCED and sha:
            if sha != f["sha256"] and not self.history.containsKey((e["artifact"], sha)):
                self.history.updateValue((e["artifact"], sha), (e["seq"],))
                f["versions"] += 1
            f |= {"sha256": sha, "epoch": e["seq"]}
        elif kind == views.RECEIPT and sha:
            f |= {"receipt_for": sha, "epoch": e["seq"]}
        elif kind == views.DECISION and sha and e["verdict"] in views.VERDICTS:
            if e["verdict"] == "UNDO":
                counts = bool(e["human"]) and f["withdrawal"] is not None and e["undo_of"] == f["withdrawal"]
                f["withdrawal"] = None if counts else f["withdrawal"]
            else:
                counts = e["verdict"] == "WITHDRAW" or f["withdrawal"] is None
                f["withdrawal"] = e["seq"] if e["verdict"] == "WITHDRAW" else f["withdrawal"]
            if counts:
                f |= {"decided_sha256": sha, "verdict": e["verdict"], "epoch": e["seq"]}
        elif kind == views.DECISION:
            f |= {"decided_sha256": None, "verdict": None}
            return 1
        elif kind == views.ANCHOR and f["sha256"] is not None and e["outcome"] in views.OUTCOMES:
            f["outcome"] = e["outcome"]
        else:
            return int(kind in (views.PRODUCED, views.RECEIPT, views.ANCHOR))
        return 0

    def close(self) -> None:
        pass


def replay(stream: DataFrame) -> DataFrame:
    """A stream of events (record_id and EVENTS) as a stream of the rows of ``views.views`` for the records of each batch.

    State is kept by record, however many batches and restarts there are. Events of a record may come in any order within a
    batch; one that came before is passed over, and a gap in ``number`` fails the batch, so that nothing is told
    from a journal with a hole. Output mode update: of the rows of one artifact that with the largest ``upto`` counts.
    """
    kind = stream.schema["record_id"].dataType.simpleString()
    told = stream.select("record_id", *EVENTS).groupBy("record_id").transformWithState(Replay(), views.SCHEMA.format(kind), "Update", "None")
    return told.where("artifact is not null")


def run(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> None:
    """All files of ``folder`` that no run under this checkpoint has seen, into the Parquet folder ``out``; ends when they are done.

    Sets the session's state store (RocksDB, which this kind of state needs) where it is another, and one bound on the memory of
    all stores of an executor, since each partition of the state has its own.
    """
    base = "spark.sql.streaming.stateStore"
    if "RocksDB" not in spark.conf.get(f"{base}.providerClass"):
        spark.conf.set(f"{base}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, value in (("boundedMemoryUsage", "true"), ("maxMemoryUsageMB", "256")):
        if spark.conf.get(f"{base}.rocksdb.{name}", None) is None:
            spark.conf.set(f"{base}.rocksdb.{name}", value)
    stream = spark.readStream.schema(schema).parquet(folder)
    sink = replay(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    sink.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()


def latest(told: DataFrame) -> DataFrame:
    """What holds by now: of each record and artifact the row of the largest ``upto``."""
    keep = [c for c in told.columns if c not in ("record_id", "artifact", "batch")]
    return told.groupBy("record_id", "artifact").agg(F.max_by(F.struct(*keep), F.struct("upto")).alias("x")).select("record_id", "artifact", "x.*")
