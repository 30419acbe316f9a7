"""A journal table with transactions: sealed parts that count once a manifest names them, and snapshots by manifest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import chain

NAMES = ["seq", "at", "kind", "record_id", "payload", "operation_intent_sha256", "prev", "digest"]


class Moved(RuntimeError):
    """Another writer was first, or the journal moved under a reader, more often than was allowed."""


class Journal:
    """``folder``/parts/<attempt> holds the rows of a transaction, ``folder``/manifest/<version>.json tells that they count.

    A version is a file that only one writer can create: its JSON is written beside and renamed without overwriting, as
    Structured Streaming does for its own log. Everything before that leaves the journal as it was. What a writer is about to do
    stands in ``folder``/intents before it begins, so that ``recover`` can finish or drop what a dead one left. Needs a store whose rename doesn't replace (HDFS, local disks).
    """

    def __init__(self, spark: SparkSession, folder: str, key: bytes | None = None):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.jvm = spark._jvm
        path = self._path(self.folder)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = path.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.fs.mkdirs(self._path(f"{self.folder}/manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def log(self) -> DataFrame:
        """version, part, operation, seq and digest (of the last event) of all transactions."""
        return self.spark.read.schema("version long, part string, operation string, seq long, digest string").json(f"{self.folder}/manifest")

    def head(self) -> dict:
        """The newest transaction's line; version 0 if there is none. Versions have no gaps, so their names tell it."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.folder}/manifest"))]
        newest = max((n for n in found if n.endswith(".json") and not n.startswith(".")), default=None)
        if newest is None:
            return {"version": 0, "part": None, "operation": None, "seq": 0, "digest": chain.GENESIS}
        return self._read(f"{self.folder}/manifest/{newest}")

    def _write(self, name: str, line: dict) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(json.dumps(line, sort_keys=True).encode()))
        stream.close()

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, line: dict) -> bool:
        """Creates the next version; False if another writer has."""
        made, beside = f"{self.folder}/manifest/{line['version']:020d}.json", f"{self.folder}/manifest/.{uuid.uuid4().hex}"
        self._write(beside, line)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self.context.rename(self._path(beside), self._path(made), options)
        except Exception:
            if not self.fs.exists(self._path(made)):
                raise
            self.fs.delete(self._path(beside), False)
            return False
        return True

    def _done(self, operation: str) -> dict | None:
        found = self.log().where(F.col("operation") == operation).first()
        return found and found.asDict()

    def _publish_part(self, head: dict, part: str, operation: str) -> int | None:
        """The version that now names the part; None if the head has moved."""
        last = self.spark.read.parquet(part).agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest")).first()
        ended = (last["seq"], last["digest"]) if last["seq"] is not None else (head["seq"], head["digest"])
        line = {"version": head["version"] + 1, "part": part, "operation": operation, "seq": ended[0], "digest": ended[1]}
        return line["version"] if self._publish(line) else None

    def append(self, events: DataFrame, operation: str, attempts: int = 3, before_publish: Callable[[], None] | None = None) -> int:
        """Appends events (order, at, kind, record_id, payload) as one transaction; gives the version that holds them.

        ``operation`` names the transaction: done once, it is never done again, so a batch that is run again after a
        crash, at whatever step, changes nothing. Its digest is the intent in every row. The rows are sealed to the head
        that was read; if another writer published meanwhile, they are sealed again to the new one, up to
        ``attempts`` times. ``before_publish`` runs when the part is written and not yet named.
        """
        for _ in range(attempts):
            head, done = self.head(), self._done(operation)
            if done is not None:
                return done["version"]
            name = uuid.uuid4().hex
            part, intent = f"{self.folder}/parts/{name}", f"{self.folder}/intents/{name}.json"
            self._write(intent, {"operation": operation, "part": part, "version": head["version"]})
            self._sealed(events, operation, head, f"{self.folder}/sealing/{name}").write.parquet(part)
            self.fs.delete(self._path(f"{self.folder}/sealing/{name}"), True)
            if before_publish is not None:
                before_publish()
            version = self._publish_part(head, part, operation)
            self.fs.delete(self._path(intent), False)
            if version is not None:
                return version
        raise Moved(f"{operation}: another writer was first {attempts} times")

    def recover(self, older: float = 3600) -> list[tuple[str, str]]:
        """What became of operations whose writers left an intent ``older`` seconds ago or more: (operation, outcome), by intent.

        ``done``: it was published before the writer died, or by another attempt. ``finished``: its part was whole and the head
        is still the one that it was sealed to, so it is published now. ``moved``: whole, but sealed to an older head;
        ``partial``: the part isn't whole. These two are dropped, the operation is to be run again. Intents of living
        writers must be younger than ``older``.
        """
        folder, out = self._path(f"{self.folder}/intents"), []
        if not self.fs.exists(folder):
            return out
        for status in sorted(self.fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            if time.time() - status.getModificationTime() / 1000 < older:
                continue
            intent = self._read(str(status.getPath()))
            part, head, done = intent["part"], self.head(), self._done(intent["operation"])
            whole = self.fs.exists(self._path(f"{part}/_SUCCESS"))
            if done is None and whole and head["version"] == intent["version"] and self._publish_part(head, part, intent["operation"]) is not None:
                outcome, keep = "finished", True
            else:
                outcome, keep = ("done", done["part"] == part) if done is not None else ("moved" if whole else "partial", False)
            if not keep:
                self.fs.delete(self._path(part), True)
            self.fs.delete(self._path(f"{self.folder}/sealing/{part.rpartition('/')[2]}"), True)
            self.fs.delete(status.getPath(), False)
            out.append((intent["operation"], outcome))
        return out

    def _sealed(self, events: DataFrame, operation: str, head: dict, folder: str) -> DataFrame:
        intent = F.sha2(F.lit(operation), 256)
        rows = events.select(F.lit(0).alias("journal"), "order", "at", "kind", "record_id", "payload").withColumn("operation_intent_sha256", intent)
        return chain.seal(rows, self.key, head["seq"], head["digest"], folder).select(*NAMES)

    def snapshot(self, version: int | None = None) -> DataFrame | None:
        """The journal as of a transaction (default: the newest), whatever is appended meanwhile; None if it is empty.
        Parts never change; the names of as many as there were transactions come to the driver."""
        upto = self.head()["version"] if version is None else version
        parts = [r["part"] for r in self.log().where(F.col("version") <= upto).select("part").collect()]
        return self.spark.read.parquet(*parts) if parts else None

    def stable(self, read: Callable[[DataFrame | None], object], attempts: int = 3) -> object:
        """What ``read`` makes of a snapshot that is still the newest one afterwards; Moved after so many attempts."""
        for _ in range(attempts):
            before = self.head()["version"]
            found = read(self.snapshot(before))
            if self.head()["version"] == before:
                return found
        raise Moved(f"the journal moved {attempts} times while it was read")

    def sink(self, query: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch of a streaming query is one transaction, exactly once over restarts."""
        return lambda batch, n: self.append(batch, f"{query}/{n}") and None
