"""What a confirmation rests on: a record's last revision, where its text came from, and who gave its languages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: Kinds of rows.
REVISION, PROJECTION, LANGUAGES, CONFIRM = "revision", "projection", "languages", "confirm"


def chains(events: DataFrame) -> DataFrame:
    """record_id, seq, revision, revision_seq, projection_seq, assignment, languages_seq, problem for every ``confirm`` row.

    The last revision before it; of that revision's bytes the last projection receipt; of the assignment that this one names
    the last language receipt. problem is the first link that is missing: revision, projection, languages. Receipts of
    other bytes, or that come later, don't count. Events: record_id, seq, kind, output (the bytes made), assignment (of
    projections). One sort by record and one pass that holds the record's receipts by output.
    """
    names = ["record_id", "seq", "revision", "revision_seq", "projection_seq", "assignment", "languages_seq", "problem"]
    kinds = [to_arrow_type(events.schema["record_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, projections, languages = None, None, {}, {}
        for batch in batches:
            out = []
            for record, seq, kind, output, assignment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if record != now:
                    now, last, projections, languages = record, None, {}, {}
                if kind == REVISION:
                    last = (output, seq)
                elif kind == PROJECTION:
                    projections[output] = (seq, assignment)
                elif kind == LANGUAGES:
                    languages[output] = seq
                elif kind == CONFIRM:
                    projected, named = projections.get(last[0], (None, None)) if last else (None, None)
                    spoken = languages.get(named) if projected is not None else None
                    problem = "revision" if last is None else "projection" if projected is None else "languages" if spoken is None else None
                    out.append((record, seq, *(last or (None, None)), projected, named, spoken, problem))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = events.schema["record_id"].dataType.simpleString()
    rows = events.select("record_id", "seq", "kind", "output", "assignment").repartition("record_id").sortWithinPartitions("record_id", "seq")
    return rows.mapInArrow(run, f"record_id {kind}, seq long, revision string, revision_seq long, projection_seq long, assignment string, languages_seq long, problem string")
