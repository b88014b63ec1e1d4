"""Structured Streaming over operation logs.

``apply_stream`` follows a folder of JSON-lines files of operations and applies
each micro-batch to a memory in the order of ``seq``; operations that were
applied before are passed over, so a batch that runs twice changes nothing; the
store's log and manifest hold the number, so that holds after a restart too.
``tag_counts`` keeps counts of tags by windows of recorded time, with a
watermark for late rows.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.memory import Memory

OPS = "seq long, op string, now long, payload string"


def read_ops(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(seq, op, now, payload): one row an operation, its fields as JSON."""
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def apply_batch(memory: Memory, batch: DataFrame, together: int = 256) -> int:
    """Apply the operations of a batch that are new, in order; how many.

    Verbs depend on one another, so they are folded in order; runs of
    ``remember`` go ``together`` at a time.
    """
    n, held, marks = 0, [], []

    def flush():
        if held:
            memory.remember_many(list(held), marks=list(marks))
            held.clear()
            marks.clear()

    try:
        for r in batch.where(F.col("seq") > memory.stream_seq).dropDuplicates(["seq"]).orderBy("seq").toLocalIterator():
            verb, fields = r["op"], json.loads(r["payload"] or "{}")
            if verb not in ("remember", "revise", "forget", "link", "unlink"):
                raise ValueError(f"operation {r['seq']}: unknown verb {verb!r}")
            if verb == "remember":
                held.append(fields | {"now": r["now"]})
                marks.append(r["seq"])
                if len(held) >= together:
                    flush()
            else:
                flush()
                memory.mark = r["seq"]
                getattr(memory, verb)(**fields, now=r["now"])
            n += 1
    finally:
        memory.mark = None
        flush()
    return n


def apply_stream(memory: Memory, ops: DataFrame, checkpoint: str):
    """A query that writes ``ops`` into ``memory`` until it is stopped."""
    return ops.writeStream.foreachBatch(lambda batch, _: apply_batch(memory, batch)).option("checkpointLocation", checkpoint).start()


def tag_counts(facts: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, tag, count) over streamed facts (recorded_at, tags)."""
    rows = facts.select(F.timestamp_millis("recorded_at").alias("at"), F.explode("tags").alias("tag")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "tag").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "tag", "count")
