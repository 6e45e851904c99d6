"""Incremental ledger and bar ingestion (ST1, ST2)."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.labels import after_close_gate, gate_open
from tidemark.operators.checks import DataQualityError
from tidemark.schema import BARS
from tidemark.sources.tables import _exists, upsert_bars


def clock_gated(rows: DataFrame, day: str = "evidence_date", observed: str = "observed_at") -> DataFrame:
    """Adds the clock reason; works on batch and streaming frames alike."""
    return rows.withColumn("clock", after_close_gate(F.col(day), F.col(observed)))


class FirstObservation(StatefulProcessor):
    """Per key the hash of its first observation: rows with that hash are repeats, others conflicts.

    State is one short string a key, so nothing of it ever has to expire and no row is too late.
    """

    def __init__(self, names: list[str], hash_column: str, observed: str):
        self.names, self.hash_column, self.observed = names, hash_column, observed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        have = self.kept.get()[0] if self.kept.exists() else None
        copies = Counter(tuple(r[n] for n in self.names) for r in rows)  # exact copies within a micro-batch count, they are not held
        at, seen = self.names.index(self.hash_column), self.names.index(self.observed)
        order = sorted(copies, key=lambda r: (r[seen] is None, r[seen] or 0, str(r)))
        for k, row in enumerate(order):
            if have is None:
                have = row[at] or ""
                self.kept.update((have,))
                yield Row(**dict(zip(self.names, row, strict=True)), reason="insert")
            elif (row[at] or "") != have:
                for _ in range(copies[row]):
                    yield Row(**dict(zip(self.names, row, strict=True)), reason="immutable_conflict")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.kept.update((initialState["hash"],))


def ingest_ledger_stream(
    spark: SparkSession, source: str, schema: StructType, ledger: str, rejects: str, checkpoint: str,
    *, keys: list[str] | None = None, hash_column: str = "content_hash",
) -> StreamingQuery:
    """ST1: new day files pass the clock gate, then an immutable append; others go to a reject table.

    Every row ends in the ledger, in the rejects, or equals a stored row, however late it comes.  What a
    key was first seen with is kept in the state store, so no micro-batch reads the ledger; a ledger that
    was there before the job's first start is read once, as the initial state.  A micro-batch writes
    folders of its own, named by the job and its number: replayed, it writes the same ones again.
    The state store needs RocksDB; it is chosen in a session of the job's own.
    """
    keys = keys or ["evidence_date"]
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = clock_gated(session.readStream.schema(schema).parquet(source))
    gate = F.coalesce(gate_open(F.col("clock")), F.lit(False))
    plain = StructType([*rows.schema.fields])
    out = StructType([*plain.fields, StructField("reason", StringType())])
    initial = None
    if not _exists(session, checkpoint) and _exists(session, ledger):
        stored = session.read.parquet(ledger).groupBy(*keys).agg(F.min_by(hash_column, "observed_at").alias("hash"))
        initial = stored.groupBy(*keys)
    judged = rows.where(gate).groupBy(*keys).transformWithState(
        FirstObservation(plain.names, hash_column, "observed_at"), outputStructType=out, outputMode="Append", timeMode="None", initialState=initial)
    told = judged.unionByName(rows.where(~gate).withColumn("reason", F.col("clock")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        job = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        batch = batch.persist()
        try:
            batch.where("reason = 'insert'").drop("reason").write.mode("overwrite").parquet(f"{ledger}/batch={job}-{batch_id}")
            batch.where("reason != 'insert'").write.mode("overwrite").parquet(f"{rejects}/batch={job}-{batch_id}")
        finally:
            batch.unpersist()

    return told.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_bars_stream(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """ST2: new bar files are merged into the stored bars, the latest value per (symbol, day) wins.

    Inside a micro-batch the newest file wins; replaying a batch writes the same rows again.
    """
    stream = spark.readStream.schema(BARS).parquet(source).withColumn("_file_time", F.col("_metadata.file_modification_time")).withColumn("_file", F.col("_metadata.file_path"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        names = [c for c in BARS.names if c not in ("symbol", "trade_date")]
        newest = batch.groupBy("symbol", "trade_date").agg(
            F.max_by(F.struct(*names), F.struct("_file_time", "_file")).alias("_r")
        ).select("symbol", "trade_date", "_r.*")
        try:
            upsert_bars(batch.sparkSession, newest, root)
        except DataQualityError as exc:
            raise DataQualityError(f"bar batch {batch_id} refused: {exc}") from exc

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
