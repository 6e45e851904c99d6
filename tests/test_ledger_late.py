import inspect

from helpers import day, rows, ts
from pyspark.sql.types import StructType

from tidemark.streaming import ingest as ST


def test_late_rows_reach_ledger_or_rejects(spark, tmp_path):
    """No option of the job may lose rows that come later than others, such as a watermark would."""
    p = lambda n: str(tmp_path / n)
    schema = "evidence_date date, content_hash string, observed_at timestamp"
    options = {k: "1 hour" for k in inspect.signature(ST.ingest_ledger_stream).parameters if "delay" in k}
    batch = lambda *r: spark.createDataFrame([(day(d), h, ts(t)) for d, h, t in r], schema).coalesce(1).write.mode("append").parquet(p("in"))
    run = lambda: ST.ingest_ledger_stream(spark, p("in"), StructType.fromDDL(schema), p("ledger"), p("rejects"), p("ck"), **options).awaitTermination(60)
    batch(("2026-10-20", "new", "2026-10-20T08:00"))
    run()
    batch(("2026-10-12", "late", "2026-10-12T08:00"), ("2026-10-10", "late weekend", "2026-10-10T08:00"))
    run()
    assert rows(spark.read.parquet(p("ledger")), "content_hash") == [("late",), ("new",)]
    assert rows(spark.read.parquet(p("rejects")), "content_hash") == [("late weekend",)]
