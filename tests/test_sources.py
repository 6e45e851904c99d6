import pytest
from helpers import bars_from, day, rows, trend_bars, ts
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import evidence as E
from tidemark.operators import reconstruct as K
from tidemark.operators.checks import DataQualityError
from tidemark.sources import tables as IO
from tidemark.streaming import ingest as ST


def test_bars_round_trip_and_upsert(spark, tmp_path):
    root = str(tmp_path / "bars")
    IO.write_bars(trend_bars(spark, [("000001", 0.01, 1e7), ("600000", 0.02, 1e7)], n=5), root, buckets=4)
    assert IO.read_bars(spark, root).count() == 10 and IO.read_bars(spark, root, ["600000"], buckets=4).count() == 5
    first = IO.read_bars(spark, root).agg(F.min("trade_date")).first()[0]
    IO.upsert_bars(spark, bars_from(spark, [("000001", first, 50, 51, 7), ("000001", day("2025-01-02"), 60, 61, 7)]), root, buckets=4)
    got = IO.read_bars(spark, root).where("symbol = '000001'")
    assert got.count() == 6 and got.where(F.col("trade_date") == F.lit(first)).first()["close"] == 51.0
    assert IO.read_bars(spark, root).where("symbol = '600000'").count() == 5
    with pytest.raises(ValueError, match="4 buckets"):
        IO.read_bars(spark, root, buckets=8)
    with pytest.raises(ValueError, match="4 buckets"):
        IO.upsert_bars(spark, bars_from(spark, [("000001", first, 50, 51, 7)]), root, buckets=8)
    with pytest.raises(DataQualityError):
        IO.upsert_bars(spark, bars_from(spark, [("1", first, -1, 1, 1)]), root, buckets=4)


def test_facts_upsert_keeps_revisions(spark, tmp_path):
    root = str(tmp_path / "facts")
    mk = lambda v, seen: spark.createDataFrame([("000001", "roe", v, ts("2024-03-31"), ts(seen), "x")], S.FACTS)
    IO.upsert_facts(spark, mk(0.1, "2024-04-30"), root)
    IO.upsert_facts(spark, mk(0.1, "2024-04-30"), root)
    IO.upsert_facts(spark, mk(0.2, "2024-05-30"), root)
    assert sorted(r["value"] for r in IO.read_facts(spark, root).require().collect()) == [0.1, 0.2]
    with pytest.raises(DataQualityError):
        IO.upsert_facts(spark, mk(0.3, "2024-04-30"), root)


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    root = tmp_path / "bars"
    mk = lambda *days: bars_from(spark, [("000001", day(d), 50, 51, 7) for d in days])
    IO.write_bars(mk("2024-01-02", "2024-02-02"), str(root), buckets=4)
    files = lambda: {str(p) for p in root.rglob("*.parquet")}
    before = files()
    IO.upsert_bars(spark, mk("2024-02-05"), str(root))
    gone = before - files()
    assert len(gone) == 1 and "month=2024-02" in gone.pop() and IO.read_bars(spark, str(root)).count() == 3


def test_append_snapshot_needs_every_exchange(spark, tmp_path):
    root = str(tmp_path / "master")
    m = spark.createDataFrame([(f"00000{i}", "n", x, "b", day("2000-01-01"), None, 1.0, 1.0, False, True, ts("2026-10-12T08:00")) for i, x in enumerate(S.REQUIRED_EXCHANGES)], S.MASTER)
    IO.append_snapshot(m, root)
    IO.append_snapshot(m, root)
    assert IO.read_snapshots(spark, root).count() == 3
    with pytest.raises(DataQualityError):
        IO.append_snapshot(m.withColumn("name", F.lit("other")), root)
    with pytest.raises(DataQualityError):
        IO.append_snapshot(m.unionByName(m.limit(1).withColumns({"symbol": F.lit("9"), "exchange": F.lit("XXX")})), root)
    IO.append_snapshot(m.withColumn("observed_at", F.lit("2026-10-12 09:00:00").cast("timestamp")), root)
    assert IO.read_snapshots(spark, root).count() == 6
    with pytest.raises(DataQualityError):
        IO.append_snapshot(m.where("exchange <> 'BSE'"), root)


def test_candidates_and_ledger_files(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    open(path, "w").write("symbol,amount\n1,5\n")
    assert rows(IO.read_candidates(spark, path), "symbol", "screen_source") == [("000001", "external_candidate_file")]
    folder = tmp_path / "ledger" / "signals"
    folder.mkdir(parents=True)
    head = ",".join(S.SIGNAL_LEDGER.names)
    for d in ("2026-09-29", "2026-09-30"):
        (folder / f"{d}.csv").write_text(f"{head}\n{d},1,n,主板,false,1,0.5,0.1,spot,v1,2026-09-30T09:00:00Z\n")
    assert rows(IO.read_ledger(spark, str(tmp_path / "ledger")), "signal_date", "symbol", "target_weight") == [(day("2026-09-29"), "000001", 0.1), (day("2026-09-30"), "000001", 0.1)]


def test_report_writers(spark, tmp_path):
    root = str(tmp_path)
    ranking = spark.createDataFrame([("000001", 1, 0.5), ("000002", 2, 0.1), ("000003", None, None)], "symbol string, rank int, composite_score double")
    excl, summary = ranking.limit(1).select("symbol"), spark.createDataFrame([(2,)], "ranked_count int")
    IO.write_selection(ranking, excl, summary, f"{root}/sel", 1)
    assert rows(spark.read.option("header", True).csv(f"{root}/sel/selected"), "symbol") == [("000001",)] and spark.read.json(f"{root}/sel/summary").first()["ranked_count"] == 2
    IO.write_backtest_report(ranking, excl, summary, f"{root}/bt", comparison=ranking)
    assert spark.read.parquet(f"{root}/bt/benchmark").count() == 3
    IO.write_inventory(ranking, excl, summary, f"{root}/inv")
    assert spark.read.parquet(f"{root}/inv/lifecycle").count() == 3
    days = ranking.withColumn("trade_date", F.lit("2024-01-02").cast("date"))
    IO.write_candidate_days(K.Reconstruction(days, excl, excl), f"{root}/days")
    assert spark.read.parquet(f"{root}/days/candidates").where("trade_date = '2024-01-02'").count() == 3


def test_shard_files(spark, tmp_path):
    for i in (0, 1):
        spark.createDataFrame([(f"00000{i}", day("2024-01-02"), 1.0)], "symbol string, trade_date date, amount double").coalesce(1).write.parquet(str(tmp_path / "in" / f"shard={i}"))
    rows_in = IO.read_shards(spark, str(tmp_path / "in"))
    assert rows(rows_in, "symbol", "shard_index") == [("000000", 0), ("000001", 1)]
    s = spark.createDataFrame([(i, 2, 1, 1, 1.0, "a", "b") for i in (0, 1)], "shard_index int, shard_count int, symbol_count int, success_count int, success_rate double, period_start string, period_end string")
    IO.write_merged(rows_in, s, 2, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("month = '2024-01'").count() == 2


def test_append_immutable(spark, tmp_path):
    root = str(tmp_path / "days")
    mk = lambda *kv: spark.createDataFrame(list(kv), "k string, content_hash string")
    IO.append_immutable(spark, mk(("a", "1")), root, ["k"])
    IO.append_immutable(spark, mk(("a", "1"), ("b", "2")), root, ["k"])
    assert spark.read.parquet(root).count() == 2
    with pytest.raises(DataQualityError):
        IO.append_immutable(spark, mk(("a", "9")), root, ["k"])


def test_checkpoint_folder_is_read_from_the_session(spark, tmp_path):
    from tidemark.sources.scratch import settled, shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    at = shared_dir(spark, "x")
    assert at.startswith(named) if named else at.startswith("file:///")
    assert at != shared_dir(spark, "x")
    kept = settled(spark.range(3))
    assert kept.count() == 3 and "/settled-" in kept.inputFiles()[0]
    assert settled(spark.createDataFrame([], "a long, b string")).columns == ["a", "b"]


def test_only_folders_with_a_key_are_read(spark, tmp_path):
    from tidemark.sources.keyed import append_keyed, read_keyed, touched_parts

    root = str(tmp_path / "keyed")
    mk = lambda *ks: spark.createDataFrame([(k, d, f"{k}{d}") for k, d in ks], "k string, d int, v string")
    parts = [append_keyed(mk(*[(f"s{n}", d) for d in range(50)]), root, ["k", "d"]) for n in range(4)]
    assert touched_parts(spark, root, mk(("s2", 7), ("s3", 49), ("none", 1)), ["k", "d"]) == sorted(parts[2:])
    got = read_keyed(spark, root, mk(("s1", 3)), ["k", "d"])
    assert got.count() == 50 and all(f"part={parts[1]}" in f for f in got.inputFiles())
    assert read_keyed(spark, root, mk(("none", 1)), ["k", "d"]).count() == 0 and spark.read.parquet(root).count() == 200


def test_ranged_snapshots_read_what_differs(spark, tmp_path):
    a = spark.range(2000).selectExpr("cast(id as string) AS symbol", "cast(id as double) AS x", "'n' AS name")
    b = a.where("symbol != '17'").withColumn("x", F.when(F.col("symbol") == "5", 5.5).when(F.col("symbol") == "9", F.col("x") * (1 + 1e-15)).otherwise(F.col("x")))
    b = b.unionByName(spark.createDataFrame([("new", 1.0, "n")], b.schema))
    for name, df in (("a", a), ("b", b)):
        IO.write_ranged_snapshot(df, str(tmp_path / name), ["symbol"])
    got = IO.compare_ranged_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["symbol"], ["x"], ["name"])
    assert rows(got, "symbol", "verdict") == [("17", "missing_in_new"), ("5", "differs:x"), ("new", "missing_in_stored")]
    read = {f.split("leaf=")[1].split("/")[0] for f in got.inputFiles()}
    assert len(read) <= 4
    assert rows(E.compare_by_ranges(a, b, ["symbol"], ["x"], ["name"]), "symbol", "verdict") == rows(got, "symbol", "verdict")
    same = IO.compare_ranged_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "a"), ["symbol"], ["x"], ["name"])
    assert same.count() == 0


def test_ledger_stream_takes_over_a_ledger_and_replays(spark, tmp_path):
    from pyspark.sql.types import StructType

    p = lambda n: str(tmp_path / n)
    schema = "evidence_date date, content_hash string, observed_at timestamp"
    mk = lambda *r: spark.createDataFrame([(day(d), h, ts(t)) for d, h, t in r], schema).coalesce(1)
    mk(("2026-10-12", "a", "2026-10-12T08:00")).write.parquet(p("ledger/batch=old"))
    run = lambda: ST.ingest_ledger_stream(spark, p("in"), StructType.fromDDL(schema), p("ledger"), p("rejects"), p("ck")).awaitTermination(120)
    mk(("2026-10-12", "a", "2026-10-12T09:00"), ("2026-10-12", "z", "2026-10-12T09:30"), ("2026-10-14", "q", "2026-10-14T09:00"), ("2026-10-14", "p", "2026-10-14T08:00"), ("2026-10-14", "p", "2026-10-14T08:30")).write.mode("append").parquet(p("in"))
    run()
    mk(("2026-10-14", "p", "2026-10-14T10:00"), ("2026-10-14", "r", "2026-10-14T10:00"), ("2026-10-14", "r", "2026-10-14T10:00")).write.mode("append").parquet(p("in"))
    run()
    assert rows(spark.read.parquet(p("ledger")), "evidence_date", "content_hash") == [(day("2026-10-12"), "a"), (day("2026-10-14"), "p")]
    assert rows(spark.read.parquet(p("rejects")), "content_hash") == [("q",), ("r",), ("r",), ("z",)]


def test_ledger_stream(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    schema = "evidence_date date, content_hash string, observed_at timestamp"
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    batch = lambda *r: spark.createDataFrame([(day(d), h, ts(t)) for d, h, t in r], schema).coalesce(1).write.mode("append").parquet(p("in"))
    run = lambda: ST.ingest_ledger_stream(spark, p("in"), st, p("ledger"), p("rejects"), p("ck")).awaitTermination(120)
    batch(("2026-10-12", "a", "2026-10-12T08:00"), ("2026-10-10", "w", "2026-10-10T08:00"), ("2026-10-13", "early", "2026-10-13T05:00"))
    run()
    batch(("2026-10-12", "b", "2026-10-12T09:00"), ("2026-10-13", "c", "2026-10-13T08:00"))
    run()
    assert rows(spark.read.parquet(p("ledger")), "evidence_date", "content_hash") == [(day("2026-10-12"), "a"), (day("2026-10-13"), "c")]
    assert rows(spark.read.parquet(p("rejects")), "content_hash", "reason") == [("b", "immutable_conflict"), ("early", "before_signal_close_or_future_signal"), ("w", "non_weekday_signal")]


def test_bars_stream_upserts(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    d = day("2024-01-02")
    feed = lambda close: bars_from(spark, [("000001", d, close, close, 1)]).coalesce(1).write.mode("append").parquet(p("in"))
    run = lambda: ST.upsert_bars_stream(spark, p("in"), p("bars"), p("ck")).awaitTermination(120)
    feed(10)
    run()
    feed(12)
    run()
    assert rows(IO.read_bars(spark, p("bars")), "symbol", "close") == [("000001", 12.0)]
