"""Incremental runs against one batch."""

from pyspark.sql import functions as F

from tallyforge.streaming import ingest

ROWS = [(i, f"ACC-{i % 3}", f"2026-01-{i % 28 + 1:02d}", (-1) ** i * 100 * i, "SGD", f"row {i}") for i in range(40)]
SCHEMA = "row_id long, account string, date string, amount long, currency string, description string"


def test_ingest_is_incremental(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    df = spark.createDataFrame(ROWS, SCHEMA)
    for part in (df.filter("row_id < 15"), df.filter("row_id >= 15")):
        part.coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(SCHEMA).parquet(source), table, state)
    got = spark.read.parquet(table)
    assert sorted(r.row_id for r in got.collect()) == list(range(40))
    assert got.select("batch").distinct().count() == 2 and got.filter("fingerprint IS NULL").count() == 0
    ingest.ingest(spark.readStream.schema(SCHEMA).parquet(source), table, state)
    assert spark.read.parquet(table).count() == 40


def test_rolling_totals_match_a_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("ts", F.to_timestamp("date"))
    df.write.parquet(source)
    totals = ingest.rolling_totals(spark.readStream.schema(df.schema).parquet(source), "ts")
    totals.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    want = df.groupBy(F.window("ts", "1 day"), "account", "currency").agg(F.sum(F.greatest("amount", F.lit(0))).alias("total_in"), F.sum(F.greatest(-F.col("amount"), F.lit(0))).alias("total_out"), F.count(F.lit(1)).alias("n"))
    plain = lambda d: sorted(tuple(r) for r in d.select("window.start", "account", "total_in", "total_out", "n").collect())
    assert plain(spark.read.parquet(out)) == plain(want)


def test_files_arrive_once(spark, tmp_path):
    source, out, state = (tmp_path / x for x in ("in", "out", "state"))
    source.mkdir()
    for name, text in (("a.csv", "x,y"), ("b.csv", "x,y"), ("c.csv", "other")):
        (source / name).write_text(text)
    files = ingest.first_arrivals(ingest.new_files(spark, str(source)))
    files.select("sha256").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(out)).count() == 2


def test_late_files_displace_and_rows_sent_again_move(spark, tmp_path):
    """After each arrival the table is what merging all rows as they now stand would give; nothing staged stays."""
    from tallyforge.operators.ledger import merge_across_files

    schema = "row_id long, account string, date string, amount long, currency string, description string, file int"
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    row = lambda i, amount, file: (i, "A", "2026-01-02", amount, "SGD", "coffee", file)
    arrivals = [
        [row(1, 100, 1), row(2, 200, 1), row(3, 300, 1)],
        [row(11, 100, 0), row(12, 100, 0)],  # twice in the later file: it displaces row 1
        [row(11, 900, 0), row(3, 400, 1)],  # both corrected: row 1 comes back on a tie lost by order, row 3 leaves an empty bucket
        [row(12, 901, 0)],
        [row(12, 901, 0), (20, "A", None, 5, "SGD", "no date", 2)],
    ]
    now = {}
    for arrival in arrivals:
        now |= {r[0]: r for r in arrival}
        spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.merge_arrivals(spark.readStream.schema(schema).parquet(source), table, state, 8)
        want = {(r.row_id, r.amount, r.kept) for r in merge_across_files(spark.createDataFrame(list(now.values()), schema)).collect()}
        got = [(r.row_id, r.amount, r.kept) for r in spark.read.parquet(table).collect()]
        assert len(got) == len(want) and set(got) == want
    assert not [p for p in tmp_path.iterdir() if "arrival" in p.name]
    ingest.merge_arrivals(spark.readStream.schema(schema).parquet(source), table, state, 8)
    assert {(r.row_id, r.amount, r.kept) for r in spark.read.parquet(table).collect()} == want


def test_keyed_state_decides_as_one_batch_would(spark, tmp_path):
    import time

    from tallyforge.operators.ledger import merge_across_files
    from tallyforge.streaming.stateful import decide_arrivals

    schema = "row_id long, account string, date string, amount long, currency string, description string, file int"
    row = lambda i, amount, file: (i, "A", "2026-01-02", amount, "SGD", "coffee", file)
    arrivals = [[row(1, 100, 1), row(2, 200, 1), (3, "A", None, 5, "SGD", "no date", 1)], [row(11, 100, 0), row(12, 100, 0), row(13, 200, 2)], [row(12, 900, 0), row(11, 900, 0), row(1, 100, 1)]]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source, folder, now = str(tmp_path / "in"), str(tmp_path / "out"), {}
        for arrival in arrivals:
            now |= {r[0]: r for r in arrival}
            spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(source)
            got = decide_arrivals(spark.readStream.schema(schema).parquet(source), folder)
            want = {(r.row_id, r.kept) for r in merge_across_files(spark.createDataFrame(list(now.values()), schema)).collect()}
            assert {(r.row_id, r.kept) for r in got.collect()} == want
        n = spark.read.parquet(f"{folder}/decisions").count()
        assert {(r.row_id, r.kept) for r in decide_arrivals(spark.readStream.schema(schema).parquet(source), folder).collect()} == want and spark.read.parquet(f"{folder}/decisions").count() == n
        # What has expired displaces nothing any more.
        source, folder = str(tmp_path / "in2"), str(tmp_path / "out2")
        for arrival in ([row(1, 100, 0), row(2, 100, 0)], [row(3, 100, 1)]):
            spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(source)
            got = decide_arrivals(spark.readStream.schema(schema).parquet(source), folder, days=1 / 86400)
            time.sleep(2)
        assert {(r.row_id, r.kept) for r in got.collect()} == {(1, True), (2, True), (3, True)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
