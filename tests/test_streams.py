"""Last values of many keys: groups that reach Python, nulls, ties of time, keys that only some batches have."""

from marketloom.streaming import market as ST


def test_keys_share_groups_and_batches_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKETS", 3)
    rows = [(e, (e * 7) % 41 if e % 50 else None, None if e % 60 == 0 else "ab"[e % 2], 1_000_000 * ((e * 13) % 97), float(e) if e % 11 else None) for e in range(600)] + [(9000, 77, "a", 5, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, us long, value double").selectExpr("event_id", "user_id", "event_type", "timestamp_micros(us) AS ts", "value")
    for part in range(3):
        df.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = ST.event_stream(spark, f"file://{tmp_path}")
    got = {tuple(r) for r in ST.run_to_end(ST.value_changes(stream), "t", "update", ("user_id", "event_type")).collect()}
    want = {}
    for e, u, k, us, v in sorted(rows, key=lambda r: (r[3], r[0])):
        n, _, now = want.get((u, k), (0, None, None))
        want[u, k] = (n + 1, now, v)
    assert got == {(*key, *x) for key, x in want.items()}


def test_groups_do_not_grow_with_keys(spark, tmp_path):
    """Rows of state, which are the groups that Python is called for: at most ``BUCKETS``, not one for each of 12,000 keys."""
    df = spark.range(12000).selectExpr("id AS event_id", "id AS user_id", "'a' AS event_type", "timestamp_micros(id) AS ts", "1.0D AS value")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = ST.value_changes(ST.event_stream(spark, f"file://{tmp_path}"))
    query = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert 0 < max(kept) <= ST.BUCKETS
