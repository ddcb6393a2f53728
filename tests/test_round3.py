"""Cases that larger tables and odd rows showed: requests that take no time, streams and packets of any size."""

from pyspark.sql import functions as F

from packetlens.operators import limits as L


def test_requests_that_take_no_time_count_for_themselves(spark):
    log = [(1, "a", 0, 2.0), (2, "a", 0, 0.0), (3, "a", 0, 1.0), (4, "a", 1, 0.0), (5, "a", 1, None), (6, "a", 2, 0.0), (7, "b", 1, 0.0), (8, "a", 3, -2.0), (9, "a", 4, 0.5)]
    df = spark.createDataFrame(log, "event_id long, k string, t long, need double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.n_active for r in L.concurrency(df, "k", F.col("need")).collect()}
    assert got == {i: sum(1 for j, q, s, n in log if q == k and (s, j) <= (t, i) and (j == i or n is not None and s + n > t)) for i, k, t, _ in log}


def test_state_is_kept_by_groups_of_keys(spark, tmp_path):
    """600 keys of which each had state of its own: now a row for a group's open span, in batches of any order; one key is null."""
    import pandas as pd

    from packetlens.streaming import events as S

    start = pd.Timestamp("2024-01-01")
    rows = [(i, start + pd.Timedelta(minutes=(i * 7) % 2000, seconds=i % 50), i * 7919 % 600 or None) for i in range(3000)]
    late = [r for r in rows if r[1] >= start + pd.Timedelta(hours=16)]
    for n, own in enumerate(([r for r in rows if r not in late], late)):
        frame = pd.DataFrame(own, columns=["event_id", "ts", "user_id"]).astype({"user_id": "Int64"}).sample(frac=1, random_state=n)
        frame.to_parquet(tmp_path / f"events.parquet{n or ''}", coerce_timestamps="us")
    progress = []
    got = S.drained(lambda r: S.bucket_decisions(r, capacity=2.0, rate=1 / 40000, groups=8), S.stream(spark, str(tmp_path), 1), progress).toPandas()
    state, want = {}, {}
    for event, ts, user in sorted(rows, key=lambda r: (r[1], r[0])):
        tokens, last = state.get(user, (2.0, ts))
        tokens = min(2.0, tokens + (ts - last).total_seconds() / 40000)
        want[event] = tokens >= 1
        state[user] = tokens - want[event], ts
    assert dict(zip(got.event_id, got.allowed, strict=True)) == want and len(set(want.values())) == 2
    assert got.user_id.isna().sum() == sum(r[2] is None for r in rows)
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert max(kept) < 600 and kept[-1] == 0


def test_members_are_read_by_their_list(spark, tmp_path):
    from packetlens.sources import archives as Z

    rows = [(i % 3, i, f"m{i}.txt", bytes([i]) * (i * 7 % 50), None) for i in range(60)]
    members = spark.createDataFrame(rows, "packet_id long, position long, name string, content binary, metadata string")
    path = str(tmp_path / "out")
    Z.write_archives(members, path, 100, compress="false")
    got = {(r.packet_id, r.position): bytes(r.content) for r in Z.read_members(Z.manifest(spark, path), path).collect()}
    assert got == {(p, i): c for p, i, _, c, _ in rows}


def test_neighbours_of_a_large_group_are_in_many_tasks(spark):
    from packetlens.operators.scans import with_neighbour

    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("p"), (F.col("id") * 3).alias("v"))
    for step in (-1, 1):
        out = with_neighbour(rows, "k", "p", {"near": "v"}, step, 64)
        got = {(r.k, r.p): r.near if r.has_neighbour else None for r in out.collect()}
        assert got == {(k, p): (2 * (p + step) + k) * 3 if 0 <= p + step < 2500 else None for k in (0, 1) for p in range(2500)}
        assert out.groupBy("k", F.spark_partition_id()).count().where("count < 2500").count() > 2


def test_pages_in_blocks_have_the_same_signals(spark):
    from packetlens.operators import boundaries as B
    from packetlens.sources.packets import packet_pages

    pages = packet_pages(spark, "/root/testdata/sf0.001")
    one, blocks = (sorted(map(str, B.heuristic(pages, every=True, dense=d).collect())) for d in (False, True))
    assert one == blocks and one
