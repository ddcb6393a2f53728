"""Streams of many files: the same rows as one, in whatever order they come, with state that goes once the watermark has passed."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetlens.streaming import events as S
from packetlens.streaming import uploads as U

DAY = pd.Timestamp("2024-01-01")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two days of events of three keys in twelve files, of which each has its rows in no order; key 3 is silent from noon to evening."""
    path = tmp_path_factory.mktemp("events")
    rows = [(i, DAY + pd.Timedelta(minutes=7 * i), 1 + i % 3, "view" if i % 4 else "error", float(i % 10)) for i in range(400)]
    rows = [r for r in rows if not (r[2] == 3 and 12 <= r[1].hour < 20)]
    for n in range(12):
        own = pd.DataFrame(rows[n * len(rows) // 12 : (n + 1) * len(rows) // 12], columns=["event_id", "ts", "user_id", "event_type", "value"]).sample(frac=1, random_state=n)
        own.to_parquet(path / ("events.parquet" if n == 0 else f"events.parquet{n:02}"), coerce_timestamps="us")
    return str(path), rows


def streamed(spark, folder, make, files=1):
    progress = []
    out = S.drained(make, S.stream(spark, folder[0], files), progress)
    return out.toPandas(), progress


def most_state(progress):
    return max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress), progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_rates_and_sessions_keep_open_windows_alone(spark, folder):
    rows = pd.DataFrame(folder[1], columns=["event_id", "ts", "user_id", "event_type", "value"])
    got, progress = streamed(spark, folder, S.rates)
    want = rows.groupby([rows.ts.dt.floor("5min"), "event_type"]).size()
    assert len(got) == len(want) and got.n.sum() == len(rows) and len(progress) > 12
    most, left = most_state(progress)
    assert most < 60 < len(want) and left == 0
    got, progress = streamed(spark, folder, lambda r: S.sessions(r, gap="2 hours"))
    assert got.n.sum() == len(rows) and len(got) == 5 and most_state(progress)[1] == 0


@pytest.mark.parametrize("files", [1, 12])
def test_buckets_decide_in_order_of_time(spark, folder, files):
    got, progress = streamed(spark, folder, lambda r: S.bucket_decisions(r, capacity=2.0, rate=1 / 1500), files)
    state, want = {}, {}
    for event, ts, user, *_ in folder[1]:
        tokens, last = state.get(user, (2.0, ts))
        tokens = min(2.0, tokens + (ts - last).total_seconds() / 1500)
        want[event] = tokens >= 1
        state[user] = tokens - want[event], ts
    assert dict(zip(got.event_id, got.allowed, strict=True)) == want and 0 < got.allowed.sum() < len(want)
    assert most_state(progress)[1] == 0


@pytest.mark.parametrize("files", [1, 12])
def test_silent_connections_are_lost_once(spark, folder, files):
    got, progress = streamed(spark, folder, lambda r: S.lost_connections(r, seconds=3600.0), files)
    lost = sorted(zip(got.user_id, pd.to_datetime(got.last_micros, unit="us"), got.beats, strict=True))
    rows = {k: [r[1] for r in folder[1] if r[2] == k] for k in (1, 2, 3)}
    noon = [max(t for t in rows[3] if t < DAY + pd.Timedelta(days=d, hours=12)) for d in (0, 1)]
    want = [(1, rows[1][-1], len(rows[1])), (2, rows[2][-1], len(rows[2]))]
    want += [(3, t, sum(1 for x in rows[3] if a < x <= t)) for a, t in zip([DAY - pd.Timedelta(days=1), *noon], [*noon, rows[3][-1]], strict=True)]
    assert lost == sorted(want)
    assert most_state(progress)[1] == 0


def test_no_events_no_rows(spark, tmp_path, folder):
    spark.read.parquet(f"{folder[0]}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert S.drained(S.rates, S.stream(spark, str(tmp_path))).count() == 0
    assert S.drained(S.lost_connections, S.stream(spark, str(tmp_path))).count() == 0


def test_uploads_come_in_any_order(spark, tmp_path):
    content = {i: bytes(range(i % 256)) * (i % 5) for i in range(1, 40)}
    sent = [(i, k, -(-len(c) // 100) or 1, c[k * 100 : k * 100 + 100], DAY + pd.Timedelta(minutes=(i * 31 + k * 17) % 90)) for i, c in content.items() for k in range(-(-len(c) // 100) or 1)]
    lost = next(x for x in sent if x[0] == 29 and x[1] == 1)
    sent = sorted([x for x in sent if x != lost] + [x for x in sent if x[0] % 4 == 0], key=lambda x: (x[1] * 7 + x[0]) % 13)
    sent.append((5, 99, 1, b"outside", DAY))
    for n in range(6):
        pd.DataFrame(sent[n::6], columns=["file_id", "chunk_number", "total_chunks", "data", "ts"]).astype({"chunk_number": "int32", "total_chunks": "int32"}).to_parquet(tmp_path / f"{n}.parquet", coerce_timestamps="us")
    rows = spark.readStream.schema(U.CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    progress = []
    got = {r.file_id: r for r in S.drained(lambda r: U.assembled(r, 7200.0, "2 hours"), rows, progress).collect()}
    assert len(got) == len(content) and got[29].status == "expired" and got[29].content is None and got[29].n_bytes == 100
    assert all(r.status == "complete" and bytes(r.content) == content[i] and r.n_chunks == (-(-len(content[i]) // 100) or 1) for i, r in got.items() if i != 29)
    assert most_state(progress)[1] == 0


def test_chunks_of_files(spark):
    files = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "i long, c string")
    got = sorted((r.file_id, r.chunk_number, r.total_chunks, bytes(r.data or b"")) for r in U.chunks(files, "i", F.coalesce("c", F.lit("")), F.lit("2024-01-01"), 3).collect())
    assert got == [(1, 0, 3, b"abc"), (1, 1, 3, b"def"), (1, 2, 3, b"g"), (2, 0, 1, b""), (3, 0, 1, b"")]
