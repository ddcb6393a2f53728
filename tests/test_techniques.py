"""Techniques by name, grids of runs against counting each run, and rows of several versions."""

import pytest
from pyspark.sql import functions as F

from packetlens.operators import techniques as Q
from packetlens.operators import versions as V


def test_grid_has_every_run_that_counting_gives(spark):
    values = [0.0, 0.1, 0.1, 0.3, 0.5, 0.5, 0.9, None, float("nan")]
    rows = [(v, None if v is None else v * 40, i % 3 == 0 if i != 4 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "embeddings double, phash double, truth boolean")
    runs = {"embeddings": [0.1, 0.5, 0.1, 2.0], "phash": [0, 4, 20]}
    got = {(r.technique, r.threshold): (r.tp, r.fp, r.tn, r.fn) for r in Q.grid(df, "truth", runs).collect()}
    assert set(got) == {("embeddings", t) for t in (0.1, 0.5, 2.0)} | {("phash", float(t)) for t in (0, 4, 20)}
    for (name, t), found in got.items():
        want = [0, 0, 0, 0]
        for a, b, truth in rows:
            v = a if name == "embeddings" else b
            if v is None or truth is None:
                continue
            hit = v == v and (v > t if name == "phash" else v < t)
            want[(0 if truth else 1) if hit else (3 if truth else 2)] += 1
        assert list(found) == want, (name, t)
    assert [r.technique for r in Q.ranking(Q.grid(df, "truth", runs)).orderBy("place").collect()] in (["embeddings", "phash"], ["phash", "embeddings"])
    assert Q.grid(df.limit(0), "truth", {"embeddings": None}).first().tp == 0


def test_techniques_have_names_and_directions(spark):
    assert Q.of("Perceptual_Hash").above and not Q.of("ssim").above and Q.of("combined_hash").threshold == 0.6
    with pytest.raises(ValueError):
        Q.of("ocr")
    df = spark.createDataFrame([([0.5, -0.5, 0.25, 0.1], [0.5, -0.5, 0.25, 0.1]), ([1.0, 1.0, -1.0, -1.0], [-1.0, -1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    same, other = Q.scored(df, "a", "b", ["histogram", "ssim", "phash", "embeddings", "combined"]).collect()
    assert (same.histogram, round(same.ssim, 9), same.phash, round(same.embeddings, 9), round(same.combined, 9)) == (1.0, 1.0, 0.0, 1.0, 1.0)
    assert other.phash == 4 and other.ssim < 0 and other.embeddings == 0


def test_rows_of_older_versions_are_filled(spark, tmp_path):
    body = "{\"segments\": [{\"segment_id\": \"s\", \"start_page\": 1, \"end_page\": 2, \"confidence\": 0.5, \"document_type\": \"x\", \"later\": [1]}]}"
    at = [F.timestamp_seconds(F.lit(i)).alias(c) for i, c in enumerate(("created_at", "updated_at", "expires_at"))]
    row = lambda i, proposal, changes, meta: spark.range(1).select(F.lit(i).alias("session_id"), F.lit("pending").alias("status"), *at, F.lit(proposal).alias("proposal"), F.lit(changes).alias("modifications"), F.lit(meta).alias("metadata"))
    path = str(tmp_path / "s")
    V.append(row(1, body, None, None), path, 1)
    assert V.detailed(V.sessions(spark, path)).first().modifications == []
    V.append(row(2, "not json", "[{\"type\": \"split\", \"segment_id\": \"s\"}]", "{}"), path, 2)
    V.append(row(3, body, "null", "{\"upload_id\": 7, \"total_pages\": \"many\", \"auto_confirmed\": true}"), path)
    got = {r.session_id: r for r in V.detailed(V.sessions(spark, path)).collect()}
    assert [len(got[i].segments) for i in (1, 2, 3)] == [1, 0, 1] and got[1].segments[0].end_page == 2
    assert [len(got[i].modifications) for i in (1, 2, 3)] == [0, 1, 0] and got[2].modifications[0].type == "split"
    assert (got[3].upload_id, got[3].total_pages, got[3].auto_confirmed) == ("7", 0, True) and (got[1].upload_id, got[1].total_pages) == (None, 0)
    with pytest.raises(ValueError):
        V.stored(row(1, "{}", "[]", "{}"), 4)
