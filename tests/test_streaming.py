import datetime as dt
import os
import random


from churnlens.streaming import jobs


def _polls(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base, "1.0"), (1, base + dt.timedelta(hours=1), "1.0"), (1, base + dt.timedelta(hours=2), "1.1"),
            (1, base + dt.timedelta(hours=3), ""), (1, base + dt.timedelta(hours=4), "1.2-rc"),
            (2, base, "0.1"), (3, base, None)]
    return spark.createDataFrame(rows, "repo long, polled_at timestamp, tag string")


def test_release_changes_batch(spark):
    got = {(r.repo, r.old_version, r.new_version) for r in jobs.release_changes(_polls(spark)).collect()}
    assert got == {(1, "1.0", "1.1"), (1, "1.1", "1.2-rc")}      # first sight, same tag, empty list: no change


def test_release_changes_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "polls")
    _polls(spark).write.parquet(src)
    stream = spark.readStream.schema("repo long, polled_at timestamp, tag string").parquet(src)
    q = (jobs.release_changes_stream(stream).writeStream.format("memory").queryName("rel_changes_t")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True)
         .start())
    q.awaitTermination(120)
    got = {(r.repo, r.old_version, r.new_version) for r in spark.table("rel_changes_t").collect()}
    assert got == {("1", "1.0", "1.1"), ("1", "1.1", "1.2-rc")}


def _requests(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for client in range(4):
        t = base
        for _ in range(400):
            t += dt.timedelta(seconds=rnd.choices([0.2, 0.5, 1, 2, 60, 61, 90], weights=[40, 30, 15, 5, 2, 4, 4])[0])
            rows.append((client, t, eid))
            eid += 1
    return rows


def test_throttle_matches_brute_force(spark):
    rows = _requests(spark)
    df = spark.createDataFrame(rows, "client long, ts timestamp, event_id long")
    got = {r.event_id: r.label for r in jobs.throttle_labels(df).collect()}
    expected = {}
    for c in range(4):
        seq = sorted((ts, e) for cl, ts, e in rows if cl == c)
        labels, _, _ = jobs._throttle_rows([ts for ts, _ in seq], None, 0)
        expected.update({e: lab for (_, e), lab in zip(seq, labels)})
    assert got == expected
    assert "rejected" in expected.values()


def test_throttle_edges():
    t0 = dt.datetime(2024, 1, 1)
    ts = [t0 + dt.timedelta(milliseconds=10 * i) for i in range(51)]
    labels, _, _ = jobs._throttle_rows(ts, None, 0)
    assert labels[49] == "allowed" and labels[50] == "rejected"
    # exactly 60 s after the last allowed request is not a reset; 60 s + 1 ms is
    labels, _, _ = jobs._throttle_rows(ts[:50] + [ts[49] + dt.timedelta(seconds=60)], None, 0)
    assert labels[-1] == "rejected"
    labels, _, _ = jobs._throttle_rows(ts[:50] + [ts[49] + dt.timedelta(seconds=60, milliseconds=1)], None, 0)
    assert labels[-1] == "allowed"
    # rejected requests do not move last_seen
    seq = ts[:50] + [ts[49] + dt.timedelta(seconds=30), ts[49] + dt.timedelta(seconds=61)]
    labels, _, _ = jobs._throttle_rows(seq, None, 0)
    assert labels[-2:] == ["rejected", "allowed"]


def test_throttle_stream_equals_batch(spark, scratch):
    rows = _requests(spark)
    src = os.path.join(scratch, "req")
    spark.createDataFrame(rows, "client long, ts timestamp, event_id long").write.parquet(src)
    stream = spark.readStream.schema("client long, ts timestamp, event_id long").parquet(src)
    q = (jobs.throttle_stream(stream).writeStream.format("memory").queryName("throttle_t").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = {r.event_id: r.label for r in spark.table("throttle_t").collect()}
    batch = {r.event_id: r.label for r in
             jobs.throttle_labels(spark.createDataFrame(rows, "client long, ts timestamp, event_id long")).collect()}
    assert got == batch


def test_document_log_and_latest(spark, scratch):
    docs = os.path.join(scratch, "docs")
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "running", base, 1), (2, "running", base, 1)],
                          "analysis_id long, status string, modified_at timestamp, revision int").write.parquet(docs + "/a")
    spark.createDataFrame([(1, "completed", base + dt.timedelta(hours=1), 2)],
                          "analysis_id long, status string, modified_at timestamp, revision int").write.parquet(docs + "/b")
    stream = (spark.readStream.schema("analysis_id long, status string, modified_at timestamp, revision int")
              .option("recursiveFileLookup", "true").parquet(docs))
    log = os.path.join(scratch, "log")
    q = jobs.incremental_documents(stream, log, os.path.join(scratch, "ck3"))
    q.awaitTermination(120)
    latest = {r.analysis_id: r.status for r in jobs.latest_documents(spark.read.parquet(log).drop("_epoch")).collect()}
    assert latest == {1: "completed", 2: "running"}


def test_trend_stream_day(spark, scratch):
    src = os.path.join(scratch, "roll")
    base = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([(base, "completed", "library", 2), (base + dt.timedelta(hours=2), "completed", "cve_auto", 3),
                           (base + dt.timedelta(days=1), "completed", "library", 1),
                           (base, "completed", "products", 9)],
                          "created_at timestamp, status string, source string, vuln_count long").write.parquet(src)
    stream = spark.readStream.schema("created_at timestamp, status string, source string, vuln_count long").parquet(src)
    q = (jobs.vuln_trend_stream(stream, "day").writeStream.format("memory").queryName("trend_t")
         .outputMode("update").option("checkpointLocation", os.path.join(scratch, "ck4"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {}
    for r in spark.table("trend_t").collect():
        got[r.period] = r.vuln_count
    assert got == {"2024-01-01": 5, "2024-01-02": 1}


def test_pending_feed(spark, scratch):
    src = os.path.join(scratch, "res")
    spark.createDataFrame([(1, "a", ""), (1, "b", "done"), (2, "c", None), (3, "d", "")],
                          "analysis_id long, filename string, ai_response string").write.parquet(src)
    scored = spark.createDataFrame([(3, "d")], "analysis_id long, filename string")
    stream = spark.readStream.schema("analysis_id long, filename string, ai_response string").parquet(src)
    q = (jobs.pending_feed(stream, scored, ["analysis_id", "filename"]).writeStream.format("memory")
         .queryName("pending_t").option("checkpointLocation", os.path.join(scratch, "ck5"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert {(r.analysis_id, r.filename) for r in spark.table("pending_t").collect()} == {(1, "a"), (2, "c")}


def test_throttle_long_session_across_batches(spark):
    base = dt.datetime(2024, 1, 1)
    # one client, 700 requests 0.5 s apart (one session), labelled with 64-row Arrow batches
    rows = [(9, base + dt.timedelta(milliseconds=500 * i), i) for i in range(700)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.event_id: r.label for r in jobs.throttle_labels(
            spark.createDataFrame(rows, "client long, ts timestamp, event_id long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    labels, _, _ = jobs._throttle_rows([t for _, t, _ in rows], None, 0)
    assert [got[i] for i in range(700)] == labels


def test_document_log_replay_is_idempotent(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, "completed", base, 2)],
                                  "analysis_id long, status string, modified_at timestamp, revision int")
    log = os.path.join(scratch, "log2")
    write = jobs.document_log_writer(log)
    write(batch, 0)
    write(batch, 0)          # the same epoch replayed
    write(batch, 1)
    assert spark.read.parquet(log).count() == 2


def test_trend_stream_week(spark, scratch):
    src = os.path.join(scratch, "roll_w")
    rows = [(dt.datetime(2024, 12, 29, 10), 1), (dt.datetime(2024, 12, 30, 9), 2),   # Sun (W52), Mon (2025-W01)
            (dt.datetime(2025, 1, 5, 23), 4), (dt.datetime(2025, 1, 6, 0), 8)]       # Sun (2025-W01), Mon (W02)
    spark.createDataFrame([(t, "completed", "library", v) for t, v in rows],
                          "created_at timestamp, status string, source string, vuln_count long").write.parquet(src)
    stream = spark.readStream.schema("created_at timestamp, status string, source string, vuln_count long").parquet(src)
    q = (jobs.vuln_trend_stream(stream, "week").writeStream.format("memory").queryName("trend_w")
         .outputMode("update").option("checkpointLocation", os.path.join(scratch, "ck6"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.period: r.vuln_count for r in spark.table("trend_w").collect()}
    assert got == {"2024-W52": 1, "2025-W01": 6, "2025-W02": 8}


def test_release_stream_state_across_micro_batches(spark, scratch):
    import time
    base = dt.datetime(2024, 1, 1)
    first = [(1, base, "1.0"), (2, base, "0.1"), (1, base + dt.timedelta(hours=1), "1.1")]
    second = [(1, base + dt.timedelta(hours=2), "1.1"), (1, base + dt.timedelta(hours=3), "1.2"),
              (2, base + dt.timedelta(hours=3), "0.2")]
    src = os.path.join(scratch, "polls_mb")
    schema = "repo string, polled_at timestamp, tag string"
    first, second = ([(f"https://host/org/{r}", *x) for r, *x in rows] for rows in (first, second))
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(os.path.join(src, "a"))
    time.sleep(1.1)   # the file source orders files by modification time
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    q = (jobs.release_changes_stream(stream).writeStream.format("memory").queryName("rel_mb")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "ck7"))
         .trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = {(r.repo, r.old_version, r.new_version) for r in spark.table("rel_mb").collect()}
    batch = {(str(r.repo), r.old_version, r.new_version) for r in
             jobs.release_changes(spark.createDataFrame(first + second, schema)).collect()}
    one, two = "https://host/org/1", "https://host/org/2"
    assert got == batch == {(one, "1.0", "1.1"), (one, "1.1", "1.2"), (two, "0.1", "0.2")}
    assert len(q.recentProgress) >= 2          # really ran as several micro-batches


def test_trend_stream_month(spark, scratch):
    src = os.path.join(scratch, "roll_m")
    rows = [(dt.datetime(2024, 1, 31, 23), 1), (dt.datetime(2024, 2, 1, 0), 2), (dt.datetime(2024, 2, 29, 12), 4)]
    spark.createDataFrame([(t, "completed", "cve_auto", v) for t, v in rows],
                          "created_at timestamp, status string, source string, vuln_count long").write.parquet(src)
    stream = spark.readStream.schema("created_at timestamp, status string, source string, vuln_count long").parquet(src)
    q = (jobs.vuln_trend_stream(stream, "month").writeStream.format("memory").queryName("trend_m")
         .outputMode("update").option("checkpointLocation", os.path.join(scratch, "ck8"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert {r.period: r.vuln_count for r in spark.table("trend_m").collect()} == {"2024-01": 1, "2024-02": 6}


def test_requests_per_window(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(seconds=k % 60)) for k in range(70)] + [(1, base + dt.timedelta(seconds=60)), (2, base + dt.timedelta(seconds=59))]
    got = {(r.client, r.window_start, r.requests, r.over_limit) for r in
           jobs.requests_per_window(spark.createDataFrame(rows, "client long, ts timestamp")).collect()}
    assert got == {(1, base, 70, 20), (1, base + dt.timedelta(seconds=60), 1, 0), (2, base, 1, 0)}
