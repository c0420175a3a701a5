"""Structured Streaming jobs and their batch twins.

Streaming versions keep O(1) state per key (``applyInPandasWithState``),
so a hot key costs state updates, never a growing group.  Batch twins give
the same answers over a static table and are what the correctness checks
run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from churnlens.functions.paths import valid_version
from churnlens.operators.dashboards import LIBRARY_SOURCES, period_key
from churnlens.operators.sequence import index_within

# Fixed values of the request throttle.
REQUESTS_PER_WINDOW = 50
WINDOW_SECONDS = 60
IDLE_DROP_SECONDS = 3600


# --------------------------------------------------------------------------- T02 / T03

def release_changes(polls: DataFrame) -> DataFrame:
    """T02 batch twin: per repository, a change (old, new) whenever a poll sees a tag
    different from the last recorded one; the first poll only records; polls with
    no tag leave the state untouched.  polls: repo, polled_at, tag.
    """
    p = polls.where(F.coalesce(F.col("tag"), F.lit("")) != "").select("repo", "polled_at", "tag")
    nb = index_within(p, ["repo"], [F.asc("polled_at"), F.asc("tag")], out="poll_seq", carry=["tag"])
    return (nb.where(F.col("prev_tag").isNotNull() & (F.col("prev_tag") != F.col("tag")))
            .select("repo", "polled_at", F.col("prev_tag").alias("old_version"), F.col("tag").alias("new_version")))


CHANGE_SCHEMA = "repo string, polled_at timestamp, old_version string, new_version string"


def _release_state(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    last = state.get[0] if state.exists else ""
    out = []
    # a key's rows of one micro-batch can come in several chunks: order them all
    rows = pd.concat(list(pdfs)).sort_values(["polled_at", "tag"])
    for row in rows.itertuples(index=False):
        if not row.tag:
            continue
        if row.tag != last:
            if last:
                out.append((key[0], row.polled_at, last, row.tag))
            last = row.tag
    state.update((last,))
    if out:
        yield pd.DataFrame(out, columns=["repo", "polled_at", "old_version", "new_version"])


def release_changes_stream(polls_stream: DataFrame) -> DataFrame:
    """T02 as a stateful stream keyed by repository, an id or a URL as text (state: last recorded version)."""
    return (polls_stream.select(F.col("repo").cast("string").alias("repo"), "polled_at", "tag").groupBy("repo")
            .applyInPandasWithState(_release_state, CHANGE_SCHEMA, "last_version string", "append",
                                    GroupStateTimeout.NoTimeout))


def auto_requests(changes: DataFrame, library: DataFrame) -> DataFrame:
    """Analysis requests for detected changes; both versions valid; mode by CPE presence."""
    lib = library.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"), "repo_url", "cpe")
    c = changes.withColumn("repo_id", F.col("repo").cast("string"))
    mode = F.when(F.coalesce(F.col("cpe"), F.lit("")) != "", F.lit("cve_auto")).otherwise(F.lit("library_auto"))
    return (c.join(lib, "repo_id", "inner")
            .where(valid_version("old_version") & valid_version("new_version"))
            .select("repo", "polled_at", "repo_name", "repo_url", "old_version", "new_version", mode.alias("mode")))


# --------------------------------------------------------------------------- T04

def _throttle_rows(rows: list, last_seen, count):
    """Label requests of one client in time order; returns labels and the final state."""
    labels = []
    for ts in rows:
        if last_seen is None or (ts - last_seen).total_seconds() > WINDOW_SECONDS:
            count, last_seen = 1, ts
            labels.append("allowed")
        elif count >= REQUESTS_PER_WINDOW:
            labels.append("rejected")
        else:
            count, last_seen = count + 1, ts
            labels.append("allowed")
    return labels, last_seen, count


def _throttle_partitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Label long sessions; rows arrive sorted by (client, session, ts, event_id) per partition.

    A session can span several Arrow batches, so the state (current session,
    time of the last allowed request, count) is carried from batch to batch;
    memory stays O(batch) however long a session is.
    """
    key, last_us, count = None, None, 0
    window_us = WINDOW_SECONDS * 1_000_000
    for pdf in batches:
        if pdf.empty:
            continue
        clients = pdf["client"].to_numpy()
        sessions = pdf["session"].to_numpy()
        ts_us = pdf["ts"].to_numpy(dtype="datetime64[us]").astype("int64")
        labels = []
        for c, s_, t in zip(clients, sessions, ts_us):
            if (c, s_) != key:
                key, last_us, count = (c, s_), None, 0
            if last_us is None or t - last_us > window_us:
                count, last_us = 1, t
                labels.append("allowed")
            elif count >= REQUESTS_PER_WINDOW:
                labels.append("rejected")
            else:
                count, last_us = count + 1, t
                labels.append("allowed")
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "client": clients, "label": labels})


def throttle_labels(requests: DataFrame) -> DataFrame:
    """T04 batch twin: allowed / rejected label of every request (client, ts, event_id).

    A gap of more than the window since the previous request always resets
    a client's counter, so the stream is cut into sessions at such gaps
    (skew-safe positions, no per-client window).  A session of at most
    REQUESTS_PER_WINDOW requests can never be throttled and is labelled in
    Catalyst; only longer sessions are labelled sequentially, in one
    ``mapInPandas`` pass over data hash-partitioned by session and sorted.
    A session spans only uninterrupted traffic of one client; a very long
    one streams through a single task with constant memory.
    """
    r = requests.select("client", "ts", "event_id")
    nb = index_within(r, ["client"], [F.asc("ts"), F.asc("event_id")], out="req_seq", carry=["ts"])
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    starts = nb.withColumn("is_start", F.when(F.col("prev_ts").isNull() | (gap > WINDOW_SECONDS * 1_000_000), 1)
                           .otherwise(0))
    sess = (index_within(starts, ["client"], [F.asc("ts"), F.asc("event_id")], out="_s", running_sum="is_start")
            .select("client", "ts", "event_id", F.col("_s_cum").alias("session")))
    sizes = sess.groupBy("client", "session").agg(F.count(F.lit(1)).alias("_n"))
    sized = sess.join(sizes, ["client", "session"])
    short = (sized.where(F.col("_n") <= REQUESTS_PER_WINDOW)
             .select("event_id", "client", F.lit("allowed").alias("label")))
    long = (sized.where(F.col("_n") > REQUESTS_PER_WINDOW).drop("_n")
            .repartition("client", "session").sortWithinPartitions("client", "session", "ts", "event_id")
            .mapInPandas(_throttle_partitions, "event_id long, client long, label string"))
    return short.unionByName(long)


def _throttle_state(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    last_seen, count = (state.get if state.exists else (None, 0))
    # a key's rows of one micro-batch can come in several chunks: order them all
    pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
    labels, last_seen, count = _throttle_rows(list(pdf["ts"]), last_seen, count)
    state.update((last_seen, count))
    state.setTimeoutTimestamp(int(pd.Timestamp(last_seen).timestamp() * 1000) + IDLE_DROP_SECONDS * 1000)
    if len(pdf):
        yield pd.DataFrame({"event_id": pdf["event_id"].values, "client": key[0], "label": labels})


def throttle_stream(requests_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T04 as a stream: O(1) state per client, dropped after an hour without requests."""
    return (requests_stream.select("client", "ts", "event_id").withWatermark("ts", watermark)
            .groupBy("client")
            .applyInPandasWithState(_throttle_state, "event_id long, client long, label string",
                                    "last_seen timestamp, count long", "append", GroupStateTimeout.EventTimeTimeout))


def requests_per_window(requests: DataFrame, seconds: int = WINDOW_SECONDS, limit: int = REQUESTS_PER_WINDOW) -> DataFrame:
    """T04 asked of a log: client, window_start, requests and how many of them are beyond the limit.

    Windows are fixed, so a client that never pauses is many keys, and counts are
    combined in each task.  The same aggregate runs over a stream with a watermark on ``ts``.
    """
    g = requests.groupBy("client", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("client", F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("over_limit"))


# --------------------------------------------------------------------------- T05

def vuln_trend_stream(roll_stream: DataFrame, period: str, watermark: str = "2 days") -> DataFrame:
    """Vulnerability trend per day / ISO week / month over a stream of finished analyses.

    Day and week are event-time windows (weeks start on Monday: the epoch
    was a Thursday, so the window start is offset by 4 days); months are not
    fixed-length and are grouped on their key.  Rows older than the
    watermark are dropped.
    """
    s = (roll_stream.where((F.col("status") == "completed") & F.col("source").isin(*LIBRARY_SOURCES))
         .withColumn("created_at", F.col("created_at").cast("timestamp"))
         .withWatermark("created_at", watermark))
    if period == "day":
        g = s.groupBy(F.window("created_at", "1 day").alias("w"))
        key = F.date_format("w.start", "yyyy-MM-dd")
    elif period == "week":
        g = s.groupBy(F.window("created_at", "7 days", "7 days", "4 days").alias("w"))
        key = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col("w.start")), F.weekofyear("w.start"))
    elif period == "month":
        # months are not fixed-length windows: group on the month key (update / complete output mode)
        g = s.groupBy(period_key("month").alias("period"))
        return g.agg(F.sum("vuln_count").cast("bigint").alias("vuln_count"))
    else:
        raise ValueError(period)
    return g.agg(F.sum("vuln_count").cast("bigint").alias("vuln_count")).select(key.alias("period"), "vuln_count")


# --------------------------------------------------------------------------- T01 / W08

def latest_documents(log: DataFrame, key: str = "analysis_id", mtime: str = "modified_at",
                     tiebreak: tuple[str, ...] = ("revision",)) -> DataFrame:
    """The newest revision of each document, by (mtime, tie-break columns) — a partial aggregate."""
    cols = [c for c in log.columns if c != key]
    ties = [F.col(c).alias(f"_t{i}") for i, c in enumerate(tiebreak) if c in log.columns]
    best = F.max(F.struct(F.col(mtime).alias("_m"), *ties, *[F.col(c) for c in cols]))
    return log.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def document_log_writer(log_path: str):
    """T01 sink: each micro-batch of documents lands in its own ``_epoch`` partition of a Parquet log.

    A replayed epoch (after a failure) overwrites only its own partition
    (dynamic partition overwrite), so the log never holds a batch twice.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("_epoch", F.lit(epoch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_epoch").parquet(log_path))
    return write


def incremental_documents(doc_stream: DataFrame, log_path: str, checkpoint: str, trigger_once: bool = True):
    """Pick up new/changed documents and append them to the log; readers take W08 on read."""
    w = doc_stream.writeStream.foreachBatch(document_log_writer(log_path)).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


# --------------------------------------------------------------------------- T06

def pending_feed(results_stream: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Results still lacking a response and not yet scored (stream-static anti-join)."""
    return (results_stream.where(F.coalesce(F.col("ai_response"), F.lit("")) == "")
            .join(scored.select(*keys), keys, "left_anti"))
