"""Jobs, limits and sessions as pure functions of tables; ``as_of`` stands where a clock would. Nothing locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: job types, those with lanes, and the lane that each gets by default
JOB_TYPES = [
    "shell_file_processing", "ai_processing", "data_migration", "audit_cleanup", "system_maintenance", "notification_delivery",
    "report_generation", "backup_operation", "semantic_processing", "consent_verification", "provider_verification",
]
LANES = {"shell_file_processing": ["standard_queue", "fast_queue"], "ai_processing": ["ai_queue_simple", "ai_queue_complex"]}
DONE = ("completed", "failed", "cancelled")


def later(at: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, at)


def stale(jobs: DataFrame, as_of: Column, seconds: int) -> Column:
    return (F.col("status") == "processing") & (F.col("heartbeat_at") < later(as_of, F.lit(-seconds)))


def enqueued(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with their lane and estimated tokens, refused jobs with the reason).

    ``jobs`` has job_id, job_type, payload (JSON). A lane comes from the payload or the type; some types must have none.
    """
    told = F.get_json_object("payload", "$.job_lane")
    default = F.when(F.col("job_type") == "ai_processing", "ai_queue_simple").when(F.col("job_type") == "shell_file_processing", "standard_queue")
    rows = jobs.withColumn("job_lane", F.coalesce(told, default))
    wrong_lane = F.coalesce(*(F.when(F.col("job_type") == t, ~F.col("job_lane").isin(*lanes)) for t, lanes in LANES.items()),
        F.col("job_lane").isNotNull())
    reason = (
        F.when(~F.col("job_type").isin(*JOB_TYPES), "invalid_job_type").when(wrong_lane, "invalid_job_lane")
        .when(F.col("payload").isNull() | (F.trim("payload") == "{}"), "empty_payload")
    )
    rows = rows.withColumn("reason", reason)
    tokens = F.coalesce(F.get_json_object("payload", "$.estimated_tokens").try_cast("int"), F.lit(1000))
    return rows.where("reason IS NULL").drop("reason").withColumn("estimated_tokens", tokens), rows.where("reason IS NOT NULL").select("job_id",
        "job_type", "reason")


def delayed(jobs: DataFrame, limits: DataFrame, provider: str, endpoint: str) -> DataFrame:
    """AI jobs put off by the delay of a provider whose use is over its threshold."""
    use = F.try_divide(F.col("requests_used").cast("double"), F.nullif("requests_per_minute", F.lit(0)))
    over = limits.where((F.col("provider") == provider) & (F.col("endpoint") == endpoint) & (F.col("status") == "active") & (use > F.col("threshold")))
    wait = over.agg(F.coalesce(F.max("delay_seconds"), F.lit(0)).alias("_wait"))  # one row
    put_off = F.when(F.col("job_type") == "ai_processing", F.col("_wait")).otherwise(0)
    return jobs.crossJoin(F.broadcast(wait)).withColumn("scheduled_at", later(F.col("scheduled_at"), put_off)).drop("_wait")


def claimed(jobs: DataFrame, as_of: Column, types: list[str] | None = None, lanes: list[str] | None = None, workers: int = 1, timeout: int = 300,
    jitter: int = 60) -> DataFrame:
    """Every job with the action that a claim takes on it (T05, L11, N17): reclaim or dead_letter where its worker has been silent too
    long, claim for the first ``workers`` pending ones by priority and age, else none; and its status, retries and schedule.

    The jitter of a reclaimed job is a hash of its id, so that the result is the same on every run. The wanted pending
    jobs are found by a sort with a limit, not by ranking all jobs in one task.
    """
    silent = stale(jobs, as_of, timeout)
    wanted = (F.col("status") == "pending") & (F.col("scheduled_at") <= as_of)
    if types is not None:
        wanted = wanted & F.col("job_type").isin(*types)
    if lanes is not None:
        wanted = wanted & F.col("job_lane").isin(*lanes)
    next_ones = jobs.where(wanted).orderBy(F.desc("priority"), "created_at", "job_id").limit(workers).select("job_id", F.lit(True).alias("_next"))
    rows = jobs.join(next_ones, "job_id", "left")
    action = F.when(silent & (F.col("retry_count") < F.col("max_retries")), "reclaim").when(silent, "dead_letter").when(F.col("_next"),
        "claim").otherwise("none")
    wait = F.pmod(F.xxhash64("job_id"), F.lit(jitter + 1)).cast("int")
    status = F.when(action == "reclaim", "pending").when(action == "dead_letter", "failed").when(action == "claim",
        "processing").otherwise(F.col("status"))
    return rows.select(
        "job_id", action.alias("action"), status.alias("status"),
            (F.col("retry_count") + F.when(action == "reclaim", 1).otherwise(0)).alias("retry_count"),
        F.when(action == "reclaim", later(as_of, wait)).otherwise(F.col("scheduled_at")).alias("scheduled_at"),
    )


def watchdog(jobs: DataFrame, as_of: Column, seconds: int = 120) -> DataFrame:
    """One row: how many silent jobs go back to the queue and how many have failed for good."""
    silent = stale(jobs, as_of, seconds)
    again = F.col("retry_count") < F.col("max_retries")
    return jobs.agg(F.count_if(silent & again).alias("requeued"), F.count_if(silent & ~again).alias("failed"))


def transitions(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after their updates (job_id, new_status, at, error) in order of time (T07, N14, N16): the first start is kept, an
    end and a duration come with a status that ends a job, later values win where they are not null."""
    u = updates.groupBy("job_id").agg(
        F.max_by("new_status", F.struct("at", "new_status")).alias("_status"),
            F.min(F.when(F.col("new_status") == "processing", F.col("at"))).alias("_start"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "new_status"))).alias("_error"), F.max("at").alias("_at"),
    )
    rows = jobs.join(u, "job_id", "left")
    start = F.coalesce("started_at", "_start")
    end = F.when(F.col("_status").isin(*DONE), F.col("_at")).otherwise(F.col("completed_at"))
    return rows.select(
        "job_id", F.coalesce("_status", "status").alias("status"), start.alias("started_at"), end.alias("completed_at"),
            F.coalesce("_error", "error").alias("error"),
        F.timestamp_diff("SECOND", start, end).alias("duration_seconds"),
    )


def window_limit(events: DataFrame, key: list[str], seconds: str, tie: str, limit: int | None = 100, window: int = 60, tokens: str | None = None,
    token_limit: int | None = None) -> DataFrame:
    """Adds ``allowed``: at most ``limit`` events, and ``token_limit`` tokens, of a key in a window that opens with the first event
    more than ``window`` seconds after the last one opened (T02, T03). Denied events count for nothing.

    A window is anchored where the one before it expired, so the answer depends on all earlier events of the key. Spark deals
    events by key and sorts each partition by key and time; one pass over it keeps three numbers, whatever the size
    of a key. Keys are independent, but one key is one pass.
    """
    import pyarrow as pa

    names = [*key, seconds]

    def passes(batches):
        own, opened, count, used = None, 0.0, 0, 0
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in names]
            asked = batch.column(tokens).to_pylist() if tokens else [0] * batch.num_rows
            for *k, t, n in zip(*columns, asked, strict=True):
                if k != own:
                    own, opened, count, used = k, t, 0, 0
                if t > opened + window:
                    opened, count, used = t, 0, 0
                fine = (limit is None or count < limit) and (token_limit is None or used + (n or 0) <= token_limit)
                count, used = count + fine, used + (n or 0) * fine
                out.append(fine)
            yield batch.append_column("allowed", pa.array(out, pa.bool_()))

    dealt = events.repartition(*key).sortWithinPartitions(*key, seconds, tie)
    return dealt.mapInArrow(passes, dealt.withColumn("allowed", F.lit(True)).schema)


def usage_by_month(events: DataFrame, limits: DataFrame, profile: str = "profile_id") -> DataFrame:
    """Per profile and month: files, pages and tokens, the percentage of each limit and whether one is passed.

    ``events`` has profile, at, files, pages, tokens, seconds; ``limits`` profile, files_limit, pages_limit, tokens_limit (null: none).
    Minutes are whole ones.
    """
    month = F.trunc(F.col("at").cast("date"), "month").alias("month")
    sums = events.groupBy(profile, month).agg(*(F.sum(c).alias(c) for c in ("files", "pages", "tokens")),
        F.floor(F.sum("seconds") / 60).alias("minutes"))
    rows = sums.join(limits, profile, "left")
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.nullif(f"{c}_limit", F.lit(0))), 1).alias(f"{c}_percent")
    over = [F.coalesce(F.col(c) > F.col(f"{c}_limit"), F.lit(False)) for c in ("files", "pages", "tokens")]
    return rows.select(profile, "month", "files", "pages", "tokens", "minutes", share("files"), share("pages"), share("tokens"),
        (over[0] | over[1] | over[2]).alias("over_limit"))


def session_metrics(chunks: DataFrame, pendings: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session: chunks, tokens, cost, confidence, elapsed milliseconds, fragments, their kinds, and why to review.

    Each side is counted before they meet, so that nothing is counted twice (A29, J08).
    """
    c = chunks.groupBy(session).agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
            F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.timestamp_diff("MILLISECOND", F.min("started_at"), F.max("completed_at")).alias("elapsed_ms"),
            F.count_if(F.col("status") == "failed").alias("failed"),
    )
    p = pendings.groupBy(session).agg(
        F.count_if(F.col("status") == "pending").alias("open_fragments"),
            F.count_distinct(F.when(F.col("is_cascading"), F.col("cascade_id"))).alias("cascades"),
        F.array_sort(F.collect_set("encounter_type")).alias("kinds"),
    )
    rows = c.join(p, session, "left").withColumns({"open_fragments": F.coalesce("open_fragments", F.lit(0)),
        "cascades": F.coalesce("cascades", F.lit(0)), "kinds": F.coalesce("kinds", F.array().cast("array<string>"))})
    reasons = F.filter(F.array(F.when(F.col("open_fragments") > 0, "fragments_left"), F.when(F.col("confidence") < 0.7, "low_confidence"),
        F.when(F.col("failed") > 0, "failed_chunks")), lambda r: r.isNotNull())
    return rows.withColumn("reasons", reasons)


def batch_rollup(batches: DataFrame, parent: str, index: str = "batch_index") -> DataFrame:
    """Per parent: batches that succeeded and failed, retries beyond the first attempt, the first failed one and its error, sums of those
    that succeeded, and the status (A17, A18, D23)."""
    good = F.col("status") == "succeeded"
    bad = F.when(~good, F.col(index))
    rows = batches.groupBy(parent).agg(
        F.count("*").alias("batches"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"),
        F.greatest(F.sum("attempts") - F.count("*"), F.lit(0)).alias("retries"), F.min(bad).alias("first_failed"),
            F.min(F.when(~good, F.struct(F.col(index).alias("i"), F.col("error_code").alias("e"))))["e"].alias("error_code"),
        F.coalesce(F.sum(F.when(good, F.col("entities"))), F.lit(0)).alias("entities"),
            F.coalesce(F.sum(F.when(good, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
    return rows.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("succeeded"))


def batch_sizes(batches: DataFrame, pages: str) -> DataFrame:
    """One row: number, mean, least, greatest and sum of pages a batch; zeros where there is none."""
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    return batches.agg(F.count(pages).alias("batches"), zero(F.round(F.avg(pages), 6), 0.0).alias("mean"), zero(F.min(pages)).alias("least"),
        zero(F.max(pages)).alias("most"), zero(F.sum(pages)).alias("pages"))


def retry_wait(attempt: Column, retry_after: Column, as_of: Column, base: int = 1000, cap: int = 60_000, spare: int = 300_000,
    most: int = 3) -> Column:
    """Milliseconds to wait (N42, F74): what Retry-After says in seconds or as a date, else the capped exponential; a longer time
    once attempts are used up. Jitter is left to the caller."""
    seconds = retry_after.try_cast("double") * 1000
    told = F.regexp_extract(retry_after, r"(\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    date = F.timestamp_diff("MILLISECOND", as_of, F.try_to_timestamp(F.concat(told, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss xxxx")))
    own = F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt - 1))
    return F.when(attempt > most, F.lit(float(spare))).otherwise(F.coalesce(seconds,
        F.when(date.isNotNull(), F.greatest(date, F.lit(0)).cast("double")), own))


def uploads(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Each upload request with the file it stands for and whether that is new (S22): the first request of an idempotency key makes a
    file unless there is one already; requests without a key are new ones each."""
    order = Window.partitionBy("idempotency_key").orderBy("at", "request_id")
    rows = requests.withColumn("_first", F.first("request_id").over(order)).join(known.select("idempotency_key", F.col("file_id").alias("_file")),
        "idempotency_key", "left")
    keyed = F.col("idempotency_key").isNotNull()
    file = F.when(keyed, F.coalesce("_file", "_first")).otherwise(F.col("request_id"))
    return rows.select("request_id", file.alias("file_id"),
        (~keyed | (F.col("_file").isNull() & (F.col("_first") == F.col("request_id")))).alias("is_new"))


def carried_context(chunks: DataFrame, session: str, chunk: str, value: str, first: str) -> DataFrame:
    """Adds what each chunk hands on and what it got from the one before; the first gets ``first``."""
    return chunks.withColumn("context", F.coalesce(F.lag(value).over(Window.partitionBy(session).orderBy(chunk)), F.lit(first)))
