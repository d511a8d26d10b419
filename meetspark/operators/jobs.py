"""Jobs and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

DAY = 24 * 3600
ORPHANED = "no sign of life"


def latest_stage(events: DataFrame) -> DataFrame:
    """``events(job_id, stage, ts, ord, value)``: the last event of each stage and the order in which stages came."""
    last = events.groupBy("job_id", "stage").agg(F.max_by("value", F.struct("ts", "ord")).alias("value"), F.max("ts").alias("ts"), F.min(F.struct("ts", "ord")).alias("first"))
    return last.select("job_id", "stage", "value", "ts", F.row_number().over(Window.partitionBy("job_id").orderBy("first")).cast("long").alias("pos"))


def job_state(events: DataFrame, terminal: str = "error") -> DataFrame:
    """First and last time, first terminal time, and the state."""
    out = events.groupBy("job_id").agg(F.min("ts").alias("started"), F.max("ts").alias("seen"), F.min(F.when(F.col("stage") == terminal, F.col("ts"))).alias("finished_at"))
    return out.withColumn("state", F.when(F.col("finished_at").isNull(), "running").otherwise("done"))


def job_states(jobs: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """``job_id, state, started_at, finished_at`` of ``jobs(job_id, created_at, expires_at)`` with ``changes(job_id, ord, ts, state, has_chapters)``.

    A job without changes is ``queued``; else the latest change (by time, then ord) gives ``running``, ``done`` or ``failed``, where a failure
    of a job that has its chapters is ``done``: only titles are missing. From ``expires_at`` on (at ``now``, if given) it is
    ``expired``. ``finished_at`` is the first end and never moves.
    """
    ended = F.col("state").isin("done", "failed")
    state = F.when((F.col("state") == "failed") & F.coalesce("has_chapters", F.lit(False)), "done").otherwise(F.col("state"))
    last = changes.groupBy("job_id").agg(F.max_by(state, F.struct("ts", "ord")).alias("state"), F.min(F.when(F.col("state") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(ended, F.col("ts"))).alias("finished_at"))
    out = jobs.join(last, "job_id", "left")
    over = F.lit(False) if now is None else F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return out.select("job_id", F.when(over, "expired").otherwise(F.coalesce("state", F.lit("queued"))).alias("state"), "started_at", "finished_at")


def rate_limit(requests: DataFrame, cap: int | None = 5, window_sec: int = DAY) -> DataFrame:
    """``client, ord, n_before, exceeded``: requests of the same client in the window before each one (itself not counted, a request
    exactly ``window_sec`` old is), and whether the cap is reached. Without a cap, and for rows whose ``loopback`` is true (if there is such a
    column), nothing is exceeded."""
    t = F.unix_micros("ts")
    w = Window.partitionBy("client").orderBy(t).rangeBetween(-window_sec * 1_000_000, 0)
    local = F.coalesce(F.col("loopback"), F.lit(False)) if "loopback" in requests.columns else F.lit(False)
    over = F.lit(False) if cap is None else (F.col("n_before") >= cap) & ~local
    return requests.withColumn("n_before", F.count("*").over(w) - 1).select("client", "ord", "n_before", over.alias("exceeded"))


def admission(requests: DataFrame, per_day: int | None = 5, concurrent: int | None = 1, queue: int | None = 3, slice_sec: float = 60.0) -> DataFrame:
    """Which of ``requests(client, ord, ts, loopback, started, ended)`` (times in seconds; ord unique) break a limit, in the order of the live check.

    ``status, reason``: 429 ``address`` at ``per_day`` requests of the client in the day before (not for loopback), then 409 ``concurrent`` at that
    many jobs of any client queued or running, then 409 ``queue`` at that many queued, else 200. A job waits from ``ts`` to ``started`` and is active until
    ``ended``; what ends at a moment is over by then, requests of one moment go by ord. A limit of None is off. The counts over all
    jobs are a sweep in slices of time with carries, never one sorted list.
    """
    edge = lambda t, rank, active, queued, own: F.struct(F.col(t).alias("t"), F.lit(rank).alias("rank"), F.lit(active).alias("a"), F.lit(queued).alias("q"), F.lit(own).alias("own"))
    jobs = requests.select("client", "ord", "loopback", F.col("ts"), F.greatest("ts", "started").alias("started"), F.greatest("ts", "started", "ended").alias("ended"))
    steps = jobs.select(F.lit("all").alias("all"), "ord", F.inline(F.array(edge("ts", 2, 1, 1, True), edge("started", 1, 0, -1, False), edge("ended", 1, -1, 0, False))))
    # what a request of no length at all takes back comes after it
    steps = steps.join(jobs.select("ord", "ts"), "ord").withColumn("rank", F.when(F.col("own"), 1).when(F.col("t") == F.col("ts"), 2).otherwise(0)).drop("ts")
    swept = running(steps, ["t", "rank", "ord", "own", "a"], {"active": ("sum", F.col("a")), "queued": ("sum", F.col("q"))}, at="t", width=slice_sec, key="all").filter("own")
    counts = swept.select("ord", (F.col("active") - 1).cast("long").alias("active"), (F.col("queued") - 1).cast("long").alias("queued"))
    timed = jobs.select("client", "ord", "loopback", F.timestamp_micros(F.round(1e6 * F.col("ts")).cast("long")).alias("ts"))
    out = jobs.select("client", "ord").join(rate_limit(timed, per_day).select("ord", "n_before", "exceeded"), "ord").join(counts, "ord")
    full = lambda c, most: F.lit(False) if most is None else F.col(c) >= most
    reason = F.when(F.col("exceeded"), "address").when(full("active", concurrent), "concurrent").when(full("queued", queue), "queue")
    return out.withColumn("reason", reason).select("client", "ord", "n_before", "active", "queued", F.when(F.col("reason").isNull(), 200).when(F.col("reason") == "address", 429).otherwise(409).alias("status"), "reason")


def admission_audit(jobs: DataFrame, concurrent: int = 3) -> DataFrame:
    """Jobs open at the same time as each job of ``jobs(client, ord, start, end)`` starts: a sweep of starts and ends."""
    opens = jobs.select("client", "ord", F.col("start").alias("t"), F.lit(1).alias("step"))
    closes = jobs.select("client", F.lit(None).cast("long").alias("ord"), F.col("end").alias("t"), F.lit(-1).alias("step"))
    w = Window.partitionBy("client").orderBy("t", "step", "ord")
    return opens.unionByName(closes).withColumn("open", F.sum("step").over(w)).filter("step = 1").select("client", "ord", "open", (F.col("open") > concurrent).alias("refused"))


def expired(jobs: DataFrame, now) -> DataFrame:
    return jobs.filter(F.col("expires_at") <= now)


def stale_staging(staged: DataFrame, now, hours: float = 6.0) -> DataFrame:
    """Rows of ``staged(staging_id, created_at, modified)`` at least ``hours`` old; text times without a zone are UTC, and a time that
    can't be read gives way to the time of the file."""
    at = F.coalesce(F.try_to_timestamp("created_at"), F.col("modified"))
    return staged.filter(F.unix_micros(now) - F.unix_micros(at) >= int(hours * 3_600_000_000)).select("staging_id")


def stalled_jobs(states: DataFrame, now, timeout_sec: int) -> DataFrame:
    """Running jobs without an event for ``timeout_sec``."""
    return states.filter((F.col("state") == "running") & (F.unix_micros("seen") < F.unix_micros(now) - timeout_sec * 1_000_000)).select("job_id", "seen")


def failure_events(stalled: DataFrame, now: Column) -> DataFrame:
    """The events that end jobs of ``stalled_jobs``: ``job_id, stage, status, pct, message, ts``."""
    return stalled.select("job_id", F.lit("worker").alias("stage"), F.lit("failed").alias("status"), F.lit(0).alias("pct"), F.lit(ORPHANED).alias("message"), now.alias("ts"))


def progress(stages: DataFrame, total: int) -> DataFrame:
    """Percent of ``total`` stages seen, cut to a whole number, and the latest stage."""
    return stages.groupBy("job_id").agg(F.floor(100 * F.count("*") / total).cast("long").alias("pct"), F.max_by("stage", F.struct("ts", "pos")).alias("label"))


def job_progress(jobs: DataFrame, stages: DataFrame, total: int, now: Column) -> DataFrame:
    """``job_id, pct, stage, elapsed_sec`` of ``jobs(job_id, state, created_at, finished_at)`` with ``stages(job_id, pos, stage, status, pct, runtime_sec)``.

    100 for a done job; else stages done, and the share of the first one running, of ``total``, cut to a whole number; while the job runs not
    less than the active stage itself reports. The active stage is the latest one running, or the latest of all. Elapsed: from
    creation to the end of a job that ended, or where that is unknown its stages' runtimes if there are any, else until ``now``; whole seconds, 0 at least.
    """
    pos = F.col("pos")
    is_running = F.col("status") == "running"
    share = F.coalesce(F.col("pct").cast("double"), F.lit(0.0)) / 100
    of = stages.groupBy("job_id").agg(
        F.count(F.when(F.col("status") == "done", 1)).alias("done"), F.min_by(share, F.when(is_running, pos)).alias("share"), F.max_by(F.struct("stage", "pct"), F.when(is_running, pos)).alias("busy"), F.max_by(F.struct("stage", "pct"), pos).alias("latest"), F.sum("runtime_sec").alias("runtime")
    )
    met = jobs.join(of, "job_id", "left").withColumn("active", F.coalesce("busy", "latest"))
    rough = F.floor(100 * (F.coalesce("done", F.lit(0)) + F.coalesce("share", F.lit(0.0))) / max(total, 1) + 1e-9)
    rough = F.least(F.greatest(rough, F.lit(0)), F.lit(100)).cast("long")
    own = F.when(F.col("state") == "running", F.floor(F.col("active.pct")).cast("long"))
    whole = lambda a, b: F.greatest(F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000), F.lit(0)).cast("long")
    ended = F.col("state").isin("done", "failed")
    elapsed = F.when(ended & F.col("finished_at").isNotNull(), whole(F.col("created_at"), F.col("finished_at"))).when(ended & (F.col("runtime") > 0), F.floor("runtime").cast("long")).otherwise(whole(F.col("created_at"), now))
    return met.select("job_id", F.when(F.col("state") == "done", F.lit(100).cast("long")).otherwise(F.greatest(rough, own)).alias("pct"), F.col("active.stage").alias("stage"), elapsed.alias("elapsed_sec"))


#: stages in order and the artifact that each makes; a valid transcript stands for all stages up to recognition
STEPS = (("normalize", "audio"), ("vad", "regions"), ("diarize", "turns"), ("asr", "transcript"), ("chunk", "chapters"), ("titles", "chapters"), ("extract", "insights"), ("report", "report"))
IMPLIED = {"transcript": ("normalize", "vad", "diarize", "asr")}


def stage_plan(artifacts: DataFrame, chapters: DataFrame, available: list[str] | None = None, steps: tuple = STEPS, implied: dict = IMPLIED) -> DataFrame:
    """``job_id, pos, stage, status`` of every job of ``artifacts(job_id, artifact, valid)``: ``done``, ``pending``, or ``unavailable`` if the stage is not
    in ``available`` (all are, by default).

    A stage is done if its artifact is valid, or a valid artifact implies it (``implied``: artifact to stages). ``titles`` also needs a
    title that is not blank for each of the job's ``chapters(job_id, title)``.
    """
    valid = F.collect_set(F.when(F.col("valid"), F.col("artifact")))
    untitled = chapters.groupBy("job_id").agg(F.count(F.when(F.trim(F.coalesce("title", F.lit(""))) == "", 1)).alias("untitled"))
    jobs = artifacts.groupBy("job_id").agg(valid.alias("valid")).join(untitled, "job_id", "left")
    rows = []
    for pos, (stage, artifact) in enumerate(steps):
        done = F.array_contains("valid", artifact)
        if stage == "titles":
            done = done & (F.coalesce("untitled", F.lit(0)) == 0)
        for origin, stages in implied.items():
            if stage in stages:
                done = done | F.array_contains("valid", origin)
        missing = "pending" if available is None or stage in available else "unavailable"
        rows.append(F.struct(F.lit(pos).cast("long").alias("pos"), F.lit(stage).alias("stage"), F.when(done, "done").otherwise(missing).alias("status")))
    return jobs.select("job_id", F.inline(F.array(*rows)))


def artifact_completeness(stages: DataFrame, expected: list[str]) -> DataFrame:
    """done or pending for every expected stage of every job."""
    jobs = stages.select("job_id").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, expected))))
    return jobs.join(stages.select("job_id", "stage", F.lit("done").alias("s")), ["job_id", "stage"], "left").select("job_id", "stage", F.coalesce("s", F.lit("pending")).alias("status"))


def time_to_first(events: DataFrame, stage: str) -> DataFrame:
    """Seconds from a job's first event to its first of a stage."""
    out = events.groupBy("job_id").agg(F.min("ts").alias("a"), F.min(F.when(F.col("stage") == stage, F.col("ts"))).alias("b"))
    return out.filter("b IS NOT NULL").select("job_id", F.round((F.unix_micros("b") - F.unix_micros("a")) / 1e6, 3).alias("sec"))


def stage_timings(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def stage_runtimes(documents: DataFrame) -> DataFrame:
    """``stage, n, total_sec, mean_sec, median_sec, longest_sec`` over ``documents(job_id, stage, runtime_sec)``, one for each artifact made; those without a
    runtime are not counted."""
    r = F.col("runtime_sec")
    known = documents.filter(r.isNotNull()).groupBy("stage")
    return known.agg(F.count("*").alias("n"), F.round(F.sum(r), 3).alias("total_sec"), F.round(F.avg(r), 3).alias("mean_sec"), F.round(F.percentile(r, F.lit(0.5)), 3).alias("median_sec"), F.round(F.max(r), 3).alias("longest_sec"))
