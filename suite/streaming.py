"""Streams replayed from the driver's files and compared with the batch result."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from riskloom.operators import decision, drift, explain, shadow
from riskloom.operators.monitor import LATENCY_BUCKETS
from riskloom.operators.scale import fit_scaling
from riskloom.plans.batch_scoring import REASONS, responses
from riskloom.session import shared_folder
from riskloom.streaming import days, jobs, service, sinks

from .evaluation import _SCORE_LIST, SCORE_SQL
from .explanation import _REASONS, COEFFICIENTS, FEATURES, _filled
from .monitoring import SHADOW_SQL
from .quality import _APPLICATION_CASES
from .registry import query, rounded
from .views import _TEXTS, RECENT_REFERENCE, table, with_views


def _source(spark, folder, name):
    """A driver table as a stream of files."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _stream(spark, folder, name):
    """A derived view over a streamed table; a second table it needs stays static."""
    text, needed = _TEXTS[name]
    parts = {}
    for i, n in enumerate(needed):
        if i > 0:
            parts[n] = table(spark, folder, n)
        else:
            parts[n] = _stream(spark, folder, n) if n in _TEXTS else _source(spark, folder, n)
    return spark.sql(text, **parts)


_VALID = " AND ".join(f"coalesce({c}, false)" for _, c in _APPLICATION_CASES)


@query(
    "stream_application_scoring",
    with_views(
        ["scored", "borrowers"],
        f"""SELECT {_SCORE_LIST} FROM ({SCORE_SQL.format(ead='7500::DOUBLE')}) s
WHERE borrower_id IN (SELECT borrower_id FROM borrowers WHERE {_VALID})""",
    ),
)
def _(spark, folder):
    applications = _stream(spark, folder, "borrowers").withColumn("application_id", F.col("borrower_id"))

    def score(valid):
        scored = spark.sql(_TEXTS["scored"][0], borrowers=valid)
        return decision.score_frame(scored, keep=["borrower_id"])

    path = shared_folder(spark, "stream-scores")
    sinks.drain(jobs.scored_stream(applications, score), path)
    return rounded(sinks.read_batches(spark, path))


def _arrivals(spark, frames, run, pieces=3, closing=None):
    """Replays tables as streams: ``run`` drains after each of ``pieces`` arrivals, cut by the order column.

    Every drain starts anew from its checkpoint. ``frames`` holds a table and its order column per stream; the cuts
    are those of the first. ``closing`` names rows that arrive last, by which watermarks pass all others.
    """

    def place(df, order):
        kept = F.col(order).cast("timestamp") if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
        return kept.cast("double")

    df, order = next(iter(frames.values()))
    low, high = df.agg(F.min(place(df, order)), F.max(place(df, order))).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    cuts = [low + (high - low) * i / pieces for i in range(1, pieces)]
    base = shared_folder(spark, "arrivals")
    for i in range(pieces + (closing is not None)):
        for name, (df, order) in frames.items():
            if i == pieces:
                part = closing[name]
            else:
                at = F.coalesce(place(df, order), F.lit(low))
                part = df.where((at >= cuts[i - 1] if i else F.lit(True)) & (at < cuts[i] if i < pieces - 1 else F.lit(True)))
            part.write.mode("append").parquet(f"{base}/{name}")
        run(*[spark.readStream.schema(df.schema).parquet(f"{base}/{n}") for n, (df, _) in frames.items()])


_MESSAGE_BROKEN = "borrower_id % 29 = 0"


def _service(spark, folder):
    """Applications as JSON messages, some cut off, through the service; returns its folder."""
    applications = table(spark, folder, "borrowers").withColumn("application_id", F.col("borrower_id"))
    whole = F.to_json(F.struct(*applications.columns))
    text = F.when(F.expr(_MESSAGE_BROKEN), F.substring(whole, 1, 60)).otherwise(whole)
    messages = applications.select("borrower_id", text.alias("value"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in applications.schema)
    scaling = fit_scaling(_filled(table(spark, folder, "borrowers")), FEATURES)

    def decide(valid):
        explained = explain.linear_contributions(_filled(valid), COEFFICIENTS, scaling)
        reasons = explain.notice(explain.adverse_reasons(explained), "borrower_id")
        scored = valid.sparkSession.sql(_TEXTS["scored"][0], borrowers=valid).join(reasons, "borrower_id")
        scored = scored.withColumn("application_id", F.col("borrower_id"))
        return responses(decision.score_frame(scored, keep=["application_id", REASONS]))

    path = shared_folder(spark, "service")

    def run(stream):
        service.decide_stream(stream, schema, decide, path).awaitTermination()

    _arrivals(spark, {"messages": (messages, "borrower_id")}, run)
    return path


@query(
    "stream_decision_service",
    with_views(
        ["borrowers", "scored"],
        f"""{_REASONS},
notices AS (SELECT borrower_id, string_agg(code || ': ' || description, '; ' ORDER BY slot) AS notice FROM reasons
  GROUP BY borrower_id)
SELECT borrower_id AS application_id, credit_score, risk_tier, round(pd, 6) AS probability_of_default,
  round(lgd, 6) AS loss_given_default, round(ead, 6) AS exposure_at_default, round(expected_loss, 6) AS expected_loss,
  fraud_score, fraud_flag, decision, CASE WHEN decision = 'declined' THEN coalesce(notice, '') END AS reasons
FROM ({SCORE_SQL.format(ead='7500::DOUBLE')}) s LEFT JOIN notices USING (borrower_id)
WHERE borrower_id IN (SELECT borrower_id FROM borrowers WHERE {_VALID} AND NOT {_MESSAGE_BROKEN})""",
    ),
)
def _(spark, folder):
    replies = service.read_decisions(spark, _service(spark, folder))
    lines = F.transform(REASONS, lambda r: F.concat(r["code"], F.lit(": "), r["reason"]))
    replies = replies.withColumn("reasons", F.array_join(lines, "; "))
    return rounded(replies.drop(REASONS, "batch", "batch_id", "model_version", "scored_at"))


@query(
    "stream_quarantine",
    with_views(
        ["borrowers"],
        f"""SELECT CASE WHEN NOT {_MESSAGE_BROKEN} THEN borrower_id END AS application_id, reasons FROM
(SELECT borrower_id, CASE WHEN {_MESSAGE_BROKEN} THEN 'message' ELSE concat_ws(',', """
        + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _APPLICATION_CASES)
        + ") END AS reasons FROM borrowers) q WHERE reasons <> ''",
    ),
)
def _(spark, folder):
    refused = service.read_quarantine(spark, _service(spark, folder))
    return refused.select("application_id", F.concat_ws(",", "violations").alias("reasons"))


@query(
    "stream_service_totals",
    with_views(
        ["borrowers"],
        f"""SELECT count(*) AS received, count(*) FILTER ({_VALID} AND NOT {_MESSAGE_BROKEN}) AS total_processed,
  true AS timed FROM borrowers""",
    ),
)
def _(spark, folder):
    return service.finished_batches(spark, _service(spark, folder)).agg(
        F.sum("received").alias("received"),
        F.sum("total_processed").alias("total_processed"),
        F.every(F.col("processing_time_ms") > 0).alias("timed"),
    )


@query("stream_shadow_log", with_views(["scored"], SHADOW_SQL + " SELECT application_id, agreement FROM logged"))
def _(spark, folder):
    applications = _stream(spark, folder, "scored").withColumnRenamed("borrower_id", "application_id")
    path = shared_folder(spark, "stream-shadow")
    sinks.drain(jobs.shadow_stream(applications, "pd", "challenger_pd", traffic=0.8), path)
    return sinks.read_batches(spark, path).select("application_id", "agreement")


_ANSWERED = "application_id % 15 <= 10 AND application_id % 17 <> 3"
_FAILED = "application_id % 13 = 4"


def _shadow_pairs(spark, folder):
    """Champion and challenger as two streams; some answers are late, some absent, some without a probability."""
    scored = table(spark, folder, "scored").withColumnRenamed("borrower_id", "application_id")
    key = F.col("application_id")
    champion = scored.select(
        "application_id",
        F.col("pd").alias("champion_pd"),
        "fraud_score",
        (key % 40 / 8 + 3).alias("champion_ms"),
        F.timestamp_seconds(key * 10 + 1704067200).alias("scored_at"),
    )
    challenger = scored.where("application_id % 17 <> 3").select(
        "application_id",
        F.when(~F.expr(_FAILED), F.col("challenger_pd")).alias("challenger_pd"),
        (key % 24 / 8 + 4).alias("challenger_ms"),
        F.timestamp_seconds(key * 10 + 1704067200 + key % 15 * 60).alias("scored_at"),
    )
    closing = {
        name: df.limit(1).select(
            *[
                F.timestamp_seconds(F.lit(4102444800)).alias(c) if c == "scored_at"
                else F.lit(-1).cast(t).alias(c) if c == "application_id" else F.col(c)
                for c, t in df.dtypes
            ]
        )
        for name, df in (("champion", champion), ("challenger", challenger))
    }
    path = shared_folder(spark, "stream-pairs")
    _arrivals(
        spark,
        {"champion": (champion, "scored_at"), "challenger": (challenger, "scored_at")},
        lambda first, second: sinks.drain(jobs.shadow_pairs(first, second), path),
        closing=closing,
    )
    return sinks.read_batches(spark, path).where("application_id >= 0")


@query(
    "stream_shadow_pairs",
    with_views(
        ["scored"],
        SHADOW_SQL
        + f""" SELECT *, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(application_id * 10),
  '%Y-%m-%d %H:%M:%S') AS timestamp FROM logged WHERE {_ANSWERED} AND NOT {_FAILED}""",
    ),
)
def _(spark, folder):
    log = shadow.shadow_log(
        _shadow_pairs(spark, folder), "champion_pd", "challenger_pd", traffic=0.8, timestamp="scored_at",
        latencies=("champion_ms", "challenger_ms"),
    )
    return log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_shadow_misses",
    with_views(
        ["scored"],
        f"""SELECT application_id, CASE WHEN {_ANSWERED} THEN 'failed' ELSE 'no answer' END AS reason
FROM (SELECT borrower_id AS application_id FROM scored) s WHERE NOT ({_ANSWERED}) OR {_FAILED}""",
    ),
)
def _(spark, folder):
    return jobs.shadow_misses(_shadow_pairs(spark, folder), "challenger_pd")


_BUCKETS = {f"le_{b * 1000:g}ms": b for b in LATENCY_BUCKETS}


@query(
    "stream_request_windows",
    with_views(
        ["requests"],
        """SELECT strftime(date_trunc('minute', requested_at), '%Y-%m-%d %H:%M') AS window_start, endpoint, status,
  count(*) AS requests, round(sum(latency_seconds), 6) AS latency_sum, """
        + ", ".join(f"count(*) FILTER (latency_seconds <= {b}) AS {n}" for n, b in _BUCKETS.items())
        + " FROM requests GROUP BY ALL",
    ),
)
def _(spark, folder):
    path, keys = shared_folder(spark, "stream-requests"), ["window_start", "endpoint", "status"]

    def run(stream):
        days.write_days(jobs.request_windows(stream), path, keys, F.col("window_start")).awaitTermination()

    _arrivals(spark, {"requests": (table(spark, folder, "requests"), "requested_at")}, run)
    latest = days.read_days(spark, path, keys)
    return rounded(latest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")))


@query(
    "stream_clients_over_limit",
    with_views(
        ["requests"],
        """SELECT strftime(date_trunc('hour', requested_at), '%Y-%m-%d %H:%M') AS window_start, client_id,
  count(*) AS requests FROM requests GROUP BY ALL HAVING count(*) > 1""",
    ),
)
def _(spark, folder):
    path, keys = shared_folder(spark, "stream-limits"), ["window_start", "client_id"]

    def run(stream):
        limited = jobs.over_limit(stream, 1, length="1 hour")
        days.write_days(limited, path, keys, F.col("window_start")).awaitTermination()

    _arrivals(spark, {"requests": (table(spark, folder, "requests"), "requested_at")}, run)
    latest = days.read_days(spark, path, keys)
    return latest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


_SINCE = {d: f"timestamp >= TIMESTAMP '{RECENT_REFERENCE} 00:00:00' - INTERVAL {d} DAY" for d in (7, 30, 90)}


@query(
    "stream_velocity",
    with_views(
        ["recent_transactions"],
        "SELECT borrower_id, "
        + ", ".join(
            f"count(amount) FILTER ({c}) AS txn_count_{d}d,"
            f" round(coalesce(sum(amount) FILTER ({c}), 0), 6) AS txn_amount_sum_{d}d"
            for d, c in _SINCE.items()
        )
        + f" FROM recent_transactions WHERE {_SINCE[90]} GROUP BY borrower_id",
    ),
)
def _(spark, folder):
    path, keys = shared_folder(spark, "stream-activity"), ["day", "borrower_id"]

    def run(stream):
        days.write_days(jobs.daily_activity(stream), path, keys, F.col("day")).awaitTermination()

    _arrivals(spark, {"txns": (table(spark, folder, "recent_transactions"), "timestamp")}, run)
    first = date.fromisoformat(RECENT_REFERENCE) - timedelta(days=90)
    return rounded(jobs.velocity_as_of(days.read_days(spark, path, keys, first.isoformat()), RECENT_REFERENCE))


@query(
    "stream_sliding_velocity",
    with_views(
        ["recent_transactions"],
        """SELECT strftime(date_trunc('day', timestamp) - to_days(back::INT), '%Y-%m-%d') AS window_start, borrower_id,
  count(amount) AS txn_count, round(sum(amount), 6) AS txn_amount_sum
FROM recent_transactions, range(7) r(back) GROUP BY ALL""",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "stream-sliding")
    sinks.drain(jobs.sliding_velocity(_stream(spark, folder, "recent_transactions")), path, mode="update")
    latest = sinks.read_latest(spark, path, ["window_start", "borrower_id"])
    return rounded(latest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


_DAY_SHARES = """
WITH span AS (SELECT min(amount) AS low, max(amount) AS high, (max(amount) - min(amount)) / 10 AS width
  FROM long_transactions),
spine AS (SELECT bin FROM range(10) r(bin)),
r AS (SELECT ({bin}) AS bin, count(*) AS n FROM long_transactions, span GROUP BY 1),
ref AS (SELECT bin, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS share FROM spine LEFT JOIN r USING (bin)),
c AS (SELECT timestamp::DATE AS day, ({bin}) AS bin, count(*) AS n FROM recent, span
  WHERE amount BETWEEN low AND high GROUP BY 1, 2),
days AS (SELECT DISTINCT timestamp::DATE AS day FROM recent),
cur AS (SELECT day, bin, share, coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY day), 1) AS c
  FROM days CROSS JOIN ref LEFT JOIN c USING (day, bin)),
psi AS (SELECT day, sum((greatest(c, 1e-6) - greatest(share, 1e-6)) * ln(greatest(c, 1e-6) / greatest(share, 1e-6)))
  AS psi FROM cur GROUP BY day)
SELECT day, 'amount' AS feature, round(psi, 4) AS psi,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'alert' END AS status FROM psi""".format(
    bin=" + ".join(f"(amount >= low + {k} * width)::INT" for k in range(1, 10))
).replace("WITH span", "WITH recent AS (SELECT timestamp, amount * 1000 AS amount FROM recent_transactions),\nspan")


@query("stream_drift_by_day", with_views(["long_transactions", "recent_transactions"], _DAY_SHARES))
def _(spark, folder):
    reference = drift.reference_bins(table(spark, folder, "long_transactions"), ["amount"])
    txns = table(spark, folder, "recent_transactions").withColumn("amount", F.col("amount") * 1000)
    path, keys = shared_folder(spark, "stream-drift"), ["day", "feature", "bin"]
    count = jobs.drift_counts(reference, ["amount"], "timestamp")

    def run(arrived):
        days.write_days(arrived, path, keys, F.col("day"), count, add=["rows"], mode="append").awaitTermination()

    _arrivals(spark, {"txns": (txns, "timestamp")}, run)
    return jobs.drift_by_day(days.read_days(spark, path, keys, add=["rows"]), reference)


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, folder):
    events = _source(spark, folder, "events").withColumn("id", F.concat_ws(":", "user_id", "event_type"))
    path = shared_folder(spark, "stream-dedupe")
    sinks.drain(jobs.first_seen(events, "id", "ts", "40 days"), path)
    return sinks.read_batches(spark, path).select("user_id", "event_type")


@query(
    "stream_parsed_applications",
    "SELECT c_custkey AS borrower_id, round(c_acctbal, 6) AS annual_income FROM customer WHERE c_acctbal > 0",
)
def _(spark, folder):
    messages = _source(spark, folder, "customer").select(
        F.to_json(F.struct(F.col("c_custkey").alias("borrower_id"), F.col("c_acctbal").alias("annual_income"))).alias(
            "value"
        )
    )
    parsed = jobs.read_applications(messages, "borrower_id long, annual_income double")
    path = shared_folder(spark, "stream-parsed")
    sinks.drain(parsed.filter("annual_income > 0"), path)
    return rounded(sinks.read_batches(spark, path))
