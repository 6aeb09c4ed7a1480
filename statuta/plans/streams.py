"""Queries over the live flows: each runs its stream to the end of the data and returns what it left."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.plans import reports as PQ
from statuta.plans.inputs import lit, sql_strip
from statuta.plans.registry import query
from statuta.session import shared_folder
from statuta.sources.tables import table
from statuta.streaming import flows as L


def folders(spark, name):
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream(spark, d, name):
    """A table of the data folder as a stream of files."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def arriving(spark, d, name, order, out, parts=4):
    """A table of the data folder as a stream of ``parts`` files, one a batch: in order of time, or dealt by hash of ``order``."""
    df = table(spark, d, name)
    if order == "ts":
        first, last = df.select(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp")) + 1).first()
        part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - first) * parts / (last - first))
    else:
        part = F.pmod(F.xxhash64(order), F.lit(parts))
    # file by file, as files come in the order of their times
    for k in range(parts):
        df.filter(part == k).coalesce(1).write.mode("append").parquet(f"{out}/incoming")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/incoming")


_LINES = ["Step 1: x", "noise", "Running OCR", "Merging", "Parse it", "Generated nothing", "Generated 5 chunks", "  ", "Embedding", "Step 3: again", "Committing to Production"]


def lines(events):
    """Events as log lines of one ingest per user and day."""
    line = F.element_at(F.array(*map(F.lit, _LINES)), ((F.col("event_id") * 7 + F.col("user_id")) % len(_LINES) + 1).cast("int"))
    doc = F.col("user_id") * 1000 + F.dayofyear("ts")
    return events.select(doc.alias("doc_id"), "ts", F.col("event_id").alias("line_no"), line.alias("line"))


_DOC = "user_id * 1000 + dayofyear(ts)"
_STEPS = ", ".join(map(str, [1, 0, 2, 3, 3, 0, 4, 0, 5, 3, 5]))


@query("ingest_progress_stream", f"""WITH x AS (SELECT {_DOC} AS doc_id, ts, event_id AS line_no, CAST((event_id * 7 + user_id) % {len(_LINES)} AS BIGINT) + 1 AS i FROM events),
y AS (SELECT *, [{', '.join(map(lit, _LINES))}][i] AS line, [{_STEPS}]::INTEGER[][i] AS own FROM x)
SELECT doc_id, line_no, line, max(own) OVER (PARTITION BY doc_id ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING) AS step FROM y WHERE trim(line) <> ''""".replace("[1, 0, 2, 3, 3, 0, 4, 0, 5, 3, 5]::INTEGER[][i]", "([1, 0, 2, 3, 3, 0, 4, 0, 5, 3, 5]::INTEGER[])[i]"))
def ingest_progress_stream(spark, d):
    out, checkpoint = folders(spark, "progress")
    L.run_available(L.progress_stream(lines(arriving(spark, d, "events", "event_id", checkpoint))), out, f"{checkpoint}/log")
    return L.settled(spark.read.schema(L._PROGRESS).parquet(out))


@query("progress_outcome", f"""WITH e AS (SELECT {_DOC} AS doc_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS code, CAST(floor(value) AS BIGINT) AS n FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) = 1), s AS (SELECT doc_id * 1000 + 5 AS doc_id, doc_id AS stored FROM labels)
SELECT doc_id, CASE WHEN stored IS NOT NULL THEN 'already_exists' WHEN code = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN stored IS NOT NULL THEN stored WHEN code = 0 THEN n ELSE 0 END AS num_chunks FROM f LEFT JOIN s USING (doc_id)""")
def progress_outcome(spark, d):
    out, checkpoint = folders(spark, "outcome")
    events = arriving(spark, d, "events", "ts", checkpoint).filter(F.col("event_type").isin("purchase", "error"))
    ends = events.select(
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("doc_id"), "ts", F.col("event_id").alias("line_no"),
        F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("exit_code"), F.floor("value").cast("long").alias("num_chunks"),
    )
    store = table(spark, d, "labels").select((F.col("doc_id") * 1000 + 5).alias("doc_id"), F.col("doc_id").alias("num_chunks"))
    L.outcome_stream(ends, store, out, f"{checkpoint}/log")
    return spark.read.schema(L.OUTCOME).parquet(out).select("doc_id", "status", "num_chunks")


@query("rate_limit_admission", """WITH RECURSIVE r AS (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'view'),
s AS (SELECT client, 0::BIGINT AS n, NULL::BIGINT AS request_id, NULL::INTEGER AS status, []::BIGINT[] AS recent FROM (SELECT DISTINCT client FROM r)
  UNION ALL SELECT client, n, request_id, CASE WHEN len(kept) < 3 THEN 200 ELSE 429 END::INTEGER, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END FROM (
    SELECT r.client, r.n, r.request_id, r.us, list_filter(s.recent, lambda t: r.us - t < 86400000000) AS kept FROM s JOIN r ON r.client = s.client AND r.n = s.n + 1))
SELECT client, request_id, status FROM s WHERE n > 0""")
def rate_limit_admission(spark, d):
    out, checkpoint = folders(spark, "requests")
    requests = arriving(spark, d, "events", "ts", checkpoint).select(
        F.col("user_id").alias("client"), F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "view", F.lit("/health")).otherwise("/api/chat").alias("path"), F.col("ts").cast("timestamp").alias("ts"),
    )
    L.run_available(L.rate_limit(requests, 3, 86400), out, f"{checkpoint}/log")
    return spark.read.schema(L._ADMITTED).parquet(out).select("client", "request_id", "status")


@query("incremental_ingest_stream", f"""WITH x AS (SELECT sha256(text) AS sha256, any_value(text) AS text FROM documents GROUP BY 1), l AS (SELECT sha256, unnest(string_split(text, chr(10))) AS t FROM x)
SELECT sha256, count(*) AS n_chunks, CAST(sum(len(t)) AS BIGINT) AS chars FROM l WHERE {sql_strip('t')} <> '' GROUP BY sha256""")
def incremental_ingest_stream(spark, d):
    out, checkpoint = folders(spark, "ingest")
    docs = table(spark, d, "documents").select("doc_id", "text")
    # the table arrives as four files, one per batch
    docs.repartition(4, "doc_id").write.parquet(f"{out}/incoming")
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/incoming")
    L.ingest_stream(arriving, out, checkpoint)
    chunks = spark.read.schema(L.CHUNKS).parquet(f"{out}/chunks")
    return chunks.groupBy("sha256").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("log_stream_sink", f"""WITH {PQ.LOG}, n AS (SELECT count(*) AS t FROM log) SELECT 'tier' AS part, tier AS name, count(*) AS n, round(count(*) / any_value(t)::DOUBLE, 4) AS rate, NULL::DOUBLE AS value FROM log, n GROUP BY tier
UNION ALL SELECT 'decision', gating_decision, count(*), round(count(*) / any_value(t)::DOUBLE, 4), NULL FROM log, n GROUP BY gating_decision
UNION ALL SELECT 'overall', unnest(['avg_latency_total_ms', 'error_rate', 'api_savings_rate']), count(*), NULL, unnest([round(avg(latency_total_ms), 1), round(avg(CAST(error <> '' AS INTEGER)), 4), round(avg(CAST(tier <> 'api' AS INTEGER)), 4)]) FROM log""")
def log_stream_sink(spark, d):
    out, checkpoint = folders(spark, "logsink")
    rows = PQ.log_of(stream(spark, d, "events"))
    L.log_stream(rows, out, checkpoint)
    return L.refresh_summary(spark, out, rows.schema)
