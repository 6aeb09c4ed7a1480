"""Live flows as Structured Streaming jobs, each with the batch form of its result."""
from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statuta.functions import fixed_values as V
from statuta.functions.text import strip
from statuta.operators.reports import log_summary
from statuta.unfold import unfold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream, path: str, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all data there is, to parquet files under ``path`` or through ``batch``."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path).outputMode("append")
    writer.start().awaitTermination()


# ---- ingest progress --------------------------------------------------------


def line_step(line: Column) -> Column:
    """Step named by a log line, 0 for none; the first rule that holds decides."""

    def holds(mark) -> Column:
        parts = mark if isinstance(mark, tuple) else (mark,)
        return reduce(lambda a, b: a & b, [F.contains(line, F.lit(p)) for p in parts])

    cases = [F.when(reduce(lambda a, b: a | b, map(holds, marks)), F.lit(step)) for step, marks in V.PROGRESS_RULES]
    return F.coalesce(*cases, F.lit(0))


def progress_batch(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, ts, line_no, line)`` with the document's step, which never falls."""
    upto = W.partitionBy("doc_id").orderBy("ts", "line_no").rowsBetween(W.unboundedPreceding, 0)
    kept = lines.filter(F.rtrim("line") != "").withColumn("own", line_step(F.col("line")))
    return kept.select("doc_id", "line_no", "line", F.max("own").over(upto).alias("step"))


_PROGRESS = "doc_id long, line_no long, ts timestamp, line string, step int"


_TOP = max(step for step, _ in V.PROGRESS_RULES)
_NEVER = 2**63 - 1
_LAST = 2**62  # for a null, which makes floats of a column: exact there


def _progress(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The lines of one bucket of documents; those without a document are bucket -1."""
    rows = pd.concat(list(batches))
    timed = rows["us"].notna().to_numpy()
    doc, t, n = (rows[c].fillna(full).to_numpy(np.int64) for c, full in (("doc_id", 0), ("us", _LAST), ("line_no", _LAST)))
    order = np.lexsort((n, t, doc))
    rows, timed, doc, t, n, own = rows.iloc[order], timed[order], doc[order], t[order], n[order], rows["own"].to_numpy()[order]
    # where each step of a document was first reached: times and line numbers, of the steps 1, 2, ...
    known, *first = (np.frombuffer(x, np.int64) for x in (state.get if state.exists else (b"", b"", b"")))
    docs = np.union1d(known, doc)
    us, line = (np.full((len(docs), _TOP), _NEVER) for _ in first)
    us[np.searchsorted(docs, known)], line[np.searchsorted(docs, known)] = (x.reshape(-1, _TOP) for x in first)
    at = np.searchsorted(docs, doc)
    steps = np.zeros(len(rows), np.int32)
    for k in range(_TOP):
        hit = np.flatnonzero((own > k) & timed)
        of, place = np.unique(at[hit], return_index=True)
        t1, n1 = t[hit][place], n[hit][place]
        sooner = (t1 < us[of, k]) | ((t1 == us[of, k]) & (n1 < line[of, k]))
        us[of[sooner], k], line[of[sooner], k] = t1[sooner], n1[sooner]
        steps[timed & ((t > us[at, k]) | ((t == us[at, k]) & (n >= line[at, k])))] = k + 1
    state.update(tuple(x.tobytes() for x in (docs, us, line)))
    yield pd.DataFrame({c: rows[c] for c in ("doc_id", "line_no", "ts", "line")} | {"step": steps})


def progress_stream(lines: DataFrame, buckets: int = 1024) -> DataFrame:
    """The same over a stream: each line once, with its document's highest step up to its time among the lines that came so far.

    No line is too late, as there is no watermark, and no state is dropped: that of a document is where each step was first reached,
    a few numbers on the state store's disk. A late line can raise lines given out before; ``settled`` tells. Documents are keyed by
    ``buckets`` hashes of their ids, as a call of Python per document and batch takes milliseconds; a batch rewrites the states of the
    buckets that it has lines of. Their number is fixed by the checkpoint: take more of them for very many documents.
    """
    kept = lines.filter(F.rtrim("line") != "").withColumns({"own": line_step(F.col("line")), "ts": F.col("ts").cast("timestamp")})
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).cast("int")
    kept = kept.withColumns({"us": F.unix_micros("ts"), "bucket": bucket})
    return kept.groupBy("bucket").applyInPandasWithState(_progress, _PROGRESS, "docs binary, us binary, line binary", "append", GroupStateTimeout.NoTimeout)


def settled(rows: DataFrame) -> DataFrame:
    """What the stream gave out, in the state of ``progress_batch`` over the same lines, in whatever order they came."""
    upto = W.partitionBy("doc_id").orderBy("ts", "line_no").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("doc_id", "line_no", "line", F.max("step").over(upto).alias("step"))


# ---- outcomes ---------------------------------------------------------------


def outcome_batch(ends: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, status, num_chunks) from the first end of each document; a stored document already exists.

    ``ends(doc_id, ts, line_no, exit_code, num_chunks)``, ``store(doc_id, num_chunks)``.
    """
    first = ends.groupBy("doc_id").agg(F.min_by(F.struct("exit_code", "num_chunks"), F.struct("ts", "line_no")).alias("e"))
    known = store.select("doc_id", F.col("num_chunks").alias("stored"))
    out = first.join(known, "doc_id", "left")
    status = F.when(F.col("stored").isNotNull(), F.lit("already_exists")).when(F.col("e.exit_code") == 0, F.lit("success")).otherwise("failed")
    chunks = F.when(F.col("stored").isNotNull(), F.col("stored")).when(F.col("e.exit_code") == 0, F.col("e.num_chunks")).otherwise(0)
    return out.select("doc_id", status.alias("status"), chunks.alias("num_chunks"))


OUTCOME = "doc_id bigint, status string, num_chunks bigint"


_END_COLUMNS = ("doc_id", "us", "line_no", "exit_code", "num_chunks")
_END = "doc_id long, us long, line_no long, exit_code int, num_chunks long, nulls int"


def _first_ends(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first end of each document of one bucket that had none before; documents without an id are bucket -1."""
    rows = pd.concat(list(batches))
    known = np.frombuffer(state.get[0], np.int64) if state.exists else np.zeros(0, np.int64)
    doc, us, line_no, nulls = (rows[c].to_numpy() for c in ("doc_id", "us", "line_no", "nulls"))
    order = np.lexsort((line_no, nulls & 4, us, nulls & 2, doc))  # the bits of null times and lines, which come last
    docs, first = np.unique(doc[order], return_index=True)
    new = ~np.isin(docs, known)
    if new.any():
        state.update((np.union1d(known, docs[new]).tobytes(),))
        yield rows.iloc[order[first[new]]][[*_END_COLUMNS, "nulls"]]


def outcome_stream(ends: DataFrame, store: DataFrame, path: str, checkpoint: str, buckets: int = 1024) -> None:
    """Append each document's outcome once, from the first end of the first batch that has one.

    The state store remembers which documents have one, so a batch reads nothing of earlier batches. They are keyed by ``buckets``
    hashes of their ids, as a call of Python per document and batch takes milliseconds; the state of a bucket is its documents' ids,
    8 bytes each. Their number is fixed by the checkpoint: take more of them for very many documents. A batch owns one folder, so a
    repeated batch replaces itself.
    """
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).cast("int")
    cast = ends.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("line_no").cast("long").alias("line_no"),
        F.col("exit_code").cast("int").alias("exit_code"), F.col("num_chunks").cast("long").alias("num_chunks"),
    )
    # numbers without nulls, which would make floats of them
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(_END_COLUMNS)])
    filled = [F.coalesce(c, F.lit(0).cast(cast.schema[c].dataType)).alias(c) for c in _END_COLUMNS]
    first = cast.select(*filled, nulls.cast("int").alias("nulls"), bucket.alias("bucket")).groupBy("bucket").applyInPandasWithState(
        _first_ends, _END, "docs binary", "append", GroupStateTimeout.NoTimeout
    )

    def write(batch: DataFrame, number: int) -> None:
        back = [F.when(F.col("nulls").bitwiseAND(1 << i) == 0, F.col(c)).alias(c) for i, c in enumerate(_END_COLUMNS)]
        told = batch.select(*back).withColumn("ts", F.timestamp_micros("us"))
        outcome_batch(told, store).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(first, path, checkpoint, write)


# ---- rate limit -------------------------------------------------------------

_ADMITTED = "client long, request_id long, ts timestamp, status int, late boolean"


def _late_fits(passed: list[int], us: int, limit: int, span: int) -> bool:
    """Whether no window that holds ``us`` would have more than ``limit`` of the sorted ``passed`` and it."""
    i = bisect_right(passed, us)
    firsts = range(max(0, i - limit), min(i, len(passed) - limit) + 1)
    return all(max(passed[j + limit - 1], us) - min(passed[j], us) >= span for j in firsts)


def _admission(limit: int, seconds: int, late: int):
    span, memory = seconds * 1_000_000, late * 1_000_000

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, passed = state.get if state.exists else (None, [])
        passed = list(passed)
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        status, behind = [], []
        for us in rows["us"].tolist():
            behind.append(newest is not None and us < newest)
            if not behind[-1]:
                # times come in order, so the oldest of the last `limit` that passed decides alone
                fits, newest = len(passed) < limit or us - passed[-limit] >= span, us
            else:
                fits = us >= newest - memory and _late_fits(passed, us, limit, span)
            status.append(200 if fits else 429)
            if fits:
                insort(passed, us)
        state.update((newest, passed[bisect_right(passed, newest - memory - span) :]))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "ts": rows["ts"], "status": pd.array(status, dtype="int32"), "late": behind})

    return admit


def rate_limit(requests: DataFrame, limit: int = V.RATE_LIMIT_REQUESTS, seconds: int = V.RATE_LIMIT_SECONDS, late: int = 600) -> DataFrame:
    """``requests(client, request_id, path, ts)`` on API paths, each answered once with status 200 or 429.

    A request passes when fewer than ``limit`` passed in the window before it. A ``late`` one, older than a request of its client that a
    batch before answered, passes when no window around it gets more than ``limit``; one that is over ``late`` seconds behind is
    answered with 429, as what passed then is no longer known. The state of a client, which stays, holds the times that passed since then.
    """
    api = requests.filter(F.col("path").startswith(V.RATE_LIMIT_PREFIX))
    keyed = api.select("client", "request_id", "ts", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("client").applyInPandasWithState(
        _admission(limit, seconds, late), _ADMITTED, "newest long, passed array<long>", "append", GroupStateTimeout.NoTimeout
    )


# ---- incremental ingest -----------------------------------------------------

REGISTRY = "doc_id bigint, sha256 string"
CHUNKS = "sha256 string, doc_id bigint, chunk_index int, text string"


def ingest_stream(documents: DataFrame, path: str, checkpoint: str) -> None:
    """``documents(doc_id, text)``: new content is registered once and cut into line chunks.

    The state store remembers the hashes, so a batch reads nothing of earlier batches; of equal contents within one batch any one is
    registered. Every batch writes its own folder of both tables, so a repeated batch replaces itself.
    """
    hashed = documents.withColumn("sha256", F.sha2("text", 256)).dropDuplicates(["sha256"])

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/new/batch={number}"
        first = batch.select("sha256", "doc_id", "text")
        first.write.mode("overwrite").parquet(target)
        new = batch.sparkSession.read.schema(first.schema).parquet(target)
        lines = unfold(new, ["sha256", "doc_id"], F.split("text", "\n"), "text", "chunk_index")
        lines.filter(strip(F.col("text")) != "").write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        # the registry comes last: what it names is complete
        new.select("doc_id", "sha256").write.mode("overwrite").parquet(f"{path}/registry/batch={number}")

    run_available(hashed, path, checkpoint, write)


# ---- log sink ---------------------------------------------------------------


def log_stream(rows: DataFrame, path: str, checkpoint: str, every: int = 10) -> None:
    """Append log rows batch by batch; the summary over all of them is refreshed every ``every`` batches."""
    schema = rows.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if number % every == 0:
            refresh_summary(batch.sparkSession, path, schema)

    run_available(rows, path, checkpoint, write)


def refresh_summary(spark: SparkSession, path: str, schema) -> DataFrame:
    log_summary(spark.read.schema(schema).parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/summary")
    return spark.read.parquet(f"{path}/summary")
