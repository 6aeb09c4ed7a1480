"""Chunk, vector and conversation stores: append, delete, commit, repair, counts, samples."""
from __future__ import annotations

import json
import uuid
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.text import tokens
from statuta.operators.ranges import numbered
from statuta.operators.retrieval import postings


def corpus_append(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, then new ones whose ids go on where the old ones end."""
    start = old.agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0]
    return old.unionByName(numbered(new, key, start))


def doc_delete(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Each table without the given ``_key`` values; an unknown document is an error."""
    first = next(iter(tables.values()))
    if first.join(keys, "_key", "left_semi").isEmpty():
        raise LookupError("no rows of these documents")
    return {name: df.join(keys, "_key", "left_anti").drop("_key") for name, df in tables.items()}


def conversation_delete(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and, by cascade, their messages."""
    return conversations.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def conversation_order(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages with the place of their conversation (latest first) and their place in it."""
    placed = numbered(conversations.withColumn("_order", F.struct(-F.col("updated_at"), F.col("conv_id"))), "_order", 1, "conv_pos")
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    return messages.select("conv_id", "turn", "role").join(placed.select("conv_id", "conv_pos"), "conv_id").withColumn("msg_pos", at)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key: the same rows on any cluster."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)


# ---- versions ---------------------------------------------------------------
# A version is one entry of the store's log: a small file named by its number, with a list of steps and the counts they give. A step is
# a part (chunks, vectors and postings of added rows), or a list of chunk ids that are gone from the parts before it. A change writes and
# counts its own rows only; entries are put where there is none of that number, so one of two writers wins and the other one fails.

STORES = ("chunks", "vectors", "postings")


class _Files:
    """The few calls on the store's file system that a log needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._folder = self._path(folder)
        self._system = self._folder.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system.getUri(), conf)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._system.listStatus(self._folder)] if self._system.exists(self._folder) else []

    def read(self, name: str) -> str:
        stream = self._system.open(self._path(self._folder, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Write the whole file under another name, then give it its own: false where that is taken."""
        draft = self._path(self._folder, f".{name}.{uuid.uuid4().hex}")
        stream = self._system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._context.rename(draft, self._path(self._folder, name), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            self._system.delete(draft, False)
            return False
        return True


def _log(spark: SparkSession, root: str) -> _Files:
    return _Files(spark, f"{root}/log")


def _entry(spark: SparkSession, root: str, version: str | None = None) -> dict | None:
    """The log entry of a version, or the latest one."""
    log = _log(spark, root)
    if version is None:
        version = max((name.removesuffix(".json") for name in log.names() if name.startswith("v")), default=None)
    return json.loads(log.read(f"{version}.json")) if version else None


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the published version: that of the latest entry."""
    entry = _entry(spark, root)
    return entry["version"] if entry else None


def _tables(spark: SparkSession, root: str, steps: list[str], stores=STORES) -> dict[str, DataFrame]:
    """The stores after all steps; parts that follow one another are one scan."""
    out: dict[str, DataFrame] = {}
    for gone, group in groupby(steps, lambda step: step.startswith("gone-")):
        names = list(group)
        for store in stores:
            if gone:
                out[store] = out[store].join(spark.read.parquet(*[f"{root}/{name}" for name in names]), "chunk_id", "left_anti")
            else:
                part = spark.read.parquet(*[f"{root}/{name}/{store}" for name in names])
                out[store] = out[store].unionByName(part) if store in out else part
    return out


def read_version(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    return _tables(spark, root, _entry(spark, root, version)["steps"])


def _write_part(spark: SparkSession, root: str, chunks: DataFrame, vectors: DataFrame) -> tuple[str, dict]:
    """A written part, and its counts."""
    part = f"part-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{root}/{part}/chunks")
    vectors.write.parquet(f"{root}/{part}/vectors")
    postings(spark.read.parquet(f"{root}/{part}/chunks")).write.parquet(f"{root}/{part}/postings")
    tables = _tables(spark, root, [part])
    sizes = tables["vectors"].agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    counts = store_stats(tables).first().asDict() | {"least": sizes[0], "length": sizes[1]}
    return part, counts


def _publish(spark: SparkSession, root: str, old: dict | None, steps: list[str], counts: dict) -> str:
    """Check the counts, then put the next entry; a check that fails leaves the old version current."""
    if counts["n_chunks"] != counts["n_vectors"] or counts["n_postings"] > counts["n_chunks"] or counts.get("least") != counts.get("length"):
        raise ValueError(f"store counts disagree: {counts}")
    number = old["number"] + 1 if old else 1
    entry = {"version": f"v{number:020d}", "number": number, "steps": steps} | {k: counts[k] for k in ("n_chunks", "n_vectors", "n_postings", "length")}
    if not _log(spark, root).put_if_absent(f"{entry['version']}.json", json.dumps(entry)):
        raise RuntimeError(f"version number {number} was taken by another writer")
    return entry["version"]


def _changed(old: dict, plus: dict | None = None, minus: dict | None = None) -> dict:
    added = lambda key: old[key] + (plus[key] if plus else 0) - (minus[key] if minus else 0)
    return {key: added(key) for key in ("n_chunks", "n_vectors", "n_postings")} | {"least": old["length"], "length": old["length"]}


def commit(spark: SparkSession, root: str, chunks: DataFrame, vectors: DataFrame) -> str:
    """Publish a version that holds exactly these rows."""
    old = _entry(spark, root)
    part, counts = _write_part(spark, root, chunks, vectors)
    return _publish(spark, root, old, [part], counts)


def append(spark: SparkSession, root: str, chunks: DataFrame, vectors: DataFrame) -> str:
    """Publish the current version and further rows: new ids, vectors of the same length.

    Only the new rows are written and counted; of the old ones only the chunk ids are read.
    """
    old = _entry(spark, root)
    if old is None:
        return commit(spark, root, chunks, vectors)
    part, counts = _write_part(spark, root, chunks, vectors)
    if counts["n_chunks"] != counts["n_vectors"]:
        raise ValueError(f"store counts disagree: {counts}")
    lengths = {counts["least"], counts["length"], old["length"]} - {None}
    if len(lengths) > 1:
        raise ValueError("vectors differ in length from those of the store")
    new, before = _tables(spark, root, [part], ("chunks",)), _tables(spark, root, old["steps"], ("chunks",))
    if not new["chunks"].join(before["chunks"].select("chunk_id"), "chunk_id", "left_semi").isEmpty():
        raise ValueError("chunk ids are already in the store")
    whole = _changed(old, counts)
    if old["length"] is None:
        whole |= {"least": counts["least"], "length": counts["length"]}
    return _publish(spark, root, old, [*old["steps"], part], whole)


def _leave(spark: SparkSession, root: str, old: dict, rows: DataFrame) -> tuple[str, dict]:
    """A written list of the chunks of ``rows`` that go, and what the counts lose."""
    gone = f"gone-{uuid.uuid4().hex}"
    has = F.max((F.size(tokens(F.col("text"))) > 0).cast("long"))
    rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.coalesce(has, F.lit(0)).alias("has")).write.parquet(f"{root}/{gone}")
    ids = spark.read.parquet(f"{root}/{gone}")
    chunks, with_tokens = ids.agg(F.sum("n"), F.sum("has")).first()
    vectors = _tables(spark, root, old["steps"], ("vectors",))["vectors"].select("chunk_id").join(ids, "chunk_id", "left_semi").count()
    return gone, {"n_chunks": chunks or 0, "n_vectors": vectors, "n_postings": with_tokens or 0}


def delete(spark: SparkSession, root: str, target: Column) -> str:
    """Publish the current version without the targeted chunks, their vectors and postings; no such chunk is an error."""
    old = _entry(spark, root)
    rows = _tables(spark, root, old["steps"], ("chunks",))["chunks"].filter(target) if old else None
    if rows is None or rows.isEmpty():
        raise LookupError("no rows of these documents")
    gone, less = _leave(spark, root, old, rows)
    return _publish(spark, root, old, [*old["steps"], gone], _changed(old, minus=less))


def repair_version(spark: SparkSession, root: str, target: Column, wrong: str, right: str) -> str:
    """Publish the current version with a phrase replaced in the targeted chunks; only these are written anew. No hit is an error."""
    old = _entry(spark, root)
    tables = _tables(spark, root, old["steps"], ("chunks", "vectors")) if old else None
    fixed = repair(tables["chunks"], target, wrong, right) if old else None
    if fixed is None or fixed.filter("repaired").isEmpty():
        raise LookupError("no row holds the phrase")
    gone, less = _leave(spark, root, old, tables["chunks"].join(fixed.filter("repaired").select("chunk_id"), "chunk_id", "left_semi"))
    ids = spark.read.parquet(f"{root}/{gone}").select("chunk_id")
    part, more = _write_part(spark, root, *(df.join(ids, "chunk_id", "left_semi") for df in (fixed.drop("repaired"), tables["vectors"])))
    return _publish(spark, root, old, [*old["steps"], gone, part], _changed(old, more, less))


def compact(spark: SparkSession, root: str) -> str:
    """Publish the current version as one part, for readers that would read very many steps; older versions stay readable."""
    old = _entry(spark, root)
    part = f"part-{uuid.uuid4().hex}"
    for name, rows in _tables(spark, root, old["steps"]).items():
        rows.write.parquet(f"{root}/{part}/{name}")
    return _publish(spark, root, old, [part], _changed(old))


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the count of each store and whether vectors and chunks agree.

    Chunks without tokens have no postings; they may be fewer, never more.
    """
    postings_n = tables["postings"].agg(F.count_distinct("chunk_id")).scalar()
    vectors_n = tables["vectors"].agg(F.count("*")).scalar()
    out = tables["chunks"].agg(F.count("*").alias("n_chunks"))
    out = out.withColumn("n_vectors", vectors_n).withColumn("n_postings", postings_n)
    ok = (F.col("n_chunks") == F.col("n_vectors")) & (F.col("n_postings") <= F.col("n_chunks"))
    return out.withColumn("consistent", ok)


def repair(chunks: DataFrame, target: Column, wrong: str, right: str) -> DataFrame:
    """Replace a phrase in the targeted rows; ``repaired`` marks them."""
    hit = F.coalesce(target & F.contains("text", F.lit(wrong)), F.lit(False))
    out = chunks.withColumn("repaired", hit)
    return out.withColumn("text", F.when(F.col("repaired"), F.replace("text", F.lit(wrong), F.lit(right))).otherwise(F.col("text")))
