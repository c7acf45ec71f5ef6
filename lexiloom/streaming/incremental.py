"""Incremental recomputation: only what changed, and a stream of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def digests(docs: DataFrame) -> DataFrame:
    """docs with sha256 of the UTF-8 text."""
    return docs.withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))


def changed(current: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """Rows of current (doc_id, sha256, ...) that state (doc_id, sha256, version) does not hold under this version."""
    same = state.where(F.col("version") == version).select("doc_id", "sha256")
    return current.join(same, ["doc_id", "sha256"], "left_anti")


def vanished(current: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(current.select("doc_id"), "doc_id", "left_anti")


def merged(old: DataFrame, fresh: DataFrame, current: DataFrame) -> DataFrame:
    """Analyses after an update: fresh rows replace old ones, rows of vanished documents go."""
    kept = old.join(fresh.select("doc_id"), "doc_id", "left_anti").join(current.select("doc_id"), "doc_id", "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


FINGERPRINT_IDS = 65_536


def fingerprint(docs: DataFrame) -> DataFrame:
    """One digest of the whole corpus: of the digests, in order, of ranges of FINGERPRINT_IDS ids, each of its (id, text digest) pairs in order.

    A task gathers the ids and digests of a range, and the last one a digest a range. Rows without an
    id are a range before all others, in the order of their texts' digests; repeated rows count each.
    """
    nul = F.lit("\0")
    rows = digests(docs).select(F.floor(F.col("doc_id") / FINGERPRINT_IDS).alias("range"), "doc_id", "sha256")
    ranges = rows.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("doc_id", "sha256"))).alias("a"))
    line = F.transform("a", lambda x: F.concat(F.coalesce(x["doc_id"].cast("string"), F.lit("")), nul, x["sha256"], nul))
    held = ranges.select("range", F.sha2(F.array_join(line, ""), 256).alias("s")).agg(F.sort_array(F.collect_list(F.struct("range", "s"))).alias("a"))
    return held.select(F.sha2(F.array_join(F.transform("a", lambda x: x["s"]), ""), 256).alias("fingerprint"))


def write_cache(path: str, analyses: DataFrame, fingerprint: str, versions: dict[str, int]) -> None:
    """Keeps analyses (entity, metric, value) with the corpus' fingerprint and the version of each metric's rule."""
    version = F.create_map(*(F.lit(x) for kv in versions.items() for x in kv)) if versions else F.create_map().cast("map<string,int>")
    held = analyses.select("entity", "metric", "value", F.lit(fingerprint).alias("fingerprint"), F.coalesce(F.try_element_at(version, F.col("metric")), F.lit(0)).alias("version"))
    held.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str, fingerprint: str, versions: dict[str, int]) -> tuple[DataFrame, list[str]] | None:
    """The analyses kept for this corpus and the metrics to compute anew, or None where there are none."""
    try:
        held = spark.read.schema("entity string, metric string, value double, fingerprint string, version int").parquet(path).where(F.col("fingerprint") == fingerprint)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    kept = {r[0]: r[1] for r in held.select("metric", "version").distinct().collect()}  # a row for each metric
    if not kept:
        return None
    stale = sorted(m for m, v in kept.items() if versions.get(m, 0) != v)
    return held.where(~F.col("metric").isin(stale)).select("entity", "metric", "value"), stale


def follow(spark: SparkSession, path: str, schema: str, state_path: str, version: str, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Analyses Parquet documents as they arrive; a batch skips what the state already holds.

    Output and state are folders with one part a batch (`batch=n`), each overwritten where a batch
    is tried again, so that no row is written twice. Of a document that changed the state has its
    digests by batch, of which the latest counts.
    """

    def batch(df: DataFrame, n: int) -> None:
        now = digests(df)
        try:
            known = spark.read.schema("doc_id long, sha256 string, version string, batch long").parquet(state_path).where(F.col("batch") < n)
            latest = known.groupBy("doc_id").agg(F.max_by(F.struct("sha256", "version"), "batch").alias("s")).select("doc_id", "s.sha256", "s.version")
            now = changed(now, latest, version)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        now = now.persist()
        analyse(now).write.mode("overwrite").parquet(f"{out}/batch={n}")
        now.select("doc_id", "sha256", F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{state_path}/batch={n}")
        now.unpersist()

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
