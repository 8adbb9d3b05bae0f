"""Decisions of a stream by the model and tables that are in force when a batch starts.

Versions are published side by side: models, routes per pool, threshold and sends of a version in a folder of its own, and a
line that names it last, so a version that can be seen is whole. A batch takes the latest version there is and notes which one
before it decides; a batch that is repeated after a loss takes the noted one, and replaces its own folder. So the log says
which policy made each record, and deciding the same rows again by that version as a table gives the same records.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions import bits
from txlens.operators import boosting as B
from txlens.operators import models as MD
from txlens.operators.pools import ROUTES_PER_PACK
from txlens.streaming import run

# Fixed values
SAMPLE_ONE_IN = 1000


@dataclass
class Policy:
    """What is in force: models of probability and size, routes per pool (pool, route, support), threshold, sends."""

    version: int
    arb: B.Model
    size: B.Model
    pool_routes: DataFrame
    threshold: float
    sends: int


def _line(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def publish(spark: SparkSession, root: str, policy: Policy) -> None:
    """Write a version; it is in force for batches that start from now on. A version number is published once."""
    if policy.version in versions(spark, root):
        raise ValueError(f"version {policy.version} is published already")
    at = f"{root}/v{policy.version}"
    B.save(policy.arb, spark, f"{at}/arb")
    B.save(policy.size, spark, f"{at}/size")
    policy.pool_routes.select("pool", "route", "support").write.mode("overwrite").parquet(f"{at}/pool_routes")
    _line(spark, f"{root}/published/v{policy.version}", {"version": policy.version, "threshold": policy.threshold, "sends": policy.sends})


def versions(spark: SparkSession, root: str) -> dict[int, dict]:
    """Published versions with their settings, a line each."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").text(f"{root}/published").collect()
    except AnalysisException:
        return {}
    return {d["version"]: d for d in (json.loads(r.value) for r in rows)}


def load(spark: SparkSession, root: str, version: int, features: Sequence[str], size_features: Sequence[str] | None = None) -> Policy:
    """A published version; models of another feature order are refused."""
    known = versions(spark, root)[version]
    at = f"{root}/v{version}"
    arb, size = B.load(spark, f"{at}/arb", features), B.load(spark, f"{at}/size", size_features or features)
    return Policy(version, arb, size, spark.read.parquet(f"{at}/pool_routes"), known["threshold"], known["sends"])


def decide(tx: DataFrame, policy: Policy) -> DataFrame:
    """Decision records: sent rows with the routes chosen, and one in a thousand of the rest by a stable hash of the id.

    `tx`: (tx_id, pools, the inputs of both models). A transaction without pools or candidates is never sent.
    """
    scored = MD.score(policy.size, MD.score(policy.arb, tx, "p"), "size").withColumn("ev", MD.ev_size("p", "size"))
    touched = tx.select("tx_id", F.explode(F.array_distinct("pools")).alias("pool"))
    best = touched.join(policy.pool_routes, "pool").groupBy("tx_id", "route").agg(F.max("support").alias("support"))
    ranked = best.withColumn("r", F.row_number().over(W.partitionBy("tx_id").orderBy(F.desc("support"), "route")))
    most = ROUTES_PER_PACK * policy.sends
    chosen = ranked.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_candidates"),
                                         F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "route")))), lambda x: x["route"]).alias("routes"))
    x = scored.join(chosen, "tx_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    sent = F.coalesce((F.col("ev") >= policy.threshold) & (F.col("n_candidates") > 0), F.lit(False))
    sampled = ~F.col("sent") & (bits.mix_mod(bits.SAMPLE_SEED, F.col("tx_id"), SAMPLE_ONE_IN) == 0)
    x = x.withColumn("sent", sent).withColumn("sampled", sampled).where("sent OR sampled")
    inputs = sorted({*policy.arb.features, *policy.size.features})
    return x.select("tx_id", F.lit(policy.version).alias("version"), F.lit(policy.threshold).alias("threshold"), F.lit(policy.sends).alias("sends"), "sent", "sampled", "p", "ev",
                    F.coalesce(F.size("pools"), F.lit(0)).alias("n_pools"), "n_candidates", F.when(F.col("sent"), F.col("routes")).alias("routes"),
                    F.xxhash64(*[F.col(c).cast("double") for c in inputs]).alias("features_digest"))


def drain(stream: DataFrame, root: str, features: Sequence[str], checkpoint: str, out: str, size_features: Sequence[str] | None = None) -> DataFrame:
    """The log of everything available, with the batch number of each record."""
    spark, held = stream.sparkSession, {}

    def in_force(number: int) -> int:
        noted = f"{out}-versions/batch={number}"
        try:
            return json.loads(spark.read.text(noted).first().value)["version"]
        except AnalysisException:
            latest = max(versions(spark, root))
            _line(spark, noted, {"version": latest})
            return latest

    def change(batch: DataFrame, number: int) -> DataFrame:
        version = in_force(number)
        if version not in held:
            held.clear()
            held[version] = load(spark, root, version, features, size_features)
        return decide(batch, held[version])

    return run.drain_by_batch(stream, "decisions", change, checkpoint, out)
