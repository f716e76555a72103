"""Registered queries of this package: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm import kdshards, lattice, licenses, lthash, maxent, neighbours, packing, ranked, repeats, runs, segments, simhash, toxicity

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(plan):
        PLANS[key] = plan
        if sql is not None:
            CHECKS[key] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_gumbel_segmentations")
def gumbel_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return segments.digest(segments.sampled(table(spark, folder, "documents")))


@query("op2_simhash_pigeonring")
def simhash_pigeonring(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


TOXIC_AT = 0.7


@query("op3_toxicity_nnpu")
def toxicity_nnpu(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = toxicity.fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


@query("op9_lexical_packing")
def lexical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op4_kd_shards")
def kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = kdshards.slots(kdshards.assign(table(spark, folder, "documents")))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


@query("op6_multiset_hash")
def multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return lthash.with_edits(table(spark, folder, "documents"))


@query("op8_shifted_curves")
def shifted_curves(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op7_repeated_strings")
def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(repeats.removed(table(spark, folder, "documents")))


@query("op10_hashed_maxent")
def hashed_maxent(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return maxent.scored(docs, toxicity.fold(F.col("doc_id"), 10) == 0)


@query("op11_synchronised_runs")
def synchronised_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.with_runs(runs.planted(table(spark, folder, "documents")), ["doc_id"]))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op12_hybrid_search",
    f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {TERMS} AS t FROM documents),
 s AS (SELECT count(*) AS texts, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
 f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(texts) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY 1),
 q AS (SELECT no, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS no, item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
 m AS (SELECT no, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * texts) // words)))) AS BIGINT) AS score
 FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL)
 SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m WHERE score > 0) WHERE rank <= 20""",
)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op13_lattice_near_dedup",
    """WITH RECURSIVE d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 v AS (SELECT * FROM d WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
 SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id""",
)
def lattice_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def checks() -> dict[str, str]:
    return dict(CHECKS)
