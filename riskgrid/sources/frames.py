"""Risk frames from JSON documents of two versions, and digests of files.

Documents lie in any store that Spark reads, one in a file or one in a line.
They become cells by ``codec.cells_of``; headers keep what tells frames apart.

Defined cases: a document that isn't JSON, or has no id, is reported by
``codec.tampered`` and gives no header; no files give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.values import utc_micros

#: Versions of frame documents, and the marks of what was lifted from the first (fixed values).
V1, V2 = "bc.risk-frame.v1", "bc.risk-frame.v2"
LEGACY_SOURCE, LEGACY = "legacy_bc_v1_adapter", "legacy_unverified"

HEADER = "schema_version string, risk_id string, run_id string, scenario_id string, corridor_id string, vessel_profile_id string, config_digest string, model_config_digest string, generation_id int, valid_time string, as_of_time string, generated_at string, model_version string, provenance string, source_summary array<struct<source_id:string,data_id:string,issue_time:string,valid_time:string,version:string,quality_flag:string,checksum:string>>"


def read_documents(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(document) of every file, or of every line."""
    return spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("document"))


def headers(documents: DataFrame) -> DataFrame:
    """One row for each document with an id: its fields but the payload, times in epoch microseconds."""
    d = documents.select(F.from_json("document", HEADER).alias("d")).select("d.*").where("risk_id is not null")
    return d.select("*", *(utc_micros(F.col(c)).alias(u) for c, u in (("valid_time", "valid_us"), ("as_of_time", "as_of"), ("generated_at", "generated"))))


def lifted(heads: DataFrame, run_id: str, model_config_digest: str, acknowledged: bool) -> DataFrame:
    """Headers of the first version in the form of the second, marked for good as unverified; others are left out."""
    if not acknowledged:
        raise ValueError(f"frames of {V1} are taken only if it is acknowledged that they are unverified")
    none = F.lit(None).cast("string")
    source = F.struct(F.lit(LEGACY_SOURCE).alias("source_id"), F.col("risk_id").alias("data_id"), none.alias("issue_time"), F.col("valid_time"), F.lit(V1).alias("version"), F.lit(LEGACY).alias("quality_flag"), none.alias("checksum"))
    return heads.where(F.col("schema_version") == V1).withColumns(
        {
            "schema_version": F.lit(V2),
            "run_id": F.lit(run_id),
            "model_config_digest": F.lit(model_config_digest),
            "model_version": F.concat(F.lit("legacy-v1:"), "model_version"),
            "provenance": F.lit(LEGACY),
            "source_summary": F.array(source),
        }
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
