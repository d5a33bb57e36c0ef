"""Selection of frame revisions, committed windows, and their contracts.

Frame tables have one row for each published frame: an id, the identity
columns, the time it is valid for and the times it was known and made.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.operators import hash_tree
from riskgrid.operators.shared import create_file

REVISION = ("as_of", "generated", "risk_id")


class CorridorMismatch(ValueError):
    """Frames of the run exist, but for another corridor only."""


def matching(frames: DataFrame, **identity) -> DataFrame:
    """Frames of one identity: a conjunction that reaches the scan."""
    for name, value in identity.items():
        frames = frames.where(F.col(name) == value)
    return frames


def latest_revisions(frames: DataFrame, keys: list[str], valid: str = "valid", revision: tuple[str, ...] = REVISION) -> DataFrame:
    """One row for each key and valid time: the last known, last made, largest id.

    ``max_by`` keeps one row for each key and task before the shuffle.
    """
    rest = [c for c in frames.columns if c not in (*keys, valid)]
    best = frames.groupBy(*keys, valid).agg(F.max_by(F.struct(*rest), F.struct(*revision)).alias("__rg_f"))
    return best.select(*keys, valid, *(F.col(f"__rg_f.{c}").alias(c) for c in rest))


def window(frames: DataFrame, start, end, as_of, identity: dict, corridor: str = "corridor_id") -> DataFrame:
    """The frames of a closed time window as known at ``as_of``, ordered by valid time."""
    others = matching(frames, **{k: v for k, v in identity.items() if k != corridor})
    if corridor in identity and others.where(F.col(corridor) == identity[corridor]).isEmpty() and not others.isEmpty():
        raise CorridorMismatch(identity[corridor])
    known = matching(frames, **identity).where((F.col("as_of") <= as_of) & F.col("valid").between(start, end))
    return latest_revisions(known, list(identity)).orderBy("valid")


def latest_before(targets: DataFrame, frames: DataFrame, key: str, target: str = "target", valid: str = "valid") -> DataFrame:
    """As-of join: for each target the last frame of its key valid at or before it (NULLs if none).

    Both sides are put in one sorted run for each key and the last frame is
    carried forward, so no pair of rows beyond the result is made.
    """
    rest = [c for c in frames.columns if c != key]
    left = targets.select("*", F.col(target).alias("__rg_t"), F.lit(1).alias("__rg_o"), F.lit(None).cast(frames.select(F.struct(*rest)).schema[0].dataType).alias("__rg_f"))
    right = frames.select(key, *(F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in targets.columns if c != key), F.col(valid).alias("__rg_t"), F.lit(0).alias("__rg_o"), F.struct(*rest).alias("__rg_f"))
    order = Window.partitionBy(key).orderBy("__rg_t", "__rg_o").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__rg_l", F.last("__rg_f", ignorenulls=True).over(order))
    return both.where("__rg_o = 1").select(*targets.columns, *(F.col(f"__rg_l.{c}").alias(c if c not in targets.columns else f"frame_{c}") for c in rest))


def gaps(frames: DataFrame, keys: list[str], step: int, valid: str = "valid") -> DataFrame:
    """Times missing between the first and last frame of each key.

    A gap is found from neighbours; only the missing times are made.
    """
    w = Window.partitionBy(*keys).orderBy(valid)
    pair = frames.select(*keys, valid).distinct().withColumn("__rg_n", F.lead(valid).over(w))
    return pair.where(F.col("__rg_n") - F.col(valid) > step).select(*keys, F.explode(F.sequence(F.col(valid) + step, F.col("__rg_n") - 1, F.lit(step).cast("long"))).alias("missing"))


def duplicates(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def identity_violations(frames: DataFrame, scope: list[str], identity: list[str]) -> DataFrame:
    """Scopes whose frames do not agree in every identity column.

    Least and greatest values tell as much as distinct counts and need one
    row for each scope in the shuffle.
    """
    agg = frames.groupBy(*scope).agg(*(f(c).alias(f"__rg_{k}_{c}") for c in identity for k, f in (("a", F.min), ("z", F.max))))
    differs = [F.when(~F.col(f"__rg_a_{c}").eqNullSafe(F.col(f"__rg_z_{c}")), F.lit(c)) for c in identity]
    return agg.select(*scope, F.array_join(F.array_compact(F.array(*differs)), ",").alias("mixed")).where("mixed <> ''")


def exists(frames: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted row with a flag whether a frame has its keys (null-safe)."""
    have = frames.select(*keys).distinct().withColumn("__rg_e", F.lit(True))
    on: Column | None = None
    w, h = wanted.alias("w"), have.alias("h")
    for k in keys:
        same = F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}"))
        on = same if on is None else on & same
    return w.join(h, on, "left").select("w.*", F.coalesce("h.__rg_e", F.lit(False)).alias("available"))


def of_generation(frames: DataFrame, generation: int) -> DataFrame:
    """What a reset to a generation keeps."""
    return frames.where(F.col("generation") == generation)


def merge_published(store: DataFrame, new: DataFrame, digest: str = "digest") -> DataFrame:
    """Frames to add: new ids only; equal content again is no change, other content under a known id is an error."""
    clash = new.join(store.select("risk_id", F.col(digest).alias("__rg_d")), "risk_id").where(F.col(digest) != F.col("__rg_d"))
    twice = new.groupBy("risk_id").agg(F.min(digest).alias("a"), F.max(digest).alias("z")).where("a <> z")
    if not clash.isEmpty() or not twice.isEmpty():
        raise ValueError("an id is published with other content")
    return new.dropDuplicates(["risk_id"]).join(store.select("risk_id"), "risk_id", "left_anti")


def content_digest(frames: DataFrame) -> str:
    """A digest of all rows and columns that does not depend on their order or partitioning: from sums over the rows' SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(frames.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    sums = frames.agg(F.count("*"), *parts).first()
    return hashlib.sha256(",".join(str(x or 0) for x in sums).encode()).hexdigest()


def commit_window(frames: DataFrame, path: str) -> str:
    """Freeze a window under a path once, and return its digest; the same content again is accepted, other content is not.

    The frames go to a fresh folder; a manifest that names it and the digest
    is created last, which one writer only can do. So a reader that finds it
    finds all frames, and two writers never mix.
    """
    spark = frames.sparkSession
    digest = content_digest(frames)
    if _manifest(spark, path) is None:
        data = f"{path}/frames-{uuid.uuid4().hex}"
        frames.write.parquet(data)
        create_file(spark, f"{path}/manifest", f"{digest} {data}")
    found = _manifest(spark, path)
    if found is None or found[0] != digest:
        raise ValueError("another window is committed under this key")
    return digest


def commit_cells(cube: DataFrame, path: str) -> str:
    """Freeze a window of cells with the digests of its frames beside it (see ``hash_tree``), and return the root."""
    spark = cube.sparkSession
    base = f"{path}/cells-{uuid.uuid4().hex}"
    cube.write.parquet(f"{base}/cells")
    frames = hash_tree.frame_digests(spark.read.parquet(f"{base}/cells"))
    frames.write.parquet(f"{base}/frames")
    root = hash_tree.window_digest(spark.read.parquet(f"{base}/frames")).first().digest
    create_file(spark, f"{path}/manifest", f"{root} {base}")
    found = _manifest(spark, path)
    if found is None or found[0] != root:
        raise ValueError("another window is committed under this key")
    return root


def committed_cells(spark: SparkSession, path: str, root: str, frames: list[int] | None = None) -> DataFrame:
    """Cells of a committed window, of all frames or of those valid at given times; what is read must still have its digest."""
    found = _manifest(spark, path)
    if found is None or found[0] != root:
        raise LookupError(f"no such committed window: {path}")
    cells, tree = spark.read.parquet(f"{found[1]}/cells"), spark.read.parquet(f"{found[1]}/frames")
    if hash_tree.window_digest(tree).first().digest != root:
        raise ValueError(f"the committed window has changed: {path}")
    if frames is not None:
        cells, tree = cells.where(F.col("valid_us").isin(frames)), tree.where(F.col("valid_us").isin(frames))
    if not hash_tree.changed_frames(tree, hash_tree.frame_digests(cells)).isEmpty():
        raise ValueError(f"the committed window has changed: {path}")
    return cells


def _manifest(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """Digest and folder of a committed window."""
    try:
        rows = spark.read.text(f"{path}/manifest").take(1)
    except AnalysisException:
        return None
    return tuple(rows[0].value.split(" ", 1)) if rows else None


def committed_window(spark: SparkSession, path: str, digest: str | None = None, check: bool = False) -> DataFrame:
    """A committed window; with a digest, only if it is the same; with ``check``, only if its rows still have it."""
    found = _manifest(spark, path)
    if found is None or (digest is not None and found[0] != digest):
        raise LookupError(f"no such committed window: {path}")
    frames = spark.read.parquet(found[1])
    if check and content_digest(frames) != found[0]:
        raise ValueError(f"the committed window has changed: {path}")
    return frames


def window_contract(frames: DataFrame, start: int, end: int, step: int, as_of: int, valid: str = "valid") -> DataFrame:
    """Violations of a committed window: missing, unexpected and repeated times, and frames known too late."""
    if step <= 0 or end < start or (end - start) % step:
        raise ValueError("a window is a whole number of steps")
    spark = frames.sparkSession
    wanted = spark.range(start, end + 1, step).withColumnRenamed("id", "at")
    have = frames.groupBy(F.col(valid).alias("at")).agg(F.count("*").alias("n"), F.max("as_of").alias("as_of"))
    both = wanted.withColumn("w", F.lit(True)).join(have, "at", "full")
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("as_of") > as_of, "known too late")
    return both.select("at", reason.alias("reason")).where("reason is not null")
