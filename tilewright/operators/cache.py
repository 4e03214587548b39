"""Jobs over a table of cached tiles: lookups, coverage, redundancy, budgets and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.tiles import TILE, overlapping

MIB = 1 << 20


def lookup(requests: DataFrame, cache: DataFrame, pending: DataFrame) -> DataFrame:
    """requests with `found`: hit, pending or missing. cache and pending are keyed by (source_id, z, x, y)."""
    hits = cache.select(*TILE).distinct().withColumn("_hit", F.lit(True))
    waits = pending.select(*TILE).distinct().withColumn("_wait", F.lit(True))
    joined = requests.join(hits.hint("merge"), TILE, "left").join(waits.hint("merge"), TILE, "left")
    return joined.withColumn("found", F.when(F.col("_hit"), "hit").when(F.col("_wait"), "pending").otherwise("missing")).drop("_hit", "_wait")


def lookup_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("scene_id").agg(F.count("*").alias("n_required"), *[F.count_if(F.col("found") == k).alias(f"n_{k}") for k in ("hit", "pending", "missing")])


def missing(requests: DataFrame, cache: DataFrame, pending: DataFrame, attempted: DataFrame) -> DataFrame:
    """Requests that are neither cached, pending nor attempted in the scene, ranked in it. attempted: (scene_id, source_id, z, x, y)."""
    # By sorting: packed, these tables look small enough to be sent to all tasks, and the driver would hold them whole.
    left = requests.join(cache.select(*TILE).hint("merge"), TILE, "left_anti").join(pending.select(*TILE).hint("merge"), TILE, "left_anti").join(attempted.select("scene_id", *TILE).hint("merge"), ["scene_id", *TILE], "left_anti")
    order = Window.partitionBy("scene_id").orderBy("priority", *TILE)
    return left.select("scene_id", *TILE, F.row_number().over(order).alias("rank"))


def coverage(requests: DataFrame, ready: DataFrame) -> DataFrame:
    """(scene_id, n_required, n_covered, n_opaque, is_full). ready: source_id, z, x, y, is_opaque; a scene without required tiles is not full."""
    joined = requests.join(ready.select(*TILE, "is_opaque").hint("merge"), TILE, "left")
    by = joined.groupBy("scene_id").agg(F.count("*").alias("n_required"), F.count("is_opaque").alias("n_covered"), F.count_if(F.col("is_opaque")).alias("n_opaque"))
    return by.withColumn("is_full", (F.col("n_required") > 0) & (F.col("n_required") == F.col("n_covered")))


def redundant(cache: DataFrame, active: DataFrame, ready: DataFrame) -> DataFrame:
    """(source_id, z, x, y, is_redundant) of cached tiles of other zooms than the active tiles that they overlap.

    Such a tile is redundant if every active tile under or over it is ready, itself or through a ready tile above it that is nearer than the cached one.
    Tiles that overlap no active tile are not redundant, and not in the result if they overlap none.
    """
    pairs = overlapping(cache, active).filter(F.col("a_z") != F.col("b_z"))
    at = ["source_id", "b_z", "b_x", "b_y"]
    above = overlapping(active, ready).filter(F.col("b_z") <= F.col("a_z")).select("source_id", F.col("a_z").alias("b_z"), F.col("a_x").alias("b_x"), F.col("a_y").alias("b_y"), F.col("b_z").alias("ready_z"))
    finest = above.groupBy(*at).agg(F.max("ready_z").alias("ready_z"))
    joined = pairs.join(finest.hint("merge"), at, "left").withColumn("ok", F.coalesce((F.col("ready_z") == F.col("b_z")) | (F.col("ready_z") > F.col("a_z")), F.lit(False)))
    return joined.groupBy("source_id", *[F.col(f"a_{k}").alias(k) for k in "zxy"]).agg(F.bool_and("ok").alias("is_redundant"))


def budget(protected: Column) -> Column:
    """Bytes that a cache may hold: the protected ones and 16 MiB, from 32 to 128 MiB; from 112 MiB on the protected ones, 128 MiB at least."""
    return F.when(protected >= 112 * MIB, F.greatest(protected, F.lit(128 * MIB))).otherwise(F.least(F.greatest(protected + 16 * MIB, F.lit(32 * MIB)), F.lit(128 * MIB)))


def lru_evict(cache: DataFrame, protected: DataFrame, *, pool: str = "source_id", limit: Column | None = None, slot: Column | None = None) -> DataFrame:
    """The tiles to evict: (pool, source_id, z, x, y, bytes). Per pool, unprotected tiles by last use, until the total is within the budget.

    cache: source_id, z, x, y, bytes, last_used; protected: source_id, z, x, y. limit: a fixed budget, else that of the protected bytes.

    slot: the span of time that a tile was last used in (by default its day). Bytes are summed by pool and slot first, and running totals of those few sums tell
    which slots go whole and which one the budget ends in: only the tiles of that slot are put in order. So a pool of any size is never one task's.
    """
    marked = cache.join(protected.select(*TILE).distinct().withColumn("_safe", F.lit(True)), TILE, "left").withColumn("_safe", F.coalesce("_safe", F.lit(False)))
    marked = marked.withColumns({"_pool": F.col(pool), "_slot": slot if slot is not None else F.date_trunc("day", "last_used")})
    sums = marked.groupBy("_pool", "_slot").agg(F.sum("bytes").alias("_all"), F.sum(F.when(F.col("_safe"), F.col("bytes")).otherwise(0)).alias("_kept"))
    of_pool = Window.partitionBy("_pool")
    earlier = of_pool.orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    loose = F.col("_all") - F.col("_kept")
    total, kept = F.sum("_all").over(of_pool), F.sum("_kept").over(of_pool)
    sums = sums.withColumns({"_over": total - (limit if limit is not None else budget(kept)), "_gone": F.coalesce(F.sum(loose).over(earlier), F.lit(0)), "_loose": loose}).filter("_over > _gone AND _loose > 0")
    slots = sums.select("_pool", "_slot", "_over", "_gone", (F.col("_gone") + F.col("_loose") <= F.col("_over")).alias("_whole"))
    same = F.col("c._slot").eqNullSafe(F.col("s._slot")) & (F.col("c._pool") == F.col("s._pool"))
    met = marked.filter(~F.col("_safe")).alias("c").join(slots.alias("s"), same).select("c._pool", "c._slot", *[F.col(f"c.{k}") for k in (*TILE, "bytes", "last_used")], "s._over", "s._gone", "s._whole")
    cols = [F.col("_pool").alias("pool"), *TILE, "bytes"]
    order = Window.partitionBy("_pool").orderBy("last_used", *TILE).rowsBetween(Window.unboundedPreceding, -1)
    last = met.filter(~F.col("_whole")).withColumn("_gone", F.col("_gone") + F.coalesce(F.sum("bytes").over(order), F.lit(0))).filter("_over > _gone")
    return met.filter("_whole").select(cols).unionByName(last.select(cols))


def evict_report(cache: DataFrame, evicted: DataFrame, *, pool: str = "source_id") -> DataFrame:
    """(pool, n_evicted, bytes_evicted, bytes_left) of every pool."""
    have = cache.groupBy(F.col(pool).alias("pool")).agg(F.sum("bytes").alias("_total"))
    gone = evicted.groupBy("pool").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return have.join(gone, "pool", "left").select("pool", F.coalesce("n", F.lit(0)).alias("n_evicted"), F.coalesce("b", F.lit(0)).alias("bytes_evicted"), (F.col("_total") - F.coalesce("b", F.lit(0))).alias("bytes_left"))
