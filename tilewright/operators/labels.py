"""Jobs over features and label placements of scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.staging import in_order, written

#: What a source layer's name holds, in order of precedence, and the kind of its features.
FEATURE_KINDS = (
    ("Road", ("road", "transportation")), ("Transit", ("transit",)), ("Water", ("water", "marine")), ("NaturalFeature", ("natural", "landcover")),
    ("Landmark", ("poi", "building")), ("AdministrativeArea", ("boundary", "admin")), ("Place", ("place", "label")),
)


def classify_feature(source_layer: Column) -> Column:
    """Kind of feature, by the first rule that a part of its source layer's name meets; else Other."""
    name, out = F.lower(source_layer), None
    for kind, parts in FEATURE_KINDS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Other")


def dedupe_named(candidates: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Per scene (by) and name the candidate of the highest layer order, then prominence, then first sequence. Reduced before the shuffle."""
    best = F.max(F.struct("layer_order", "prominence", (-F.col("seq")).alias("_s"), *keep)).alias("_b")
    rows = candidates.filter(F.col("name").isNotNull()).groupBy(*by, "name").agg(best)
    return rows.select(*by, "name", "_b.layer_order", "_b.prominence", (-F.col("_b._s")).alias("seq"), *[f"_b.{k}" for k in keep])


def top_features(named: DataFrame, by: list[str], k: int = 8) -> DataFrame:
    """The first k by layer order and prominence (descending), then distance, then sequence: with `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc("layer_order"), F.desc("prominence"), "distance", "seq")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def describe(ranked: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """(by, text): the first k names that are not blank, as "a", "a and b" or "a, b and c"."""
    names = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: F.trim(r["name"])), lambda n: n != "")
    rows = ranked.groupBy(*by).agg(F.slice(names, 1, k).alias("_n"))
    n = F.size("_n")
    text = F.when(n == 0, "").when(n == 1, F.get("_n", F.lit(0))).otherwise(F.concat(F.array_join(F.slice("_n", F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get("_n", n - 1)))
    return rows.select(*by, text.alias("text"))


def symbol_bounds(left: Column, top: Column, width: Column, height: Column, rotation: Column) -> dict[str, Column]:
    """Axis-aligned box of a rectangle that is turned about its centre by degrees."""
    r = F.radians(rotation)
    half_w = (F.abs(F.cos(r)) * width + F.abs(F.sin(r)) * height) / 2
    half_h = (F.abs(F.sin(r)) * width + F.abs(F.cos(r)) * height) / 2
    x, y = left + width / 2, top + height / 2
    return {"x0": x - half_w, "y0": y - half_h, "x1": x + half_w, "y1": y + half_h}


#: What one symbol at one of its places is: repeats along a line are symbols of their own.
SYMBOL = ["scene_id", "symbol_group", "placement_index"]


def collision_groups(placements: DataFrame) -> DataFrame:
    """placements with `component` (0, or with an optional member 1 for the icon and 2 for the text of a symbol's place) and `family` (the place's first sequence)."""
    own = Window.partitionBy(*SYMBOL)
    optional = F.max(F.col("optional").cast("int")).over(own) == 1
    return placements.withColumn("component", F.when(optional, F.when(F.col("kind") == "icon", 1).otherwise(2)).otherwise(0)).withColumn("family", F.min("seq").over(own))


def collision_candidates(grouped: DataFrame) -> DataFrame:
    """One row for each (scene, symbol group, placement, component): union box, least sort key, most padding, flags that hold for all members, glyphs (texts), first sequence."""
    boxes = grouped.withColumns(symbol_bounds(*[F.col(c) for c in ("left", "top", "width", "height", "rotation")]))
    return boxes.groupBy(*SYMBOL, "component").agg(
        F.min("family").alias("family"), F.min_by("style_order", "seq").alias("style_order"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min("sort_key").alias("sort_key"), F.max("padding").alias("padding"), F.bool_and("allow_overlap").alias("allow_overlap"), F.bool_and("ignore_placement").alias("ignore_placement"), F.count_if(F.col("kind") == "text").alias("n_glyphs"), F.min("seq").alias("seq"),
    )


#: Side of the cells in which boxes meet.
CELL = 64.0


class Boxes:
    """Accepted boxes of a scene, looked up by cells. A box comes with the first and the last cell that it touches in either direction."""

    def __init__(self) -> None:
        self.at: dict[tuple[int, int], list[tuple]] = {}

    def hit(self, x0: float, y0: float, x1: float, y1: float, family: int, cx0: int, cy0: int, cx1: int, cy1: int) -> bool:
        for cx in range(cx0, cx1 + 1):
            for cy in range(cy0, cy1 + 1):
                for a, b, c, d, f in self.at.get((cx, cy), ()):
                    if a < x1 and c > x0 and b < y1 and d > y0 and f != family:
                        return True
        return False

    def add(self, x0: float, y0: float, x1: float, y1: float, family: int, cx0: int, cy0: int, cx1: int, cy1: int) -> None:
        for cx in range(cx0, cx1 + 1):
            for cy in range(cy0, cy1 + 1):
                self.at.setdefault((cx, cy), []).append((x0, y0, x1, y1, family))


#: Candidates of a scene that one task resolves in order. Larger scenes are resolved by rounds.
MOST_IN_TASK = 50_000
RANK = ["scene_id", "style_order", "sort_key", "seq"]


def before(a: str, b: str) -> Column:
    """Whether candidate a is placed before b."""
    first = lambda c, up: F.col(f"{a}.{c}") < F.col(f"{b}.{c}") if up else F.col(f"{a}.{c}") > F.col(f"{b}.{c}")
    same = lambda c: F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return first("style_order", False) | (same("style_order") & (first("sort_key", True) | (same("sort_key") & first("seq", True))))


def conflicts(candidates: DataFrame, cell: float = CELL) -> DataFrame:
    """(scene_id, seq, by): pairs of candidates of a scene, of different families, whose padded boxes overlap, `by` being placed before `seq`; `by` blocks and `seq` can be blocked.
    Boxes meet in cells, and count in the first one that both touch."""
    boxes = candidates.select(*RANK, "family", "allow_overlap", "ignore_placement", *[(F.col(c) + s * F.col("padding")).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / cell), F.floor(F.col(f"{a}1") / cell))
    cells = boxes.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    a, b = cells.filter("NOT ignore_placement").alias("a"), cells.filter("NOT allow_overlap").alias("b")
    key = (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    meet = (F.col("a.x0") < F.col("b.x1")) & (F.col("a.x1") > F.col("b.x0")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("a.y1") > F.col("b.y0"))
    home = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a.cy"))
    return a.join(b, key & (F.col("a.family") != F.col("b.family")) & meet & home & before("a", "b")).select("b.scene_id", "b.seq", F.col("a.seq").alias("by"))


def resolve_by_rounds(candidates: DataFrame) -> DataFrame:
    """candidates with `accepted`, as placing them in order would have it. In each round, a candidate that an accepted one blocks is rejected, and one whose blockers are all rejected is
    accepted; a scene's first undecided candidate is always decided, so rounds end, most often after some ten. No scene is a group."""
    open_pairs = written(conflicts(candidates), "conflicts")
    key = ["scene_id", "seq"]
    by = [F.col("scene_id"), F.col("by").alias("seq")]
    rejected = None
    while True:
        # Whoever nobody blocks any more is accepted, and rejects those that it blocks.
        blocked = open_pairs.select(*key).distinct()
        free = open_pairs.select(*by).distinct().join(blocked, key, "left_anti")
        if free.isEmpty():
            break
        gone = written(open_pairs.join(free.select("scene_id", F.col("seq").alias("by")), ["scene_id", "by"]).select(*key).distinct(), "rejected")
        rejected = gone if rejected is None else rejected.unionByName(gone)
        rest = open_pairs.join(gone, key, "left_anti").join(gone.select("scene_id", F.col("seq").alias("by")), ["scene_id", "by"], "left_anti")
        open_pairs = written(rest.select(*key, "by"), "conflicts")
    if rejected is None:
        return candidates.withColumn("accepted", F.lit(True))
    return candidates.join(rejected.withColumn("_r", F.lit(True)), key, "left").withColumn("accepted", F.col("_r").isNull()).drop("_r").select(*candidates.columns, "accepted")


def resolve_collisions(candidates: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """candidates with `accepted`: taken in order of layer (descending), sort key and sequence; one is rejected if its padded box
    overlaps an accepted box of another family, unless it allows overlap; boxes that ignore placement block nothing. A scene of up to `most_in_task` candidates is one task's; larger
    ones are resolved by rounds over the pairs that overlap, with the same result."""

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, taken = None, Boxes()
        for b in batches:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            real = lambda c: column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            sides = [real(c) + s * real("padding") for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
            if any(np.isinf(v).any() for v in sides):
                raise ValueError("a box has no end")
            # A box without a place or a size meets nothing: it has no cells.
            known = ~np.isnan(sides).any(axis=0)
            cells = [np.where(known, np.floor(v / CELL), -(k > 1)).astype(np.int64).tolist() for k, v in enumerate(sides)]
            out = []
            for s, free, passes, *box in zip(*(column(c).to_pylist() for c in ("scene_id", "allow_overlap", "ignore_placement")), *(v.tolist() for v in sides), column("family").to_pylist(), *cells, strict=True):
                if s != scene:
                    scene, taken = s, Boxes()
                ok = bool(free or not taken.hit(*box))
                if ok and not passes:
                    taken.add(*box)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "accepted"])

    def placed(rows: DataFrame) -> DataFrame:
        """Scenes are dealt in a fixed number of partitions, and placed as their candidates stream by in order: no scene is gathered."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        key = F.when(~F.isnan("sort_key"), F.col("sort_key"))
        order = ["scene_id", F.col("style_order").desc_nulls_last(), key.asc_nulls_last(), F.col("seq").asc_nulls_last()]
        return rows.repartition(n, "scene_id").sortWithinPartitions(*order).mapInArrow(greedy, schema)

    candidates = written(candidates, "candidates")
    large = candidates.groupBy("scene_id").count().filter(F.col("count") > most_in_task).select("scene_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields) + ", accepted boolean"
    if large.isEmpty():
        return placed(candidates)
    small = placed(candidates.join(large, "scene_id", "left_anti"))
    return small.unionByName(resolve_by_rounds(candidates.join(large, "scene_id", "left_semi")))


def batch_runs(placements: DataFrame, key: list[str]) -> DataFrame:
    """placements with `batch`: the number of the run of equal keys, in order of style order, sort key and sequence, within a scene."""
    order = Window.partitionBy("scene_id").orderBy("style_order", "sort_key", "seq")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(order))
    return placements.withColumn("_new", F.when(same & (F.row_number().over(order) > 1), 0).otherwise(1)).withColumn("batch", F.sum("_new").over(order)).drop("_new")


def element_order(elements: DataFrame) -> DataFrame:
    """Visible elements with `draw_order`, dense over all layers: by layer, z-index, collection index, id. Ranks are taken by ranges of all four: neither a layer nor the table is one task's."""
    return in_order(elements.filter("is_visible"), ["layer_index", "z_index", "collection_index", "element_id"], "draw_order")


def layer_summary(elements: DataFrame) -> DataFrame:
    return elements.groupBy("layer_index").agg(F.count("*").alias("n_elements"), F.count_if("is_visible").alias("n_visible"), F.countDistinct("texture_id").alias("n_textures"))


def validate_batch(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(element_id, n, reason) of a batch's ids: null, repeated, present, or ok."""
    counts = batch.groupBy("element_id").agg(F.count("*").alias("n"))
    known = existing.select("element_id").distinct().withColumn("_has", F.lit(True))
    reason = F.when(F.col("element_id").isNull(), "null").when(F.col("n") > 1, "repeated").when(F.col("_has"), "present").otherwise("ok")
    return counts.join(known, "element_id", "left").select("element_id", "n", reason.alias("reason"))


def symbol_stats(placements: DataFrame) -> DataFrame:
    is_icon = F.col("kind") == "icon"
    return placements.groupBy("scene_id", "style_order").agg(
        F.count_if(is_icon).alias("n_icons"), F.count_if(~is_icon).alias("n_texts"), F.count_if(F.col("rotation") != 0).alias("n_rotated"), F.count_if(F.col("sort_key") != 0).alias("n_sorted"), F.count_if(F.col("allow_overlap") | F.col("ignore_placement")).alias("n_override")
    )
