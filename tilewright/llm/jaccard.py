"""Near copies by the Jaccard similarity of their five-word shingles.

Candidates come from MinHash bands: a pair of similarity 0.8 shares one of 24 bands of 5 with a probability of 0.9999. Every
candidate is verified on the shingles themselves. Texts with the same shingles take part once. In bands of up to `small` texts all pairs
are candidates. Texts that meet in larger bands are families, within which nothing is lost: what any pair of a family connects, the links connect.

Words are cut at white space, with A-Z in lower case; a text of fewer words than the width is one shingle, texts without words (null
ones too) are copies of each other. Texts are taken whole. An empty table has neither nodes nor links. Other columns do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import bytesvec as V
from tilewright.llm.common import lean, saved
from tilewright.llm.graph import components
from tilewright.llm.labelled import LOWER

WIDTH, LEAST, BANDS, ROWS, SMALL = 5, 0.8, 24, 5, 8
#: Texts and shingles that a task compares with each other.
BLOCK, MEMBERS = 2048, 1 << 21
#: Odd factors and offsets of the permutations, fixed by a seed.
_RNG = np.random.default_rng(5)
FACTOR = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the shingles of a run of texts, in order, repeats included."""
    data = LOWER[data]
    start, end, row = V.words(data, at)
    values = V.word_hashes(data, start, end, 31)
    if len(values) >= width:
        whole = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
        found, of = V.windowed(values, width)[whole], row[whole]
    else:
        found, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(row, minlength=len(at) - 1)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        head = np.searchsorted(row, few, "left")
        found = np.concatenate([found, [V.windowed(values[h : h + k], int(k))[0] for h, k in zip(head, n[few], strict=True)]])
        of = np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, of


def sets_of(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, in order, and the place where each row that has any starts."""
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.flatnonzero(np.diff(of, prepend=-1))


def bands(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bands' keys of sets that are not empty: a row of BANDS numbers each."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(starts), k, np.uint64)
        for j in range(k * ROWS, k * ROWS + ROWS):
            x = found * FACTOR[j]
            x += OFFSET[j]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            key = V.joined(key, np.minimum.reduceat(x, starts))
        out[:, k] = key
    return out


def signatures(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, digest, bands): digest is equal for texts with the same shingles."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, at in V.runs(b.column(1)):
                n = len(at) - 1
                found, of = shingles(data, at)
                found, starts = sets_of(found, of)
                has = np.unique(of)
                digest = np.zeros(n, np.int64)
                ends = np.append(starts[1:], len(found))[: len(starts)]
                digest[has] = [xxhash.xxh3_64_intdigest(found[s:e].tobytes()) - (1 << 63) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys = bands(found, starts) if len(starts) else np.zeros((0, BANDS), np.uint64)
                size = np.zeros(n, np.int32)
                size[has] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(digest), lists], names=["node", "digest", "bands"])

    return rows.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(lean(made), "node long, digest long, bands array<long>")


def shingled(texts: DataFrame) -> DataFrame:
    """(node, s): the shingles of texts (node, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, at in V.runs(b.column(1)):
                n = len(at) - 1
                found, of = sets_of_rows(*shingles(data, at), n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.ListArray.from_arrays(pa.array(of), pa.array(found.view(np.int64)))], names=["node", "s"])

    return texts.mapInArrow(lean(made), "node long, s array<long>")


def sets_of_rows(found: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each of n rows, and the n + 1 places where they start and end."""
    rows = np.unique(of)
    found, starts = sets_of(found, of)
    size = np.zeros(n, np.int32)
    size[rows] = np.diff(np.append(starts, len(found)))
    return found, np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, s) are alike."""
    side = [sets.select(F.col("node").alias(c), F.col("s").alias(f"_{c}")).hint("merge") for c in ("a", "b")]
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(side[0], "a").join(side[1], "b").filter(both >= least * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def alike_in(sizes: np.ndarray, shared: np.ndarray, size: int, least: float) -> np.ndarray:
    return shared >= least * (sizes + size - shared)


def flat(sets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(the sets' members as small numbers, sizes) of sets that are not empty."""
    column = sets.combine_chunks()
    return np.unique(column.flatten().to_numpy(), return_inverse=True)[1], np.diff(column.offsets.to_numpy())


def connected(t: pa.Table, least: float = LEAST) -> pa.Table:
    """Links (a, b) that connect what pairs of a family (node, s) connect. Breadth first: what was reached is not compared again, so a dense family costs little more than
    one pass, and one without links all its pairs, counted here and made nowhere."""
    node, (members, sizes) = t["node"].to_numpy(), flat(t["s"])
    ends = np.cumsum(sizes)
    mark = np.zeros(members.max() + 1, bool)
    free, out, todo = np.arange(len(node)), [], []
    held = members
    while len(free):
        if not todo:
            todo, held, free = [int(free[0])], held[sizes[free[0]] :], free[1:]
            continue
        i = todo.pop()
        own = members[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        starts = np.cumsum(sizes[free]) - sizes[free]
        near = alike_in(sizes[free], np.add.reduceat(mark[held], starts, dtype=np.int64), sizes[i], least)
        mark[own] = False
        if near.any():
            todo += free[near].tolist()
            out.append(np.column_stack([np.full(near.sum(), node[i]), node[free[near]]]))
            held, free = held[np.repeat(~near, sizes[free])], free[~near]
    x = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pa.table({"a": x.min(axis=1), "b": x.max(axis=1)})


def across(t: pa.Table, least: float = LEAST) -> pa.Table:
    """Links between the outer texts of a block and all texts of another one (outer, main, node, s): those that connect what was not connected. Texts of the main part are."""
    node, outer, main, (members, sizes) = t["node"].to_numpy(), t["outer"].to_numpy(zero_copy_only=False), t["main"].to_numpy(zero_copy_only=False), flat(t["s"])
    ends, mark, out = np.cumsum(sizes), np.zeros(members.max() + 1, bool), []
    rest = np.flatnonzero(~outer)
    held, starts = members[np.repeat(~outer, sizes)], np.cumsum(sizes[rest]) - sizes[rest]
    root = {int(k): int(k) for k in node} | {int(k): -1 for k in node[main]} | {-1: -1}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in np.flatnonzero(outer).tolist() if len(rest) else []:
        own = members[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        near = alike_in(sizes[rest], np.add.reduceat(mark[held], starts, dtype=np.int64), sizes[i], least)
        mark[own] = False
        for k in node[rest[near]].tolist():
            x, y = find(int(node[i])), find(k)
            if x != y:
                # The main part's number is -1, and stays a root.
                root[max(x, y)] = min(x, y)
                out.append((min(int(node[i]), k), max(int(node[i]), k)))
    x = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": x[:, 0], "b": x[:, 1]})


def within_families(families: DataFrame, sets: DataFrame, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) that connect the texts of each family (node, component, met) as all its pairs do. A family of up to `block` texts and `members` shingles is one group. In a larger one
    all texts are compared with a pivot, and those that are not like it with four more of those that are. Only what is left is compared with all texts, in pairs of blocks."""
    rows = saved(families.join(sets.hint("merge"), "node").withColumnRenamed("component", "family"), "families")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("s")) / members)).cast("int")
    size = saved(rows.groupBy("family").agg(parts.alias("parts"), F.max_by("node", F.struct("met", "node")).alias("pivot")), "sizes")
    small = rows.join(size.filter("parts = 1").select("family").hint("merge"), "family").select("family", "node", "s")
    out = small.groupBy("family").applyInArrow(lambda t: connected(t), "a long, b long")
    large = size.filter("parts > 1")
    if large.isEmpty():
        return out
    rows = rows.join(large.hint("merge"), "family")
    star = saved(verified(rows.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), sets), "stars")
    held = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    main = rows.select("family", "node").join(held.hint("merge"), "node", "left_semi")
    more = main.groupBy("family", F.pmod(F.xxhash64("node"), F.lit(4)).alias("_p")).agg(F.max("node").alias("pivot")).drop("_p")
    rest = rows.select("family", "node").join(held.hint("merge"), "node", "left_anti")
    tried = rest.join(more.hint("merge"), "family").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    again = saved(verified(tried, sets), "stars")
    held = saved(held.unionByName(again.select(F.col("a").alias("node"))).unionByName(again.select(F.col("b").alias("node"))).distinct(), "held")
    known = rows.select("family", "node", "s", "parts").join(held.withColumn("_h", F.lit(True)).hint("merge"), "node", "left").withColumn("main", F.coalesce("_h", F.lit(False))).drop("_h")
    left = known.filter("NOT main").groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("s")) / members)).cast("int").alias("outers"))
    known = known.join(left.hint("merge"), "family")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = known.filter("NOT main").select("family", own("outers").alias("i"), every("parts").alias("j"), F.lit(True).alias("outer"), "main", "node", "s")
    inner = known.select("family", every("outers").alias("i"), own("parts").alias("j"), F.lit(False).alias("outer"), "main", "node", "s")
    crossed = outer.unionByName(inner).groupBy("family", "i", "j").applyInArrow(lambda t: across(t), "a long, b long")
    return out.unionByName(star).unionByName(again).unionByName(crossed)


def links(rows: DataFrame, *, id_col: str = "_row", text: str = "text", small: int = SMALL, block: int = BLOCK, members: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, node being the least id of a text with the same shingles, and the links (a, b) between nodes. Ids are distinct longs; rows with a null id are left out."""
    own = saved(signatures(rows.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text), "signatures")
    first = own.groupBy("digest").agg(F.min("node").alias("least"))
    of = saved(own.select(F.col("node").alias(id_col), "digest").join(first.hint("merge"), "digest").select(id_col, F.col("least").alias("node")), "nodes")
    keys = own.join(first.select(F.col("least").alias("node")).hint("merge"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    band = saved(keys.join(shared.hint("merge"), "key"), "bands")
    few = band.filter(F.col("n") <= small).select("key", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b").hint("merge"), "key").filter("a < b").select("a", "b").distinct()
    texts = rows.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text}`").alias("text")).join(band.select("node").distinct().hint("merge"), "node", "left_semi")
    sets = saved(shingled(texts), "candidates")
    many = band.filter(F.col("n") > small)
    families = components(many.select(F.col("node").alias("a"), F.col("least").alias("b")))
    # How many texts a text shares bands with: what many are like stands in the middle of them.
    families = families.join(many.groupBy("node").agg(F.sum("n").alias("met")).hint("merge"), "node")
    return of, verified(pairs, sets).unionByName(within_families(families, sets, block, members)).distinct()
