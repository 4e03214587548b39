"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints that differ in at most three bits, one
segment differs in at most one. Every segment is indexed once as it is and 32 times with one bit left out; equal keys
are joined (for a left-out bit: those that have it set with those that do not) and every candidate is verified.
Fingerprints take part once each, however many documents have them. A key's fingerprints are not paired out: they are
searched breadth first, and only links that connect them are passed on; keys with more than `block` fingerprints take a byte of the other
segment as well, and what is large even so is dealt out as pairs of blocks.

Null texts and texts without words have fingerprint zero, linked like any other. Repeated rows are linked as copies; rows
with a null id (and texts of any length, taken whole) get their fingerprint, and count in no component's smallest id (a component of null ids alone is null).
An empty table gives no rows. Other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import lean, saved
from tilewright.llm.graph import components

BITS, SEGMENT, BLOCK, TASK = 64, 32, 2048, 16384


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (A-Z in lower case; repeats count)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start = (end - size)[: len(words) - width + 1].tolist()
    end = (end - 1)[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(start), 1 << 14):
        hashed = np.array([h(line[a:b], seed) for a, b in zip(start[i : i + (1 << 14)], end[i : i + (1 << 14)], strict=True)], "<u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(lean(made), schema)


def variants(fps: DataFrame) -> DataFrame:
    """(key, bit, fp): each segment as it is (bit 0), and with one bit left out (bit: the one left out)."""
    k = F.col("_k")
    segment = F.when(k < 33, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", SEGMENT))
    at = (k % 33).cast("int")
    mask = F.when(at < 32, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    return (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("_k"))
        .select("fp", segment.alias("_s"), mask.alias("_m"), (k.cast("long") * (1 << 32)).alias("_p"))
        .select((F.col("_p") + F.col("_s") - F.col("_s").bitwiseAND(F.col("_m"))).alias("key"), (F.col("_s").bitwiseAND(F.col("_m")) != 0).cast("int").alias("bit"), "fp")
    )


def within(x: np.ndarray, y: np.uint64, most: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= most


def spanning(fps: np.ndarray, side: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs at most `most` bits apart, of different sides where there are two (side -1: of any).

    Breadth first: a fingerprint that was reached is not compared again, so a dense group costs little more than one pass.
    """
    out: list[tuple[int, int]] = []
    free = np.ones(len(fps), bool)
    both = (side >= 0).any()
    for root in range(len(fps)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                return out
            if both:
                rest = rest[side[rest] != side[i]]
            near = rest[within(fps[rest], fps[i], most)]
            free[near] = False
            out += [(int(fps[i].view(np.int64)), int(x)) for x in fps[near].view(np.int64)]
            todo += near.tolist()
    return out


def links(fps: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at most `most` (up to 3) bits apart: all of them where a key has two
    fingerprints, else enough to connect the same ones."""
    # A fixed number of fingerprints a task, as each becomes 66 rows.
    n_fps = fps.count()
    index = variants(fps.repartition(max(1, -(-n_fps // TASK)), "fp"))
    of_key = index.groupBy("key").agg(*[f(F.when(F.col("bit") == s, x)).alias(f"{n}{s}") for s in (0, 1) for f, n, x in ((F.count, "n", F.lit(1)), (F.min, "lo", F.col("fp")), (F.max, "hi", F.col("fp")))])
    exact = (F.shiftrightunsigned("key", 32) % 33) == 32
    # A table, as both what two fingerprints share and what more share come from it; single fingerprints end here.
    shared = saved(of_key.filter(F.when(exact, F.col("n0") > 1).otherwise((F.col("n0") > 0) & (F.col("n1") > 0))), "keys")
    n = F.col("n0") + F.col("n1")
    pairs = shared.filter(n == 2).select(F.least("lo0", F.coalesce("lo1", "hi0")).alias("a"), F.greatest("lo0", F.coalesce("lo1", "hi0")).alias("b"))
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    more = index.join(shared.filter(n > 2).select("key", n.alias("n"), exact.alias("exact")).hint("merge"), "key")
    side = F.when(F.col("exact"), F.lit(-1)).otherwise(F.col("bit")).alias("side")
    dealt = more.filter(F.col("n") <= block).select("key", F.lit(0).cast("long").alias("cell"), side, "fp")
    # Large keys take a byte of the other segment as well: of two that differ in at most three bits, one of its four bytes is equal.
    other = F.when(F.shiftrightunsigned("key", 32) < 33, F.shiftrightunsigned("fp", SEGMENT)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    byte = lambda j: (F.shiftrightunsigned(other, 8 * j).bitwiseAND(F.lit(255)) + 1 + 256 * j).cast("long")
    large = saved(more.filter(F.col("n") > block).select("key", F.explode(F.array(*[byte(j) for j in range(4)])).alias("sub"), side, "fp"), "large")
    sizes = large.groupBy("key", "sub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own)))
    spread = large.join(sizes.hint("merge"), ["key", "sub"]).select("key", "sub", F.explode(cells).alias("_c"), "side", "fp")
    dealt = dealt.unionByName(spread.select("key", (F.col("sub") * (1 << 40) + F.col("_c")).alias("cell"), "side", "fp"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def of(cols: list[np.ndarray]) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if len(cols[0]):
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]))
                for a, z in zip(cut, [*cut[1:], len(cols[0])], strict=True):
                    found += spanning(cols[3][a:z].view(np.uint64), cols[2][a:z], most)
            x = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x.min(axis=1)), pa.array(x.max(axis=1))], names=["a", "b"])

        for b in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            # The last key may go on in the next batch.
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(same) else 0
            held = [c[cut:] for c in cols]
            yield of([c[:cut] for c in cols])
        yield of(held)

    found = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(lean(connect), "a long, b long")
    return pairs.unionByName(found).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id that is reachable over links, the row's own included."""
    own = saved(fingerprints(docs, id_col=id_col, text=text, width=width, seed=seed), "fingerprints")
    distinct = saved(own.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    of = components(links(distinct.select("fp"), most))
    joined = distinct.join(of.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = saved(joined, "classes")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(least.hint("merge"), "component").select("fp", "component_id")
    return own.join(by_fp.hint("merge"), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
