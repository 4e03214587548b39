"""Substring deduplication with a count-min prefilter.

A window is `width` consecutive words. Of each distinct window the first place (smallest id, then earliest start)
stays; the words of every other place go. All windows are judged on the input.

1. Every partition sketches its windows; the partitions' sketches are merged and sent to all. A window is counted
   through its anchor, the shorter run of words with the least hash inside it, which equal windows share: the count
   of an anchor is at least that of each of its windows, so the sketch never underestimates, and about a seventh of
   the places are counted. Counters stop at two.
2. Only windows whose estimate is two or more are grouped, by 95 bits of hash. Within a batch only the first place of a window goes
   on to the shuffle, so a window that all documents share weighs as much as one that two share.
3. The places found to be repeats are joined back to the texts, and every one of them is held against the words of the place that it
   repeats: inside a batch word by word, else by 128-bit digests of both places' words. If two windows that share a hash differ, nothing is
   returned of that try, and the job is run again with other hashes: what is removed does repeat.

The sketch has a bounded size (`most_counters`): beyond the input that fits it, estimates grow, more windows are grouped, and the result
stays the same.

Null texts have no words. Null ids come after all others. Rows that share an id count as one place for equal starts, so
exact repeats of a row (same id, same text) do not remove each other's words. Texts shorter than a window keep all
words. Words and texts of any length are taken whole: a text's words are held one text at a time. An empty table gives no rows. Other
columns do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import bytesvec as V
from tilewright.llm.common import lean, saved

ANCHOR, SLICE_BITS, NO_ID, CUT, TRIES = 8, 16, (1 << 63) - 1, 256, 8
#: Second halves of hashes that are none: places known to repeat, and places whose words differ from those that share their hash.
KNOWN, CLASH = -1, -2


def windows(values: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows that lie in one row, least anchor hash of each, hashes of anchor places that are least in one).

    Anchors that tie for the least are all counted, so that two places of a window always have two anchor places.
    """
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashed = V.windowed(values, min(ANCHOR, width))
    within = width - min(ANCHOR, width) + 1
    least = V.least_of(hashed, within)
    whole = row[: len(row) - width + 1] == row[width - 1 :]
    # An anchor place is counted if it is the least of a whole window that it lies in.
    shown = np.where(whole, least, np.uint64(0))
    pad = np.zeros(within - 1, np.uint64)
    greatest = V.least_of(np.concatenate([pad, shown, pad]), within, np.maximum)
    lies = V.least_of(np.concatenate([pad.astype(bool), whole, pad.astype(bool)]), within, np.maximum)
    at = np.flatnonzero(whole)
    return at, least[at], hashed[lies & (greatest == hashed)]


def counters(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each hash, of 2**bits in each row of the sketch."""
    shift = np.uint64(64 - bits)
    return (x >> shift).astype(np.int64), ((x * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def sketch_bits(docs: DataFrame, text: str, most_counters: int) -> int:
    """Enough counters that about one in four is used: a window is counted for about 45 bytes of text."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, size / 11))), SLICE_BITS, np.log2(most_counters)))


def sketch(docs: DataFrame, text: str, width: int, bits: int, seed: int) -> np.ndarray:
    """The merged sketch: for two rows of 2**bits counters a bit each that says whether it reached two."""

    def cells(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Slices of a partition's sketch: which counters are one, and which are two, as 16-bit numbers."""
        hashed = np.concatenate(found)
        for line, cell in enumerate(counters(hashed, bits)):
            cell, count = np.unique(cell, return_counts=True)
            of = cell >> SLICE_BITS
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            low = (cell & ((1 << SLICE_BITS) - 1)).astype(np.uint16)
            parts = zip(np.split(low, cut[1:]), np.split(count, cut[1:]), strict=True)
            one, two = zip(*((a[c == 1].tobytes(), a[c > 1].tobytes()) for a, c in parts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array((of[cut] * 2 + line).astype(np.int32)), pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["slice", "one", "two"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            for _, data, at in V.runs(b.column(0)):
                start, end, row = V.words(data, at)
                x = windows(V.word_hashes(data, start, end, seed), row, width)[2]
                found.append(x)
                n += len(x)
                if n > 2_000_000:
                    yield from cells(found)
                    found, n = [], 0
        if n:
            yield from cells(found)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's rows come as a stream, so that no worker holds what all partitions say of it."""
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for b in batches:
            for name, by in (("one", 1), ("two", 2)):
                for x in b.column(name):
                    total[np.frombuffer(x.as_buffer(), np.uint16)] += by
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(total > 1, bitorder="little").tobytes()]})

    parts = docs.select(F.col(text)).mapInArrow(lean(count), "slice int, one binary, two binary")
    out = np.zeros((2, 1 << (bits - 3)), np.uint8)
    step = 1 << (SLICE_BITS - 3)
    for r in parts.groupBy("slice").applyInArrow(merge, "slice int, bits binary").toLocalIterator():
        at = (r["slice"] >> 1) * step
        out[r["slice"] & 1, at : at + step] = np.frombuffer(r["bits"], np.uint8)
    return out


def estimated_repeats(least: np.ndarray, seen: np.ndarray, bits: int) -> np.ndarray:
    both = [(seen[k][c >> 3] >> (c & 7).astype(np.uint8)) & 1 for k, c in enumerate(counters(least, bits))]
    return (both[0] & both[1]).astype(bool)


def consecutive(*same: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where a new run starts, of rows in order: where a value of `same` changes, or step does not go up by one."""
    new = np.ones(len(step), bool)
    if len(step):
        new[1:] = step[1:] != step[:-1] + 1
        for x in same:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def places(docs: DataFrame, width: int, bits: int, seen, seed: int, strength: int) -> DataFrame:
    """Of rows (_id, _variant, text): first places in a batch of each window estimated repeated (h1, h2 of 64 and 31 bits; last is 0), runs
    of word numbers [first, last) that are known to be repeats already (h2 is KNOWN, and h1 any number that spreads them), and CLASH rows."""
    names = ["h1", "h2", "_id", "_variant", "first", "last"]

    def batch(h1, h2, ids, variants, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2.astype(np.int32), ids, variants, first.astype(np.int32), last.astype(np.int32))], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(seen.value, np.uint8).reshape(2, -1)
        for b in batches:
            ids, variants = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            got: list[tuple[np.ndarray, ...]] = []
            for i, data, at in V.runs(b.column(2)):
                start, end, row = V.words(data, at)
                values = V.word_hashes(data, start, end, seed)
                begin, least, _ = windows(values, row, width)
                begin = begin[estimated_repeats(least, table, bits)]
                if len(begin):
                    h1 = V.windowed(values, width, begin) >> np.uint64(min(63, 95 - strength))
                    h2 = V.windowed(V.word_hashes(data, start, end, seed + TRIES), width, begin) >> np.uint64(64 - min(31, strength))
                    head = np.searchsorted(row, np.arange(len(at)), "left")
                    got.append((h1, h2, row[begin] + i, begin - head[row[begin]]))
            if not got:
                continue
            h1, h2, row, place = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((place, ids[row], h2, h1))
            h1, h2, row, place = h1[order], h2[order], row[order], place[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            # Places that tie with the first (the same id and start) go on as well.
            tie = (ids[row] == ids[row[lead]]) & (place == place[lead])
            # In the order of the texts, which packs well in the shuffle.
            order = np.flatnonzero(tie)
            order = order[np.lexsort((place[order], row[order]))]
            r, p = row[order], place[order]
            yield batch(h1[order].view(np.int64), h2[order], ids[r], variants[r], p, np.zeros(len(p)))
            later = np.flatnonzero(~tie)
            if not len(later):
                continue
            later = later[np.lexsort((place[later], row[later]))]
            r, p, of, shift = row[later], place[later], row[lead[later]], place[later] - place[lead[later]]
            cut = consecutive(r, of, shift, step=p)
            r, of, shift, first, last = r[cut], of[cut], shift[cut], p[cut], p[np.append(cut[1:], len(p)) - 1] + width
            held: dict[int, list[bytes]] = {}
            for k in {*r.tolist(), *of.tolist()}:
                held[k] = words_of(b.column(2)[k].as_py())
            same = np.array([held[i][s:e] == held[j][s - d : e - d] for i, j, s, e, d in zip(r.tolist(), of.tolist(), first.tolist(), last.tolist(), shift.tolist(), strict=True)])
            yield batch(V.mixed((ids[r] + first).astype(np.uint64)).view(np.int64), np.where(same, KNOWN, CLASH), ids[r], variants[r], first, last)

    return docs.mapInArrow(lean(find), "h1 long, h2 int, _id long, _variant long, first int, last int")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


#: A repeat: the window at `first`, and the place whose words it repeats, `_shift` words earlier in a text (_src, _src_variant). Known runs and clashes have no source, and their number
#: of words for a shift.
REPEAT = "_kind int, _src long, _src_variant long, _shift int, first int"


def repeats(found: DataFrame) -> DataFrame:
    """(_id, _variant, REPEAT) of found places: a row for each that is not the first of its window."""
    ordered = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "_id", "first", "_variant")
    names = ["_id", "_variant", "_kind", "_src", "_src_variant", "_shift", "first"]

    def later(c: list[np.ndarray]) -> pa.RecordBatch:
        """Of whole keys' rows."""
        h1, h2, ids, variants, first, last = c
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        sure = h2 < 0
        keep = sure | (ids != ids[lead]) | (first != first[lead])
        none = np.zeros_like(ids)
        out = [ids, variants, np.where(sure, h2, 0), np.where(sure, none, ids[lead]), np.where(sure, none, variants[lead]), np.where(sure, last - first, first - first[lead]), first]
        kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(k)) for x, k in zip(out, kinds, strict=True)], names=names)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 6
        for b in batches:
            c = [np.concatenate([h, x.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, x in zip(held, b.columns, strict=True)]
            # The last key may go on in the next batch.
            cut = int(np.argmax((c[0] == c[0][-1]) & (c[1] == c[1][-1]))) if len(c[0]) else 0
            held = [x[cut:] for x in c]
            yield later([x[:cut] for x in c])
        yield later(held)

    return ordered.mapInArrow(lean(reduce), f"_id long, _variant long, {REPEAT}")


def runs_of(entries: pa.StructArray, width: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int]]]:
    """(runs [first, last) of words that go, pieces (source, its variant, from, to, shift) of the source's words to hold against them) of a text's repeats.

    Pieces end at every CUT words of the source, so that texts which repeat the same words ask for the same pieces, and what is asked of a text
    is bounded by its own length.
    """
    lists = entries.field(4)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    kind, src, variant, shift = (entries.field(k).to_numpy(zero_copy_only=False)[of] for k in range(4))
    first = lists.flatten().to_numpy(zero_copy_only=False)
    last = first + np.where(kind == 0, width, shift)
    known = kind == KNOWN
    gone = list(zip(first[known].tolist(), last[known].tolist(), strict=True))
    at = np.flatnonzero(kind == 0)
    at = at[np.lexsort((first[at], shift[at], variant[at], src[at]))]
    cut = consecutive(src[at], variant[at], shift[at], step=first[at])
    ends = np.append(cut[1:], len(at))[: len(cut)] - 1
    pieces = []
    for i, a, z in zip(at[cut].tolist(), first[at[cut]].tolist(), last[at[ends]].tolist(), strict=True):
        gone.append((a, z))
        d = int(shift[i])
        edges = [a - d, *range((a - d) // CUT * CUT + CUT, z - d, CUT), z - d]
        pieces += [(int(src[i]), int(variant[i]), s, e, d) for s, e in zip(edges, edges[1:], strict=False)]
    return gone, pieces


def asked(by_text: DataFrame, width: int) -> DataFrame:
    """(_id, _variant, asked: array<struct<s,e>>): the distinct pieces of each source."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {p[:4] for e in b.column(0) for p in runs_of(e.values, width)[1]}
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_id", "_variant", "s", "e"])

    rows = by_text.select("entries").mapInArrow(lean(of), "_id long, _variant long, s int, e int").distinct()
    return rows.groupBy("_id", "_variant").agg(F.collect_list(F.struct("s", "e")).alias("asked"))


def merged(runs: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n words lie in one of the runs."""
    change = np.zeros(n + 1, np.int64)
    if runs:
        first, last = np.array(runs).T
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(last, n), -1)
    return np.cumsum(change[:-1]) > 0


def digest(words: list[bytes]) -> tuple[int, int]:
    x = blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def once(own: DataFrame, width: int, bits: int, id_type: str, keep_text: bool, seed: int, strength: int) -> DataFrame | None:
    """A try: the result, or None if two windows that differ share a hash."""
    spark = own.sparkSession
    seen = spark.sparkContext.broadcast(sketch(own, "_text", width, bits, seed).tobytes())
    rows = repeats(places(own.select("_id", "_variant", "_text"), width, bits, seen, seed, strength))
    # By source first, which takes most of the rows together before they are shuffled.
    source = [c.split()[0] for c in REPEAT.split(", ")[:-1]]
    by_source = rows.groupBy("_id", "_variant", *source).agg(F.collect_list("first").alias("firsts"))
    by_text = saved(by_source.groupBy("_id", "_variant").agg(F.collect_list(F.struct(*source, "firsts")).alias("entries")), "repeats")
    if not by_text.filter(F.exists("entries", lambda e: e["_kind"] == CLASH)).isEmpty():
        return None
    kinds = [("_id", id_type), ("_carry", own.schema["_carry"].dataType.simpleString()), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "string"), ("checks", "array<struct<id:bigint,variant:bigint,s:int,e:int,x:bigint,y:bigint>>")]
    check = pa.list_(pa.struct([(n, t) for n, t in zip(("id", "variant", "s", "e", "x", "y"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, i, variant, entries, pieces in zip(*(b.column(k) for k in range(2, 7)), strict=True):
                w = words_of(t.as_py())
                n, checks = len(w), []
                if pieces.is_valid:
                    checks = [(i.as_py(), variant.as_py(), p["s"], p["e"], *digest(w[p["s"] : p["e"]])) for p in pieces.as_py()]
                if entries.is_valid:
                    runs, told = runs_of(entries.values, width)
                    checks += [(src, v, s, e, *digest(w[s + d : e + d])) for src, v, s, e, d in told]
                    w = [x for x, g in zip(w, merged(runs, n).tolist(), strict=True) if not g]
                kept = b" ".join(w)
                out.append((n, n - len(w), sha256(kept).hexdigest(), kept if keep_text else None, [dict(zip(("id", "variant", "s", "e", "x", "y"), c, strict=True)) for c in checks]))
            n, gone, hexes, kept, checks = zip(*out, strict=True) if out else [()] * 5
            made = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(hexes, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(checks, check)]
            yield pa.RecordBatch.from_arrays(made, names=[k for k, _ in kinds])

    key = ["_id", "_variant"]
    met = own.join(by_text.hint("merge"), key, "left").join(asked(by_text, width).hint("merge"), key, "left")
    ids = F.when(F.col("_id") != NO_ID, F.col("_id")).cast(id_type)
    out = saved(met.select(ids.alias("_out"), "_carry", "_text", "_id", "_variant", "entries", "asked").mapInArrow(lean(keep), ", ".join(f"{k} {t}" for k, t in kinds)), "deduplicated")
    checks = out.select(F.explode("checks").alias("c")).select("c.*").groupBy("id", "variant", "s", "e").agg(*[f(c).alias(n + c) for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    return out.drop("checks") if checks.filter("lox <> hix OR loy <> hiy").isEmpty() else None


def deduplicated(docs: DataFrame, *, width: int = 20, id_col: str = "doc_id", text: str = "text", most_counters: int = 1 << 28, keep_text: bool = True, carry: tuple[str, ...] = (), strength: int = 95) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]): every row's words that stay, joined by one space, and their digest.

    carry: other columns of docs to keep, under their names. strength: bits of hash by which windows are grouped; few of them show that what
    merely shares a hash is found out.
    """
    own = docs.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in carry]).alias("_carry"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_variant"), F.col(f"`{text}`").alias("_text"))
    bits = sketch_bits(own, "_text", most_counters)
    for seed in range(TRIES):
        out = once(own, width, bits, docs.schema[id_col].dataType.simpleString(), keep_text, seed, strength)
        if out is not None:
            return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text, *[F.col(f"_carry.`{c}`") for c in carry])
    raise RuntimeError(f"windows that differ shared hashes of {strength} bits in {TRIES} tries")
