"""Benchmark passages in documents: a prefix-filtered join of item-sized windows.

Words are runs of digits, a-z and characters beyond ASCII, after A-Z are put in lower case. An item's windows are its runs of `width` words; an item of fewer words
(but some) is one window. A document holds a window if it holds all its words side by side, so all of the window's tokens are necessary, and a
prefix of one token suffices: its rarest word, by occurrences in all documents. Documents' words are joined with these rarest words; the word's place bounds where the
window must start and end, which drops what would not fit into the document; what is left is compared word by word.

Tokens meet as hashes of their words in lower case, and every match is verified on the words themselves. Windows are sent to all tasks behind a check of their number;
where there are more, tokens are shuffled by their hash. DataFrame functions alone.

Null texts have no words. Repeated documents are rows of their own, ids may be null. An item with a null id marks words, but is in no list;
items that share an id count once. Texts are taken whole. Empty tables of documents give no rows, of items no hits. Other columns do not take part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import numbered, saved

WIDTH = 10
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many windows, of so many bytes in all, go to all tasks.
MOST_SENT, MOST_BYTES = 200_000, 32 << 20


def split_words(text: Column) -> Column:
    """The words as they are. An empty string may stand first or last: it is no word of an item, so it does no harm there."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def token(word: Column) -> Column:
    """Equal for words that are equal but for the case of A-Z (and of some others, which are told apart later)."""
    return F.xxhash64(F.lower(word))


def windows(items: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(item, win, n): the windows of each item, n words joined by spaces."""
    own = items.select(F.col(f"`{id_col}`").alias("item"), F.translate(F.col(f"`{text}`"), UPPER, LOWER).alias("_t"))
    own = own.select("item", F.filter(split_words(F.col("_t")), lambda w: w != "").alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.size("_w") - width)
    cut = own.select("item", "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    return cut.select("item", F.slice("_w", F.col("_i") + 1, F.lit(width)).alias("_p")).select("item", F.array_join("_p", " ").alias("win"), F.size("_p").alias("n"))


def prefixes(wins: DataFrame, docs: DataFrame, sent: bool) -> DataFrame:
    """(_wid, win, n, token, off): each window's rarest word in docs (_w), and its place in the window. Windows with a word that no document has are left out."""
    words = wins.select("_wid", F.posexplode(F.split("win", " ")).alias("off", "word")).withColumn("token", token(F.col("word")))
    vocabulary = words.select("token").distinct()
    every = docs.select(F.explode("_w").alias("_x")).select(token(F.col("_x")).alias("token"))
    counts = every.join(F.broadcast(vocabulary) if sent else vocabulary.hint("merge"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    counts = saved(counts, "counts")
    rarest = words.join(F.broadcast(counts) if sent else counts.hint("merge"), "token", "left").groupBy("_wid")
    rarest = rarest.agg(F.min(F.struct("seen", "token", "off")).alias("_r"), F.count("seen").alias("_k"), F.count("*").alias("_all")).filter("_k = _all")
    return wins.join(rarest.select("_wid", "_r.token", "_r.off").hint("merge"), "_wid")


def occurrences(docs: DataFrame, heads: DataFrame, sent: bool) -> DataFrame:
    """(_row, start, n, _wid): where docs (_row, _w) hold windows."""
    start = F.col("pos") - F.col("off")
    # Where the window would begin before the text or end behind it, there is nothing to compare.
    fits = (start >= 0) & (start + F.col("n") <= F.size("_w"))
    equal = F.translate(F.array_join(F.slice("_w", start + 1, F.col("n")), " "), UPPER, LOWER) == F.col("win")
    if sent:
        tokens = docs.select("_row", "_w", F.posexplode("_w").alias("pos", "_x")).select("_row", "_w", "pos", token(F.col("_x")).alias("token"))
        met = tokens.join(F.broadcast(heads), "token")
    else:
        tokens = docs.select("_row", F.size("_w").alias("_n"), F.posexplode("_w").alias("pos", "_x")).select("_row", "_n", "pos", token(F.col("_x")).alias("token"))
        near = tokens.join(heads.hint("merge"), "token").filter((start >= 0) & (start + F.col("n") <= F.col("_n"))).drop("_n")
        met = near.join(docs.select("_row", "_w").hint("merge"), "_row")
    return met.filter(fits & equal).select("_row", start.alias("start"), "n", "_wid")


def covered(spans: Column) -> Column:
    """How many places lie in some of the spans (start, end), which are in order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, most_sent: int = MOST_SENT) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row; items: the ids, as strings in order, of the items with windows in it."""
    own = numbered(docs.select(F.col(f"`{id_col}`").alias("_id"), split_words(F.col(f"`{text}`")).alias("_w")), "_row", "words")
    carried = saved(windows(items, item_col, item_text, width), "carried")
    size = carried.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("win")), F.lit(0))).first()
    sent = size[0] <= most_sent and size[1] <= MOST_BYTES
    wins = numbered(carried.select("win", "n").distinct(), "_wid", "windows")
    hits = saved(occurrences(own, prefixes(wins, own, sent), sent), "hits")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    hit = hits.groupBy("_row").agg(spans.alias("_s")).select("_row", covered(F.col("_s")).alias("n_hit"))
    names = carried.filter("item IS NOT NULL").select(F.col("item").cast("string").alias("item"), "win").distinct().join(wins.select("win", "_wid").hint("merge"), "win").select("_wid", "item")
    named = hits.select("_row", "_wid").distinct().join(F.broadcast(names) if sent else names.hint("merge"), "_wid").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    size, first, last = F.size("_w"), F.get("_w", F.lit(0)) == "", F.get("_w", F.size("_w") - 1) == ""
    n_words = size - first.cast("int") - ((size > 1) & last).cast("int")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    out = own.select("_row", "_id", n_words.cast("long").alias("n_words")).join(hit.hint("merge"), "_row", "left").join(named.hint("merge"), "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (n_hit > 0).alias("contaminated"))
