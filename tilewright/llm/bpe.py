"""Byte-level BPE with the tokenizers library, over Arrow batches.

A space with visible characters on both sides always starts a new match of the pattern, so a text
is cut there and every distinct piece is encoded once for each worker; the matches inside a piece
and their merges are the library's. Byte-level characters stand for bytes by the usual table:
printable Latin-1 for itself, every other byte for the next free character from 256 on.

Null texts count as empty (no ids), null ids are kept, repeated rows are encoded each for itself, and an empty table gives no
rows. Texts of any length are encoded whole. Other columns are kept as they are, but for a column that has the name of an output,
which the output replaces.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import lean

#: Entries of a worker's piece cache, and the longest piece that it keeps.
CACHE, LONGEST = 600_000, 48
#: Marks that may end a piece, and the first character beyond the Latin blocks whose letters every library knows alike.
MARKS, BEYOND = frozenset(".,!?:;"), chr(0x250)
TWO_BLANKS = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The character of each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that a token is merged from in the end: what lower ranks leave of its bytes."""
    most, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, most), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= most:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@cache
def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizer of the tokenizers library for a file of ranks; each match of pattern is encoded separately."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = ranks_of(path), byte_characters()
    shown = {t: "".join(table[b] for b in t) for t in ranks}
    pairs = [merge_parts(t, ranks) for t in sorted((t for t in ranks if len(t) > 1), key=ranks.get)]
    made = Tokenizer(models.BPE(vocab={shown[t]: i for t, i in ranks.items()}, merges=[(shown[p[0]], shown[p[1]]) for p in pairs if len(p) == 2], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@cache
def tokenizer_from_json(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer(path: str, pattern: str | None = None):
    """path: a .json of the tokenizers library, or a file of ranks, which needs a pattern."""
    return tokenizer_from_json(path) if path.endswith(".json") else tokenizer_from_ranks(path, pattern)


@cache
def token_bytes(path: str, pattern: str | None = None) -> list[bytes]:
    """The bytes of each id, by the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer(path, pattern).get_vocab(with_added_tokens=True)
    out = [b""] * (1 + max(vocabulary.values()))
    for t, i in vocabulary.items():
        out[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    return out


class Encoder:
    """ids of texts as little-endian 32-bit bytes.

    A tokenizer's file may list added tokens, which the library finds in texts before it cuts them: texts that hold one go through the
    library's own call. A file of ranks has none, so strings that look like special tokens are ordinary text there.
    """

    def __init__(self, path: str, pattern: str | None = None) -> None:
        made = tokenizer(path, pattern)
        self.whole, self.added = made.encode, [t.content for t in made.get_added_tokens_decoder().values()]
        self.cut, self.merge = made.pre_tokenizer.pre_tokenize_str, made.model.tokenize
        self.matches: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(made.get_vocab_size(with_added_tokens=True) + 1)]
        self.inner = Pieces(self, " ")
        self.first = Pieces(self, "")

    def match(self, shown: str) -> bytes:
        if (out := self.matches.get(shown)) is None:
            out = b"".join([self.packed[t.id] for t in self.merge(shown)])
            if len(shown) <= LONGEST:
                if len(self.matches) >= CACHE:
                    self.matches.clear()
                self.matches[shown] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        for token in self.added:
            if token in text:
                return np.array(self.whole(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = LONE_SPACE.split(text) if TWO_BLANKS.search(text) else text.split(" ")
        if not pieces[0]:  # a text that starts with a space
            return b"".join(map(self.inner.__getitem__, pieces[1:]))
        head = self.first[pieces[0]]
        del pieces[0]
        return head + b"".join(map(self.inner.__getitem__, pieces))


SHOWN = dict(enumerate(byte_characters()))


class Pieces(dict):
    """The ids of each piece, with what precedes it. Full, it forgets all."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before, self.shown = encoder, before, "".join(byte_characters()[b] for b in before.encode())

    def __missing__(self, piece: str) -> bytes:
        e = self.encoder
        # Latin letters, perhaps with a mark at the end: their matches are known without the pattern.
        body, mark = (piece[:-1], piece[-1]) if piece and piece[-1] in MARKS else (piece, "")
        if body.isalpha() and max(body) < BEYOND:
            out = e.match(self.shown + (body if body.isascii() else body.encode().decode("latin-1").translate(SHOWN)))
            if mark:
                out += e.match(mark)
        else:
            out = b"".join([e.match(shown) for shown, _ in e.cut(self.before + piece)])
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


@cache
def encoder(path: str, pattern: str | None = None) -> Encoder:
    return Encoder(path, pattern)


def offsets_of(text: str, ids: np.ndarray, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets of each token: tokens that hold part of a character span the whole of it."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    end = np.cumsum(np.fromiter((len(table[i]) for i in ids), np.int64, len(ids)))
    start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(ids) else end
    return (character[start], character[end - 1] + 1) if len(ids) else (start, end)


def over(df: DataFrame, column: str, schema: T.StructType, rows: Callable[[list], list[pa.Array]]) -> DataFrame:
    """df with further columns, made from one of its columns batch by batch in the workers."""
    kept = [f for f in df.schema.fields if f.name not in schema.names]
    ins = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias("_in"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = rows(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*(f.name for f in kept), *schema.names])

    return ins.mapInArrow(lean(mapped), T.StructType([*kept, *schema.fields]))


def encode(df: DataFrame, path: str, *, pattern: str | None = None, text: str = "text", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """df with the ids of a text column (array<int>), and on demand `offsets` (array<struct<start,end>>, in characters)."""
    schema = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if offsets:
        schema.add("offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))

    def rows(texts: list) -> list[pa.Array]:
        run, table = encoder(path, pattern), token_bytes(path, pattern)
        found = [np.frombuffer(run(t or ""), "<u4") for t in texts]
        at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
        flat = np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32)
        out: list[pa.Array] = [pa.ListArray.from_arrays(at, pa.array(flat))]
        if offsets:
            both = [offsets_of(t or "", x, table) for t, x in zip(texts, found, strict=True)]
            parts = [pa.array(np.concatenate([*(b[k] for b in both), np.zeros(0, np.int64)]).astype(np.int32)) for k in (0, 1)]
            out.append(pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(parts, names=["start", "end"])))
        return out

    return over(df, text, schema, rows)


def decode(df: DataFrame, path: str, *, pattern: str | None = None, ids: str = "ids", decoded: str = "decoded", text: str | None = "decoded_text") -> DataFrame:
    """df with the bytes of an ids column, and as text. Null ids count as none; an id that is not in the vocabulary fails.

    Bytes are joined before they are read as UTF-8, so characters that are split over tokens come back whole;
    bytes that form no character (a cut list of ids) show as U+FFFD in the text and stay as they are in the bytes.
    """
    schema = T.StructType([T.StructField(decoded, T.BinaryType())])
    if text:
        schema.add(text, T.StringType())

    def rows(lists: list) -> list[pa.Array]:
        table = token_bytes(path, pattern)
        out = [b"".join([table[i] for i in x or ()]) for x in lists]
        return [pa.array(out, pa.binary()), *([pa.array([x.decode("utf-8", "replace") for x in out], pa.string())] if text else [])]

    return over(df, ids, schema, rows)


def digests(df: DataFrame, path: str, *, pattern: str | None = None, text: str = "text") -> DataFrame:
    """df with n_tokens, and the SHA-256 of the ids and of what they decode to, without a column of ids in between."""
    from hashlib import sha256

    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def rows(texts: list) -> list[pa.Array]:
        run, table = encoder(path, pattern), token_bytes(path, pattern)
        as_text = decimal(len(table))
        counts, one, two = [], [], []
        for t in texts:
            ids = np.frombuffer(run(t or ""), "<u4").tolist()
            counts.append(len(ids))
            one.append(sha256(" ".join(map(as_text.__getitem__, ids)).encode()).hexdigest())
            two.append(sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

    return over(df, text, schema, rows)


@cache
def decimal(n: int) -> list[str]:
    return [str(i) for i in range(n)]


