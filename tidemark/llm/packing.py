"""Packing documents into fixed sequences along a Hilbert curve.

A document's tokens are hashed into a vector of counts, which a fixed random matrix
projects to three dimensions; the point's place on a Hilbert curve is its key. Documents
are range-sorted by that key, so neighbours in a sequence are alike, and laid end to end:
a document's place is the number of tokens before it on the curve, and every ``length``
tokens are one sequence. Documents are cut at sequence ends, so only the last sequence
has padding.

Places are summed in two levels: inside each range of the sort, then over the ranges.
Keys are made unique by a row number that was written with the tokens, so many copies of
one document spread over as many ranges as they fill. The tokens themselves move once,
to meet their place.

A null text is empty and has the end token alone. Null and repeated keys are kept, a
piece for every row. Equal curve keys are taken in the order of the written rows. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import counted, written

LENGTH = 2048
END = 1

HASHED = 4096
DIMENSIONS = 3
BITS = 10
SEED = 20

# Words whose tokens a worker remembers; cleared when full, some 100 MB.
REMEMBERED = 500_000

# ASCII signs, without the apostrophe, which may open a piece together with letters.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others, in order, for what follows U+00FF."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens(dict):
    """Token ids of words, little-endian unsigned 32 bit, remembered as they come up.

    No token of the vocabulary spans an ASCII blank, and normalisation does not cross
    one either, so a text's ids are those of its words in a row. Letters are lowered by
    the vocabulary itself, so A-Z may be lowered before; a text with the start of a
    special token, which counts capitals, is left as it is. Signs after a letter or
    digit are a piece of their own, so words differing in them alone share their ids.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = [re.findall(r"\b(?:NFC|Replace|Lowercase|Split|ByteLevel)\b", str(x))
                 for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        if steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            raise ValueError(f"{path} is not a vocabulary of lower-case words")

    def __missing__(self, word: bytes) -> bytes:
        bare = word.rstrip(SIGNS)
        if len(bare) < len(word) and bare[-1:].isalnum() and b"<|" not in word:
            found = self[bare] + self[word[len(bare):]]
        else:
            text = word.decode("utf-8", "surrogatepass")
            if text.isalpha() and max(text) < "\u0180" and text.lower() == text:
                # Lower-case Latin letters are a piece as they are, in any normal form.
                ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_LETTERS))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > REMEMBERED:
            self.clear()
        out = []
        for text in texts:
            body = (text or "").encode("utf-8", "surrogatepass")
            words = (body if b"<|" in body else body.lower()).split()
            out.append(np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4"))
        return out


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((HASHED, DIMENSIONS))


def points(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Grid points of documents: hashed counts of unit length, projected, squashed."""
    out = np.zeros((len(ids), DIMENSIONS))
    for i, one in enumerate(ids):
        hashed = (one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        counts = np.bincount(hashed.astype(np.int64), minlength=HASHED).astype(np.float64)
        length = np.sqrt(counts @ counts)
        if length:
            out[i] = counts @ matrix / length
    unit = (1 + np.tanh(out / 2)) / 2
    return np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each grid point on the Hilbert curve through all of them."""
    x = [grid[:, i].copy() for i in range(grid.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> bit) & 1)
    return key


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           end: int = END, section: str | None = None) -> DataFrame:
    """_key, _section, _curve, _n and _ids (little-endian unsigned 32 bit) of each row."""
    path = path or default_vocabulary()
    part = F.col(f"`{section}`") if section else F.lit("")
    narrow = docs.select(
        F.col(f"`{key}`").alias("_key"), part.cast("string").alias("_section"),
        F.col(f"`{text}`").alias("_text"),
    )
    last = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = word_tokens(path), projection()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                ids = words.ids(batch.column(2).to_pylist())
                curve = hilbert(points(ids, matrix))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(curve, pa.int64()),
                        pa.array([len(x) + 1 for x in ids], pa.int64()),
                        pa.array([x.tobytes() + last.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["_key", "_section", "_curve", "_n", "_ids"],
                )

    kind = narrow.schema["_key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_key {kind}, _section string, _curve long, _n long, _ids binary")


def places(tokenised: DataFrame) -> DataFrame:
    """_rid and _at, the tokens before each document along the curve."""
    order = ["_section", "_curve", "_rid"]
    ranged = written(
        tokenised.select(*order, "_n").repartitionByRange(*order)
        .select("*", F.spark_partition_id().alias("_range")),
        "pack-ranges",
    )
    # One row per range: as many as the sort has tasks.
    bases = counted(
        ranged.groupBy("_range").agg(F.sum("_n").alias("_all"))
        .select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_base")),
        "pack-bases",
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.select("_rid", "_range", (F.sum("_n").over(inside) - F.col("_n")).alias("_local"))
        .join(bases, "_range")
        .select("_rid", (F.col("_base") + F.col("_local")).alias("_at"))
    )


def cut(ids: np.ndarray, at: int, length: int) -> list[tuple[int, int, int, int, int]]:
    """start, length, crc32, sequence and offset of each piece of a document placed at ``at``."""
    out, start = [], 0
    while start < len(ids):
        sequence, offset = divmod(at + start, length)
        size = min(length - offset, len(ids) - start)
        out.append((start, size, zlib.crc32(ids[start : start + size].tobytes()), sequence, offset))
        start += size
    return out


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text",
         path: str | None = None, end: int = END, section: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """key and the columns of ``PIECE`` for each piece of each row, and its ``ids`` if wanted.

    ``section`` names a column by which the stream is sorted before the curve: documents
    of one section stay together, in the order of its values as text.
    """
    tokenised = written(
        tokens(docs, key, text, path, end, section).withColumn("_rid", F.monotonically_increasing_id()),
        "pack-tokens",
    )
    placed = tokenised.select("_rid", "_key", "_ids").join(places(tokenised), "_rid")
    placed = placed.select("_key", "_ids", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows, bodies = [], [], []
            for i, (ids, at) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                one = np.frombuffer(ids.as_buffer(), "<u4")
                for start, size, crc, sequence, offset in cut(one, at, length):
                    which.append(i)
                    rows.append((start, size, crc, len(one), sequence, offset))
                    if with_ids:
                        bodies.append(one[start : start + size].astype(np.int64))
            columns = [batch.column(0).take(pa.array(which, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(PIECE))]
            names = ["_key", *PIECE]
            if with_ids:
                columns.append(pa.array(bodies, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = placed.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in PIECE) + (", ids array<long>" if with_ids else "")
    out = placed.mapInArrow(run, schema)
    return out.select(F.col("_key").alias(key), *PIECE, *(["ids"] if with_ids else []))
