"""Packing of documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe import BATCH_ROWS, WordBpe, byte_letters, token_ids
from ledgerline.llm.common import parts, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long, ids array<int>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_length long, ids array<int>"
#: Sequences of one full window count down from -1 by partition and place; packed ones are numbered
#: by group and place in it.
GROUP_STEP = 1 << 36


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts.

    A leaf stands for a capacity, an inner node holds how many windows lie below it. tightest(n)
    climbs from leaf n to the first node with windows on its right and descends to the leftmost.
    """

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        at = self.base + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, room: int) -> int:
        at = self.base + room
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.windows[room].pop()

    def tightest(self, need: int) -> int:
        """The least capacity of at least `need` that an open window has, or -1."""
        at = self.base + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """Window number and offset of each length, and the tokens in each window.

    Lengths are from 1 to window. Equal lengths keep their order, so the result is a function of the
    list alone.
    """
    place, offset, filled = [0] * len(lengths), [0] * len(lengths), []
    open_ = OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = open_.tightest(n)
        if room < 0:
            w, room = len(filled), window
            filled.append(0)
        else:
            w = open_.take(room)
        place[i], offset[i] = w, filled[w]
        filled[w] += n
        if room > n:
            open_.add(room - n, w)
    return place, offset, filled


class LibraryBpe(WordBpe):
    """Word ids by the tokenizers library's own model; chunks and tables are as in WordBpe."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def merge(self, word: str) -> list[int]:
        letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return [token.id for token in self.tokenize(letters)]


_LOADED: dict[str, LibraryBpe] = {}


def loaded(path: str) -> LibraryBpe:
    """The file's encoder, once for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = LibraryBpe(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Full windows of each document and its rest, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        end = np.array([end_id], "<u4")
        place = 0
        for batch in batches:
            for part in parts(batch, "text", BATCH_ROWS):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), token_ids(bpe, pc.fill_null(part.column("text"), "")), strict=True):
                    ids = np.concatenate([ids, end])
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        place += 1
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), place, piece.astype("i4") if keep_ids else None))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, group_rows: int = 16384, keep_ids: bool = False) -> DataFrame:
    """Packs the token ids of docs (doc_id, text) into sequences of at most `window` tokens.

    A document is its ids and then end_id; a null or empty text is end_id alone. Overlong documents
    are first cut into full windows, which are sequences of their own. What is left of each document,
    under a window, goes to one of ceil(rests / group_rows) groups by a hash; each group is packed by
    best-fit decreasing. A group is bounded and large enough that its last, looser windows don't
    matter, so the work spreads without a global order. Repeated rows and ids are packed row by row.

    Result: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    the sequence's sequence_tokens and padded_length (the window, or the tokens where they are a power
    of two), and ids where keep_ids. Columns of docs but doc_id and text are left out.

    The pieces (numbers only) are written to the shared folder first: the texts are encoded once, and
    a lost executor costs its tasks only.
    """
    pieces = written(token_pieces(docs, tokenizer, window, end_id, keep_ids).withColumn("part", F.spark_partition_id()), "pieces")
    rests = pieces.where(F.col("length") < window)
    groups = max(1, -(-rests.count() // group_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "ids_crc32", "part", "place"], ascending=[False, True, True, True, True], ignore_index=True)
        place, offset, filled = best_fit_decreasing(pdf["length"].tolist(), window)
        tokens = np.array(filled, "int64")[place]
        return pd.DataFrame({
            **{c: pdf[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")},
            "sequence_id": pdf["pack_group"] * GROUP_STEP + np.array(place, "int64"),
            "offset": np.array(offset, "int64"), "sequence_tokens": tokens,
            "padded_length": np.where(tokens & (tokens - 1), window, tokens), "ids": pdf["ids"],
        })

    packed = rests.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "part", "place"), F.lit(groups))).groupBy("pack_group").applyInPandas(pack, PACKED)
    full = pieces.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (-F.col("part").cast("long") * GROUP_STEP - F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_tokens"), F.col("length").alias("padded_length"), "ids",
    )
    out = full.unionByName(packed)
    return out if keep_ids else out.drop("ids")
