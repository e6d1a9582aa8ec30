"""BPE encoding and decoding with a public word-level vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the merges of neighbours by rank
and position. An entry whose symbols have changed since it was queued is stale and skipped. Decoding
concatenates vocabulary strings, one blank between tokens, as the file names no decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import parts

#: What the tokenizer file's pre-tokenizer splits by (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: These count as blanks for str.split() but not for the file's pattern.
SEPARATORS = regex.compile("[\x1c-\x1f]")
NOT_BLANK = regex.compile(r"[^\p{White_Space}]+")
#: Texts that are encoded together.
BATCH_ROWS = 2048
#: Stands where a symbol has become part of the one before it; no vocabulary is so large.
DEAD = (1 << 20) - 1
#: Entries of one generation of a worker's tables, and the longest text kept there.
CACHE_TEXTS, CACHE_CHARS = 150_000, 48


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.tokens = [""] * size
        for token, i in chain(vocab.items(), self.added.items()):
            self.tokens[i] = token
        self.numbers = [str(i) for i in range(size)]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(model["merges"], 1)}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.words = Recent(lambda word: np.array(self.merge(word), "<u4").tobytes())

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token.

        A queue entry is one number: rank, symbol made, place. The rank tells the two symbols, so an
        entry is stale if the symbols now at its place have another merge or none.
        """
        data = word.encode("utf-8", "surrogatepass")
        symbol = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        find, push = self.merges.get, heapq.heappush
        queue = [found << 32 | at for at in range(n - 1) if (found := find(symbol[at] << 20 | symbol[at + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at, found = entry & 0xFFFFFFFF, entry >> 32
            to = after[at]
            if to < 0 or find(symbol[at] << 20 | symbol[to]) != found:
                continue  # stale
            made = symbol[at] = found & 0xFFFFF
            symbol[to] = DEAD
            right = after[at] = after[to]
            if right >= 0:
                before[right] = at
                if found := find(made << 20 | symbol[right]):
                    push(queue, found << 32 | at)
            left = before[at]
            if left >= 0 and (found := find(symbol[left] << 20 | made)):
                push(queue, found << 32 | left)
        return [s for s in symbol if s != DEAD]

    def plain(self, part: str) -> str:
        """Composed and in lower case; that goes letter by letter there, so no final sigma."""
        return part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without blanks, as little-endian numbers."""
        if self.split_added and "<" in chunk:
            parts = self.split_added.split(chunk)
            return b"".join(self.added[x].to_bytes(4, "little") if x in self.added else self.plain_ids(x) for x in parts)
        return self.plain_ids(chunk)

    def plain_ids(self, part: str) -> bytes:
        plain = self.plain(part)
        return self.words[plain] if plain.isalpha() else b"".join(map(self.words.__getitem__, WORDS.findall(plain)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.chunk, chunks(text))), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def chunks(text: str) -> list[str]:
    """Maximal runs without blanks; no pre-token crosses a blank."""
    return NOT_BLANK.findall(text) if SEPARATORS.search(text) else text.split()


class Recent(dict):
    """Text to what `make` gives, for short texts that a worker has met lately.

    A full table becomes the old one and a new one begins; what is found in the old one moves over,
    so frequent texts stay. The two hold 2 * CACHE_TEXTS entries at most.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str):
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_TEXTS:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The file's encoder, once for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def token_ids(bpe: WordBpe, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text. Chunks between blanks are made distinct first, so each is encoded once."""
    if pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():  # blanks there, but not here
        lists = pa.array([chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    known = list(map(bpe.chunk, coded.dictionary.to_pylist()))
    size = np.fromiter(map(len, known), "i8", len(known)) // 4
    ids, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
    chunk = coded.indices.to_numpy()
    each = size[chunk]
    end = np.cumsum(each)
    ids = ids[np.repeat(start[chunk] - end + each, each) + np.arange(end[-1] if len(end) else 0)]
    bound = np.r_[0, end][lists.offsets.to_numpy()]
    return [ids[x:y] for x, y in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): its token ids and the text decoded from them.

    With digest, instead the number of tokens and SHA-256 of the ids (decimal, one blank between)
    and of the decoded text, so that no long arrays leave the worker. Null and empty texts give no
    ids and an empty text. Null and repeated doc_ids pass through row by row; other columns are left
    out. No shuffle: a text is encoded in the task that reads it, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        number, token = bpe.numbers.__getitem__, bpe.tokens.__getitem__
        sha = hashlib.sha256
        for batch in batches:
            for part in parts(batch, "text", BATCH_ROWS):
                counts, first, second = [], [], []
                for ids in map(np.ndarray.tolist, token_ids(bpe, pc.fill_null(part.column("text"), ""))):
                    counts.append(len(ids))
                    decoded = " ".join(map(token, ids))
                    first.append(sha(" ".join(map(number, ids)).encode()).hexdigest() if digest else ids)
                    second.append(sha(decoded.encode()).hexdigest() if digest else decoded)
                doc_id = part.column("doc_id")
                if digest:
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(first, pa.list_(pa.int32())), pa.array(second, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST if digest else SCHEMA)
