"""Toxicity: a learned lexicon, misspellings by Levenshtein automata over its trie, and context.

The lexicon holds the words that labels show to be abusive. A word of a text hits a term if it is
the term or few edits away, more of them for longer terms, two letters that changed places being one:
the word's Levenshtein automaton runs over the trie of terms, so shared prefixes are walked once. Terms that clean texts use, too, are doubtful and have
evidence and weights of their own. The words around a hit tell quotation from abuse. A logistic model
over the hits of a text gives its score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import held_out, labelled_sample, parts, written

WORD = re.compile(r"[^\W_]+")
#: Letters from which on a term is matched with one edit, and with two. In fewer, an edit makes another word.
FUZZY_LETTERS, LOOSE_LETTERS = 5, 12
#: Words on each side of a hit that are its context.
WINDOW = 6
QUOTES = "\"'“”„«»‹›‘’`"
MARKS = frozenset(QUOTES)
#: Words that report what others say, and words that address somebody (fixed lists).
REPORTING = frozenset("said says quote quoted quotes called calls wrote word term dijo dice palabra dit disait mot sagte sagt wort nannte".split())
ADDRESS = frozenset("you your youre u du dich dein ihr tu te tes vous vos tú te tus usted eres es bist are".split())
#: Letters of the stems that are learned beside whole words, for languages that inflect; a stem is written with a star.
STEMS = (4, 5, 6)
#: Texts whose chunks are made distinct together.
BATCH_ROWS = 1024


def forms(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def allowed(term: str) -> int:
    """How many edits a term is matched with; a stem has none."""
    return 0 if term[-1] == "*" else (len(term) >= FUZZY_LETTERS) + (len(term) >= LOOSE_LETTERS)


def shortened(word: str, most: int) -> set[str]:
    """The word with at most `most` letters left out. Words within so many edits, swaps included, have one in common."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def trigrams(word: str) -> list[str]:
    return [word[i : i + 3] for i in range(len(word) - 2)]


def unlike_all(word: str, most: int, deletions: set[str], loose: set[str]) -> bool:
    """Whether no form of the word with up to `most` letters left out is among the deletions.

    loose: the trigrams of terms that are matched with two edits. An edit spoils three of a term's
    trigrams and a swap four, so of the ten that twelve letters have a word within two edits keeps two;
    words with fewer are at most one edit from any term.
    """
    if not most:
        return True
    if most == 1 or sum(map(loose.__contains__, trigrams(word))) < 2:
        return word not in deletions and deletions.isdisjoint([word[:i] + word[i + 1 :] for i in range(len(word))])
    return deletions.isdisjoint(shortened(word, most))


class LevenshteinAutomaton:
    """Accepts the words within `most` edits of `word`; a state holds (place, edits) pairs.

    Two neighbours that changed places are one edit; a place below zero waits for the second of them:
    -1 - i has read the letter behind place i.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        edits: dict[int, int] = {}
        swaps: dict[int, int] = {}
        for i, e in state:  # by place
            if i < 0:
                if self.word[-1 - i] == letter:
                    edits[1 - i] = min(edits.get(1 - i, e), e)
                continue
            if e < self.most and i + 1 < len(self.word) and self.word[i + 1] == letter != self.word[i]:
                swaps[-1 - i] = e + 1
            if e < self.most:
                edits[i] = min(edits.get(i, e + 1), e + 1)  # the letter is extra
            if i < len(self.word):
                cost = e + (self.word[i] != letter)
                if cost <= self.most:
                    edits[i + 1] = min(edits.get(i + 1, cost), cost)
        for i in sorted(edits):  # letters of the word that are left out
            j, e = i + 1, edits[i] + 1
            while j <= len(self.word) and e <= self.most and edits.get(j, e + 1) > e:
                edits[j] = e
                j, e = j + 1, e + 1
        return tuple(sorted((edits | swaps).items()))

    def edits(self, state: tuple[tuple[int, int], ...]) -> int:
        """Edits at the end of the read word; over `most` if it isn't accepted."""
        return min((e + len(self.word) - i for i, e in state if i >= 0), default=self.most + 1)

    def accepts(self, state: tuple[tuple[int, int], ...]) -> bool:
        return self.edits(state) <= self.most


@dataclass
class Trie:
    """Terms by letters; `deletions` has each fuzzy term with at most as many letters left out as it has edits."""

    root: dict = field(default_factory=dict)
    deletions: set[str] = field(default_factory=set)
    #: Trigrams of the terms that are matched with two edits.
    loose: set[str] = field(default_factory=set)
    #: By length of a word, how many edits away a term may be.
    reach: dict[int, int] = field(default_factory=dict)

    @classmethod
    def of(cls, terms: list[str]) -> Trie:
        trie = cls()
        for term in terms:
            node = trie.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if allowed(term):
                trie.deletions.update(shortened(term, allowed(term)))
            if allowed(term) == 2:
                trie.loose.update(trigrams(term))
            for n in range(-allowed(term), allowed(term) + 1):
                trie.reach[len(term) + n] = max(trie.reach.get(len(term) + n, 0), allowed(term))
        return trie

    def near(self, word: str) -> str | None:
        """The term with the fewest edits from the word, within those it allows; the first of equals.

        Words that share no form with letters left out need no walk; the walk alone decides.
        """
        most = self.reach.get(len(word), 0)
        if unlike_all(word, most, self.deletions, self.loose):
            return None
        machine = LevenshteinAutomaton(word, most)
        stack = [(self.root, machine.start())]
        best = None
        while stack:
            node, state = stack.pop()
            term = node.get("")
            if term is not None and (n := machine.edits(state)) <= allowed(term) and allowed(term) and (best is None or (n, term) < best):
                best = n, term
            for letter, below in node.items():
                if letter and (to := machine.step(state, letter)):
                    stack.append((below, to))
        return best and best[1]


#: Counts of a text: exact and near hits, each in plain and in quoting context, and hits in abusive context.
KINDS = ("exact", "near", "exact_quoted", "near_quoted", "abusive")
#: The same of sure and of doubtful terms.
EVIDENCE = (*KINDS, *(f"doubtful_{k}" for k in KINDS))
#: Weights before any label is seen: a quoted hit counts for little, and so does one of a doubtful term.
PRIOR = np.array([2.0, 1.0, 0.3, 0.1, 0.5, 0.5, 0.25, 0.1, 0.05, 0.1])
#: Share of toxic documents among those that use a term unquoted from which on it is sure.
SURE = 0.9


@dataclass
class Lexicon:
    """Terms, words that look like terms but clean texts use, the model's weights, and doubtful terms."""

    terms: list[str]
    clean: frozenset[str]
    weight: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0
    doubtful: list[str] = field(default_factory=list)


def marks(chunks: list[str]) -> np.ndarray:
    """Of each chunk, whether it opens a quotation, closes one, reports, and addresses somebody."""
    bits = bytearray(len(chunks))
    for k, c in enumerate(chunks):
        plain = c[:1].isalnum() and c[-1:].isalnum()
        word = (c if plain else c.strip(QUOTES + ".,;:!?()")).lower()
        bits[k] = 4 * (word in REPORTING) + 8 * (word in ADDRESS)
        if not plain:
            bits[k] += (c[:1] in MARKS) + 2 * (c.rstrip(".,;:!?")[-1:] in MARKS)
    return (np.frombuffer(bits, "u1")[:, None] >> np.arange(4, dtype="u1") & 1).astype(bool)


def contexts(flags: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the WINDOW chunks on each side of places, within [first, end), quote and address.

    flags: marks of all chunks.
    """
    total = np.zeros((len(flags) + 1, 4), "i4")
    np.cumsum(flags, 0, out=total[1:])
    left = total[at] > total[np.maximum(first, at - WINDOW)]
    right = total[np.minimum(end, at + WINDOW + 1)] > total[at + 1]
    beside = left | right
    return flags[at, 0] | flags[at, 1] | left[:, 0] & right[:, 1] | beside[:, 2], beside[:, 3]


def unquoted(text: str) -> set[str]:
    """The words of a text that some place uses without quoting them."""
    chunks = text.split()
    at = np.arange(len(chunks))
    quoting = contexts(marks(chunks), at, 0 * at, 0 * at + len(chunks))[0].tolist()
    return {w for c in {c for c, q in zip(chunks, quoting, strict=True) if not q} for w in WORD.findall(c.lower())}


class Matcher:
    """Hits of words and their evidence in whole texts."""

    def __init__(self, lexicon: Lexicon):
        self.clean = lexicon.clean
        self.kind = {**dict.fromkeys(lexicon.doubtful, 1), **dict.fromkeys(lexicon.terms, 0)}
        self.stems = {f[:-1]: k for f, k in self.kind.items() if f[-1] == "*"}
        self.tries = Trie.of(lexicon.terms), Trie.of(lexicon.doubtful)
        self.deletions, self.loose = self.tries[0].deletions | self.tries[1].deletions, self.tries[0].loose | self.tries[1].loose
        self.reach = {n: max(t.reach.get(n, 0) for t in self.tries) for n in self.tries[0].reach | self.tries[1].reach}

    def known(self, word: str) -> int:
        """Whether the word or a stem of it is a sure term (0), or else a doubtful one (1); 2 if none is a term."""
        least = self.kind.get(word, 2)
        for n in STEMS:
            if len(word) > n:
                least = min(least, self.stems.get(word[:n], 2))
        return least

    def near(self, word: str) -> int | None:
        """Whether the word is near a sure term (0) or else a doubtful one (1)."""
        if unlike_all(word, self.reach.get(len(word), 0), self.deletions, self.loose):
            return None
        return next((k for k, trie in enumerate(self.tries) if trie.near(word)), None)

    def hits(self, chunk: str) -> list[int] | None:
        """Exact and near hits of a chunk between blanks, of sure and then of doubtful terms; mostly none."""
        out = None
        for word in WORD.findall(chunk.lower()):
            if (known := self.known(word)) < 2:
                column = 2 * known
            elif word not in self.clean and (k := self.near(word)) is not None:
                column = 2 * k + 1
            else:
                continue
            out = out or [0, 0, 0, 0]
            out[column] += 1
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """EVIDENCE of each text, a row each.

        Chunks are made distinct over all the texts first, so each is matched once.
        """
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = np.zeros((len(names), 4), "i8")
        for k, own in enumerate(map(self.hits, names)):
            if own:
                found[k] = own
        number, bound = coded.indices.to_numpy(), lists.offsets.to_numpy().astype("i8")
        counts = np.zeros((len(texts), len(EVIDENCE)))
        if not found.any():
            return counts
        flags = marks(names)[number]
        for k in (0, 1):
            exact, near = found[:, 2 * k], found[:, 2 * k + 1]
            at = np.flatnonzero((exact + near > 0)[number])
            row = np.searchsorted(bound, at, "right") - 1
            quoting, addressing = contexts(flags, at, bound[row], bound[row + 1])
            close = (np.diff(at) <= WINDOW) & (np.diff(row) == 0)
            abusive = (addressing | np.r_[False, close][: len(at)] | np.r_[close, False][: len(at)]) & ~quoting
            for kind, n in enumerate((exact[number[at]] * ~quoting, near[number[at]] * ~quoting, exact[number[at]] * quoting, near[number[at]] * quoting, abusive)):
                np.add.at(counts[:, len(KINDS) * k + kind], row, n)
        return counts


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Penalised logistic regression around the prior weights, classes weighted alike, by Newton steps.

    No weight is negative: kinds of evidence that would have one are left out, and the others fitted anew.
    """
    x1 = np.c_[x, np.ones(len(x))]
    centre = np.r_[prior, bias]
    theta = centre.copy()
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(60 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -35, 35)))
        g = x1.T @ (weight * (p - y)) + 0.05 * (theta - centre)
        h = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + 0.05 * np.eye(len(theta))
        step = np.linalg.solve(h, g)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    kept = theta[:-1] >= 0
    if kept.all():
        return theta[:-1], float(theta[-1])
    weight = np.zeros(len(prior))
    weight[kept], bias = fit_logistic(x[:, kept], y, prior[kept], bias)
    return weight, bias


#: Hashes of a sketch: copies share all, texts that share half of their shingles one with a chance of 98 %.
SKETCH = 6


def sketch(text: str) -> list[int]:
    """The least hashes of the text's five-word shingles under SKETCH permutations."""
    words = text.lower().split()
    own = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))], "u8")
    return [int(((own + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).min()) for k in range(SKETCH)]


def unlike(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """The least doc_id of each group of rows (doc_id, label, sketch) of one label that hashes of the sketches join."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for doc_id, label, hashes in sorted(rows):
        for k, h in enumerate(hashes):
            root[find((label, k, h))] = find((label, doc_id))
    kept: dict = {}
    for doc_id, label, _ in sorted(rows):
        kept.setdefault(find((label, doc_id)), doc_id)
    return sorted(kept.values())


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, error: float = 0.05) -> Lexicon:
    """Lexicon and weights from at most sample_rows labelled documents, crc32(doc_id) mod 3 not 1.

    A word or stem is a term if toxic documents use it unquoted so much more often than their share
    that chance would name, among all words and stems counted, `error` such terms. Of documents that are alike one
    counts. Those that clean
    documents use, too (over one in ten), are doubtful and have weights of their own. Counting is
    distributed; terms, clean look-alikes, sketches and the evidence of the sample (sixteen numbers a
    row) reach the driver.
    """
    spark = docs.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 256):
                texts = part.column("text").to_pylist()
                found = pa.array([sorted({f for w in unquoted(t) for f in forms(w)}) for t in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("text"), found, pa.array(map(sketch, texts), pa.list_(pa.int64()))], names=["doc_id", "label", "text", "words", "alike"])

    sample = written(labelled_sample(docs, labels, "toxic", 3, 1, sample_rows).mapInArrow(words, "doc_id long, label int, text string, words array<string>, alike array<long>"), "toxic")
    # Of documents that are alike one counts, as their words are no separate findings.
    first = unlike([tuple(r) for r in sample.select("doc_id", "label", "alike").collect()])
    sample = sample.join(F.broadcast(spark.createDataFrame([(i,) for i in first], "doc_id long")), "doc_id", "left_semi").drop("alike")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    counts = written(sample.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "words")
    base = min(max((toxic + 0.5) / (toxic + clean + 1), 1e-6), 1 - 1e-6)
    share = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    excess = (F.col("t") > 0) & (share > base) & (gain >= math.log(max(1, counts.count()) / error))
    chosen = counts.where(excess & (F.length("word") >= 3)).select("word", "t", "c", (share >= SURE).alias("sure")).collect()
    lexicon = Lexicon(sorted(r["word"] for r in chosen if r["sure"]), frozenset(), doubtful=sorted(r["word"] for r in chosen if not r["sure"]))
    sent = spark.sparkContext.broadcast(lexicon)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(sent.value)
        for batch in batches:
            kept = [w for w in batch.column("word").to_pylist() if w[-1] != "*" and own.near(w) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["word"])

    # A look-alike is no misspelling if its documents are far less likely to have a term's share of
    # toxic ones (all sure terms taken together) than that of all documents.
    t, c = (sum(r[x] for r in chosen if r["sure"]) for x in "tc")
    usual = (t + 0.5) / (t + c + 1)
    odds = F.col("t") * math.log(usual / base) + F.col("c") * math.log((1 - usual) / (1 - base))
    near = counts.where((F.col("c") > 0) & (odds <= math.log(error))).select("word").mapInArrow(alike, "word string")
    lexicon.clean = frozenset(r["word"] for r in near.collect())
    scores = with_evidence(sample.select("doc_id", "label", "text"), lexicon).drop("text").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = np.array(scores.column(EVIDENCE_COLUMN).to_pylist(), float).reshape(-1, len(EVIDENCE))
    if toxic and clean:
        lexicon.weight, lexicon.bias = fit_logistic(np.log1p(x), scores.column("label").to_numpy().astype(float), PRIOR, -3.0)
    return lexicon


EVIDENCE_COLUMN = "_toxicity_evidence"


def with_evidence(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with the counts of EVIDENCE of each text as a last column; null texts have none."""
    send = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(send.value)
        for batch in batches:
            for part in parts(batch, "text", BATCH_ROWS):
                counts = own.evidence(pc.fill_null(part.column(at), ""))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(counts), pa.list_(pa.float64()))], names=[*batch.schema.names, EVIDENCE_COLUMN])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(EVIDENCE_COLUMN, T.ArrayType(T.DoubleType()))]))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, column: str = "score") -> DataFrame:
    """docs with `column`, the probability of label 1, as the last column; all others stay.

    Null and empty texts score as texts without hits. Scores depend on the text alone.
    """
    margin = F.lit(lexicon.bias)
    for k, w in enumerate(lexicon.weight.tolist()):
        margin = margin + F.log1p(F.col(EVIDENCE_COLUMN)[k]) * w
    return with_evidence(docs, lexicon).withColumn(column, 1 / (1 + F.exp(-margin))).drop(EVIDENCE_COLUMN)


def classify_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of docs (doc_id, text), a row per row."""
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
