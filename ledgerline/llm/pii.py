"""Personal data: patterns with checks, and a skip-chain conditional random field that adds spans.

The patterns give base spans. The field labels a document's candidate tokens: those with a digit or
an at sign, and words that are the name in one of its addresses. Neighbours in the token chain share a
transition potential, the word before a token gives evidence, and equal or similar tokens share a skip
potential however far apart they are. Tokens are similar if their last seven digits are the same, if
long numbers are one digit apart, or if one is the name in the other's address. Tokens of base spans
are observed; loopy message passing, in sweeps over the whole document until nothing moves, carries
their labels to the others. Stretches of plain words between two candidates have the same potentials
at every word, so they are summed out exactly as a power of one matrix.

The weights are fitted by pseudo-likelihood on counts over all documents that have candidates, with
the base spans as labels. So that context and skips must explain a label, each labelled token counts
once more with the marks hidden that its pattern asks for. Tokens without a label that are linked to
labelled ones are what the field is to decide, so they count as neither.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import parts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
CANDIDATE = re.compile("[0-9@]")
TOKEN = re.compile(r"\S+")
EDGE = "\"'`()[]{}<>,.;:!?*|"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits whose start fails, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of the address pattern, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, by start and kind."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        # Zeros in front don't count, and Python reads no number of very many digits.
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# Features of a token, a bit each.
FEATURES = (
    lambda t, d: True,
    lambda t, d: "@" in t,
    lambda t, d: t.startswith("+"),
    lambda t, d: "(" in t or ")" in t,
    lambda t, d: t.strip(EDGE).count(".") == 3,
    lambda t, d: 0 < t.strip(EDGE).count(".") < 3,
    lambda t, d: "-" in t,
    lambda t, d: any(c.isalpha() for c in t),
    lambda t, d: d <= 2,
    lambda t, d: 3 <= d <= 5,
    lambda t, d: 6 <= d <= 11,
    lambda t, d: 12 <= d <= 19,
    lambda t, d: d > 19,
    lambda t, d: "=" in t or '"' in t,
    lambda t, d: 12 <= d <= 19 and luhn(digits_of(t)),
)
#: The features that stay where a token's own marks are hidden: letters and how many digits it has.
COARSE = sum(1 << k for k in (0, 7, 8, 9, 10, 11, 12))
#: Buckets of the word before a token.
CONTEXTS = 64
#: The feature of words that are no candidates; it stands alone.
PLAIN = 1 << len(FEATURES)
N_FEATURES, N_LABELS = len(FEATURES) + 1, len(LABELS)
#: Least value of a message. Sweeps without a new low of movement before messages are damped by half,
#: and the part of a new message under which loopy propagation counts as unsettled.
TINY, PATIENCE, LEAST_PART = 1e-60, 20, 1 / 64
#: Log potential of what is impossible; far under the sum of as many least messages as a text can have.
NEVER = -1e12


def features(token: str) -> int:
    digits = sum("0" <= c <= "9" for c in token)
    return sum(1 << k for k, f in enumerate(FEATURES) if f(token, digits))


def skip_key(token: str) -> str:
    """Tokens of one key share potentials: the same digits (four or more), or the same letters."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    return digits if len(digits) >= 4 and "@" not in token else token.strip(EDGE).lower()


def address_name(token: str) -> str:
    """The name in an address, four letters at least; empty if the token is none."""
    name = token.partition("@")[0].lstrip(EDGE).lower()
    return name if "@" in token and len(name) >= 4 else ""


def one_apart(a: str, b: str) -> bool:
    """Whether two numbers of one length differ in one digit."""
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def context_of(word: str) -> int:
    """Bucket of the word before a token; -1 for none and for words without letters."""
    word = word.strip(EDGE).lower()
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % CONTEXTS if any(map(str.isalpha, word)) else -1


class Tokens:
    """The candidates of a text: places in the text and chain, features, contexts, observed labels, skips.

    skips maps pairs of candidates to 0 where they are equal and 1 where they are similar.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, self.place, self.mask, self.context, tokens = [], [], [], [], []
        names = {address_name(m[0]) for m in TOKEN.finditer(text) if "@" in m[0]} - {""} if "@" in text else set()
        n, before = -1, ""
        for n, m in enumerate(TOKEN.finditer(text)):
            if CANDIDATE.search(text, m.start(), m.end()) or names and m[0].strip(EDGE).lower() in names:
                self.spans.append(m.span())
                self.place.append(n)
                self.mask.append(features(m[0]))
                self.context.append(context_of(before))
                tokens.append(m[0])
            before = m[0]
        self.words = n + 1
        whole = {}  # the last token of a base span stands for all the span's digits
        self.label = [0] * len(self.spans)
        k = 0
        for a, kind, b in base:
            while k and self.spans[k - 1][1] > a:
                k -= 1
            while k < len(self.spans) and self.spans[k][1] <= a:
                k += 1
            j = k
            while j < len(self.spans) and self.spans[j][0] < b:
                self.label[j] = self.label[j] or kind + 1
                whole.pop(j, None)
                j += 1
            if j > k:
                whole[j - 1] = digits_of(text[a:b])
        self.skips: dict[tuple[int, int], int] = {}
        seen: dict[tuple, list[tuple[int, str]]] = defaultdict(list)
        for i, token in enumerate(tokens):
            own = digits_of(token)
            digits = whole.get(i, own) if "@" not in token else ""
            keys = [(0, skip_key(token))]
            if len(digits) >= 7:
                keys.append((1, "last", digits[-7:]))
            if len(digits) >= 8:
                half = len(digits) // 2
                keys += [(2, "head", len(digits), digits[:half]), (2, "tail", len(digits), digits[half:])]
            if names and (name := address_name(token) or token.strip(EDGE).lower()) in names:
                keys.append((1, "name", name))
            for key in keys:
                if key[1]:
                    seen[key].append((i, digits))
        for key, places in sorted(seen.items(), key=lambda x: x[0][0]):
            # Each token meets the next one of its key, and each without a label the nearest labelled ones.
            for step in (1, -1):
                labelled = None
                for x, (i, digits) in list(enumerate(places))[::step]:
                    near = [places[x - 1]] if step == 1 and x else []
                    near += [labelled] if labelled and not self.label[i] else []
                    for j, other in near:
                        if key[0] < 2 or one_apart(digits, other):
                            self.skips.setdefault((min(i, j), max(i, j)), min(key[0], 1))
                    if self.label[i]:
                        labelled = i, digits


COUNTS = "mask int, context int, label int, before int, after int, skip_a int, skip_b int, n long"


def training_counts(docs: DataFrame) -> DataFrame:
    """How often each (features, context, label, labels of neighbours) occurs over all documents with a digit or at sign.

    Plain words have label other. -1 stands for no neighbour; of a skip to a similar token the label
    is N_LABELS higher. There are few combinations, so the counts are small however many documents
    there are; they are summed before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for text in (x for part in parts(batch, "text", 512) for x in part.column("text").to_pylist()):
                t = Tokens(text, base_spans(text))
                at = dict(zip(t.place, t.label, strict=True))
                near: dict[int, list[int]] = defaultdict(list)
                for (a, b), kind in t.skips.items():
                    near[a].append(t.label[b] + N_LABELS * kind)
                    near[b].append(t.label[a] + N_LABELS * kind)
                side = lambda p, at=at, t=t: at.get(p, 0) if 0 <= p < t.words else -1
                beside = set()
                for k, p in enumerate(t.place):
                    skip = [*near[k], -1, -1][:2]
                    if t.label[k] or not any(x % N_LABELS for x in near[k]):
                        counts[t.mask[k], t.context[k], t.label[k], side(p - 1), side(p + 1), *skip] += 1
                    if t.label[k]:
                        sides = (-1 if x == t.label[k] else x for x in (side(p - 1), side(p + 1)))
                        counts[t.mask[k] & COARSE, t.context[k], t.label[k], *sides, *skip] += 1
                    beside |= {q for q in (p - 1, p + 1) if 0 <= q < t.words and q not in at}
                for p in beside:
                    counts[PLAIN, -1, 0, side(p - 1), side(p + 1), -1, -1] += 1
                counts[PLAIN, -1, 0, 0, 0, -1, -1] += t.words - len(at) - len(beside)
        if counts:
            columns = [*zip(*counts, strict=True), counts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k < 7 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in COUNTS.split(", ")])

    found = docs.select("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(run, COUNTS)
    keys = [x.split()[0] for x in COUNTS.split(", ")][:7]
    return found.groupBy(*keys).agg(F.sum("n").alias("n"))


class Field:
    """Weights: of features by label, of transitions, of agreement along skips to equal and to similar tokens, of contexts."""

    def __init__(self, unary: np.ndarray, step: np.ndarray, skip: np.ndarray, similar: np.ndarray | None = None, context: np.ndarray | None = None):
        self.weights = unary, step, skip, skip if similar is None else similar, np.zeros((CONTEXTS, N_LABELS)) if context is None else context
        self.unary, self.step, self.context = unary, np.exp(step), np.vstack([self.weights[4], np.zeros(N_LABELS)])  # -1 picks the zeros
        self.skip, self.similar = np.exp(skip), np.exp(self.weights[3])
        self.run = np.exp(unary[-1])[:, None] * self.step

    @lru_cache(maxsize=4096)  # noqa: B019
    def stretch(self, words: int) -> np.ndarray:
        """Potential between two candidates with so many plain words between them."""
        out, power, left = self.step.copy(), self.run, words
        while left:
            if left & 1:
                out = out @ power
                out /= out.max()
            power = power @ power
            power /= power.max()
            left >>= 1
        return out

    def marginals(self, t: Tokens, tolerance: float = 1e-6) -> np.ndarray:
        """Label probabilities of the candidates by loopy belief propagation, run until it converges.

        A sweep passes messages along the chain and the skips from the first candidate to the last
        and back, so evidence crosses the whole document however long it is. Without skips between
        distant candidates one sweep is exact. Otherwise sweeps go on until no message moves; where
        they don't settle, each is damped more, and where even that fails mean_field decides.
        """
        n = len(t.spans)
        bits = (np.array(t.mask)[:, None] >> np.arange(N_FEATURES)) & 1
        node = np.exp(bits @ self.unary + self.context[t.context])
        ones = np.ones(N_LABELS)
        if t.place[0]:
            node[0] *= ones @ self.stretch(t.place[0] - 1) if t.place[0] > 1 else ones @ self.step
        if left := t.words - 1 - t.place[-1]:
            node[-1] *= self.stretch(left - 1) @ ones
        label = np.array(t.label)
        seen = label > 0
        node[seen] = np.eye(N_LABELS)[label[seen]]
        node /= node.sum(1, keepdims=True)
        # A skip between neighbours and their step are one edge; edges of one potential share its matrix.
        potentials: dict[tuple[int, int], int] = {}
        edges: dict[tuple[int, int], int] = {}
        for i in range(n - 1):
            edges[i, i + 1] = potentials.setdefault((t.place[i + 1] - t.place[i] - 1, t.skips.get((i, i + 1), -1)), len(potentials))
        for pair, kind in t.skips.items():
            if pair not in edges:
                edges[pair] = potentials.setdefault((-1, kind), len(potentials))
        matrices = np.array([(self.stretch(words) if words >= 0 else 1) * (self.skip, self.similar, 1)[kind] for words, kind in potentials]).reshape(-1, N_LABELS, N_LABELS)
        pairs, which = np.array(list(edges), "i8").reshape(-1, 2), np.array(list(edges.values()), "i8")
        # By end: the edges that leave each candidate towards later ones, and towards earlier ones.
        leaving = []
        for way in (0, 1):
            order = np.argsort(pairs[:, way], kind="stable")
            leaving.append(np.split(order, np.searchsorted(pairs[order, way], np.arange(1, n))))
        turns = [(0, range(n), matrices.transpose(0, 2, 1)), (1, range(n - 1, -1, -1), matrices)]
        logs = np.full((2, len(edges), N_LABELS), -np.log(N_LABELS))  # messages to later candidates, to earlier ones
        own = np.log(node, out=np.full_like(node, NEVER), where=node > 0)

        def beliefs() -> np.ndarray:
            """Each candidate's log potential and all log messages that arrive there, added up."""
            total = own.copy()
            for way in (0, 1):
                np.add.at(total, pairs[:, 1 - way], logs[way])
            return total

        part, least, waited = 1.0, np.inf, 0
        while len(edges):
            old, total = np.exp(logs), beliefs()
            for way, order, mats in turns:
                for i in order:
                    ks = leaving[way][i]
                    if not len(ks):
                        continue
                    # What a message tells is all that its sender knows but what came the other way.
                    told = total[i] - logs[1 - way, ks]
                    told = np.exp(told - told.max(1, keepdims=True))
                    new = np.matmul(mats[which[ks]], told[:, :, None])[:, :, 0]
                    new = np.maximum(new / new.sum(1, keepdims=True), TINY)
                    if part < 1:
                        new = (1 - part) * np.exp(logs[way, ks]) + part * new
                    new = np.log(new)
                    total[pairs[ks, 1 - way]] += new - logs[way, ks]
                    logs[way, ks] = new
            change = np.abs(np.exp(logs) - old).max() / part
            if len(edges) == n - 1 or change < tolerance:
                break
            waited = 0 if change < 0.9 * least else waited + 1
            least = min(least, change)
            if waited == PATIENCE:
                part, waited = part / 2, 0
                if part < LEAST_PART:
                    return mean_field(node, {pair: matrices[k] for pair, k in edges.items()}, tolerance)
        total = beliefs()
        out = np.exp(total - total.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def mean_field(node: np.ndarray, edges: dict[tuple[int, int], np.ndarray], tolerance: float) -> np.ndarray:
    """Label probabilities of independent candidates that come closest to the field.

    Each update raises one bound by at least what it moves, so the updates always come to rest.
    """
    beside: list[list[tuple[int, np.ndarray]]] = [[] for _ in node]
    for (a, b), m in edges.items():
        logs = np.log(m + TINY)
        beside[a].append((b, logs))
        beside[b].append((a, logs.T))
    own, q, change = np.log(node + 1e-300), node.copy(), np.inf
    while change >= tolerance:
        old = q.copy()
        for i, links in enumerate(beside):
            score = own[i] + sum(logs @ q[j] for j, logs in links)
            p = np.exp(score - score.max())
            q[i] = p / p.sum()
        change = np.abs(q - old).max()
    return q


#: Agreement along skips to equal and to similar tokens before any is seen.
EQUAL, SIMILAR = 7.0, 6.5
#: How firmly skips are drawn to it, and contexts to nothing.
SKIP_L2 = 1e-3


def fit_field(counts: DataFrame, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Pseudo-likelihood fit on the combinations of training_counts, in a fixed order (Adam).

    Weights are drawn to zero, those of skips to agreement, where the counts don't say otherwise.
    """
    rows = np.array(sorted(tuple(r) for r in counts.collect()), dtype="int64").reshape(-1, 8)
    mask, context, label, before, after, skip_a, skip_b, n = rows.T
    bits = ((mask[:, None] >> np.arange(N_FEATURES)) & 1).astype(float)
    one = np.vstack([np.eye(N_LABELS), np.zeros(N_LABELS)])  # -1 picks the zeros
    both = np.vstack([np.eye(2 * N_LABELS), np.zeros(2 * N_LABELS)])
    pre, post, skips = one[before], one[after], both[skip_a] + both[skip_b]
    skip, like = skips[:, :N_LABELS], skips[:, N_LABELS:]
    near = np.vstack([np.eye(CONTEXTS), np.zeros(CONTEXTS)])[context]
    weight = np.log1p(n) / max(1e-9, np.log1p(n).sum())
    prior = [np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), EQUAL * np.eye(N_LABELS), SIMILAR * np.eye(N_LABELS), np.zeros((CONTEXTS, N_LABELS))]
    theta = [x.copy() for x in prior]
    first, second = [0 * x for x in theta], [0 * x for x in theta]
    want = np.eye(N_LABELS)[label]
    for k in range(1, steps + 1 if len(rows) else 1):
        unary, step, hop, leap, beside = theta
        score = bits @ unary + pre @ step + post @ step.T + skip @ hop + like @ leap + near @ beside
        p = np.exp(score - score.max(1, keepdims=True))
        d = weight[:, None] * (want - p / p.sum(1, keepdims=True))
        jump, far = skip.T @ d, like.T @ d
        for j, g in enumerate((bits.T @ d, pre.T @ d + d.T @ post, (jump + jump.T) / 2, (far + far.T) / 2, near.T @ d)):
            g = g - (l2 if j < 2 else SKIP_L2) * (theta[j] - prior[j])
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            theta[j] = theta[j] + rate * first[j] / (1 - 0.9**k) / (np.sqrt(second[j] / (1 - 0.999**k)) + 1e-8)
    return Field(*theta)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, floor: float) -> list[tuple[int, int, int]]:
    """Spans of the field's labels that touch no base span: runs of neighbours with one label."""
    t = Tokens(text, base)
    if not t.spans or all(t.label):
        return []
    p = field.marginals(t)
    best = np.where(p.max(1) >= floor, p.argmax(1), 0)
    out: list[tuple[int, int, int]] = []
    last = -2
    for k, kind in enumerate(best.tolist()):
        if not kind or t.label[k]:
            continue
        a, b = t.spans[k]
        while a < b and text[a] in EDGE:
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        if a == b or any(x < b and a < y for x, _, y in base):
            continue
        if out and last == k - 1 and t.place[k] == t.place[last] + 1 and out[-1][1] == kind - 1:
            out[-1] = (out[-1][0], kind - 1, b)
        else:
            out.append((a, kind - 1, b))
        last = k
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def train_pii(docs: DataFrame) -> Field:
    """The field's weights from all documents (text)."""
    return fit_field(training_counts(docs))


def find_pii(docs: DataFrame, field: Field, floor: float = 0.9) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans, SHA-256 of their list, and all spans.

    A span is kind:start:end in code points. Null and empty texts have none. Rows pass one by one,
    null and repeated ids included; other columns are left out. Added spans need a probability of
    `floor` and never touch a base span. No shuffle.
    """
    send = docs.sparkSession.sparkContext.broadcast(field.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*send.value)
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in (x for part in parts(batch, "text", 512) for x in part.column("text").to_pylist()):
                base = base_spans(text) if text and CANDIDATE.search(text) else []
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                more = added_spans(text, base, own, floor) if text and CANDIDATE.search(text) else []
                spans.append(joined(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)), pa.array(digests), pa.array(spans)] if counts else [pa.array([], f) for f in [pa.int64()] * 5 + [pa.string()] * 2], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def redact_pii(docs: DataFrame, field: Field, floor: float = 0.9) -> DataFrame:
    """docs with each personal span of text replaced by its kind in brackets; all columns stay.

    Overlapping spans become one, named after the first. Null texts stay null.
    """
    send = docs.sparkSession.sparkContext.broadcast(field.weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*send.value)
        for batch in batches:
            texts = []
            for text in (x for part in parts(batch, "text", 512) for x in part.column(at).to_pylist()):
                if text and CANDIDATE.search(text):
                    base = base_spans(text)
                    pieces, free = [], 0
                    for a, kind, b in sorted(base + added_spans(text, base, own, floor)):
                        if a >= free:
                            pieces += [text[free:a], f"[{KINDS[kind].upper()}]"]
                        free = max(free, b)
                    text = "".join([*pieces, text[free:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
