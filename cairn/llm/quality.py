"""Quality rules, and line sequence labelling by a linear-chain conditional random field.

Every line of a text gets binned features (size, symbols, capitals, digits, repetition, ...). A chain over the lines with
two states, content and boilerplate, is trained by gradient ascent on the exact log-likelihood (forward-backward), and
Viterbi decoding labels the lines of every text. A text is retained if content makes up at least `share` of its
characters; `share` is the value that separates the training rows best.

There are no line labels, so training starts from `labels.quality` of the document for all its lines; then twice, the
lines of low-quality documents are labelled anew by the chain (at least one stays boilerplate) and it is trained again.
The training rows are bounded: at most `per_class` rows of each quality, with the smallest hashes of their ids, and
of each the first `train_lines` lines with text among its first 4 * `train_lines` lines.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; texts of one long line and of
very many lines are decoded whole; without labels of both classes everything that passes the base rule is kept;
repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 0.5

_IN = [np.zeros(256, np.int64) for _ in range(6)]
_CONT, _SYM, _UP, _DIGIT, _MARK, _BANG = _IN
_CONT[0x80:0xC0] = 1
_SYM[list(SYMBOLS)] = 1
_UP[65:91] = 1
_DIGIT[48:58] = 1
_MARK[list(b"!\"'(),-.:;?[]_{}@=+/\\^~`")] = 1
_BANG[list(b"!@=+_\\/{}[]^~`")] = 1

#: Bin edges of the line features, in the order of `_lines`.
EDGES = (
    (1, 4, 9, 17, 41),  # words
    (2.5, 4, 5.5, 8),  # characters a word
    (0.01, 0.06, 0.12),  # share of symbols
    (0.05, 0.12, 0.4, 0.7),  # share of capitals
    (0.02, 0.2),  # share of digits
    (0.01, 0.04, 0.1, 0.2),  # share of punctuation
    (0.005, 0.03),  # share of unusual marks
    (0.35, 0.55, 0.75, 0.9),  # distinct words / words
    (0.02, 0.2),  # words equal to the one before
    (0.5,),  # equal to an earlier line
)
N_BITS = sum(len(e) + 1 for e in EDGES)


def _sums(table: np.ndarray, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(table[buf], out=total[1:])
    return total[end] - total[begin]


class Batch:
    """Statistics of some texts and of their lines."""

    def __init__(self, raw: list[bytes]):
        t = self.texts = textvec.Texts(raw, fold=False)
        n, buf = len(raw), t.buf
        size = np.fromiter(map(len, raw), np.int64, n)
        begin, end = t.begin, t.begin + size
        self.n_words = t.counts().astype(np.int64)
        cont = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_CONT[buf], out=cont[1:])
        chars = (t.ends - t.starts) - (cont[t.ends] - cont[t.starts])
        upto = np.concatenate([[0], np.cumsum(chars)])
        self.word_chars = upto[t.first[1:]] - upto[t.first[:-1]]
        self.n_symbols = _sums(_SYM, buf, begin, end)
        self.n_repeat_words = np.array([self._repeats(t.hashes[a:b]) for a, b in zip(t.first[:-1], t.first[1:], strict=True)], np.int64)
        self._split(raw, begin, end, cont)

    @staticmethod
    def _repeats(h: np.ndarray) -> int:
        """Words in runs of three that occur twice or more."""
        g = textvec.grams(h, 3)
        if len(g) < 2:
            return 0
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g) + 1, bool)
        twice[:-1][order[1:][same]] = True
        twice[:-1][order[:-1][same]] = True
        at = np.flatnonzero(twice[:-1])
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[at + k] = True
        return int(covered.sum())

    def _split(self, raw: list[bytes], begin: np.ndarray, end: np.ndarray, cont: np.ndarray) -> None:
        """Line bounds, n_dup_lines and the binned features of lines with a word."""
        t, buf = self.texts, self.texts.buf
        cut = np.flatnonzero(buf == 10)
        # a text's lines end at each of its newlines and at its end; the joins between texts are newlines too
        stop = np.unique(np.concatenate([cut, end])) if len(raw) else np.zeros(0, np.int64)
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        w0, w1 = np.searchsorted(t.starts, start), np.searchsorted(t.starts, stop)
        full = w1 > w0
        start, stop, w0, w1 = start[full], stop[full], w0[full], w1[full]
        self.owner = np.searchsorted(begin, start, "right") - 1
        n = len(raw)
        again = np.zeros(len(start), bool)
        self.n_dup_lines = np.zeros(n, np.int64)
        seen: set[bytes] = set()
        last = -1
        view = memoryview(buf)
        for k, (d, a, b) in enumerate(zip(self.owner.tolist(), start.tolist(), stop.tolist(), strict=True)):
            if d != last:
                seen, last = set(), d
            line = view[a:b].tobytes()
            if line in seen:
                again[k] = True
                self.n_dup_lines[d] += 1
            else:
                seen.add(line)
        self.chars = (stop - start) - (cont[stop] - cont[start])
        words = (w1 - w0).astype(float)
        size = np.maximum(1, self.chars)
        # distinct words of a line: sort (line, hash) pairs
        line_of = np.repeat(np.arange(len(start)), w1 - w0)
        inside = np.repeat(w0 - np.concatenate([[0], np.cumsum(w1 - w0)[:-1]]), w1 - w0) + np.arange(len(line_of)) if len(line_of) else np.zeros(0, np.int64)
        h = t.hashes[inside]
        order = np.lexsort((h, line_of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
        distinct = np.bincount(line_of[order], new, len(start))
        near = np.zeros(len(h))
        near[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
        follow = np.bincount(line_of, near, len(start))
        letters = np.maximum(1, self.chars - words)
        values = (
            words,
            letters / words if len(words) else words,
            _sums(_SYM, buf, start, stop) / size,
            _sums(_UP, buf, start, stop) / letters,
            _sums(_DIGIT, buf, start, stop) / size,
            _sums(_MARK, buf, start, stop) / size,
            _sums(_BANG, buf, start, stop) / size,
            distinct / words if len(words) else words,
            follow / words if len(words) else words,
            again.astype(float),
        )
        bits, at = [], 0
        for v, e in zip(values, EDGES, strict=True):
            bits.append(np.searchsorted(np.array(e, float), v, "right") + at)
            at += len(e) + 1
        #: For each line with a word, the number of its bin in each feature.
        self.bits = np.stack(bits, 1).astype(np.int16) if len(start) else np.zeros((0, len(EDGES)), np.int16)


@dataclass
class Chain:
    """Weights: of the bins for boilerplate against content, of moves between states, and the retention share."""

    bits: np.ndarray
    bias: float
    moves: np.ndarray
    share: float

    def emissions(self, bits: np.ndarray) -> np.ndarray:
        return self.bits[bits].sum(1) + self.bias

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best labels (1: boilerplate) of one text's lines, given their emissions for 1."""
        m00, m01, m10, m11 = self.moves.ravel().tolist()
        a = b = 0.0
        back = []
        first = True
        for x in e.tolist():
            if first:
                a, b, first = 0.0, x, False
                continue
            s0, s1, t0, t1 = a + m00, b + m10, a + m01, b + m11
            back.append((s1 > s0, t1 > t0))
            a, b = max(s0, s1), max(t0, t1) + x
        out = [b > a]
        for p0, p1 in reversed(back):
            out.append(p1 if out[-1] else p0)
        return np.array(out[::-1][: len(e)], bool)

    def content(self, batch: Batch) -> np.ndarray:
        """Share of each text's characters in lines that are labelled content; 0 without lines."""
        n = len(batch.n_words)
        e = self.emissions(batch.bits)
        at = np.searchsorted(batch.owner, np.arange(n + 1))
        good = np.zeros(len(e), bool)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                good[a:b] = ~self.viterbi(e[a:b])
        whole = np.bincount(batch.owner, batch.chars, n)
        return np.bincount(batch.owner, batch.chars * good, n) / np.maximum(1, whole)


def _loglik_grad(sets: list[np.ndarray], lab: list[np.ndarray], w: np.ndarray, weight: np.ndarray):
    """Gradient of the weighted log-likelihood over all sequences at once, padded to the longest."""
    n, most = len(sets), max(map(len, sets))
    bits = np.full((n, most, len(EDGES)), N_BITS, np.int16)
    y = np.zeros((n, most), int)
    mask = np.zeros((n, most))
    for k, (s, z) in enumerate(zip(sets, lab, strict=True)):
        bits[k, : len(s)], y[k, : len(s)], mask[k, : len(s)] = s, z, 1
    e = np.append(w[:N_BITS], 0.0)[bits].sum(2) + w[N_BITS]
    em = np.stack([np.zeros_like(e), e * mask], 2)
    move = w[N_BITS + 1 :].reshape(2, 2)
    alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    alpha[:, 0] = em[:, 0]
    for t in range(1, most):
        step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + em[:, t]
        alpha[:, t] = np.where(mask[:, t, None] > 0, step, alpha[:, t - 1])
    for t in range(most - 2, -1, -1):
        step = np.logaddexp.reduce(move + (em[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    p = np.exp(alpha + beta - z[:, None, None])[:, :, 1]
    r = (y - p) * mask * weight[:, None]
    g = np.zeros(len(w))
    g[:N_BITS] = np.bincount(bits.ravel(), np.repeat(r.ravel(), len(EDGES)), N_BITS + 1)[:N_BITS]
    g[N_BITS] = r.sum()
    if most > 1:
        both = mask[:, 1:] * weight[:, None]
        q = np.exp(alpha[:, :-1, :, None] + move + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        for i in (0, 1):
            for j in (0, 1):
                g[N_BITS + 1 + 2 * i + j] = ((((y[:, :-1] == i) & (y[:, 1:] == j)) - q[:, :, i, j]) * both).sum()
    return g


def _train(sets, lab, weight, w, rounds: int = 60) -> np.ndarray:
    """Gradient ascent with per-weight steps and an L2 penalty."""
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for k in range(1, rounds + 1):
        g = _loglik_grad(sets, lab, w, weight) - 0.5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Chain | None:
    """Chain of (bins of lines, characters of lines, quality) rows; None without both qualities."""
    rows = [r for r in rows if len(r[0])]
    good = np.array([q for *_, q in rows])
    if not len(rows) or good.all() or not good.any():
        return None
    sets = [b for b, _, _ in rows]
    lab = [np.full(len(b), 1 - q) for b, _, q in rows]
    weight = np.where(good == 1, len(rows) / (2 * good.sum()), len(rows) / (2 * (1 - good).sum()))
    w = np.zeros(N_BITS + 5)
    for again in range(3):
        w = _train(sets, lab, weight, w)
        chain = Chain(w[:N_BITS], float(w[N_BITS]), w[N_BITS + 1 :].reshape(2, 2), 0.5)
        if again < 2:
            for k in np.flatnonzero(good == 0):
                e = chain.emissions(sets[k])
                lab[k] = chain.viterbi(e).astype(int)
                lab[k][int(np.argmax(e))] = 1
    share = np.array([c[~chain.viterbi(chain.emissions(b))].sum() / max(1, c.sum()) for b, c, _ in rows])
    cuts = np.linspace(0.05, 1.0, 96)
    right = [(share[good == 1] >= c).mean() + (share[good == 0] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-3)
    chain.share = float(cuts[best[len(best) // 2]])
    return chain


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, train_lines: int = 48) -> Chain | None:
    """Chain learnt from labels (doc_id, quality)."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = []
    for q in (0, 1):
        chosen += [tuple(r) for r in usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not chosen:
        return None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py() or ""
                one = Batch(["\n".join(t.split("\n", 4 * train_lines)[: 4 * train_lines]).encode()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([one.bits[:train_lines].tobytes()], pa.binary()), pa.array([one.chars[:train_lines].astype(np.int64).tobytes()], pa.binary()), b.column(2).slice(k, 1)], ["doc_id", "bits", "chars", "quality"])

    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int")  # bounded by per_class
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, bits binary, chars binary, quality int").collect()
    rows = sorted((r["doc_id"], bytes(r["bits"]), bytes(r["chars"]), r["quality"]) for r in found)
    return fit([(np.frombuffer(b, np.int16).reshape(-1, len(EDGES)), np.frombuffer(c, np.int64), q) for _, b, c, q in rows])


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def assess(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the statistics, base_failed, kept and content_share of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                s = Batch(textvec.as_bytes(part.column(1)))
                failed = (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > 100 * MOST_REPEATED * s.n_words)
                share = chain.content(s) if chain else np.ones(part.num_rows)
                kept = ~failed & (share >= (chain.share if chain else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept, share))], ["key", *(c.split()[0] for c in COLUMNS.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)
