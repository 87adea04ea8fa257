"""Toxicity by compression distance.

Two separate zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is read as windows of
WINDOW bytes of running text (lower case, white space and punctuation as one space) that overlap: one begins at every
word, and one at every half window inside longer words. A window's gain is its compressed length under the ordinary
dictionary less that under the toxic one. A text's gains (how many of its distinct windows reach each of GAINS, the
largest, how many windows there are) give a score through a logistic curve fitted on labelled rows that trained no
dictionary; the curve is moved so that the decision with the best F1 there is at 0.3.

Windows are short because zstandard pays about four bytes for a match: in a longer one, what the dictionaries tell of
ordinary words around it drowns a short toxic word. Both dictionaries know a lead-in, so that every window is coded as a
block with matches and lengths can be compared.

The dictionaries are trained on whole texts of their class at first. Most of a toxic text is ordinary, so the toxic one is
then trained again, ROUNDS times, on the windows of toxic texts whose gain only a share of RARE of the ordinary windows
exceeds. Gains are taken crosswise, each half of the texts by the dictionaries of the other, so that no text speaks for
itself; of SPLITS such splits, VOTES must pick a window. The ordinary dictionary gets the ordinary windows that the toxic
one shortens by at least WORSE bytes in front.

Every window of every text is scored. Labels are learnt from a bounded sample of labelled rows: at most `per_class` rows of
label 0 and 1 (those with the smallest hash of the id) and `train_chars` characters of each.

Defined cases: a null or empty text has no windows and gets the curve's value there; rows without a label, with a null id
or without a text teach nothing; without both classes every score is 0; where no window tells the classes apart, every
score is the rate of label 1; repeated rows repeat in the result; other columns are not read.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.3
#: Bytes of a window, sizes of the dictionaries, compression level.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 10, 112_640, 32_768, 3
#: Rounds of training the toxic dictionary; how many of them the last one learns from; see above.
ROUNDS, LAST_ROUNDS, RARE, WORSE = 4, 3, 0.002, 1
GAINS = (1, 2, 3, 4, 5, 6, 8)
#: Splits into halves, how many of them must pick a window, and one in how many rows fits the curve alone.
SPLITS, VOTES, CURVE = 3, 2, 5
#: Near copies stay in the training rows if fewer rows than this would be left without them.
FEW = 10
#: Places (a power of two) of the gains that a task keeps, a window in its own place; 11 bytes each.
PLACES = 1 << 21
#: So many windows, as in training, are coded in one call on all cores.
MANY = 50_000
PAD = bytes(33 + (i * i * 7 + i * 31) % 94 for i in range(48))
_SPACED = str.maketrans(dict.fromkeys(string.punctuation + "«»“”„‘’…–—¡¿", " "))


def running(text: str) -> bytes:
    """Lower-cased words with one space between and around them."""
    words = " ".join(text.lower().translate(_SPACED).split())
    return f" {words} ".encode("utf-8", "replace") if words else b""


def windows(text: str) -> dict[bytes, None]:
    """Distinct windows in the order of the text."""
    b = running(text)
    gap = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
    at = gap[:-1]
    long = np.flatnonzero(np.diff(gap) > WINDOW)
    if len(long):
        half = WINDOW // 2
        at = np.sort(np.concatenate([at, *(np.arange(gap[k] + half, gap[k + 1] - half + 1, half) for k in long.tolist())]))
    return dict.fromkeys([b[s : s + WINDOW] for s in at.tolist()])


def _coder(content: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(content + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def _grams(rows: np.ndarray) -> np.ndarray:
    """The four bytes from each place of every row on, as integers."""
    rows = np.ascontiguousarray(rows)
    return np.ndarray((len(rows), rows.shape[1] - 3), "<u4", rows, strides=(rows.shape[1], 1))


def _hashed(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint32(2654435761)) >> np.uint32(12)


def _lengths(coder, rows: np.ndarray) -> np.ndarray:
    """Compressed lengths of full windows."""
    import zstandard

    framed = np.empty((len(rows), len(PAD) + WINDOW), np.uint8)
    framed[:, : len(PAD)] = np.frombuffer(PAD, np.uint8)
    framed[:, len(PAD) :] = rows
    places = np.full((len(rows), 2), framed.shape[1], np.uint64)
    places[:, 0] = np.arange(len(rows)) * framed.shape[1]
    made = coder.multi_compress_to_buffer(zstandard.BufferWithSegments(framed.tobytes(), places.tobytes()), threads=-1)
    return np.fromiter((len(made[k]) for k in range(len(rows))), np.int64, len(rows))


class Coder:
    """Gains of windows under two dictionaries. With `places`, windows of the full length are remembered, the last one of
    each place of a table."""

    def __init__(self, ordinary: bytes, toxic: bytes, places: int = 0):
        self.coders = _coder(ordinary), _coder(toxic)
        self.plain, self.foul = (c.compress for c in self.coders)
        self.whole = {n: len(_coder(b"").compress(PAD + bytes(range(128, 128 + n)))) for n in range(WINDOW + 1)}
        #: Whether some four bytes with this hash come before a window.
        self.before = np.zeros(1 << 20, bool)
        self.before[_hashed(_grams(np.frombuffer(toxic + PAD + PAD, np.uint8)[None]))] = True
        self.shift = np.uint64(65 - places.bit_length())
        self.kept = (np.zeros(places, np.uint64), np.zeros(places, np.uint16), np.full(places, 255, np.uint8)) if places else None

    def gain(self, window: bytes) -> int:
        """How many bytes shorter the toxic dictionary makes it, 0 if it makes it no shorter."""
        foul = len(self.foul(PAD + window))
        # what the toxic dictionary can't shorten at all needs no second look
        return max(0, len(self.plain(PAD + window)) - foul) if foul < self.whole[len(window)] else 0

    def _matches(self, rows: np.ndarray) -> np.ndarray:
        """Whether the toxic dictionary could shorten a window: a match has four bytes at least, so some four that end in the
        window must stand before it or twice in it."""
        lead = np.empty((len(rows), WINDOW + 3), np.uint8)
        lead[:, :3] = np.frombuffer(PAD[-3:], np.uint8)
        lead[:, 3:] = rows
        grams = _grams(lead)
        hit = self.before[_hashed(grams)].any(axis=1)
        left = np.flatnonzero(~hit)
        if len(left):
            own = np.sort(grams[left], axis=1)
            hit[left] = (own[:, 1:] == own[:, :-1]).any(axis=1)
        return hit

    def _fresh(self, flat: bytes) -> np.ndarray:
        """Gains of the full windows in flat; of many, all cores code them."""
        rows = np.frombuffer(flat, np.uint8).reshape(-1, WINDOW)
        out = np.zeros(len(rows), np.int64)
        at = np.flatnonzero(self._matches(rows))
        if len(at) < MANY:
            for k in at.tolist():
                out[k] = self.gain(flat[k * WINDOW : (k + 1) * WINDOW])
            return out
        foul = _lengths(self.coders[1], rows[at])
        less = foul < self.whole[WINDOW]
        at, foul = at[less], foul[less]
        out[at] = np.maximum(0, _lengths(self.coders[0], rows[at]) - foul) if len(at) else 0
        return out

    def gains(self, found) -> np.ndarray:
        """The gain of each window, in their order."""
        short = {k: self.gain(w) for k, w in enumerate(found) if len(w) != WINDOW}
        full = [w for w in found if len(w) == WINDOW] if short else list(found)
        flat = b"".join(full)
        if self.kept is None or not full:
            got = self._fresh(flat)
        else:
            low = np.ndarray(len(full), "<u8", flat, 0, (WINDOW,)).copy()
            high = np.ndarray(len(full), "<u2", flat, 8, (WINDOW,)).copy()
            at = (((low ^ (low >> np.uint64(29))) + high) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
            lows, highs, sizes = self.kept
            got = sizes[at].astype(np.int64)
            new = np.flatnonzero((lows[at] != low) | (highs[at] != high) | (got == 255))
            if len(new):
                got[new] = self._fresh(np.frombuffer(flat, np.uint8).reshape(-1, WINDOW)[new].tobytes())
                lows[at[new]], highs[at[new]], sizes[at[new]] = low[new], high[new], got[new]
        if short:
            out = np.empty(len(found), np.int64)
            out[list(short)] = list(short.values())
            out[np.delete(np.arange(len(found)), list(short))] = got
            return out
        return got


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: Intercept and weights of `features`; empty if nothing could be learnt.
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.coder = Coder(model.ordinary, model.toxic, PLACES)

    def features(self, text: str) -> list[float]:
        found = windows(text)
        gains = self.coder.gains(found)
        return [1.0, *(math.log1p(int((gains >= g).sum())) for g in GAINS), float(gains.max(initial=0)), math.log1p(len(found))]

    def score(self, text: str) -> float:
        if not self.model.weights:
            return 0.0
        z = sum(w * f for w, f in zip(self.model.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _unlike(texts: list[str]) -> list[str]:
    """Without near copies of earlier ones (5 of the 8 smallest word hashes shared), which would pass for a pattern; all
    if fewer than FEW would be left."""
    first: dict[int, int] = {}
    kept = []
    for t in texts:
        low = sorted(zlib.crc32(w) for w in set(running(t).split()))[:8]
        shared = Counter(first[h] for h in low if h in first)
        if shared and 8 * max(shared.values()) >= 5 * len(low):
            continue
        for h in low:
            first.setdefault(h, len(kept))
        kept.append(t)
    return kept if len(kept) >= FEW else texts


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary trained on the samples; all of them if they fit."""
    import zstandard

    whole = b"".join(dict.fromkeys(samples))
    if len(whole) <= size:
        return whole
    try:
        made = zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from
        return whole[:size]
    return made[-size:]


def _narrowed(ordinary: list[str], toxic: list[str]) -> list[bytes]:
    """Windows of toxic texts that the last rounds picked, two halves of the texts against each other."""
    halves = [[x[0::2], x[1::2]] for x in (ordinary, toxic)]
    plain = [_dictionary([running(t) for t in h], ORDINARY_BYTES) for h in halves[0]]
    foul = [_dictionary([running(t) for t in h], TOXIC_BYTES) for h in halves[1]]
    calm = [list(dict.fromkeys(w for t in h for w in windows(t))) for h in halves[0]]
    loud = [[list(windows(t)) for t in h] for h in halves[1]]
    learnt = []
    for r in range(ROUNDS):
        picked = []
        for j in (0, 1):
            coder = Coder(plain[1 - j], foul[1 - j])
            usual = coder.gains(calm[j])
            least = 1 + (np.quantile(usual, 1 - RARE, method="higher") if len(usual) else 0)
            picked.append([w for one in loud[j] for w, g in zip(one, coder.gains(one).tolist(), strict=True) if g >= least])
        if r >= ROUNDS - LAST_ROUNDS:
            learnt += picked[0] + picked[1]
        for j in (0, 1):
            foul[j] = _dictionary(picked[j], TOXIC_BYTES)
            plain[j] = _harder(plain[j], foul[j], calm[j])
    return learnt


def _harder(plain: bytes, foul: bytes, calm) -> bytes:
    """The ordinary dictionary with the ordinary windows in front that the toxic one shortens."""
    coder = Coder(plain, foul)
    return b"".join(w for w, g in zip(calm, coder.gains(calm).tolist(), strict=True) if g >= WORSE) + plain


def dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries of texts of the two classes."""
    votes = Counter()
    for k in range(SPLITS):
        by = lambda t: zlib.crc32(b"%d" % k + running(t))  # noqa: B023,E731
        votes.update(set(_narrowed(sorted(ordinary, key=by), sorted(toxic, key=by))))
    foul = _dictionary([w for w, n in sorted(votes.items()) if n >= VOTES], TOXIC_BYTES)
    plain = _dictionary([running(t) for t in ordinary], ORDINARY_BYTES)
    calm = list(dict.fromkeys(w for t in ordinary for w in windows(t)))
    for _ in (0, 1):
        plain = _harder(plain, foul, calm)
    return plain, foul


def fit(rows: list[tuple[str, int]]) -> Model:
    """Model of (text, label) rows: one in CURVE of each class fits the curve, the others train the dictionaries."""
    by = {y: [t for t, z in rows if z == y] for y in (0, 1)}
    if min(map(len, by.values())) < 3:
        return Model(b"", b"", ())
    by = {y: sorted(_unlike(by[y]), key=lambda t: zlib.crc32(running(t))) for y in by}
    ordinary, toxic = dictionaries(*([t for k, t in enumerate(by[y]) if k % CURVE] for y in (0, 1)))
    model = Model(ordinary, toxic, (0.0,) * (len(GAINS) + 3))
    s = model.scorer()
    last = [(t, y) for y in (0, 1) for t in by[y][::CURVE]]
    x, y = np.array([s.features(t) for t, _ in last]), np.array([float(y) for _, y in last])
    if not toxic or not x[:, 1].any():
        rate = sum(z for _, z in rows) / len(rows)
        return Model(b"", b"", (math.log(rate / (1 - rate)), *[0.0] * (len(GAINS) + 2)))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[0], spread[0] = 0.0, 1.0
    x = (x - mean) / spread
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
    z = np.sort(x @ w)
    cuts = np.unique((z[1:] + z[:-1]) / 2)
    chosen = np.argsort(-(x @ w), kind="stable")
    hit, taken = np.cumsum(y[chosen]), np.arange(1, len(y) + 1)
    at = np.searchsorted(-(x @ w)[chosen], -cuts, "right") - 1
    f1 = 2 * hit[at] / (y.sum() + taken[at])
    w[0] += math.log(CUT / (1 - CUT)) - cuts[int(np.argmax(f1))]
    w /= spread
    w[0] -= (w[1:] * mean[1:]).sum()
    return Model(ordinary, toxic, tuple(map(float, w)))


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (1500, 1000), train_chars: int = 32_768) -> Model:
    """Model learnt from labels (doc_id, toxic) of rows that are not held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = []
    for y in (0, 1):
        chosen += usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y]).collect()
    if not chosen:
        return Model(b"", b"", ())
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r[0], r[1]) for r in chosen], usable.schema)  # bounded by per_class
    rows = docs.select("doc_id", F.substring("text", 1, train_chars).alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).collect()
    return fit([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row."""

    def run(batches):
        import pyarrow as pa

        s = model.scorer()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.score(t or "") for t in part.column(1).to_pylist()], pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose score is below the cut."""
    place = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        import pyarrow as pa

        s = model.scorer()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield part.filter(pa.array([s.score(t or "") < CUT for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
