"""Fill-in-the-middle transformation: a text is cut at two of its unit boundaries and its pieces are put in another order.

A text is decoded to an array of UTF-32 code points. Each code point gets a class, such that units are maximal runs of
one class; comparing neighbours and `flatnonzero` give the boundaries. Of n units the prefix ends after the smaller and
the middle after the larger of two ranks among 0..n; the pieces are slices of the array, encoded again.

Units: `line` (up to and with its newline), `word` (a run of white space or of anything else), `char`.

Everything drawn depends on the seed and the key alone: the first four 8-digit groups h1..h4 of the hexadecimal SHA-256 of
"seed:key". Cuts are h1 and h2 modulo n + 1, a text is transformed if h3 % 100 < rate, and in suffix order if
h4 % 100 < spm. Forms: `psm` is P prefix S suffix M middle, `spm` is S suffix P prefix M middle, P, S and M being the
sentinels; `plain` is the text itself, if it is empty, holds a sentinel, or isn't drawn. Sentinels neither contain nor
overlap each other, so `restore` finds them again whatever the pieces hold.

Defined cases: a null text is an empty one; a null key is hashed as an empty string; a text without newline is one line;
equal rows give equal rows; a text of any length is one array of four bytes a code point; other columns are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

from itertools import permutations
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 100
SPM = 50
SEED = "7"
#: Rows of an Arrow batch that are transformed at a time.
STEP = 64
_WHITE = np.array([0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Sentinels:
        """Itself, if no sentinel is empty, part of another, or begins with another's (or its own) end."""
        for a, b in permutations(self, 2):
            if not a or a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")
        if any(a.endswith(a[:k]) for a in self for k in range(1, len(a))):
            raise ValueError("a sentinel overlaps itself")
        return self


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def text_of(cps: np.ndarray) -> str:
    return cps.tobytes().decode("utf-32-le")


def classes(cps: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; a unit is a maximal run of one class."""
    if unit == "line":
        before = np.zeros(len(cps), np.int64)
        np.cumsum(cps[:-1] == 0x0A, out=before[1:])
        return before
    if unit == "word":
        return np.isin(cps, _WHITE)
    if unit == "char":
        return np.arange(len(cps))
    raise ValueError(f"unit {unit!r} is not line, word or char")


def edges(cps: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units begin and end: n + 1 rising places, from 0 to the length; of an empty text just 0."""
    if not len(cps):
        return np.zeros(1, np.int64)
    kind = classes(cps, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(cps)]])


def transform(text: str, draws: tuple[int, int, int, int], unit: str = "line", rate: int = RATE, spm: int = SPM, marks: Sentinels = Sentinels()) -> Cut:
    cps = points(text)
    at = edges(cps, unit)
    n = len(at) - 1
    if not text or any(m in text for m in marks) or draws[2] % 100 >= rate:
        return Cut(n, "plain", None, None, text)
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = int(at[low]), int(at[high])
    prefix, middle, suffix = text_of(cps[:a]), text_of(cps[a:b]), text_of(cps[b:])
    if draws[3] % 100 < spm:
        return Cut(n, "spm", a, b - a, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}")
    return Cut(n, "psm", a, b - a, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}")


def restore(output: str, form: str, marks: Sentinels = Sentinels()) -> str:
    """The text that gave this output in this form."""
    if form == "plain":
        return output
    first, second = (marks.suffix, marks.prefix) if form == "spm" else (marks.prefix, marks.suffix)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(marks.middle, 1)
    return two + middle + one if form == "spm" else one + middle + two


def draws(key: Column, seed: str = SEED) -> Column:
    """h1..h4 of a key, an array of long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", rate: int = RATE, spm: int = SPM, seed: str = SEED, marks: Sentinels = Sentinels()) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output and restored (the text rebuilt from output and form) of
    every row of docs, in one pass without a shuffle."""
    marks.checked()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                made = [transform(t or "", d, unit, rate, spm, marks) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                back = [restore(c.output, c.form, marks) for c in made]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(back, pa.string())], ["key", *Cut._fields, "restored"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), draws(F.col(key), seed).alias("draws"))
    return given.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string").withColumnRenamed("key", key)


def digests(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """What fill_in_middle returns, with the SHA-256 of its texts in their place."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
