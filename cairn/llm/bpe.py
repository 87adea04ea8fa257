"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding. In a canonical BPE encoding every prefix that ends on a token boundary is itself canonical, and a sequence is
canonical when each token alone and each neighbouring pair is. So for every byte offset there is exactly one token that
can end there. Any continuation passes through one of the last L offsets, L being the longest token in bytes: the tokens
that the paths to those L offsets share can no longer change. `lookahead` of a merge list is that L. Tokens are emitted
once they are shared, and the bytes behind them are forgotten, so memory does not depend on the text's length.

Decoding. Token bytes go through an incremental UTF-8 state machine; malformed sequences become U+FFFD, one for each
maximal ill-formed part, and a sequence cut between two tokens is completed by the next.

Defined cases: a null text is an empty one; an empty text has no tokens and decodes to an empty text; special-token
strings inside a text become their ids, as the public library does by default; other columns of the input, whatever
their names, are not read; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import array
import codecs
import json
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the byte-level pre-tokeniser: fixed values that must equal the public format's.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
#: Code points on whose classes all Unicode versions agree; a text with others is split by the library's own classes.
_COMMON = regex.compile("[\\x00-՗֐-״‐-⁯₠-₵←-⏳─-⭕　-ヿ一-鿌가-힣！-￮\U0001f300-\U0001f64f]*")
#: Pieces of at most so many characters are kept with their ids, this many of them in each of two generations.
_SHORT, _KEPT = 48, 150_000
#: Pairs of tokens whose fit a worker keeps at a time.
_PAIRS = 250_000
#: Characters of a text that are split at a time.
CHUNK = 1 << 20


def _byte_chars() -> dict[str, int]:
    """The format's printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list with its vocabulary."""

    def __init__(self, vocab: dict[bytes, int], pairs: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.ids = vocab
        self.special = special
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.rank = {p: r for r, p in enumerate(pairs)}
        #: Sufficient lookahead in bytes.
        self.lookahead = max(map(len, vocab), default=1)
        #: The length of the longest token that ends with these three bytes.
        self.reach: dict[bytes, int] = {}
        for t in vocab:
            if len(t) > 2:
                self.reach[t[-3:]] = max(self.reach.get(t[-3:], 0), len(t))
        self._fits: dict[int, bool] = {}
        #: Of tokens; as many as the vocabulary has at most.
        self._ends: dict[int, tuple] = {}

    @classmethod
    def load(cls, path: str) -> Merges:
        spec = json.load(open(path, encoding="utf-8"))
        table = _byte_chars()
        raw = lambda s: bytes(map(table.__getitem__, s))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = [tuple(map(raw, p if isinstance(p, list) else p.split(" "))) for p in spec["model"]["merges"]]
        return cls(vocab, pairs, special)

    def plain(self, text: bytes) -> list[bytes]:
        """Reference encoding of a short string: apply the lowest-ranked merge until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        none = len(self.rank)
        while len(parts) > 1:
            r, k = min((self.rank.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
            if r == none:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edges(self, token: int) -> tuple[bool, list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        """Whether a token alone is canonical; and after each merge of its encoding, the merge's rank with the first part, and with
        the last part."""
        got = self._ends.get(token)
        if got is None:
            text, none, first, last = self.bytes_of[token], len(self.rank), [], []
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 1:
                r, k = min((self.rank.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
                if r == none:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                first.append((r, parts[0]))
                last.append((r, parts[-1]))
            got = self._ends[token] = (parts == [text], first, last)
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges of a and b together never join them. Each goes on as it does alone until the parts where they meet
        are the lowest-ranked pair; of equal ranks the leftmost is first."""
        (whole, _, left), (sound, right, _) = self._edges(a), self._edges(b)
        if not (whole and sound):
            return False
        rank, none = self.rank.get, len(self.rank)
        p, q, i, j = self.bytes_of[a][-1:], self.bytes_of[b][:1], 0, 0
        r = rank((p, q), none)
        while True:
            x = left[i][0] if i < len(left) else none
            y = right[j][0] if j < len(right) else none
            if r < x and r <= y and r != none:
                return False
            if x == y == none:
                return True
            if x <= y:
                was, p, i = p, left[i][1], i + 1
                changed = was != p
            else:
                was, q, j = q, right[j][1], j + 1
                changed = was != q
            if changed:
                r = rank((p, q), none)

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (a < 0: may begin a piece)."""
        key = (a + 1) << 24 | b
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) >= _PAIRS:
                self._fits.clear()
            got = self._fits[key] = self._edges(b)[0] if a < 0 else self._apart(a, b)
        return got

    def advance(self, buf: bytes, last: list[int], size: list[int]) -> None:
        """Add to last and size, for every further offset of buf, the token that can end there and its length."""
        ids, known, reach = self.ids.get, self._fits, self.reach.get
        for n in range(len(last), len(buf) + 1):
            at = n - reach(buf[n - 3 : n], 2) if n > 2 else 0
            for at in range(at if at > 0 else 0, n):
                t = ids(buf[at:n])
                if t is not None:
                    a = last[at]
                    ok = known.get((a + 1) << 24 | t)
                    if ok or (ok is None and self.fits(a, t)):
                        last.append(t)
                        size.append(n - at)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")


class Transducer:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, merges: Merges):
        self.m, self.buf, self.last, self.size = merges, bytearray(), [-1], [0]

    def feed(self, data: bytes, out: list[int]) -> None:
        m, most = self.m, self.m.lookahead
        for at in range(0, len(data), 4 * most):
            self.buf += data[at : at + 4 * most]
            buf, last, size = bytes(self.buf), self.last, self.size
            m.advance(buf, last, size)
            if len(buf) >= 4 * most:
                self._emit(out)

    def _path(self, n: int) -> list[int]:
        """Boundaries of the encoding of the first n bytes, from the end."""
        ends = []
        while n:
            ends.append(n)
            n -= self.size[n]
        return ends

    def _emit(self, out: list[int]) -> None:
        n = len(self.buf)
        shared = set(self._path(n))
        for k in range(max(1, n - self.m.lookahead + 1), n):
            shared &= set(self._path(k))
        if shared:
            q = max(shared)
            out += [self.last[e] for e in self._path(q)[::-1]]
            keep = self.last[q]
            del self.buf[:q], self.last[:q], self.size[:q]
            self.last[0] = keep  # the next token must fit it
            self.size[0] = 0

    def finish(self, out: list[int]) -> None:
        out += [self.last[e] for e in self._path(len(self.buf))[::-1]]
        self.buf, self.last, self.size = bytearray(), [-1], [0]


class Encoder:
    """Text in chunks to ids; carries at most one chunk's tail and the state of one open piece."""

    def __init__(self, path: str):
        self.path, self.m = path, Merges.load(path)
        self.pattern = regex.compile(_PIECES.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
        self.exact = None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True)))) if self.m.special else None

    def _classes(self) -> regex.Pattern:
        """The pattern with letters and numbers as the library has them, found by asking it about every code point."""
        if self.exact is None:
            from tokenizers import Tokenizer

            split = Tokenizer.from_file(self.path).pre_tokenizer

            def joined(to: str) -> str:
                """Ranges of the code points that stay in one piece with `to`; the library is asked about 4,096 at a time, since a
                piece takes far more memory than its text."""
                runs: list[list[int]] = []
                for first in range(0x80, 0x110000, 4096):
                    text = "".join(f"{to}{chr(c)}\n" for c in range(first, min(first + 4096, 0x110000)) if not 0xD800 <= c < 0xE000)
                    for c in [ord(text[a + 1]) for _, (a, b) in split.pre_tokenize_str(text) if b - a == 2 and text[a] == to]:
                        if runs and runs[-1][1] == c - 1:
                            runs[-1][1] = c
                        else:
                            runs.append([c, c])
                return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)

            letters, numbers = "a-zA-Z" + joined("a"), "0-9" + joined("1")
            self.exact = regex.compile(_PIECES.format(L=f"[{letters}]", N=f"[{numbers}]", l=letters, n=numbers))
        return self.exact

    def piece(self, s: str) -> bytes:
        """Packed ids of a short piece."""
        got = self.new.get(s) or self.old.get(s)
        if got is None:
            buf, last, size, out = s.encode(), [-1], [0], []
            whole = self.m.ids.get(buf)
            if whole is not None and self.m.fits(-1, whole):  # the first token that would be tried at the end
                out.append(whole)
            else:
                self.m.advance(buf, last, size)
                n = len(buf)
                while n:
                    out.append(last[n])
                    n -= size[n]
            got = array.array("I", out[::-1]).tobytes()
        if len(self.new) >= _KEPT:
            self.old, self.new = self.new, {}
        self.new[s] = got
        return got

    def encode(self, text: str, chunk: int = CHUNK) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for hit in self.special.finditer(text) if self.special else ():
            self._plain(text[at : hit.start()], out, chunk)
            out.append(array.array("I", [self.m.special[hit[0]]]).tobytes())
            at = hit.end()
        self._plain(text[at:] if at else text, out, chunk)
        return b"".join(out)

    def _plain(self, text: str, out: list[bytes], chunk: int) -> None:
        if not text:
            return
        pattern = self.pattern if _COMMON.fullmatch(text) else self._classes()
        if len(text) <= chunk:
            for s in pattern.findall(text):
                got = self.new.get(s)
                out.append(got if got is not None else self.piece(s) if len(s) <= _SHORT else self._long(s))
            return
        for hit in pattern.finditer(text):
            s = hit[0]
            out.append(self.piece(s) if len(s) <= _SHORT else self._long(s))

    def _long(self, s: str) -> bytes:
        ids: list[int] = []
        t = Transducer(self.m)
        for k in range(0, len(s), 4096):
            t.feed(s[k : k + 4096].encode(), ids)
        t.finish(ids)
        return array.array("I", ids).tobytes()


class Decoder:
    """Ids in, text out as soon as its bytes are whole."""

    def __init__(self, merges: Merges):
        self.table = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode(packed: bytes, merges: Merges, step: int = 1 << 16) -> str:
    d, ids = Decoder(merges), memoryview(packed).cast("I")
    return "".join([d.feed(ids[k : k + step].tolist()) for k in range(0, len(ids), step)] + [d.finish()])


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (packed little-endian uint32) and decoded text of each row of docs, in one pass without a shuffle."""

    def run(batches):
        import pyarrow as pa

        e = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [e.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([decode(i, e.m) for i in ids], pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids binary, decoded string")
    return out.withColumnRenamed("key", key)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode returns."""
    return encoded.select(key, n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
