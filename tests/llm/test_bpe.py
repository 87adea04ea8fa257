import hashlib
import random
import subprocess
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_like_the_library_for_any_chunk(library):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "\n", "é", "1", "-", "'s", "<|endoftext|>", "the", "՘", "\U0001f600", "日本", "\x00", "\x1c", " " * 300, "-" * 150, "ab" * 90]
    e = bpe.Encoder(PATH)
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (bpe.CHUNK, 5):
            packed = e.encode(text, chunk)
            assert list(memoryview(packed).cast("I")) == want if packed else want == []
        assert bpe.decode(packed, e.m, 2) == library.decode(want, skip_special_tokens=False)


def test_memory_does_not_grow_with_a_piece():
    m = bpe.encoder(PATH).m
    t, out = bpe.Transducer(m), []
    for _ in range(200):
        t.feed(b"abcabz" * 100, out)
        assert len(t.buf) <= 16 * m.lookahead
    t.finish(out)
    assert b"".join(m.bytes_of[i] for i in out) == b"abcabz" * 20000


def test_query_cases(spark, library):
    rows = [(1, "The cat", 5, "x"), (1, "The cat", 5, "x"), (2, None, None, None), (3, "", 0, "y"), (None, "é" * 5000, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = sorted(map(tuple, bpe.digests(bpe.encode_decode(docs, PATH)).collect()), key=str)

    def want(key, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return key, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert bpe.digests(bpe.encode_decode(docs.limit(0), PATH)).count() == 0


def test_pairs_fit_as_the_whole_merge_says():
    import random

    import public_tokenizers

    from cairn.llm.bpe import Merges

    m = Merges.load(public_tokenizers.path("byte_bpe_50k.json"))
    rnd, ids = random.Random(3), sorted(m.ids.values())
    for a, b in [(rnd.choice(ids), rnd.choice(ids)) for _ in range(3000)]:
        x, y = m.bytes_of[a], m.bytes_of[b]
        assert m._apart(a, b) == (m.plain(x + y) == [x, y])
        assert m.fits(-1, b) == (m.plain(y) == [y])
    assert all(m.reach[t[-3:]] >= len(t) for t in m.ids if len(t) > 2)


def test_memory_of_odd_characters_and_pairs(monkeypatch):
    # a process of its own, since the peak of this one may be anything
    code = f"import resource; from cairn.llm import bpe; bpe.Encoder({PATH!r})._classes(); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400 * 1024
    monkeypatch.setattr(bpe, "_PAIRS", 50)
    e = bpe.Encoder(PATH)
    text = " ".join(random.Random(7).choice("abcdefghij") * k + "xyzzy" for k in range(1, 40))
    assert list(memoryview(e.encode(text)).cast("I")) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert len(e.m._fits) <= 50
