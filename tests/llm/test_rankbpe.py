import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from cairn.llm import rankbpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library_for_any_chunk(library):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "\n", "é", "1", "-", "'s", "<|endoftext|>", "the", "՘", "\U0001f600", "日本", "\x00", "\x1c", " " * 300, "-" * 150, "ab" * 90, "١", " ", "\U0001e900", " ", "ـ", "क्षि"]
    e = rankbpe.Encoder(PATH, PATTERN)
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        want = library.encode_ordinary(text)
        for chunk in (rankbpe.CHUNK, 5):
            packed = e.encode([text], chunk)[0]
            assert (list(memoryview(packed).cast("I")) if packed else []) == want
        assert e.decode(packed) == text.encode()


def test_every_code_point_is_split_as_the_library_does(library):
    e = rankbpe.Encoder(PATH, PATTERN)
    for common in (True, False):
        points = [chr(c) for c in (*range(0x3400), *range(0x9F00, 0xAC00), *range(0xD700, 0xD800), *range(0xE000, 0x20000, 3)) if bool(rankbpe._COMMON.fullmatch(chr(c))) == common]
        for k in range(0, len(points), 40_000):
            text = "".join(f"a{c}1{c} {c}\n" for c in points[k : k + 40_000])
            assert list(memoryview(e.encode([text])[0]).cast("I")) == library.encode_ordinary(text)


def test_merges_like_a_plain_scan():
    rnd = random.Random(5)
    ranks = {bytes([b]): b for b in range(4)}
    while len(ranks) < 60:
        made = bytes(rnd.randrange(4) for _ in range(rnd.randint(2, 5)))
        ranks.setdefault(made, len(ranks))
    r, many, wanted = rankbpe.Ranks(ranks), [], []
    for _ in range(500):
        piece = bytes(rnd.randrange(4) for _ in range(rnd.randint(0, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if piece in ranks:
            parts = [piece]
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[i] + parts[i + 1], 999), i) for i in range(len(parts) - 1))
            if rank == 999:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert list(r.merge(piece)) == [ranks[p] for p in parts]
        many.append(piece)
        wanted.append([ranks[p] for p in parts])
    some = [i for i, p in enumerate(many) if len(p) > 1 and p not in ranks]
    got = rankbpe.Forest(r).merge([many[i] for i in some])
    assert [list(memoryview(p).cast("I")) for p in got] == [wanted[i] for i in some]
    with pytest.raises(ValueError):
        r.merge(b"\x00\x09")


def test_texts_of_a_batch_share_pieces_and_a_small_memory(library, monkeypatch):
    monkeypatch.setattr(rankbpe, "KEPT", 20)
    rnd = random.Random(7)
    e = rankbpe.Encoder(PATH, PATTERN)
    texts = ["", "x" * 100, *("".join(rnd.choice(["qua", "zimp", " ", "lor", "é", "\n", "q" * 70]) for _ in range(rnd.randint(0, 60))) for _ in range(80))]
    for chunk in (rankbpe.CHUNK, 200, 8):
        assert [list(memoryview(p).cast("I")) if p else [] for p in e.encode(texts, chunk)] == [library.encode_ordinary(t) for t in texts]


def test_time_of_a_long_piece_is_near_linear():
    r = rankbpe.encoder(PATH, PATTERN).ranks

    def took(n):
        piece = bytes(97 + (i * i + i // 7) % 26 for i in range(n))
        began = time.process_time()
        r.merge(piece)
        return time.process_time() - began

    took(1000)
    assert took(160_000) < 40 * max(took(10_000), 0.02)


def test_query_cases(spark, library):
    rows = [(1, "The cat", 5, "x"), (1, "The cat", 5, "x"), (2, None, None, None), (3, "", 0, "y"), (None, "é" * 5000, 1, "z"), (4, "naïve <|endoftext|> ١", 2, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = sorted(map(tuple, rankbpe.digests(rankbpe.encode_decode(docs, PATH, PATTERN)).collect()), key=str)

    def want(key, text):
        ids = library.encode_ordinary(text or "")
        return key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert rankbpe.encode_decode(docs.limit(0), PATH, PATTERN).count() == 0
