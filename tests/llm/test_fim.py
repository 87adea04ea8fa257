import hashlib
import random
import re

import pytest

from cairn.llm import fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s+|\S+", "char": r"(?s:.)"}


def plain(key, text, unit="line", rate=100, spm=50, seed="7"):
    """The contract by regular expressions and lists of strings."""
    text = text or ""
    parts = re.findall(UNITS[unit], text)
    n = len(parts)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", UNITS)
def test_like_regular_expressions(unit):
    rnd = random.Random(3)
    parts = ["a", " ", "\n", "\n\n", "é", "\U0001f600", "<", "S>", "<P", "P>", "M", " ", "\x1c", "\r\n", "日本 ", "<M", ">", "\x00"]
    forms = set()
    for key in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
        draws = tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        got = fim.transform(text, draws, unit, 80, 30)
        assert tuple(got) == plain(key, text, unit, 80, 30)
        assert fim.restore(got.output, got.form) == text
        forms.add(got.form)
    assert forms == {"plain", "psm", "spm"}


def test_sentinels_that_could_be_confused_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad).checked()
    assert fim.Sentinels("<|p|>", "<|s|>", "<|m|>").checked()


def test_query_cases(spark):
    rows = [(1, "one\ntwo\nthree", 5, "x"), (1, "one\ntwo\nthree", 5, "x"), (2, None, None, None), (3, "", 0, "y"), (4, "has <M> inside\n", 0, "y"), (None, "né\n\n" * 50_000, 1, "z")]
    rows += [(k, "a\nb\nc\nd", 0, "") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    made = fim.fill_in_middle(docs)
    texts = {(r.doc_id, r.restored) for r in made.collect()}
    assert texts == {(r[0], r[1] or "") for r in rows}
    got = sorted(map(tuple, fim.digests(made).collect()), key=str)

    def want(key, text):
        *most, output = plain(key, text)
        return key, *most, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    named = fim.fill_in_middle(docs.selectExpr("cast(doc_id as string) AS name", "text AS body"), "name", "body", unit="word")
    assert named.columns[0] == "name" and named.count() == len(rows)
