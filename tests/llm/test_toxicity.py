import math
import random
import zlib

import pyarrow.parquet as pq
import zstandard

from cairn.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).column(0).to_pylist()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert sorted(got) == sorted(docs)
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    pairs = [(got[i]["score"], y) for i, y in labels.items() if i in got and held(i)]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.85


def test_like_one_text_at_a_time_and_cases(spark):
    train = [(f"the calm river number {k} flows by hill and town", 0) for k in range(40)] + [(f"the calm river {k} zzgrunkle flows by town", 1) for k in range(40)]
    model = toxicity.fit(train)
    rows = [(1, "a zzgrunkle by the river"), (1, "a zzgrunkle by the river"), (2, "a calm hill by the river"), (3, None), (4, ""), (5, "x" * 200_000), (None, "town")]
    docs = spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, key string, score double")
    got = sorted(map(tuple, toxicity.score(docs, model).collect()), key=str)
    one = model.scorer()
    assert got == sorted(((i, one.score(t or "")) for i, t in rows), key=str)
    by = dict(got)
    assert by[1] >= toxicity.CUT > by[2] and by[3] == by[4]
    assert sorted(r["doc_id"] or 0 for r in toxicity.keep_clean(docs, model).collect()) == sorted(i or 0 for i, t in rows if one.score(t or "") < toxicity.CUT)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).collect()[0]["score"] == 0


def plain_score(model, text):
    """The model's score, window by window and without any memory."""
    b = toxicity.running(text)
    found = set()
    for k in range(len(b) - 1):
        word = b.rindex(b" ", 0, k + 1)
        end = b.index(b" ", word + 1)
        half = toxicity.WINDOW // 2
        if k == word or (end - word > toxicity.WINDOW and (k - word) % half == 0 and k <= end - half):
            found.add(b[k : k + toxicity.WINDOW])

    def size(content, w):
        known = zstandard.ZstdCompressionDict(content + toxicity.PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(toxicity.PAD + w))

    gains = [max(0, size(model.ordinary, w) - size(model.toxic, w)) for w in found]
    x = [1.0, *(math.log1p(sum(g >= least for g in gains)) for least in toxicity.GAINS), max(gains, default=0), math.log1p(len(found))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True))))


def test_scores_like_brute_force():
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"]]
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    model = toxicity.fit([(r["text"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels])
    s = model.scorer()
    texts = [r["text"][:1500] for r in rows[:25]] + ["", " ", "x" * 3000, "a" * 10, "idiot", "(Idiot!) " * 40, "\ud800 zz"]
    for t in texts:
        assert abs(s.score(t) - plain_score(model, t)) < 1e-9


def test_the_dictionaries_are_separate():
    ordinary, toxic = toxicity.dictionaries([f"the calm river number {k * 7919} flows by hill and town" for k in range(60)], [f"the calm river {k * 104729} zzgrunkle flows by town" for k in range(60)])
    assert b" zzgrunkl" in toxic and b"zzgrunkl" not in ordinary and ordinary not in toxic and b"the calm river" in ordinary


def test_windows_cover_every_byte():
    for n in range(70):
        b = toxicity.running("ab " + "c" * n + " de")
        covered = set()
        for w in toxicity.windows("ab " + "c" * n + " de"):
            k = b.find(w)
            while k >= 0:
                covered.update(range(k, k + len(w)))
                k = b.find(w, k + 1)
        assert covered == set(range(len(b)))
    assert toxicity.windows("") == toxicity.windows(" ,;") == {}


def test_gains_are_remembered_and_like_single_calls(monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    texts = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(500)] + ["ha " * 30, "x" * 400, "abab" * 9, "", "zq"]
    ordinary, toxic = (" ".join(rnd.choice(words) for _ in range(n)).encode() for n in (3000, 150))
    s = toxicity.Scorer(toxicity.Model(ordinary, toxic, (0.1,) * (len(toxicity.GAINS) + 3)))
    asked = []
    foul, plain = s.coder.foul, s.coder.plain
    s.coder.foul = lambda w: asked.append(w) or foul(w)
    first = [s.score(t) for t in texts]
    found = {w for t in texts for w in toxicity.windows(t)}
    assert len(found) > 70_000 and len(set(asked)) < len(found)  # some have nothing in common with the toxic dictionary
    asked.clear()
    assert [s.score(t) for t in texts] == first and len(asked) < len(found) // 10

    def alone(w):
        return max(0, len(plain(toxicity.PAD + w)) - len(foul(toxicity.PAD + w)))

    for many, coder in ((toxicity.MANY, toxicity.Coder(ordinary, toxic)), (9, toxicity.Coder(ordinary, toxic)), (9, toxicity.Coder(ordinary, toxic, 64))):
        monkeypatch.setattr(toxicity, "MANY", many)
        for t in texts[-25:] + texts[-25:]:
            w = toxicity.windows(t)
            assert coder.gains(w).tolist() == [alone(x) for x in w]
            assert coder.gains(dict.fromkeys(reversed(w))).tolist() == [alone(x) for x in reversed(w)]
