import hashlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cairn.llm import queries, toxicity

from .test_decontaminate import brute as contaminated
from .test_lines import brute as without_boilerplate
from .test_neardup import brute as classes

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_like_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns, got, stages = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, SF).cache()
        assert stages.columns == columns, name
        got.append(rows(stages))
    source = {r["doc_id"]: (r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    one = toxicity.train(docs, queries.table(spark, SF, "labels")).scorer()
    want = {i: t for i, (t, _) in source.items() if one.score(t or "") < toxicity.CUT}
    assert got[0] == want
    want = {r[0]: r[1] for r in without_boilerplate([(i, t, source[i][1]) for i, t in want.items()], 10)}
    assert got[1] == want
    keep = {r[0] for r in classes(list(want.items()), 80, 2) if r[3] or r[2] is None}
    want = {i: t for i, t in want.items() if i in keep}
    assert got[2] == want
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bad = {r[0] for r in contaminated(list(want.items()), items)}
    want = {i: t for i, t in want.items() if i not in bad}
    assert got[3] == want and bad and all(r["n_chars"] == len(r["text"]) for r in stages.select("n_chars", "text").collect())
    library = Tokenizer.from_file(queries.bpe_path())
    last = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, stages, SF).collect()}
    codes = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in want.items()}
    assert last == {i: (len(codes[i]), b"".join(x.to_bytes(4, "little") for x in codes[i]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want.items()}
    # the registered query is the whole of it
    whole = __spark_entry__.queries()["pipeline"](spark, SF)
    assert {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in whole.collect()} == last


def test_stages_take_odd_rows(spark, tmp_path):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "text", "en", "s", 4), (2, "", "en", None, 0), (3, "a b c\n" * 3000, "de", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", 9) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, node string, score int")
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
        assert out.count() == (4 if frame is docs else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == out.count()
