"""Ranked lexical search with whole-number BM25 by Fagin's threshold algorithm.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. A document's score is the
sum over an item's distinct terms of w * ((10**9 * tf) div (1000 * tf + 8 * m)), where w is a whole weight that falls with
the term's document frequency and m a whole length norm; the quotient is the term's impact in the document.

1. Documents are read once: each gets its length and the frequencies of the terms that any item asks for, which are stored.
   That table is the forward index. N, L and document frequencies are counted from it, over all documents.
2. Tasks take the forward index in blocks of documents. In each, every term has a list of its documents sorted by falling
   impact, and a row of the forward index gives all impacts of one document. For an item its lists are read round-robin,
   `ROUND` places of each at a time; every document met is scored in full from the forward index. When the threshold, the
   weighted sum of the impacts last read, falls strictly below the k-th score that the task has found so far, no unread
   document can get in, nor tie, and the block is done. The k-th score goes from block to block, so later ones end sooner.
3. The tasks' k best of each item are merged, first within salts, so that an item's rows are not merged in one task.

Items are the query set: they go out in blocks of at most `block_terms` words, so that what is sent has a bound. Within
it, a task handles items in groups of at most `GROUP` distinct terms.

Defined cases: null and empty texts have no terms, don't count in N and are never found; an item without terms, or none
that a document holds, gets no rows, and neither does a score of 0; a long text is split in parts at term boundaries and
counted as one; equal scores are ranked by ascending doc_key, nulls last; repeated rows are documents (or items) of their
own, each ranked; other columns are not read; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import shared

K = 10
#: Documents of a block, and distinct terms of a group of items. An item with more terms makes blocks smaller, so that a
#: block's impacts take at most 4 * DOCS * GROUP bytes.
DOCS, GROUP = 4096, 4096
#: Places of each list that are read between two looks at the threshold.
ROUND = 16
#: Bytes of a text that are split at a time.
CHUNK = 1 << 20
SALTS = 32
#: A-Z to a-z, all other ASCII but letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, in parts of about CHUNK bytes."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        to = text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def item_blocks(items: DataFrame, block_terms: int, key: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(key, sorted distinct terms) of the items, in blocks of a bounded number of terms; an item is never split."""
    block, size = [], 0
    for r in items.select(F.col(key), F.col(text)).toLocalIterator():
        own = sorted(set().union(*terms((r[1] or "").encode())))
        if not own:
            continue
        if block and size + len(own) > block_terms:
            yield block
            block, size = [], 0
        block.append((r[0], own))
        size += len(own)
    if block:
        yield block


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n (terms with repeats) and, for the terms of the vocabulary that it holds, ids and tf of each row with a term."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                n, ids, tf, ends = [], [], [], [0]
                for t in part.column(1).cast(pa.large_binary()).to_pylist():
                    count, found = 0, Counter()
                    for words in terms(t or b""):
                        count += len(words)
                        found.update(map(vocabulary.get, words))
                    found.pop(None, None)
                    n.append(count)
                    ids += found.keys()
                    tf += found.values()
                    ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((ids, pa.int32()), (tf, pa.int64()))]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["doc", "n", "ids", "tf"])
                yield out.filter(pa.array([c > 0 for c in n], pa.bool_()))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, n long, ids array<int>, tf array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Block:
    """Impact-sorted lists and forward index of some documents, over the terms of a group of items."""

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.forward = np.zeros((n_docs, n_terms), np.int32)
        self.forward[doc, term] = impact
        self.read = 0

    def best(self, own: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best of an item, and their scores: all that a higher score than floor, or
        the same, puts there. floor is a score that k documents are known to reach, or 0."""
        lists = (self.first[own + 1] > self.first[own]) & (weights > 0)
        own, weights = own[lists], weights[lists]
        begin, end = self.first[own], self.first[own + 1]
        met = np.zeros(len(self.forward), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while len(own) and depth < (end - begin).max():
            place = begin[:, None] + np.arange(depth, depth + ROUND)
            found = self.doc[place[place < end[:, None]]]
            self.read += len(found)
            found = np.unique(found[~met[found]])
            met[found] = True
            score = self.forward[found[:, None], own].astype(np.int64) @ weights
            docs, scores = np.concatenate([docs, found]), np.concatenate([scores, score])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
            keep = scores >= max(floor, 1)
            docs, scores = docs[keep], scores[keep]
            depth += ROUND
            last = begin + depth - 1
            threshold = int(np.where(last < end, self.impact[np.minimum(last, end - 1)], 0) @ weights)
            if threshold < floor:
                break
        order = np.lexsort((docs, -scores))[:k]
        return docs[order], scores[order]


def _groups(wanted: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Items in groups, and each group's terms: at most GROUP, if no item has more by itself."""
    group, own = [], set()
    for i, ids in enumerate(wanted):
        more = own.union(ids.tolist())
        if group and len(more) > GROUP:
            yield group, np.array(sorted(own))
            group, more = [], set(ids.tolist())
        group, own = [*group, i], more
    if group:
        yield group, np.array(sorted(own))


def _search_block(forward: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, item_type: str) -> DataFrame:
    """(at, doc, score): each task's k best documents of every item, which is named by its place in wanted."""
    groups = [(group, own, [np.searchsorted(own, wanted[i]) for i in group]) for group, own in _groups(wanted)]
    step = max(1, min(DOCS, DOCS * GROUP // max(len(own) for _, own, _ in groups)))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        best: list[list[tuple]] = [[] for _ in wanted]
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for first in range(0, b.num_rows, step):
                part = pa.Table.from_batches([b.slice(first, step)])
                part = part.take(pc.sort_indices(part, sort_keys=[("doc", "ascending")], null_placement="at_end")).combine_chunks()
                keys, n = part.column("doc"), part.column("n").to_numpy()
                lists = part.column("ids").combine_chunks()
                doc = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy())
                term, tf = lists.flatten().to_numpy(), part.column("tf").combine_chunks().flatten().to_numpy()
                impact = impacts(tf, n[doc], n_docs, n_terms)
                for group, own, places in groups:
                    column = np.full(len(weights), -1)
                    column[own] = np.arange(len(own))
                    at = column[term]
                    inside = at >= 0
                    block = Block(len(n), len(own), doc[inside], at[inside], impact[inside])
                    for i, mine in zip(group, places, strict=True):
                        top = best[i]
                        docs, scores = block.best(mine, weights[wanted[i]], k, -top[-1][0] if len(top) == k else 0)
                        if len(docs):
                            ids = [keys[int(d)].as_py() for d in docs]
                            top += [(-int(s), d is None, d) for s, d in zip(scores, ids, strict=True)]
                            top.sort(key=lambda r: r if not r[1] else r[:2])
                            del top[k:]
        rows = [(i, d, -s) for i, top in enumerate(best) for s, _, d in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), kind, pa.int64()), strict=True)], ["at", "doc", "score"])

    return forward.mapInArrow(run, f"at int, doc {item_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = 500_000, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """item_key, rank (from 1), doc_key and score: each item's k documents of highest score above 0, or all, if fewer."""
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema[item_key].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString()
    out = None
    for block in item_blocks(items, block_terms, item_key, text):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
        forward = shared.stored(forward_index(docs, vocabulary, doc_key, text), "lexical-forward")
        n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in forward.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():
            df[r[0]] = r[1]
        weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df])
        wanted = [np.array([vocabulary[t] for t in own]) for _, own in block]
        found = _search_block(forward, wanted, weights, n_docs, n_terms, k, doc_kind)
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        for by in (["at", "salt"], ["at"]):
            found = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], f"at int, item {item_kind}")
        found = found.join(names, "at").select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_key), "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"{item_key} {item_kind}, rank int, {doc_key} {doc_kind}, score long") if out is None else out
