"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when at least `threshold` of its distinct five-word shingles (fewer words: its
whole word sequence) occur there. Items are partitioned by their number of shingles n. The partition's sketch keeps the
k minimum hashes of an item, k = n_max - ceil(threshold * n_max) + 1 for the partition's largest n: a contained item
misses at most n - ceil(threshold * n) shingles, so at least one of its k minima is in the document, however long that
is, and no contained item is missed. Documents that hold a minimum are verified with exact shingle containment.

Documents are read once, without a shuffle. Items are the query set: they go to the executors in blocks whose shingles
are at most `block_shingles` (8 bytes each), so what is sent has a fixed bound and more items mean more blocks.

Defined cases: null and empty texts and items have no shingles and match nothing; a long text is hashed in blocks and
compared as one; items with equal shingles match alike; an item or document without an id keeps its null in the result; repeated rows repeat in the result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec

WIDTH = 5
THRESHOLD = 0.8


class Sketches:
    """The minima and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, width: int = WIDTH):
        self.items = []
        texts = textvec.Texts([(t or "").encode() for _, t in items])
        minima: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, (key, _) in enumerate(items):
            h = texts.hashes[texts.first[at] : texts.first[at + 1]]
            w = min(width, len(h))
            if not w:
                continue
            whole = np.unique(textvec.grams(h, w))
            top = 1 << (len(whole) - 1).bit_length()  # the partition of sizes up to this power of two
            k = top - math.ceil(threshold * top) + 1
            minima.setdefault(w, []).append((np.sort(textvec.mix(whole))[:k], len(self.items)))
            self.items.append((key, w, whole, math.ceil(threshold * len(whole) - 1e-9)))
        self.by_width = {}
        for w, found in minima.items():
            values = np.concatenate([v for v, _ in found])
            owner = np.repeat([o for _, o in found], [len(v) for v, _ in found])
            order = np.argsort(values, kind="stable")
            self.by_width[w] = values[order], owner[order]

    def matches(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items contained in a document of these word hashes: key, shingles, those found."""
        for w, (values, owner) in self.by_width.items():
            grams = textvec.grams(h, w)
            if not len(grams):
                continue
            mixed = textvec.mix(grams)
            at = np.searchsorted(values, mixed)
            hit = values[np.minimum(at, len(values) - 1)] == mixed
            if not hit.any():
                continue
            low, high = np.searchsorted(values, np.unique(mixed[hit]), "left"), np.searchsorted(values, np.unique(mixed[hit]), "right")
            wanted = {int(o) for a, b in zip(low, high, strict=True) for o in owner[a:b]}
            own = np.unique(grams)
            for o in sorted(wanted):
                key, _, whole, least = self.items[o]
                n = int(np.isin(whole, own, assume_unique=True).sum())
                if n >= least:
                    yield key, len(whole), n


def blocks(items: DataFrame, block_shingles: int, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded number of words; an item is never split."""
    block, size = [], 0
    for r in items.select(F.col(key), F.col(text)).toLocalIterator():
        n = len((r[1] or "").split())
        if block and size + n > block_shingles:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_shingles: int = 1_000_000, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """A row (doc_key, item_key, n_shingles, n_found, containment) for each item contained in a document."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_key].dataType)
    kinds = f"doc {docs.schema[doc_key].dataType.simpleString()}, item {items.schema[item_key].dataType.simpleString()}, n_shingles long, n_found long"
    out = None
    for block in blocks(items, block_shingles, item_key, text):
        sketches = Sketches(block, threshold, width)

        def run(batches, sketches=sketches):
            import pyarrow as pa

            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    part = b.slice(k, 1024)
                    texts = textvec.Texts(textvec.as_bytes(part.column(1)))
                    keys = part.column(0).to_pylist()
                    rows = [(keys[i], *m) for i in range(part.num_rows) for m in sketches.matches(texts.hashes[texts.first[i] : texts.first[i + 1]])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (part.schema.field(0).type, item_type, pa.int64(), pa.int64()), strict=True)], ["doc", "item", "n_shingles", "n_found"])

        found = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], kinds)
    return out.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_shingles: int = 1_000_000, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    place = [c.lower() for c in docs.columns].index(text.lower())
    for block in blocks(items, block_shingles, "item_id", text):
        sketches = Sketches(block, threshold, width)

        def run(batches, sketches=sketches):
            import pyarrow as pa

            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    part = b.slice(k, 1024)
                    texts = textvec.Texts(textvec.as_bytes(part.column(place)))
                    yield part.filter(pa.array([next(sketches.matches(texts.hashes[texts.first[i] : texts.first[i + 1]]), None) is None for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
