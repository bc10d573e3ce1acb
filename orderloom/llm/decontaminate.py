"""Benchmark decontamination: latent semantic retrieval of benchmark items in documents, then alignment and answer checks.

Documents and items are cut into overlapping passages of words; terms are the neighbouring word pairs of the items.
Spark counts, over every passage of every document, the terms and which terms stand together, weighted by TF-IDF; a
randomised SVD of that passage-term matrix is run on its Gram matrix, which stays distributed by rows, with random
probes going out and projected rows coming back. Passages and items are compared by the cosine of their latent
vectors; what is near enough is aligned word by word by the longest common subsequence, and items whose words were
partly replaced must also hold the answer.

The benchmark is searched in blocks of items, by their number and that of their passages, which bound vocabulary, probes and latent vectors; documents and passages
are not bounded. Edge cases: null and empty texts and items have no passages; an item of fewer than `least` words is
not searched; very long texts are read whole; a document that holds an item several times gives one row for it; repeated
rows of a document count as one; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, release_memory, sift, texts

WINDOW = 32
STRIDE = 16
LEAST = 6
BLOCK_ITEMS = 250
#: Latent dimensions: as many as the block has passages and so many more. A block ends before they pass the limit; one item
#: that is longer by itself is a block with as many as it needs.
SPARE_RANK, RANK_LIMIT = 32, 640
COSINE = 0.45
#: Share of an item's words in the common subsequence that is a leak by itself, or together with its answer if it has one.
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8

BLANK = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(BLANK).split()


class Terms:
    """Word pairs of a block of items, found in a text by whole-array steps."""

    def __init__(self, items: list[list[bytes]]):
        self.words = {w: i for i, w in enumerate(sorted({w for item in items for w in item}))}
        codes = [self.codes(item) for item in items]
        self.pairs = np.unique(np.concatenate([c[:-1] * len(self.words) + c[1:] for c in codes]))

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the pairs that the items have."""
        code = np.fromiter(map(self.words.get, words, (-1,) * len(words)), np.int64, len(words))
        at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
        key = code[at] * len(self.words) + code[at + 1]
        term = np.searchsorted(self.pairs, key)
        term[term == len(self.pairs)] = 0
        hit = self.pairs[term] == key
        return at[hit].astype(np.int32), term[hit].astype(np.int32)


def passages(row: np.ndarray, places: np.ndarray, terms: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of many texts' terms, each passage's terms once, and the first passage of each text.

    row: the text of each place. Passages are numbered through all texts, in order.
    """
    last = np.maximum(-(-(n_words - WINDOW) // STRIDE), 0)
    base = np.concatenate(([0], np.cumsum(last + 1)))
    low = np.maximum(-(-(places + 2 - WINDOW) // STRIDE), 0)
    high = np.minimum(places // STRIDE, last[row])
    many = np.maximum(high - low + 1, 0)
    passage = np.repeat(base[row] + low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key, count = np.unique(passage * (1 << 31) + np.repeat(terms, many), return_counts=True)
    return key >> 31, key & ((1 << 31) - 1), count, base


def _hits(docs: DataFrame, terms: Terms) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                at, term = sent.value.find(words)
                out.append((doc_id, len(words), at.tobytes(), term.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "at", "term"])

    return texts(docs).where("doc_id IS NOT NULL").mapInPandas(run, "doc_id bigint, n_words bigint, at binary, term binary")


def _passages_of(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = [np.frombuffer(a, np.int32) for a in batch["at"]]
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    terms = np.concatenate([np.frombuffer(t, np.int32) for t in batch["term"]])
    return passages(row, np.concatenate(at).astype(np.int64), terms, batch["n_words"].to_numpy())


def _document_frequencies(hits: DataFrame, n_terms: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_passages_of(batch)[1], minlength=n_terms)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"term": seen, "n": total[seen]})

    rows = hits.where("length(at) > 0").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(n_terms)
    for r in rows:
        df[r["term"]] = r["n"]
    return df


def _weighted(term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)) * idf[term]


def _gram(hits: DataFrame, idf: np.ndarray, unseen: float) -> DataFrame:
    """(i, row): row i of the terms' Gram matrix over all passages, as (j, w) pairs.

    Passages have unit length, their pairs that no item has included; unseen is the weight of such a pair.
    """
    sent = hits.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = len(sent.value)

        def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(values), len(key))

        keys, values, held = [], [], 0
        for batch in batches:
            if len(batch):
                passage, term, count, _ = _passages_of(batch)
                weight = _weighted(term, count, sent.value)
                edges = np.append(np.flatnonzero(np.diff(passage, prepend=-1)), len(passage))
                sizes = np.diff(edges)
                others = np.maximum(WINDOW - 1 - np.add.reduceat(count, edges[:-1]), 0) * unseen ** 2
                weight = weight / np.sqrt(np.repeat(np.add.reduceat(weight ** 2, edges[:-1]) + others, sizes))
                many = np.repeat(sizes, sizes)  # every term of a passage meets all of its terms
                left = np.repeat(np.arange(len(term)), many)
                right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.repeat(edges[:-1], sizes), many)
                keys.append(term[left] * v + term[right])
                values.append(weight[left] * weight[right])
                held += len(left)
                if held > 1_000_000:
                    key, value = summed(keys, values)
                    keys, values, held = [key], [value], 0 if len(key) < 1_000_000 else held
                    if len(key) >= 1_000_000:
                        yield pd.DataFrame({"i": key // v, "j": key % v, "w": value})
                        keys, values, held = [], [], 0
        if keys:
            key, value = summed(keys, values)
            yield pd.DataFrame({"i": key // v, "j": key % v, "w": value})

    cells = hits.where("length(at) > 0").mapInPandas(run, "i bigint, j bigint, w double").groupBy("i", "j").agg(F.sum("w").alias("w"))
    return cut_lineage(cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("row")), "terms-gram")


def _times(gram: DataFrame, right: np.ndarray) -> np.ndarray:
    """The Gram matrix times a dense one: rows are multiplied where they are, products come back (terms x rank numbers)."""
    sent = gram.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch["row"]:
                j = np.array([c["j"] for c in row])
                out.append((np.array([c["w"] for c in row]) @ sent.value[j]).astype("<f4").tobytes())
            yield pd.DataFrame({"i": batch["i"], "y": out})

    product = np.zeros(right.shape, np.float32)
    # each partition that comes back is a job of the driver, so there are no more of them than cores, however many files the rows lie in
    for r in gram.coalesce(gram.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "i bigint, y binary").toLocalIterator():
        product[r["i"]] = np.frombuffer(r["y"], "<f4")
    sent.unpersist()
    return product


def orthonormal(columns: np.ndarray, some: int = 64) -> np.ndarray:
    """The columns made orthonormal in place, some at a time and each time twice, so that only those are held in double precision."""
    for at in range(0, columns.shape[1], some):
        done, block = columns[:, :at], columns[:, at:at + some]
        for _ in range(2):
            block -= done @ (done.T @ block)
            block[:] = np.linalg.qr(block)[0]
    return columns


def latent_basis(gram: DataFrame, own: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Orthonormal (terms x rank) right singular vectors of the passages, by a randomised range finder on their Gram matrix.

    own: the items' passages. They join the corpus's as rows, with a weight above that of any direction of the corpus, so
    that the items' span is kept whole, however rare they are; what rank is left goes to the corpus's main directions.
    """
    terms = own.shape[1]
    rank = min(rank, terms)
    heaviest = gram.agg(F.max(F.aggregate("row", F.lit(0.0), lambda a, c: a + c["w"]))).first()[0] or 0.0  # bounds all eigenvalues
    weight = np.float32(100 * (1 + heaviest))

    def applied(right: np.ndarray) -> np.ndarray:
        product = _times(gram, right)
        inner = weight * (own @ right)
        for at in range(0, terms, 1024):
            product[at:at + 1024] += own[:, at:at + 1024].T @ inner
        return product

    probe = np.random.default_rng(seed).standard_normal((terms, rank), np.float32)
    for _ in range(2):
        probe = orthonormal(applied(probe))
    small = probe.T @ applied(probe)
    value, vector = np.linalg.eigh((small + small.T).astype(float) / 2)
    return probe @ vector[:, value > 1e-6 * max(value.max(), 1e-30)].astype(np.float32)


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        x = row | where.get(w, 0)
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def aligned(item: list[bytes], answer: list[bytes], words: list[bytes], passage: int) -> tuple[float, int]:
    """Best share of the item in the text near a passage, and the place; 0 if it isn't a leak.

    Stretches as long as the item, a quarter of it longer, are tried at steps of an eighth of it. Where the share alone is
    not sure and the item has an answer, the answer has to stand in the stretch or soon after it.
    """
    m = len(item)
    first, last = max(0, passage * STRIDE - m), min(len(words), passage * STRIDE + WINDOW + m)
    long, step = m + m // 4, max(1, m // 8)
    best, at = 0.0, first
    for start in range(first, max(first, last - m) + 1, step):
        share = common_subsequence(item, words[start:start + long]) / m
        if share > best and share >= LIKELY and (share >= SURE or not answer or common_subsequence(
                answer, words[start:start + long + step + 2 * len(answer)]) >= ANSWER * len(answer)):
            best, at = share, start
    return best, at


def _search(docs: DataFrame, block: list[tuple[int, list[bytes], list[bytes]]], cosine: float) -> DataFrame:
    spark = docs.sparkSession
    terms = Terms([item for _, item, _ in block])
    n_terms = len(terms.pairs)
    hits = cut_lineage(_hits(docs, terms), "leak-hits")
    n = hits.agg(F.sum(F.greatest(F.lit(1), F.ceil((F.col("n_words") - WINDOW) / STRIDE) + 1))).first()[0] or 0
    df = _document_frequencies(hits, n_terms)
    idf = np.log((n + 1) / (df + 1)) + 1

    owner, rows, lengths = [], [], []
    for k, (_, item, _) in enumerate(block):
        at, term = terms.find(item)
        passage, term, count, _ = passages(np.zeros(len(at), int), at.astype(np.int64), term, np.array([len(item)]))
        for p in np.unique(passage):
            row = np.zeros(n_terms, np.float32)
            row[term[passage == p]] = _weighted(term[passage == p], count[passage == p], idf)
            owner.append(k)
            lengths.append(np.linalg.norm(row))
            rows.append(row / lengths[-1])
    own = np.array(rows)
    basis = latent_basis(_gram(hits, idf, np.log((n + 1) / 2) + 1), own, len(rows) + SPARE_RANK)
    release_memory()
    latent = own @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    most = (own ** 2).max(0)  # a passage's cosine with any item is at most the root of this over its terms
    sent = spark.sparkContext.broadcast((basis, idf, latent, np.array(owner), most, np.array(lengths, np.float32)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, idf, latent, owner, most, lengths = sent.value
        for batch in batches:
            if not len(batch):
                continue
            passage, term, count, base = _passages_of(batch)
            edges = np.flatnonzero(np.diff(passage, prepend=-1))
            sizes = np.diff(np.append(edges, len(passage)))
            able = np.add.reduceat(most[term], edges) >= (cosine - 1e-6) ** 2
            kept = np.repeat(able, sizes)
            passage, term, count, sizes = passage[kept], term[kept], count[kept], sizes[able]
            edges = np.cumsum(sizes) - sizes
            weight = _weighted(term, count, idf).astype(np.float32)
            out = []
            for at in range(0, len(edges), 2048):
                some, size = edges[at:at + 2048], sizes[at:at + 2048]
                a, b = some[0], some[-1] + size[-1]
                vectors = np.add.reduceat(basis[term[a:b]] * weight[a:b, None], some - a, axis=0)
                norm = np.sqrt(np.add.reduceat(weight[a:b] ** 2, some - a))
                alike = (vectors / norm[:, None]) @ latent.T
                # What other items put into the passage counts no more than the item's own terms, as in lists of short items.
                p, q = np.nonzero(alike * np.maximum(norm[:, None] / lengths, 1) >= cosine)
                number = passage[some[p]]
                row = np.searchsorted(base, number, "right") - 1
                out.append(pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[row], "item": owner[q], "passage": number - base[row], "cosine": alike[p, q].astype(float)}))
            if out:
                yield pd.concat(out)

    found = cut_lineage(hits.where("length(at) > 0").mapInPandas(near, "doc_id bigint, item int, passage bigint, cosine double")
                        .groupBy("doc_id", "item", "passage").agg(F.max("cosine").alias("cosine")), "leak-candidates")
    wanted = cut_lineage(found.groupBy("doc_id").agg(F.collect_list(F.struct("item", "passage", "cosine")).alias("tries")), "leak-tries")
    items = spark.sparkContext.broadcast(block)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, tries in zip(batch["doc_id"], batch["text"], batch["tries"]):
                words = words_of(text)
                for t in tries:
                    item_id, item, answer = items.value[t["item"]]
                    share, at = aligned(item, answer, words, t["passage"])
                    if share:
                        out.append((doc_id, item_id, share, t["cosine"], at))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "cosine", "word"])

    checked = sift(texts(docs), wanted, "doc_id").join(wanted, "doc_id").mapInPandas(check, "doc_id bigint, item_id bigint, share double, cosine double, word bigint")
    return checked.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"), F.max_by("word", F.struct("share", -F.col("word"))).alias("word"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block_items: int = BLOCK_ITEMS, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, share (of the item's words that align), cosine, word (where it begins) of every leak.

    benchmark: item_id, text and, if it has one, answer; items without an answer are judged by their alignment alone.
    """
    answer = F.coalesce(F.col("answer").cast("string"), F.lit("")) if "answer" in benchmark.columns else F.lit("")
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"), answer.alias("answer"))
    found = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, share double, cosine double, word bigint")
    block: list[tuple[int, list[bytes], list[bytes]]] = []

    def searched() -> DataFrame:
        return found.unionByName(_search(docs, block, cosine))

    held = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        item = words_of(r["text"])
        if len(item) < least:
            continue
        many = max(-(-(len(item) - WINDOW) // STRIDE), 0) + 1
        if block and held + many > RANK_LIMIT - SPARE_RANK:
            found, block, held = searched(), [], 0
        held += many
        block.append((r["item_id"], item, words_of(r["answer"])))
        if len(block) == block_items:
            found, block, held = searched(), [], 0
    if block:
        found = searched()
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"), F.min("word").alias("word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Whole rows of documents in which no benchmark item was found."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
