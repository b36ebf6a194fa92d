"""Benchmark decontamination by latent semantic retrieval.

Texts are compared by passages of words with TF-IDF weights; document
frequencies are counted over the whole corpus.  A randomised SVD of the
benchmark's passages, whose passes over them are distributed, gives a latent
space; corpus passages are folded into it and compared with every benchmark
passage by cosine (a stated query set against all rows, in blocks).  A
candidate counts only if its words run through the passage in order: the
longest common subsequence with the item must cover ``least_overlap`` of it, and
that with its answer (its last sentence) ``least_answer``.  A part of the item,
one of its passages or the question before the answer, that stands there by
``NEAR_EXACT`` counts without the rest of the item.

The space is fitted to the benchmark's side because the cosine needs it there:
directions of the corpus alone tell languages apart, not passages.  A space has
no more passages than its rank, so that it keeps their cosines whole, and a block
of items has as many spaces as its passages need.  Benchmarks
larger than ``block_words`` are searched in blocks, a pass over the corpus each,
so what tasks hold doesn't grow with the benchmark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
BINS = 1 << BITS
#: Words of half a passage: corpus passages are two neighbouring halves.
HALF = 16
#: Share of a part of an item that makes a near-exact copy, least words of such a part, and of an answer.
NEAR_EXACT, LEAST_PART, LEAST_ANSWER = 0.9, 12, 5
_TABLE = bytes(32 if c in b".,;:!?\"()[]{}|*#$%&<>=_~`^/\\" else c for c in range(256))
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def bins_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BINS - 1)


def _frequencies(batches):
    counts, n = np.zeros(BINS, np.int64), 0
    for b in common.slices(batches):
        for text in b["text"].to_pylist():
            counts[np.unique(bins_of(words_of(text)))] += 1
            n += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], names=["bin", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each of the fixed number of bins, over all rows of ``docs (text)``."""
    sums = common.map_arrow(docs.select("text"), _frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # as many rows as bins at most
    counts, total = np.zeros(BINS), int(got.loc[got["bin"] < 0, "n"].sum())
    own = got[got["bin"] >= 0]
    counts[own["bin"].to_numpy()] = own["n"].to_numpy()
    return np.log((total + 1) / (counts + 1)).astype(np.float32) + np.float32(1e-3)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]
    question: list[bytes]  # the words before the last sentence


def item_of(item_id: int, text: str) -> Item:
    """An item's words, and those of its answer: the last sentence, or the last quarter if there is one sentence only; ``LEAST_ANSWER`` words at least."""
    words = words_of(text)
    sentences = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    size = len(sentences[-1]) if len(sentences) > 1 else len(words) // 4
    return Item(item_id, words, words[-max(size, LEAST_ANSWER):], words[:-len(sentences[-1])] if len(sentences) > 1 else [])


def item_passages(words: list[bytes]) -> list[list[bytes]]:
    """The item if it is as long as a corpus passage at most, else passages of that length, each half a passage on."""
    n = len(words)
    if n <= 2 * HALF:
        return [words]
    return [words[s:s + 2 * HALF] for s in [*range(0, n - 2 * HALF, HALF), n - 2 * HALF]]


def item_parts(item: Item) -> list[list[bytes]]:
    """What the latent space holds of an item: its passages, and the question if it is shorter than one."""
    return item_passages(item.words) + ([item.question] if LEAST_PART <= len(item.question) < 2 * HALF else [])


def common_length(item: list[bytes], masks: dict[bytes, int], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by one machine-independent bit vector; ``masks`` has the places of the item's words."""
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


# --- randomised SVD of the passages -----------------------------------------------------------

def _weights(words: list[bytes], rows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary rows and TF-IDF weights of a passage, of length 1."""
    bins, counts = np.unique(bins_of(words), return_counts=True)
    w = counts * idf[bins]
    return rows[bins], w / (np.linalg.norm(w) or 1)


def _partial(kind: str, basis_of, rows: np.ndarray, idf: np.ndarray):
    """Per task, the sum over its passages x of ``x (x . basis)`` (kind "range") or of the outer products of ``x . basis``."""
    def run(batches):
        basis, total = basis_of(), None
        for b in batches:
            for text in b["passage"].to_pylist():
                at, w = _weights(text.encode("utf-8", "surrogatepass").split(), rows, idf)
                y = w @ basis[at]
                if total is None:
                    total = np.zeros_like(basis) if kind == "range" else np.zeros((len(y), len(y)))
                if kind == "range":
                    total[at] += w[:, None] * y
                else:
                    total += np.outer(y, y)
        if total is not None:
            for s in range(0, len(total), 256):
                yield common.batch({"part": [s], "sums": [total[s:s + 256].ravel()]}, {"part": pa.int32(), "sums": pa.list_(pa.float64())})
    return run


def _sum(part: pa.Table) -> pa.Table:
    sums = np.sum([x.values.to_numpy() for chunk in part["sums"].chunks for x in chunk], axis=0)
    return pa.table({"part": pa.array([part["part"][0].as_py()], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})


def _gathered(passages: DataFrame, kind: str, basis_of, rows: np.ndarray, idf: np.ndarray, width: int) -> np.ndarray:
    """The tasks' sums, added up part by part on the executors; the block of passages bounds their size."""
    partial = common.map_arrow(passages, _partial(kind, basis_of, rows, idf), "part int, sums array<double>")
    got = sorted((r["part"], r["sums"]) for r in partial.groupBy("part").applyInArrow(_sum, "part int, sums array<double>").collect())
    return np.concatenate([np.array(s) for _, s in got]).reshape(-1, width)


def latent_space(passages: DataFrame, rows: np.ndarray, n_rows: int, idf: np.ndarray, rank: int, over: int = 16,
                 power: int = 2, seed: int = 0) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of ``passages (passage)``: ``(vocabulary, rank)``.

    Randomised range finder with ``power`` further passes, then the singular
    vectors from the Gram matrix in the found range.
    """
    width = min(rank + over, n_rows)

    def noise() -> np.ndarray:  # every task draws the same
        return np.random.default_rng(seed).standard_normal((n_rows, width))
    basis_of = noise
    for _ in range(1 + power):
        q, _ = np.linalg.qr(_gathered(passages, "range", basis_of, rows, idf, width))
        basis_of = lambda q=q: q
    values, vectors = np.linalg.eigh(_gathered(passages, "gram", basis_of, rows, idf, width))
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    return q @ vectors[:, keep]


# --- search ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Space:
    """A latent space of so many passages that its rank covers all of them."""

    bins: np.ndarray  # the sorted bins of its words
    space: np.ndarray  # latent vectors of words, times their weights, and a row of 0
    passages: np.ndarray  # latent vectors of the passages
    items: np.ndarray  # the item of each passage


@dataclass(frozen=True)
class Block:
    """A block of items, and what the tasks need to search for them."""

    items: list[Item]
    spaces: list[Space]
    idf: np.ndarray


def item_blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """The items with words, in blocks of about ``block_words`` words; they come to the driver one after another."""
    block, size = [], 0
    for r in benchmark.select(benchmark[id_col].cast("long").alias("item_id"),
                              F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text")).toLocalIterator():
        item = item_of(r["item_id"], r["text"])
        if not item.words:
            continue
        block.append(item)
        size += len(item.words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def prepared(spark, items: list[Item], idf: np.ndarray, rank: int) -> Block:
    """The block of ``items``, with a space for each ``rank`` passages: with more, the cosine of a verbatim copy would shrink."""
    flat = [(no, p) for no, item in enumerate(items) for p in item_parts(item)]
    return Block(items, [_space(spark, flat[at:at + rank], idf) for at in range(0, len(flat), rank)], idf)


def _space(spark, flat: list[tuple[int, list[bytes]]], idf: np.ndarray) -> Space:
    vocabulary = np.unique(np.concatenate([bins_of(p) for _, p in flat]))
    rows = np.full(BINS, -1, np.int32)
    rows[vocabulary] = np.arange(len(vocabulary))
    passages = spark.createDataFrame([(b" ".join(p).decode("utf-8", "surrogatepass"),) for _, p in flat], "passage string")
    space = latent_space(passages, rows, len(vocabulary), idf, min(len(flat), len(vocabulary)))
    vectors = np.array([w @ space[at] for at, w in (_weights(p, rows, idf) for _, p in flat)])
    weighted = np.vstack([space * idf[vocabulary, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
    return Space(vocabulary, weighted, vectors.astype(np.float32), np.array([no for no, _ in flat]))


def _candidates(block: Block, bins: list[np.ndarray], least_cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """``(text, half, item, cosine)`` of corpus passages near one of an item's; a passage starts with its half of ``HALF`` words."""
    sizes = np.array([len(b) for b in bins])
    halves = -(-sizes // HALF)
    first_half = np.cumsum(halves) - halves
    n = int(halves.sum())
    if not n:
        return
    every = np.concatenate(bins)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of a word in its text
    own = np.repeat(first_half, sizes) + place // HALF
    mass = np.bincount(own, block.idf[every].astype(np.float64) ** 2, n)
    text_of = np.repeat(np.arange(len(bins)), halves)
    joined = np.flatnonzero(np.append(text_of[1:] == text_of[:-1], False))  # halves with one after them
    mass[joined] += mass[joined + 1]
    found: dict[tuple[int, int], float] = {}  # an item's passages can be in several spaces
    for space in block.spaces:
        rows = np.full(BINS, -1, np.int32)
        rows[space.bins] = np.arange(len(space.bins))
        at = np.full((n, HALF), -1, np.int32)
        at[own, place % HALF] = rows[every]
        vectors = space.space[at[:, 0]]
        for j in range(1, HALF):  # the last row of the space, all 0, stands for words that no item has
            vectors += space.space[at[:, j]]
        vectors[joined] += vectors[joined + 1]
        cosine = vectors @ space.passages.T / np.sqrt(mass)[:, None].astype(np.float32)
        near = np.flatnonzero(cosine.max(axis=1) >= least_cosine)
        firsts = np.flatnonzero(np.append(True, space.items[1:] != space.items[:-1]))
        best = np.maximum.reduceat(cosine[near], firsts, axis=1)
        for i, item in zip(*np.nonzero(best >= least_cosine), strict=True):
            key = int(near[i]), int(space.items[firsts[item]])
            found[key] = max(found.get(key, 0.0), float(best[i, item]))
    for (half, item), cosine in sorted(found.items()):
        text = int(text_of[half])
        yield text, half - int(first_half[text]), item, min(1.0, cosine)


def found_in(block: Block, texts: list[str], least_cosine: float, least_overlap: float, least_answer: float) -> Iterator[tuple[int, int, float, float, float]]:
    """``(text, item, cosine, overlap, answer overlap)`` of the items in each text, each once."""
    words = [words_of(t) for t in texts]
    bins = [bins_of(w) for w in words]
    places: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for text, half, item, cosine in _candidates(block, bins, least_cosine):
        places.setdefault((text, item), []).append((half, cosine))
    cache: dict[int, tuple[dict, dict, set, list]] = {}
    for (text, no), spots in places.items():
        item = block.items[no]
        if no not in cache:
            cache[no] = (masks_of(item.words), masks_of(item.answer), set(item.words),
                         [(p, masks_of(p), set(p)) for p in item_parts(item) if len(p) >= LEAST_PART])
        masks, answer_masks, distinct, parts = cache[no]
        best = None
        end = -1
        for half, cosine in sorted(spots):
            if half * HALF < end:  # inside the stretch that was compared before
                continue
            begin, end = max(0, half * HALF - len(item.words)), (half + 2) * HALF + len(item.words)
            stretch = words[text][begin:end]
            end -= len(item.words)
            if len(distinct.intersection(stretch)) < least_overlap * len(distinct):
                continue
            overlap = common_length(item.words, masks, stretch) / len(item.words)
            answer = common_length(item.answer, answer_masks, stretch) / len(item.answer)
            if overlap >= least_overlap and answer >= least_answer and (best is None or (overlap, answer) > best[:2]):
                best = overlap, answer
        if not best:
            for half, _ in sorted(spots):
                near = words[text][max(0, (half - 2) * HALF):(half + 4) * HALF]
                held = set(near)
                if any(len(d - held) <= (1 - NEAR_EXACT) * len(p) and common_length(p, m, near) >= NEAR_EXACT * len(p) for p, m, d in parts):
                    stretch = words[text][max(0, half * HALF - len(item.words)):(half + 2) * HALF + len(item.words)]
                    best = common_length(item.words, masks, stretch) / len(item.words), common_length(item.answer, answer_masks, stretch) / len(item.answer)
                    break
        if best:
            yield text, no, max(c for _, c in spots), *best


def _report(block: Block, limits: tuple[float, float, float]):
    def run(batches):
        for b in common.slices(batches, 64):
            ids, out = b["doc_id"].to_pylist(), []
            for text, no, *scores in found_in(block, b["text"].to_pylist(), *limits):
                out.append((ids[text], block.items[no].item_id, *scores))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                                             names=["doc_id", "item_id", "cosine", "overlap", "answer_overlap"])
    return run


def _clean(block: Block, limits: tuple[float, float, float], name: str):
    def run(batches):
        for b in common.slices(batches, 64):
            held = {text for text, *_ in found_in(block, common.texts_of(b, name), *limits)}
            yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 256, least_cosine: float = 0.3, least_overlap: float = 0.6,
          least_answer: float = 0.5, block_words: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, cosine, overlap, answer_overlap``: which documents hold which benchmark items.

    Null and empty texts hold nothing, and items without words are in nothing.
    Repeated rows of either table each give their rows; null ids stay null.
    An empty table of either kind gives no rows.
    """
    rows = common.id_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, cosine double, overlap double, answer_overlap double"
    spark, idf = docs.sparkSession, inverse_frequencies(rows)
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, block_words, item_col, item_text_col):
        block = prepared(spark, items, idf, rank)
        out = out.unionByName(common.staged(common.map_arrow(rows, _report(block, (least_cosine, least_overlap, least_answer)), schema), "leaks"))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 256, least_cosine: float = 0.3, least_overlap: float = 0.6,
                   least_answer: float = 0.5, block_words: int = 20_000, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged."""
    own, text = common.carried(docs, text_col)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in own.dtypes)
    idf = inverse_frequencies(own.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))
    for items in item_blocks(benchmark, block_words, item_col, item_text_col):
        block = prepared(docs.sparkSession, items, idf, rank)
        own = common.map_arrow(own, _clean(block, (least_cosine, least_overlap, least_answer), text), schema)
    return own.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])
