"""Alignment of the tokens that two tokenizers cut the same text into.

Tokens are compared by their byte ranges in a space and the text.  A batch of
documents goes through two ``pandas.merge_asof`` keyed by document: each token
start finds the token of the other side that covers it; the union of both
directions is the set of overlapping pairs, and where a token of each side ends
the document is cut into groups.

Counts of id pairs over the corpus: consecutive documents form a block, which
numbers its distinct pairs and counts them; documents keep numbers.  The counts
of a pair are summed over the blocks, and each block gets back one row for each
of its pairs, so that what is shuffled are distinct pairs, not links.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sentencepieces

#: A space after a character that is neither white space nor a marker: both tokenizers cut there, whatever is around.
CUT = re.compile(f"(?<=[^\\s{sentencepieces.MARK}]) ")
#: Texts that have spaces of another kind.
ODD_SPACE = re.compile(f"(?:^|[\\s{sentencepieces.MARK}]) ")
#: Words that a worker remembers (twice as many at most), and the longest of them.
MEMO, MEMO_CHARS = 300_000, 64
#: Words that are given to a tokenizer in one text.
TOGETHER = 512
#: Bytes of text in a block, which has the rest of the document that passes them as well.
BLOCK_BYTES = 4 << 20
#: Bytes of text and rows that are aligned at once.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 256


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones for themselves,
    the others by number from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id, for a whole run of ids at a time."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = np.array(tokens, object)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        numbers = [str(i) for i in range(len(tokens))]
        #: An id inside a group, the last one of the first side, and the last one of the second side.
        self.inside, self.between, self.last = (np.array([n + mark for n in numbers], object) for mark in ",|;")

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids])


class Pair:
    """Both tokenizers: a byte-level one of the ``tokenizers`` library, and a SentencePiece model."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_path)
        self.byte_level.encode_special_tokens = True  # their strings are plain text
        self.pieces = sentencepieces.model(piece_path)
        alphabet = byte_alphabet()
        names = (self.byte_level.id_to_token(i) or "" for i in range(self.byte_level.get_vocab_size()))
        self.a = Vocabulary([bytes([alphabet[c] for c in name if c in alphabet]) for name in names])
        self.b = Vocabulary([sentencepieces.piece_bytes(self.pieces, i) for i in range(self.pieces.get_piece_size())])
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.unspelled: set[str] = set()

    def _together(self, words: list[str]) -> list[tuple[bytes, bytes]] | None:
        """The ids of words that follow each other in one text, cut where the bytes of each word end;
        nothing if a tokenizer doesn't spell that text."""
        text, ends = "".join([" " + w for w in words]), np.cumsum([len(w.encode()) + 1 for w in words])
        sides = []
        for ids, vocabulary in ((self.byte_level.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.a),
                                (self.pieces.encode(text[1:]), self.b)):
            ids = np.array(ids, np.int32)
            if vocabulary.text(ids) != text.encode():
                return None
            cuts = np.searchsorted(np.cumsum(vocabulary.sizes[ids]), ends, side="right").tolist()
            data, width = ids.tobytes(), ids.itemsize
            sides.append([data[lo * width:hi * width] for lo, hi in zip([0, *cuts], cuts, strict=False)])
        return list(zip(*sides, strict=True))

    def _alone(self, word: str) -> tuple[bytes, bytes]:
        data = (" " + word).encode()
        a = np.array(self.byte_level.encode_batch_fast([" " + word], add_special_tokens=False)[0].ids, np.int32)
        b = np.array(sentencepieces.segment(self.pieces, [word])[0], np.int32)
        if self.a.text(a) != data or self.b.text(b) != data:
            self.unspelled.add(word)
        return a.tobytes(), b.tobytes()

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        # words with a marker inside, or that don't end where the next one's space begins, go alone
        alone = [w for w in words if not w or sentencepieces.MARK in w or w[-1].isspace()]
        usual = list(set(words).difference(alone))
        out = {}
        for at in range(0, len(usual), TOGETHER):
            run = usual[at:at + TOGETHER]
            got = self._together(run)
            if got is None:
                alone += run
            else:
                out.update(zip(run, got, strict=True))
        out.update([(w, self._alone(w)) for w in alone])
        return out

    def _ids(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of distinct words by both sides, remembered or learned."""
        found = list(map(self.memo.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        fresh = {w: self.older[w] for w in new if w in self.older}
        fresh |= self._learn([w for w in new if w not in fresh])
        # words that aren't spelled aren't remembered, so each batch sees them anew
        self.memo.update((w, ids) for w, ids in fresh.items() if len(w) <= MEMO_CHARS and w not in self.unspelled)
        if len(self.memo) > MEMO:  # what isn't met again meanwhile goes
            self.older, self.memo = self.memo, {}
        return [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side the ids of all texts one after another (a space and the text; the text), and
        their number in each text: none in the empty text and in one that a tokenizer doesn't spell."""
        self.unspelled = set()
        cut = [[] if not t else CUT.split(t) if ODD_SPACE.search(t) or t[-1] == " " else t.split(" ") for t in texts]
        coded = pa.array(list(itertools.chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._ids(words)
        places, in_text = coded.indices.to_numpy(), np.array([len(c) for c in cut], np.int64)
        if self.unspelled:
            spelled = np.array([self.unspelled.isdisjoint(c) for c in cut])
            places, in_text = places[np.repeat(spelled, in_text)], in_text * spelled
        ends = np.cumsum(in_text)
        return [_gathered([ids[side] for ids in known], places, ends) for side in (0, 1)]


def _gathered(known: list[bytes], places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at ``places`` one after another, and their number in each text, whose words end at ``ends``."""
    ids, sizes = np.frombuffer(b"".join(known), np.int32), np.array([len(k) // 4 for k in known], np.int64)
    starts, n = np.cumsum(sizes) - sizes, sizes[places]
    through = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.repeat(starts[places] - through[:-1], n) + np.arange(through[-1])]
    return flat, np.diff(through[ends], prepend=0)


@functools.cache
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


@dataclass
class Aligned:
    """Tokens and links of a batch; documents are numbered from 0."""

    docs: int
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_ends: np.ndarray  # index of each group's last token, on both sides
    b_ends: np.ndarray
    links: pd.DataFrame  # a, b: indexes of tokens that overlap

    @property
    def pairs(self) -> np.ndarray:
        """Both ids of each link as one number, the second side's first."""
        return self.b_ids[self.links["b"].to_numpy()].astype(np.int64) << 32 | self.a_ids[self.links["a"].to_numpy()]

    @property
    def link_doc(self) -> np.ndarray:
        return self.a_doc[self.links["a"].to_numpy()]


def align(both: Pair, texts: list[str]) -> Aligned:
    """Overlaps and groups of a batch.  Texts whose tokens don't spell a space and the text have no tokens."""
    sides = []
    for k, ((all_ids, counts), vocabulary) in enumerate(zip(both.encode(texts), (both.a, both.b), strict=True)):
        doc = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(vocabulary.sizes[all_ids])  # the texts one after another: in order for merge_asof
        # a place more for each document before: the key holds the document too, as both sides have tokens in the same ones
        starts = ends - vocabulary.sizes[all_ids] + doc
        sides.append((all_ids, doc, ends, pd.DataFrame({"at": starts, "ab"[k]: np.arange(len(all_ids)), "ab"[k] + "_at": starts})))
    (a_ids, a_doc, a_end, a_starts), (b_ids, b_doc, b_end, b_starts) = sides
    covered = pd.merge_asof(a_starts, b_starts, on="at")
    covering = pd.merge_asof(b_starts, a_starts, on="at")
    # the union: both directions find a pair that starts at one place
    links = pd.concat([covered[["a", "b"]], covering.loc[covering["a_at"] != covering["b_at"], ["a", "b"]]], ignore_index=True)
    shared, a_ends, b_ends = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
    return Aligned(len(texts), a_ids, b_ids, a_doc, b_doc, a_ends, b_ends, links)


def group_texts(both: Pair, batch: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document: ids of both sides, group by group; empty without tokens."""
    a_group = np.searchsorted(batch.a_ends, np.arange(len(batch.a_ids)))
    b_group = np.searchsorted(batch.b_ends, np.arange(len(batch.b_ids)))
    b_before = np.concatenate([[0], batch.b_ends + 1])  # tokens of the second side before each group
    a_through = batch.a_ends + 1
    shown = np.empty(len(batch.a_ids) + len(batch.b_ids), object)
    a_shown, b_shown = both.a.inside[batch.a_ids], both.b.inside[batch.b_ids]
    a_shown[batch.a_ends] = both.a.between[batch.a_ids[batch.a_ends]]
    b_shown[batch.b_ends] = both.b.last[batch.b_ids[batch.b_ends]]
    shown[np.arange(len(batch.a_ids)) + b_before[a_group]] = a_shown
    shown[np.arange(len(batch.b_ids)) + a_through[b_group]] = b_shown
    at = np.cumsum(np.bincount(batch.a_doc, minlength=batch.docs) + np.bincount(batch.b_doc, minlength=batch.docs))
    starts = np.concatenate([[0], at[:-1]]) if batch.docs else at
    return ["".join(shown[lo:hi])[:-1] for lo, hi in zip(starts, at, strict=True)]


def _batches(batches: common.Batches):
    """Parts of the batches that are aligned at once."""
    for b in common.slices(batches, BATCH_ROWS):
        lo = size = 0
        for i, text in enumerate(b["text"]):
            more = text.as_buffer().size
            if i > lo and size + more > BATCH_BYTES:
                yield b.slice(lo, i - lo)
                lo, size = i, 0
            size += more
        if lo < b.num_rows:
            yield b.slice(lo)


MEASURES = ("n_a", "n_b", "n_groups", "n_links")
#: Rows of documents, and (with ``pair`` set) of the distinct pairs of a block.
CODED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string,"
         " numbers array<int>, times array<int>, pair long, number int, n long")


def _rows(columns: dict, length: int) -> pa.RecordBatch:
    types = {"groups": pa.string(), "groups_sha256": pa.string(), "numbers": pa.list_(pa.int32()), "times": pa.list_(pa.int32()),
             "number": pa.int32()}
    names = [c.split()[0] for c in CODED.split(", ")]
    arrays = [pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(length, types.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


class Block:
    """Distinct pairs of consecutive documents, numbered in the order of their appearance, and how often each was met."""

    def __init__(self, task: int, at: int):
        self.id = task << 32 | at
        self.at = at
        self.numbers: dict[int, int] = {}
        self.n: list[int] = []
        self.bytes = 0

    def place(self, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        for p, n in zip(pairs.tolist(), times.tolist(), strict=True):
            number = self.numbers.setdefault(p, len(self.n))
            if number == len(self.n):
                self.n.append(n)
            else:
                self.n[number] += n
        return np.fromiter((self.numbers[p] for p in pairs.tolist()), np.int64, len(pairs))

    def rows(self) -> pa.RecordBatch:
        size = len(self.n)
        return _rows({"block": [self.id] * size, "pair": list(self.numbers), "number": list(self.numbers.values()), "n": self.n}, size)


def _code(byte_path: str, piece_path: str, with_groups: bool, block_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        both = pair(byte_path, piece_path)
        task = TaskContext.get().partitionId()
        block = Block(task, 0)
        for b in _batches(batches):
            got = align(both, b["text"].to_pylist())
            pairs, place = np.unique(got.pairs, return_inverse=True)
            place = block.place(pairs, np.bincount(place, minlength=len(pairs)))[place]
            width = max(1, len(block.n))  # each document's pairs once, with how often it has them
            own, times = np.unique(got.link_doc * width + place, return_counts=True)
            ends = np.cumsum(np.bincount(own // width, minlength=got.docs))
            lists = lambda values: pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values.astype(np.int32)))  # noqa: E731, B023
            tally = lambda of: np.bincount(of, minlength=got.docs)  # noqa: E731, B023
            groups = group_texts(both, got)
            measured = zip(MEASURES, (got.a_doc, got.b_doc, got.a_doc[got.a_ends], got.link_doc), strict=True)
            yield _rows({"block": [block.id] * got.docs, "doc_id": b["doc_id"], "numbers": lists(own % width), "times": lists(times),
                         "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]}
                        | {name: tally(of) for name, of in measured} | ({"groups": groups} if with_groups else {}), got.docs)
            block.bytes += b["text"].nbytes
            if block.bytes >= block_bytes:
                yield block.rows()
                block = Block(task, block.at + 1)
        yield block.rows()
    return run


def _sum(docs, known):
    order = np.argsort(known["number"].to_numpy())  # all numbers of the block, from 0
    count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order]
    numbers, times = (docs[c].combine_chunks() for c in ("numbers", "times"))
    doc = np.repeat(np.arange(len(docs)), np.diff(numbers.offsets.to_numpy()))
    numbers, times = numbers.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    out = {}
    for name, each in (("n_best", times * best[numbers]), ("count_sum", times * count[numbers])):
        out[name] = np.zeros(len(docs), np.int64)
        np.add.at(out[name], doc, each)
    return pa.table({"doc_id": docs["doc_id"]} | {c: docs[c] for c in MEASURES} | out | {c: docs[c] for c in ("groups_sha256", "groups")})


def alignment(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False, id_col: str = "doc_id",
              text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and ``groups``).

    Side A is the byte-level file over a space and the text, side B the
    SentencePiece model over the text.  ``n_best`` counts the links whose pair
    has the highest count of its B id in the corpus, ties included.  Null and
    empty texts, and those that a side doesn't spell (such as with U+2581 in
    them), have no tokens: zeros and an empty digest.  Repeated rows and null
    ids each give their row.
    """
    rows = common.id_text(docs, id_col, text_col)
    coded = common.staged(common.map_arrow(rows, _code(byte_path, piece_path, with_groups, block_bytes), CODED), "alignment")
    asked = coded.filter("pair IS NOT NULL").select("block", "pair", "number", "n")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.shiftright("pair", 32))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most a row for each id
    counts = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = asked.join(counts, "pair").select(F.col("block").alias("of_block"), "number", "count", "best")
    aligned = coded.filter("pair IS NULL").drop("pair", "number", "n")
    out = aligned.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        _sum, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return out if with_groups else out.drop("groups")
