"""SentencePiece encoding and decoding through a table of distinct marked words.

A model whose pieces never go from another character into a white-space marker
segments each *marked word* (a run of markers with what follows it) alone as it
does in the text.  So the corpus's distinct marked words are dealt to buckets by
their hash and segmented once each, and their ids joined back by position.
:func:`model` refuses models for which this doesn't hold.

Consecutive documents form a block, which numbers its distinct words; a document
becomes the numbers of its words.  A block asks each bucket for its words on one
page, and the ids come back as a page.  So neither texts nor occurrences
of words are shuffled as such, but numbers and pages, packed with zstandard.
Both the pages and the documents come from one shuffle by block.  Should Spark
make parts of it anew from rows in another order, a block's numbers could
differ; a seal over its words, in all of its rows, makes the job fail then.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: A marked word without its first marker, which stands for a space.
WORD = re.compile(" ( *[^ ]*)")
#: Characters that normalising models change, and white space that they drop.
PROBE = " ﬁ①Å  Ａ 　x \t\n y  "
#: Bytes of text in a block, which has the rest of the batch that passes them as well.
BLOCK_BYTES = 16 << 20
#: Distinct words that a worker remembers at a time.
MEMO = 500_000


@functools.cache
def model(path: str):
    """The processor of a model file, once for each Python worker.

    Raises ``ValueError`` for a model whose pieces cross into a white-space
    marker, or that normalises texts: marked words would not stand alone.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("a piece of this model crosses a white-space marker")
    shown = b"".join(piece_bytes(sp, i) for i in sp.encode(PROBE))
    if shown != (" " + PROBE).encode():
        raise ValueError("this model changes texts before it cuts them")
    return sp


def piece_bytes(sp, piece_id: int) -> bytes:
    """The bytes a piece stands for: its text with markers as spaces, or its one byte."""
    piece = sp.id_to_piece(piece_id)
    return bytes([int(piece[3:5], 16)]) if sp.is_byte(piece_id) else piece.replace(MARK, " ").encode()


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, in order; none for the empty text.

    A marker in the text itself counts as a space, as it does for the library.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return WORD.findall(" " + text)
    return text.split(" ")


def segment(sp, words: list[str]) -> list[list[int]]:
    """The ids of each marked word.  The library adds the first marker, but has no ids for an empty text."""
    return [ids if word else [sp.piece_to_id(MARK)] for word, ids in zip(words, sp.encode(words, num_threads=1), strict=True)]


def packed(values: np.ndarray, dtype: str) -> bytes:
    """Numbers with the first bytes of all of them together, then the second ones and so on, compressed."""
    import zstandard

    values = values.astype(dtype)
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


#: Rows with the words a block asks a bucket for, and (with ``doc_ids`` set) rows of documents as numbers of words.
CODED = {"block": pa.int64(), "seal": pa.int64(), "bucket": pa.int32(), "words": pa.binary(), "numbers": pa.binary(),
         "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "places": pa.binary()}
CODED_SCHEMA = "block long, seal long, bucket int, words binary, numbers binary, doc_ids array<long>, lengths array<int>, places binary"


def _code(buckets: int, block_bytes: int):
    def row(**values):
        return common.batch({c: [values.get(c)] for c in CODED}, CODED)

    def rows(block: int, numbers: dict[str, int], docs: list[dict]):
        import zstandard

        seal = len(numbers) << 32 | zlib.crc32(MARK.join(numbers).encode())
        pages: dict[int, list[str]] = {}
        for word in numbers:
            pages.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
        for bucket, words in pages.items():
            at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            # words have no marker inside, so it can stand between them; numbers ascend, their steps are small
            yield row(block=block, seal=seal, bucket=bucket, words=zstandard.compress(MARK.join(words).encode()),
                      numbers=packed(np.diff(at, prepend=0), "<u4"))
        for doc in docs:
            yield row(block=block, seal=seal, **doc)

    def run(batches):
        from pyspark import TaskContext

        block, size, docs = TaskContext.get().partitionId() << 32, 0, []
        numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        for b in batches:
            places = []
            for text in b["text"]:
                words = marked_words(text.as_py())
                places.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            docs.append({"doc_ids": b["doc_id"].to_pylist(), "lengths": [len(p) for p in places],
                         "places": packed(np.concatenate(places), "<u4")})
            size += b["text"].nbytes
            if size >= block_bytes:
                yield from rows(block, numbers, docs)
                block, size, docs, numbers = block + 1, 0, [], defaultdict(itertools.count().__next__)
        yield from rows(block, numbers, docs)
    return run


def _pages(batches):
    for b in batches:
        yield b.filter(b["bucket"].is_valid()).select(["block", "seal", "bucket", "words", "numbers"])


def _answer(path: str):
    def run(batches):
        import zstandard

        sp = model(path)
        known: dict[str, bytes] = {}
        for b in batches:
            out = {"counts": [], "ids": []}
            for page in b["words"]:
                words = zstandard.decompress(page.as_py()).decode().split(MARK)
                new = [w for w in words if w not in known]
                known.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(new, segment(sp, new), strict=True))
                parts = [known[w] for w in words]
                out["counts"].append(packed(np.array([len(p) // 4 for p in parts]), "<u4"))
                out["ids"].append(packed(np.frombuffer(b"".join(parts), "<u4"), "<u4"))
                if len(known) > MEMO:
                    known = {}
            arrays = [b["block"], b["seal"], b["numbers"], *[pa.array(v, pa.binary()) for v in out.values()]]
            yield pa.RecordBatch.from_arrays(arrays, names=["of_block", "seal", "numbers", *out])
    return run


class Answers:
    """The ids of a block's words, by number."""

    def __init__(self):
        self.numbers, self.counts, self.ids = [], [], []
        self.starts = self.lengths = self.flat = None

    def add(self, numbers: bytes, counts: bytes, ids: bytes) -> None:
        self.numbers.append(np.cumsum(unpacked(numbers, "<u4").astype(np.int64)))
        self.counts.append(unpacked(counts, "<u4").astype(np.int64))
        self.ids.append(unpacked(ids, "<u4").astype(np.int32))

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places one after another, and how many each word has."""
        if self.flat is None:
            none = [np.empty(0, np.int64)]
            numbers, counts = np.concatenate(self.numbers or none), np.concatenate(self.counts or none)
            self.starts, self.lengths = np.empty_like(counts), np.empty_like(counts)
            self.starts[numbers], self.lengths[numbers] = np.cumsum(counts) - counts, counts
            self.flat = np.concatenate(self.ids or [np.empty(0, np.int32)])
        n = self.lengths[places]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[places] - (ends - n), n) + np.arange(n.sum())], n


def _join_back(coded, pages):
    seals = set(coded["seal"].to_pylist()) | set(pages["seal"].to_pylist())
    if len(seals) > 1:
        raise RuntimeError("a block was read in two versions: give the operator a stored table")
    answers, out = Answers(), []
    for numbers, counts, ids in zip(*(pages[c].to_pylist() for c in ("numbers", "counts", "ids")), strict=True):
        answers.add(numbers, counts, ids)
    docs = coded.filter(coded["doc_ids"].is_valid())
    for doc_ids, lengths, places in zip(docs["doc_ids"], docs["lengths"], docs["places"], strict=True):
        ids, n = answers.at(unpacked(places.as_py(), "<u4").astype(np.int64))
        before = np.concatenate([[0], np.cumsum(n)])
        words = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])
        lists = pa.ListArray.from_arrays(before[words].astype(np.int32), pa.array(ids))
        out.append(pa.RecordBatch.from_arrays([doc_ids.values, lists], schema=ENCODED))
    return pa.Table.from_batches(out, ENCODED)


ENCODED = pa.schema({"doc_id": pa.int64(), "ids": pa.list_(pa.int32())})


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids array<int>`` for every row: the ids of the whole text, without begin and end ids.

    ``path`` names a model file on every machine.  Null and empty texts have no
    ids; repeated rows and null ids each give their row.
    """
    rows = common.id_text(docs, id_col, text_col)
    # one shuffle that both sides read: no filter or selection of columns in Spark may come between
    coded = common.map_arrow(rows, _code(common.shuffle_parts(docs.sparkSession), block_bytes), CODED_SCHEMA).repartition("block")
    asked = common.map_arrow(coded, _pages, "block long, seal long, bucket int, words binary, numbers binary").repartition("bucket")
    answers = common.map_arrow(asked, _answer(path), "of_block long, seal long, numbers binary, counts binary, ids binary")
    return coded.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_join_back, "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches):
        sp = model(path)
        for b in common.slices(batches):
            texts = pa.array([sp.decode(i) for i in b["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], texts], names=["doc_id", "text"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text``: what the library makes of the ids of ``encoded (doc_id, ids)``."""
    return common.map_arrow(encoded.select("doc_id", "ids"), _decode(path), "doc_id long, text string")


def _digest(path: str):
    def run(batches):
        sp = model(path)
        shown = np.array([str(i) for i in range(sp.get_piece_size())], object)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for b in common.slices(batches):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in b["ids"]:
                ids = ids.values.to_numpy(zero_copy_only=False)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(shown[ids])))
                out["decoded_sha256"].append(sha(sp.decode(ids.tolist())))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, out.values())], names=["doc_id", *out])
    return run


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of the text they decode to."""
    return common.map_arrow(encoded.select("doc_id", "ids"), _digest(path),
                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
