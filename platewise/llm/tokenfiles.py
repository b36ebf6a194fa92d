"""Token-id files whose documents are compressed one by one with a shared zstandard dictionary.

Layout, all in Parquet so that Spark's commit protocol writes it and any
store holds it: ``dictionary`` (one row: sha256 of the dictionary, its bytes,
bytes of an id, end id) and ``blocks``.  A block has consecutive documents in
ascending id order: ``range_no, block_no, dict_sha256, first`` (ids before it in
its range), the index arrays ``doc_ids, offsets, n_tokens``, and ``data``, the
zstandard frames of the documents, one after another.  One document is read by
its offset, without those around it.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A run of white space with what follows it.  The byte-level pre-tokeniser always cuts
#: between a character that isn't white space and one that is, so segments encode alone as
#: they do in the text.  (The separators U+001C to U+001F aren't white space there.)
SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")

#: Segments that a worker remembers (twice as many at most), and the longest of them.
MEMO, MEMO_CHARS = 600_000, 48
MARKS = frozenset(".,!?;:")
#: White space to Python, but not to the pre-tokeniser.
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
#: White space of ASCII other than single spaces and line breaks.
ODD = ("  ", "\n\n", " \n", "\n ", *"\t\r\v\f\x1c\x1d\x1e\x1f")
#: Segments given to the library in one string.
TOGETHER = 512


def segment_keys(text: str) -> list[str]:
    """The segments of a text, as keys: a word alone stands for the word after a space, with a line
    break before it for just that, and with a space before it for the rest of the key as it is.
    """
    # single spaces and line breaks between words, and no other white space: the usual text
    if text.isascii() and text and text[0] not in " \n" and text[-1] not in " \n" and not any(odd in text for odd in ODD):
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = " " + pieces[0]
        return pieces
    words = text.split()
    pieces = text.replace("\n", " \n").split(" ")
    if len(words) == len(pieces) and len(text) == sum(map(len, words)) + len(words) - 1:
        pieces[0] = " " + pieces[0]
        return pieces
    return [" " + segment for segment in SEGMENT.findall(text)]


def segment_of(key: str) -> str:
    return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key


def _places_of_none(values: list) -> list[int]:
    found, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            found.append(at)
    except ValueError:
        return found


class SegmentEncoder:
    """Encodes texts with a ``tokenizers`` file, remembering the ids of short segments."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 2**16 else np.dtype("<u4")
        plain = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                 if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.separator = plain[0] if plain else None
        # bytes of each token, a character of the byte-level alphabet for each; none for added tokens
        added = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = 0 if i in added else len(token)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        gc.disable()  # millions of strings without cycles, which the collector would go through again and again
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        segments: list[str] = []
        ends = [0]
        for text in texts:
            segments += segment_keys(text)
            ends.append(len(segments))
        parts = list(map(self.memo.get, segments))
        unknown = _places_of_none(parts)
        new = {segments[i] for i in unknown}
        fresh = {s: self.older[s] for s in new if s in self.older}
        # a sentence mark after a letter is a pre-token of its own: the word before it is often known
        marked = [s for s in new if s not in fresh and s[-1] in MARKS and len(s) > 2 and s[-2].isalpha()]
        wanted = {x for s in marked for x in (s[:-1], " " + s[-1])} | new.difference(fresh).difference(marked)
        for s in wanted:
            if (ids := self.memo.get(s) or self.older.get(s)) is not None:
                fresh[s] = ids
        fresh |= self._fresh([s for s in wanted if s not in fresh])
        fresh.update([(s, fresh[s[:-1]] + fresh[" " + s[-1]]) for s in marked])
        self.memo.update((s, ids) for s, ids in fresh.items() if len(s) <= MEMO_CHARS)
        if len(self.memo) > MEMO:  # what isn't met again meanwhile goes
            self.older, self.memo = self.memo, {}
        for i in unknown:
            parts[i] = fresh[segments[i]]
        return [b"".join(parts[at:end]) for at, end in zip(ends, ends[1:])]

    def _fresh(self, keys: list[str]) -> dict[str, bytes]:
        """The library's ids of each segment.

        Many segments that begin with white space and don't end with it go in
        one string: the pre-tokeniser cuts between them.  Where each ends is
        told by the tokens' bytes.  Runs in which the bytes don't meet the
        segments' (a special token is in one), and other segments, are encoded
        with a special token between them (see :meth:`_separated`).
        """
        segments = list(map(segment_of, keys))
        inner, rest = [], []
        for pair in zip(keys, segments, strict=True):
            s = pair[1]
            (inner if s[0].isspace() and s[0] not in SEPARATORS and (s[-1] in SEPARATORS or not s[-1].isspace()) else rest).append(pair)
        out: dict[str, bytes] = {}
        runs = [inner[at:at + TOGETHER] for at in range(0, len(inner), TOGETHER)]
        width = self.dtype.itemsize
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(["".join([s for _, s in run]) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            sizes = np.fromiter((len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass")) for _, s in run), np.int64, len(run))
            ends, reached = np.cumsum(sizes), np.cumsum(self.n_bytes[ids])
            last = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
            if reached[-1] != ends[-1] or (reached[last] != ends).any():
                rest += run
                continue
            data, at = ids.tobytes(), 0
            for (key, _), end in zip(run, ((last + 1) * width).tolist(), strict=True):
                out[key] = data[at:end]
                at = end
        return out | self._separated(rest)

    def _separated(self, pairs: list[tuple[str, str]]) -> dict[str, bytes]:
        """The library's ids of each ``(key, segment)``.

        Many segments go in one string with a special token between them, at
        which the library cuts a text before anything else; each is then
        encoded as if alone.
        """
        between, mark = self.separator or ("", None)
        joined, alone = [], []
        for key, s in pairs:
            (joined if between and between not in s else alone).append((key, s))
        out = {key: np.array(e.ids, self.dtype).tobytes()
               for (key, _), e in zip(alone, self.tokenizer.encode_batch_fast([s for _, s in alone], add_special_tokens=False), strict=True)}
        runs = [joined[at:at + TOGETHER] for at in range(0, len(joined), TOGETHER)]
        texts = [between.join(s for _, s in run) for run in runs]
        width = self.dtype.itemsize
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = [*(np.flatnonzero(ids == mark) * width).tolist(), len(ids) * width]
            data, at = ids.tobytes(), 0
            for (key, _), end in zip(run, ends, strict=True):
                out[key] = data[at:end]
                at = end + width
        return out


@functools.cache
def encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(path)


def train_dictionary(docs: DataFrame, path: str, end_id: int, size: int = 65_536, sample_docs: int = 1000,
                     sample_chars: int = 16_384, seed: int = 0) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample: the ``sample_docs`` documents with
    the smallest seeded hash, at most ``sample_chars`` code points of each.  Empty if they are too few to train on.

    The sample only shapes the dictionary; every document is stored whole.
    """
    import zstandard

    # chosen by the ids alone, so that no more texts than these reach the driver
    ids = (docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).distinct().orderBy("h").limit(sample_docs)
           .select(F.col("doc_id").alias("s_id")))
    sample = (docs.join(F.broadcast(ids), docs["doc_id"] == ids["s_id"]).select(F.substring("text", 1, sample_chars).alias("text"))
              .orderBy(F.xxhash64("text")).limit(sample_docs).collect())
    enc = encoder(path)
    arrays = [a + np.array([end_id], enc.dtype).tobytes() for a in enc.encode([r["text"] for r in sample])]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compression(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _pack(path: str, end_id: int, dictionary: bytes, sha: str, block_bytes: int):
    def run(batches):
        import zstandard

        enc = encoder(path)
        press = zstandard.ZstdCompressor(level=3, **_compression(dictionary))
        end = np.array([end_id], enc.dtype).tobytes()
        types = {"range_no": pa.int32(), "block_no": pa.int32(), "dict_sha256": pa.string(), "first": pa.int64(),
                 "doc_ids": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()),
                 "data": pa.binary()}
        at = {"range_no": None, "block_no": 0, "first": 0}
        doc_ids, offsets, counts, frames, size = [], [], [], [], 0

        def block():
            return common.batch({k: [v] for k, v in (at | {
                "dict_sha256": sha, "doc_ids": doc_ids, "offsets": offsets, "n_tokens": counts, "data": b"".join(frames)}).items()}, types)
        for b in common.slices(batches):
            for no, doc, ids in zip(b["range_no"].to_pylist(), b["doc_id"].to_pylist(), enc.encode(b["text"].to_pylist()), strict=True):
                if frames and (no != at["range_no"] or size >= block_bytes):
                    yield block()
                    same = no == at["range_no"]
                    at = {"range_no": no, "block_no": at["block_no"] + 1 if same else 0, "first": at["first"] + sum(counts) if same else 0}
                    doc_ids, offsets, counts, frames, size = [], [], [], [], 0
                at["range_no"] = no
                frame = press.compress(ids + end)
                doc_ids.append(doc)
                offsets.append(size)
                counts.append(len(ids) // enc.dtype.itemsize + 1)
                frames.append(frame)
                size += len(frame)
        if frames:
            yield block()
    return run


def write(docs: DataFrame, out: str, path: str, end_id: int, block_bytes: int = 1 << 20, dictionary_size: int = 65_536,
          sample_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text with the tokenizers file ``path``, append ``end_id``, and write the files to ``out``.

    Null and empty texts have the end id only.  Null ids come first; rows with
    one id follow each other in the order of their texts.
    """
    spark = docs.sparkSession
    rows = common.id_text(docs, id_col, text_col)
    dictionary = train_dictionary(rows, path, end_id, dictionary_size, sample_docs)
    sha = hashlib.sha256(dictionary).hexdigest()
    parts = common.shuffle_parts(spark)
    ranged = rows.withColumn("range_no", common.range_of(F.col("doc_id"), common.id_ranges(rows, "doc_id", parts)))
    # the texts are moved once, to their place in the order; ids and frames are made there
    ordered = ranged.repartitionById(parts, "range_no").sortWithinPartitions("range_no", "doc_id", "text")
    common.map_arrow(ordered, _pack(path, end_id, dictionary, sha, block_bytes),
                     "range_no int, block_no int, dict_sha256 string, first long, doc_ids array<long>,"
                     " offsets array<long>, n_tokens array<long>, data binary").write.parquet(f"{out}/blocks")
    spark.createDataFrame([(sha, bytearray(dictionary), encoder(path).dtype.itemsize, end_id)],
                          "dict_sha256 string, dictionary binary, id_bytes int, end_id int").write.parquet(f"{out}/dictionary")


def _frames(block: dict):
    ends = [*block["offsets"][1:], len(block["data"])]
    return zip(block["doc_ids"], block["offsets"], ends, block["n_tokens"], strict=True)


def _opened(dictionary: bytes, sha: str):
    import zstandard

    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError("the dictionary isn't the one these files were written with")
    return zstandard.ZstdDecompressor(**_compression(dictionary))


def _read(dictionary: bytes, sha: str, id_bytes: int, with_ids: bool):
    def run(batches):
        opened, dtype = _opened(dictionary, sha), np.dtype(f"<u{id_bytes}")
        for b in batches:
            for i in range(b.num_rows):
                block = b.slice(i, 1).to_pylist()[0]
                if block["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                start = block["start"]
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                for doc, begin, end, n in _frames(block):
                    ids = np.frombuffer(opened.decompress(block["data"][begin:end]), dtype)
                    if len(ids) != n:
                        raise ValueError(f"document {doc} has {len(ids)} ids, its index says {n}")
                    out["doc_id"].append(doc)
                    out["start"].append(start)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        out["ids"].append(ids.astype(np.int32))
                    start += n
                arrays = [pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(out))
    return run


def read(spark: SparkSession, out: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of the documents in the files under ``out``.

    ``start`` counts the ids of all documents before it, and ``ids_crc32`` is over
    little-endian unsigned 32-bit ids.  With ``doc_ids`` only blocks that hold
    one of them are opened.
    """
    head = spark.read.parquet(f"{out}/dictionary").first()
    blocks = spark.read.parquet(f"{out}/blocks")
    tokens = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    # a row for each range of ids, as many as shuffle partitions at most
    ranges = blocks.groupBy("range_no").agg(F.sum(tokens).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("range_no").alias("_range"), F.coalesce(before, F.lit(0)).alias("_before"))
    chosen = blocks
    if doc_ids is not None:
        chosen = blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(d)).cast("long") for d in doc_ids])))
    placed = chosen.join(ranges, chosen["range_no"] == ranges["_range"]).withColumn("start", F.col("_before") + F.col("first"))
    read_back = common.map_arrow(
        placed.select("start", "dict_sha256", "doc_ids", "offsets", "n_tokens", "data"),
        _read(bytes(head["dictionary"]), head["dict_sha256"], head["id_bytes"], with_ids),
        "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return read_back if doc_ids is None else read_back.filter(F.col("doc_id").isin([int(d) for d in doc_ids]))
