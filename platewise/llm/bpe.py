"""Byte-level BPE encoding and decoding of texts of any length.

A text longer than ``chunk`` code points is cut into overlapping chunks, which
are pre-tokenised in parallel.  Matches of the pre-token pattern depend on
the text to their right only, so two chunks that share a boundary in their
overlap agree from there on; the text is cut at the first such boundary (the
chunks resynchronise) and the pieces are encoded separately.  Where an overlap
has none (one run fills it), the neighbours stay one piece, so the ids always
equal those of the whole text.  Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Characters to the right of a boundary that can still move it: a contraction looks at two.
MARGIN = 8


@functools.cache
def encoding(path: str, pattern: str):
    """tiktoken encoding over the ranks in ``path``, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunk_starts(n_chars: int, chunk: int, overlap: int) -> range:
    """Starts of the chunks of a text; each chunk but the last is ``chunk`` long."""
    return range(0, max(1, n_chars - overlap), chunk - overlap)


def boundaries(text: str, pattern, low: int, high: int, tail_from: int) -> tuple[list[int], list[int], bool]:
    """Cut points of one chunk: those below ``low``, those from ``tail_from`` up to ``high``, and
    whether a boundary that holds in any context lies before ``tail_from``.

    A cut point is a pre-token start after a character that isn't white space:
    there the pattern's look-ahead cannot see past the cut.
    """
    import regex

    head, tail, spaced = [], [], True
    for match in pattern.finditer(text):
        at = match.start()
        if not spaced:
            if at < low:
                head.append(at)
            if tail_from <= at <= high:
                tail.append(at)
        spaced = text[match.end() - 1].isspace()
    return head, tail, regex.search(r"[\p{L}\p{N}][^\p{L}\p{N}]", text, endpos=tail_from) is not None


def _split(size: int, overlap: int):
    def run(batches):
        types = {"_row": pa.int64(), "doc_id": pa.int64(), "chunk_no": pa.int32(), "start": pa.int32(),
                 "last": pa.bool_(), "text": pa.string()}
        for b in batches:
            for row, doc, text in zip(b["_row"].to_pylist(), b["doc_id"].to_pylist(), b["text"], strict=True):
                text = text.as_py()
                starts = chunk_starts(len(text), size, overlap)
                for k, s in enumerate(starts):
                    yield common.batch({"_row": [row], "doc_id": [doc], "chunk_no": [k], "start": [s],
                                        "last": [k == len(starts) - 1], "text": [text[s:s + size]]}, types)
    return run


def _pretokenise(pattern_text: str, overlap: int):
    def run(batches):
        import regex

        pattern = regex.compile(pattern_text)
        for b in batches:
            out = {"head": [], "tail": [], "synced": []}
            for text, start in zip(b["text"].to_pylist(), b["start"].to_pylist(), strict=True):
                head, tail, synced = boundaries(text, pattern, overlap, len(text) - MARGIN, len(text) - overlap)
                out["head"].append([start + p for p in head])
                out["tail"].append([start + p for p in tail])
                out["synced"].append(synced)
            ints = pa.list_(pa.int32())
            extra = [pa.array(out["head"], ints), pa.array(out["tail"], ints), pa.array(out["synced"])]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *out])
    return run


def pieces(docs: DataFrame, pattern: str, chunk: int = 32_768, overlap: int = 1024) -> DataFrame:
    """``_row, doc_id, piece_no, text``: every text of ``docs (_row, doc_id, text)`` cut where chunks resynchronise."""
    chunks = common.map_arrow(docs, _split(chunk, overlap),
                              "_row long, doc_id long, chunk_no int, start int, last boolean, text string")
    # one very long text is pre-tokenised by many tasks
    marked = common.map_arrow(
        chunks.repartition(F.col("_row"), F.col("chunk_no")), _pretokenise(pattern, overlap),
        "_row long, doc_id long, chunk_no int, start int, last boolean, text string,"
        " head array<int>, tail array<int>, synced boolean")
    by_doc = Window.partitionBy("_row").orderBy("chunk_no")
    previous = F.lag(F.struct("tail", "synced", "chunk_no")).over(by_doc)
    # a chunk's own boundaries hold where the text before it is known or a boundary needs no context
    trusted = previous["synced"] | (previous["chunk_no"] == 0)
    seam = F.array_min(F.array_intersect("head", previous["tail"]))
    cut = marked.withColumn("_in", F.when(F.col("chunk_no") == 0, F.lit(0)).when(trusted, seam))
    step = chunk - overlap
    begin = F.coalesce("_in", "start")
    end = F.when(F.col("last"), F.col("start") + F.char_length("text")).otherwise(
        F.coalesce(F.lead("_in").over(by_doc), F.col("start") + step))
    cut = (cut.withColumn("_run", F.count("_in").over(by_doc))
              .withColumn("_text", F.substring("text", begin - F.col("start") + 1, end - begin)))
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "_text")))
    return (cut.groupBy("_row", "doc_id", F.col("_run").cast("int").alias("piece_no"))
               .agg(F.concat_ws("", F.transform(parts, lambda p: p["_text"])).alias("text")))


def _encode(path: str, pattern: str, keep: Sequence[str]):
    def run(batches):
        enc = encoding(path, pattern)
        for b in common.slices(batches):
            ids = pa.array([np.array(enc.encode_ordinary(t), np.int32) for t in b["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], ids], names=[*keep, "ids"])
    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 32_768, overlap: int = 1024,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row: the ids of the whole text, without special tokens.

    ``path`` names a file of tiktoken ranks on every machine.  Null and empty
    texts have no ids.  Texts up to ``chunk`` code points are one piece; longer
    ones go through :func:`pieces`.  Repeated rows and null ids each give
    their row.
    """
    rows = common.id_text(docs, id_col, text_col)
    size = F.char_length("text")
    short = common.map_arrow(rows.filter(size <= chunk), _encode(path, pattern, ["doc_id"]),
                             "doc_id long, ids array<int>")
    long_rows = rows.filter(size > chunk).withColumn("_row", F.monotonically_increasing_id())
    keep = ["_row", "doc_id", "piece_no"]
    parts = common.map_arrow(pieces(long_rows, pattern, chunk, overlap), _encode(path, pattern, keep),
                             "_row long, doc_id long, piece_no int, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "ids")))
    whole = parts.groupBy("_row", "doc_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    return short.unionByName(whole.select("doc_id", "ids"))


def _decode(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for b in common.slices(batches):
            data = pa.array([enc.decode_bytes(i) for i in b["ids"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], data], names=["doc_id", "data"])
    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data binary``: the concatenated bytes of the ids of ``encoded (doc_id, ids)``."""
    return common.map_arrow(encoded.select("doc_id", "ids"), _decode(path, pattern), "doc_id long, data binary")


def _digest(path: str, pattern: str, keep: list[str]):
    def run(batches):
        enc = encoding(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in b["ids"]:
                ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(" ".join(map(str, ids)).encode()))
                out["decoded_sha256"].append(sha(enc.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *[pa.array(v) for v in out.values()]], names=[*keep, *out])
    return run


def digest(encoded: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of the bytes they decode to."""
    keep = ["doc_id", "ids"] if with_ids else ["doc_id"]
    return common.map_arrow(encoded.select("doc_id", "ids"), _digest(path, pattern, keep),
                            "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")
