"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the least hash among its s-mers is at
its first or last place.  The choice depends on the k-mer alone, so a passage
has the same anchors wherever it stands, and two texts can be matched by the
positions of shared anchors.  A fingerprint keeps the anchors with the
smallest hashes, ``size`` of them, with their first positions; a text shorter
than k is one anchor.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

S, MERS = 8, 3
K = S * MERS
SIZE = 64

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def smers(code: np.ndarray) -> np.ndarray:
    """A hash of each run of S code points."""
    mer, factor, width = code + _A, _A, 1
    while width < S:  # hashes of twice as many code points at each step
        mer = mer[:-width] * factor + mer[width:]
        factor, width = np.uint64(int(factor) ** 2 % 2**64), 2 * width
    return _mix(mer)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of ``text``, in order of position."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(code):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(code) < K:
        whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
        return np.array([whole], np.uint64), np.zeros(1, np.int64)
    mer = smers(code)
    window = K - S + 1
    least, width = mer, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:len(mer) - window + 1], least[window - width:])
    at = np.flatnonzero((mer[:len(least)] == least) | (mer[window - 1:] == least))
    h = mer[at]
    for k in range(1, MERS):
        h = _mix(h * _A + mer[at + k * S])
    return h, at


def sketch(text: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The anchors with the smallest ``size`` hashes, by hash, each at its first position."""
    h, at = anchors(text)
    h, first = np.unique(h >> np.uint64(16), return_index=True)
    return h[:size], at[first][:size]


def to_text(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join(f"{h:012x}:{p:x}" for h, p in zip(fingerprint[0].tolist(), fingerprint[1].tolist(), strict=True))


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split(":") for x in fingerprint.split(",")] if fingerprint else []
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p, 16) for _, p in pairs], np.int64)


def _chain(a: list[int], b: list[int]) -> int:
    """Most anchors that stand in the same order in both texts (longest increasing run of partners)."""
    ends: list[int] = []
    for _, p in sorted(zip(a, b, strict=True)):
        k = bisect.bisect_left(ends, p)
        ends[k:k + 1] = [p]
    return len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> float:
    """Share of shared anchors, in matching order, among all anchors below both sketches' limits.

    1 for equal texts, also for two empty ones; 0 if only one is empty.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    limit = min([x[0][-1] for x in (a, b) if len(x[0]) >= size], default=np.uint64(2**64 - 1))
    union = np.union1d(a[0], b[0])
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    below = int(np.searchsorted(shared, limit, "right"))
    total = int(np.searchsorted(union, limit, "right"))
    return _chain(a[1][i[:below]].tolist(), b[1][j[:below]].tolist()) / total


def fingerprints(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row; null and empty texts have the empty fingerprint."""
    def run(batches):
        for b in common.slices(batches):
            texts = b["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([to_text(sketch(t, size)) for t in texts])],
                                             names=["doc_id", "n_chars", "fingerprint"])
    return common.map_arrow(common.id_text(docs, id_col, text_col), run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` whose last third gives way to the start of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _compare(size: int):
    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None  # the row that waits for the one after it
        for b in common.slices(batches):
            out = []
            for doc, text, visitor in zip(*[b[c].to_pylist() for c in ("doc_id", "text", "visitor")], strict=True):
                if before is None or not visitor or not before[3]:
                    row = (doc, text, sketch(text, size), visitor)
                    if before is not None and not before[3]:
                        new = edited(before[1], text)
                        own, changed = before[2], sketch(new, size)
                        out.append((before[0], len(before[1]), hashlib.sha256(new.encode()).hexdigest(), to_text(own),
                                    to_text(changed), likeness(own, changed, size), likeness(own, row[2], size)))
                    before = row
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)],
                                             names=names)
    return run


def compare_with_next(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, and their likenesses.

    The next document has the next smaller id; after the smallest comes the
    largest.  Null ids count as the smallest, and rows with one id follow each
    other by text.  A single row is its own next one.

    Ids are cut into ranges, one for each task, which streams over its rows in
    order.  The first rows of a range also go to the range before it as
    visitors, so that its last row meets its next one: texts are moved once.
    """
    spark = docs.sparkSession
    parts = common.shuffle_parts(spark)
    rows = common.id_text(docs, id_col, text_col).withColumn("_key", F.coalesce("doc_id", F.lit(-2**63).cast("long")))
    keys = rows.select("_key")
    bounds = common.id_ranges(keys, "_key", parts)
    rows = rows.withColumn("_range", common.range_of(F.col("_key"), bounds))
    # at most one row for each range: its largest id, which the range above it needs
    tops = sorted((r["_range"], r["top"]) for r in rows.groupBy("_range").agg(F.max("_key").alias("top")).collect())
    ranges = [r for r, _ in tops]
    visits = [(top, above) for (_, top), above in zip(tops, [*ranges[1:], *ranges[:1]], strict=True)]
    to = F.broadcast(spark.createDataFrame(visits, "_top long, _to int"))
    home = F.struct(F.col("_range").alias("range"), F.lit(False).alias("visitor"))
    away = F.struct(F.col("_to").alias("range"), F.lit(True).alias("visitor"))
    places = F.when(F.col("_to").isNull(), F.array(home)).otherwise(F.array(home, away))
    dealt = (rows.join(to, rows["_key"] == to["_top"], "left").withColumn("p", F.explode(places))
             .select("doc_id", "text", "_key", "p.range", "p.visitor"))
    ordered = (dealt.repartitionById(parts, "range")
               .sortWithinPartitions("range", "visitor", F.col("_key").desc(), "text"))
    return common.map_arrow(
        ordered.select("doc_id", "text", "visitor"), _compare(size),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double")
