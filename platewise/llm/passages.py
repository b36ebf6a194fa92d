"""Substring dedup by paragraph MinHash banding, and by pieces cut at content-chosen words.

Texts are cut into paragraphs at blank lines and at sentence ends chosen by
content (by the hash of the last word, two of three).  Paragraphs are documents
to :mod:`neardup`: band their min-max hashes, compare colliding ones on their
full five-word shingle sets, and connect what is similar.  Their texts are
fetched by place, for colliding paragraphs only.  Bands of two values
favour recall: a pair at 0.8 shares none of twelve with probability 5e-6.

A passage that was pasted within a paragraph, or has no sentence ends, holds no
whole paragraph.  So paragraphs are cut further, into pieces: at line breaks, and
at words whose hash is the smallest of those around them, so that a passage is
cut in the same places wherever it was pasted.  Pieces repeat where their
shingle sets are equal, by hashes of 96 bits.  Runs of repeated pieces are
joined, and all but the first place of each piece are removals.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, neardup

#: Code points that are white space; the last place stands for all after U+3000.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_ENDS = tuple(map(ord, ".!?"))
_NEWLINES = "\r\n\v\f\x1c\x1d\x1e\x85\u2028\u2029"
#: A word ends a piece if its hash is the smallest among so many before and after it; the second kind fills in between the first.
_STRONG, _WEAK = 5, 2
#: Sets of at most so many members are sorted as rows of one array.
_SIDE_BY_SIDE = 64
#: Most words between two cuts where hashes repeat and none is smallest.
_LONGEST = 24


class _Remembered(dict):
    """Numbers of words, under which ``crc`` (of the word in lower case) and ``shingle``, its hash in shingles, are kept."""

    def __init__(self):
        self.crc = self.shingle = np.empty(0, np.uint64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > neardup.MEMO:
            self.clear()
            self.__init__()
        if new := [w for w in set(words) if w not in self]:
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            low = [w.lower().encode("utf-8", "surrogatepass") for w in new]
            # shingles lower A to Z only
            own = [x if w.isascii() else w.encode("utf-8", "surrogatepass").lower() for w, x in zip(new, low, strict=True)]
            self.crc = np.append(self.crc, np.fromiter(map(zlib.crc32, low), np.uint64, len(new)))
            self.shingle = np.append(self.shingle, neardup.word_hashes(own))
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.crc[numbers], self.shingle[numbers]


_WORDS = _Remembered()


def _smallest(values: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Which values are smaller than the ``reach`` before them and no larger than those after; ``at`` are their places, in each text
    one after another, with ``reach`` free ones at least between texts."""
    n = int(at[-1]) + 1 if len(at) else 0
    padded = np.full(n + 2 * reach, np.uint64(2**64 - 1))
    padded[at + reach] = values
    own = padded[reach:reach + n]
    least = np.ones(n, bool)
    for j in range(1, reach + 1):
        least &= own < padded[reach - j:reach - j + n]
        least &= own <= padded[reach + j:reach + j + n]
    return least[at]


def _refined(bounds: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """``bounds`` and those of the sorted ``places`` that are ``least`` away from the bounds and places before them and the next bound."""
    after = np.searchsorted(bounds, places, "right")
    after[after == len(bounds)] = 0  # a place at the last bound is none between two
    places = places[(places - bounds[after - 1] >= least) & (bounds[after] - places >= least)]
    if len(places) and (np.diff(places) < least).any():
        some, last = [], -least
        for place in places.tolist():
            if place - last >= least:
                some.append(place)
                last = place
        places = np.array(some, np.int64)
    return np.sort(np.concatenate([bounds, places]))


def _cut(texts: list[str], least: int, wide: int):
    """The texts' words, one after another: first and end places, hashes in shingles; then the numbers of the words before which
    the texts (numbers of those with ``least`` words at least come first), paragraphs (of ``wide`` words at least)
    and pieces (of ``least``) begin, with the last one's end.

    Only what is certain for the whole text goes first: blank lines, then
    sentence ends, line breaks, and the words chosen by their hashes.  Words
    after the last cut that are too few for a piece belong to the one before.
    """
    joined = " ".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(_SPACE[np.minimum(codes, len(_SPACE) - 1)], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    crc, h = _WORDS.of(joined.split())
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    origin = np.cumsum(lengths) - lengths
    counts = np.diff(np.searchsorted(starts, np.append(origin, len(codes))))
    long = counts >= least
    kept = np.repeat(long, counts)
    starts, ends, crc, h = starts[kept], ends[kept], crc[kept], h[kept]
    counts, own = counts[long], np.flatnonzero(long)
    bounds = np.append(0, np.cumsum(counts))
    if not len(own):
        return own, starts, ends, h, bounds, bounds, bounds
    inner = np.ones(len(starts), bool)  # words that aren't a text's first
    inner[bounds[:-1]] = False
    before = np.append(0, ends[:-1])
    odd = np.flatnonzero(inner & ((starts - before > 1) | (codes[np.minimum(before, len(codes) - 1)] != 32)))
    blanks, lines = [], []
    for i, end, start in zip(odd.tolist(), before[odd].tolist(), starts[odd].tolist()):
        breaks = len(joined[end:start].splitlines()) - (joined[start - 1] not in _NEWLINES)
        if breaks:
            (lines if breaks == 1 else blanks).append(i)
    blanks, lines = np.array(blanks, np.int64), np.array(lines, np.int64)
    sentences = np.flatnonzero(inner & np.append(False, np.isin(codes[ends[:-1] - 1], _ENDS) & (crc[:-1] % 3 > 0)))
    fine = _refined(_refined(bounds, blanks, least), sentences, least)
    paragraphs_ = _refined(_refined(bounds, np.intersect1d(fine, blanks), wide), np.setdiff1d(fine, bounds), wide)
    pieces = _refined(fine, lines, least)
    second = np.flatnonzero(inner)  # of each two neighbours
    pairs = neardup._mix(crc[second - 1] * neardup._A + crc[second])
    at = second + np.repeat(np.arange(len(own)), counts - 1) * _STRONG
    for reach in (_STRONG, _WEAK):
        pieces = _refined(pieces, second[_smallest(pairs, at, reach)], least)
    widths = np.diff(pieces)
    if (widths > _LONGEST + least).any():
        text = np.searchsorted(bounds, pieces[:-1], "right")
        some = np.isin(text, text[widths > _LONGEST + least]) & (widths > _LONGEST)
        pieces = _refined(pieces, np.concatenate([np.arange(a + _LONGEST, a + w, _LONGEST) for a, w in zip(pieces[:-1][some].tolist(), widths[some].tolist())]), least)
    starts, ends = (x - np.repeat(origin[own], counts) for x in (starts, ends))
    return own, starts, ends, h, bounds, paragraphs_, pieces


def _cuts(text: str, least: int, wide: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Places of the words of one text, and the numbers of the words before which its paragraphs and pieces begin, with their ends."""
    _, starts, ends, _, _, paragraphs_, pieces = _cut([text], least, wide)
    return list(zip(starts.tolist(), ends.tolist())), paragraphs_.tolist(), pieces.tolist()


def paragraphs(text: str, least: int) -> list[tuple[int, int, int]]:
    """``(start, end, words)`` in code points of the pieces of a text's paragraphs, of at least ``least`` words."""
    spans, _, pieces = _cuts(text, least, least)
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in zip(pieces, pieces[1:])]


def _set_hashes(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each set, whatever the order of its members."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    more = neardup._mix(sets * neardup._A + neardup._C) >> np.uint64(32)
    return (neardup._mix(np.add.reduceat(neardup._mix(sets + neardup._B), starts)).view(np.int64),
            (np.add.reduceat(more, starts) & np.uint64(2**32 - 1)).astype(np.uint32).view(np.int32))


def _distinct(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``counts`` values from each place in ``first``, sorted, one set after another, and where each begins."""
    owner = np.repeat(np.arange(len(first)), counts)
    before = np.cumsum(counts) - counts
    own = values[np.arange(len(owner)) + np.repeat(first - before, counts)]
    widest = int(counts.max()) if len(counts) else 0
    if widest <= _SIDE_BY_SIDE:
        grid = np.full((len(first), widest), np.uint64(2**64 - 1))
        held = np.arange(widest) < counts[:, None]
        grid[held] = own
        grid.sort(axis=1)  # what fills the rows up stays last
        own = grid[held]
    else:
        order = np.lexsort((own, owner))
        own, owner = own[order], owner[order]
    new = np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1]))[:len(own)]
    return own[new], np.searchsorted(owner[new], np.arange(len(first)))


def _units(least: int, wide: int, k: int, bands: int, seed: int):
    """The pieces, and the paragraphs (number -1) with their band keys; both with their places and the hashes of their shingle sets."""
    names = ("doc_id", "text_key", "no", "start", "end", "words", "p_start")

    def run(batches):
        factors, offsets = neardup.permutations(bands, seed)
        for b in common.slices(batches):
            own, starts, ends, h, bounds, wholes, pieces = _cut(b["text"].to_pylist(), least, wide)
            if not len(own):
                continue
            value = h[:len(h) - k + 1]
            for j in range(1, k):
                value = value * neardup._A + h[j:len(h) - k + 1 + j]
            value = neardup._mix(value + np.uint64(k))
            for cuts, whole in ((pieces, False), (wholes, True)):
                first, after = cuts[:-1], cuts[1:]
                text = np.searchsorted(bounds, first, "right") - 1
                within = np.searchsorted(wholes, first, "right")
                no = np.full(len(first), -1) if whole else np.arange(len(first)) - np.searchsorted(first, bounds)[text]
                docs = pa.array(own[text])
                columns = [b["doc_id"].take(docs), b["text_key"].take(docs), *[pa.array(c, pa.int32()) for c in (
                    no, starts[first], ends[after - 1], after - first, starts[wholes[within - 1]])]]
                sets, at = _distinct(value, first, after - first - k + 1)
                keys, sketch = neardup.signatures(sets, at, factors, offsets, bands) if whole else (np.empty((len(first), 0), np.int64),) * 2
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (keys, sketch)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, _set_hashes(sets, at)), *lists], names=[*names, "h1", "h2", "keys", "sketch"])
    return run


def _slices():
    """The texts of the places of each row."""
    def run(batches):
        for b in common.slices(batches):
            out = [(place["unit"], text[place["start"]:place["end"]])
                   for text, places in zip(b["text"].to_pylist(), b["places"].to_pylist(), strict=True) for place in places]
            yield common.batch({"doc_id": [u for u, _ in out], "text": [t for _, t in out]}, {"doc_id": pa.int64(), "text": pa.string()})
    return run


_DOC = ("doc_id", "text_key")
_PIECE = (*_DOC, "start", "end", "no", "words", "p_start")


def _runs(found: DataFrame) -> DataFrame:
    """``found`` with ``run``, which neighbouring pieces of a document share, and the run's ``n_words``."""
    by_doc = Window.partitionBy(*_DOC).orderBy("start", "end")
    # white space only, or a short sentence, may stand between neighbours
    run = F.sum(F.when(F.col("start") - F.lag("end").over(by_doc) <= 60, 0).otherwise(1)).over(by_doc)
    return found.withColumn("run", run).withColumn("n_words", F.sum("words").over(Window.partitionBy(*_DOC, "run")).cast("long"))


def _alike_paragraphs(rows: DataFrame, paragraphs_: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """``h1, h2, component_id, first_doc_id`` of the paragraphs' sets that are similar (through any chain) to those of another document."""
    signed = common.staged(paragraphs_.groupBy("h1", "h2").agg(
        F.min("unit").alias("node"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.min("label").alias("label"),
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "passage-signatures")

    def texts_of(buckets: DataFrame) -> DataFrame:
        nodes = buckets.select("node").distinct()
        places = common.staged(paragraphs_.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "unit", "start", "end")
                  .join(nodes, F.col("unit") == F.col("node"), "left_semi")
                  .groupBy("d", "t").agg(F.collect_list(F.struct("unit", "start", "end")).alias("places")), "candidate-places")
        own = rows.join(places, (rows["doc_id"] == places["d"]) & (rows["text_key"] == places["t"])).select("text", "places")
        return common.staged(common.map_arrow(own, _slices(), "doc_id long, text string").dropDuplicates(["doc_id"]), "candidate-texts")
    # stored links, which read nothing else
    found = neardup.linked_nodes(signed, texts_of, k, percent, 2 * bands).withColumnRenamed("node", "f_node")
    classes = common.staged(signed.drop("keys", "sketch"), "passage-classes")
    common.unstaged(signed)
    placed = classes.join(found, classes["node"] == found["f_node"], "left").select(
        "h1", "h2", "label", "low", "high", F.coalesce("component", "node").alias("component"))
    across = (placed.groupBy(F.col("component").alias("c")).agg(F.min("label").alias("component_id"), F.min("low").alias("first_doc_id"), F.max("high").alias("last"))
              .filter("first_doc_id < last"))
    return common.staged(placed.join(across, placed["component"] == across["c"]).select("h1", "h2", "component_id", "first_doc_id"), "passage-alike-sets")


def repeated_passages(docs: DataFrame, least_words: int = 20, paragraph_words: int = 6, k: int = 5, percent: int = 80,
                      bands: int = 12, seed: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, n_words, passage_id, first_doc_id, removed, spans``: the passages that repeat across documents.

    A row is a run of neighbouring pieces (of ``paragraph_words`` words at
    least) of a document, of ``least_words`` or more together, each equal in its
    shingles to one of another document; places are code points.  Paragraphs,
    of ``least_words`` or more, that are similar (through any chain) to one of
    another document as a whole, but of which no such run was found, count with
    all their pieces.  ``passage_id`` is a label, the same for pieces of one
    component, and the run's smallest; ``first_doc_id`` is the smallest document
    that has the run's first piece.

    ``spans (start, end, first_doc_id, removed)`` are the run's stretches with
    one first document; they leave out what stands between neighbours, a few
    words at most, and does not repeat.  A stretch is ``removed`` unless the
    document is its first one, and a row if all its stretches are.

    Null and empty texts, and rows with a null id, have none.  Repeated rows of
    one id count as one document; rows that share an id but not their text are
    two texts of one document, which each have their own rows.
    """
    if paragraph_words < k:
        raise ValueError("pieces are shorter than a shingle")
    rows = common.id_text(docs, id_col, text_col).filter("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    columns = ("doc_id long, text_key long, no int, start int, end int, words int, p_start int, h1 long, h2 int, "
               "keys array<long>, sketch array<long>")
    units = common.staged(common.map_arrow(rows, _units(paragraph_words, max(least_words, paragraph_words), k, bands, seed), columns)
                          .withColumn("unit", F.when(F.col("no") < 0, F.monotonically_increasing_id())), "passage-units").withColumn("label", F.xxhash64(*_DOC, "start", "end"))
    pieces, wholes = units.filter("no >= 0").drop("keys", "sketch", "unit"), units.filter("no < 0")

    def placed(of: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The units of ``sets``, stored; those of repeated rows each."""
        sets = sets.withColumnsRenamed({"h1": "s_h1", "h2": "s_h2"}).hint("shuffle_hash")  # the units needn't be sorted for it
        return common.staged(of.join(sets, (of["h1"] == sets["s_h1"]) & (of["h2"] == sets["s_h2"])).select(*_PIECE, "component_id", "first_doc_id"), name)
    # each step is stored, so that no more than one of the joins of all units has its shuffle at a time
    alike = placed(wholes, _alike_paragraphs(rows, wholes, k, percent, bands), "passage-alike")
    repeated = common.staged(pieces.groupBy("h1", "h2").agg(F.min("label").alias("component_id"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
                             .filter("first_doc_id < last").drop("last"), "passage-repeated-sets")
    found = placed(pieces, repeated, "passage-repeats")
    # paragraphs that are alike though none of their pieces shows it
    shown = _runs(found.repartition(*_DOC).dropDuplicates([*_DOC, "start", "end"])).filter(F.col("n_words") >= least_words).select(*_DOC, "p_start").distinct()
    alike = common.staged(alike.join(shown, [*_DOC, "p_start"], "left_anti").select(
        F.col("doc_id").alias("w_doc"), F.col("text_key").alias("w_key"), F.col("p_start").alias("w_start"), "component_id", "first_doc_id").distinct(), "passage-alike-alone").hint("shuffle_hash")
    inside = (pieces.join(alike, (pieces["doc_id"] == alike["w_doc"]) & (pieces["text_key"] == alike["w_key"]) & (pieces["p_start"] == alike["w_start"]))
              .select(*_PIECE, "component_id", "first_doc_id"))
    # a document's pieces meet once; all that follows stays there
    found = (found.unionByName(inside).repartition(*_DOC)
             .groupBy(*_PIECE).agg(F.min("component_id").alias("component_id"), F.min("first_doc_id").alias("first_doc_id")))
    by_run = Window.partitionBy(*_DOC, "run").orderBy("start", "end")
    # a stretch ends where the first document changes, or where anything but white space, which pieces leave out, comes between
    same = (F.col("first_doc_id") == F.lag("first_doc_id").over(by_run)) & (F.col("no") - F.lag("no").over(by_run) <= 1)
    stretches = (_runs(found).filter(F.col("n_words") >= least_words)
                 .withColumn("stretch", F.sum(F.when(same, 0).otherwise(1)).over(by_run)).groupBy(*_DOC, "run", "stretch", "first_doc_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("component_id").alias("component_id"))
        .withColumn("removed", F.col("doc_id") != F.col("first_doc_id")))
    return stretches.groupBy(*_DOC, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("long").alias("n_words"),
        F.min("component_id").alias("passage_id"), F.min_by("first_doc_id", "start").alias("first_doc_id"), F.min("removed").alias("removed"),
        F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id", "removed"))).alias("spans")).drop("run", "text_key")


def _without(columns: list[str], text_col: str):
    def run(batches):
        for b in common.slices(batches):
            out = []
            for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                at, parts = 0, []
                for s in sorted(spans, key=lambda s: s["start"]):
                    parts.append(text[at:s["start"]])
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else b[f"c_{c}"] for c in columns], names=columns)
    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removals of :func:`repeated_passages` cut out of their texts; other rows as they are."""
    gone = (repeated_passages(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("r_id"), F.explode("spans").alias("span"))
            .filter("span.removed").groupBy("r_id").agg(F.collect_list(F.struct("span.start", "span.end")).alias("spans")))
    gone = common.staged(gone, "removals")
    own = docs.select(*[docs[f"`{c}`"].alias(f"c_{c}") for c in docs.columns], docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("text"))
    kept = own.join(gone, own["_id"] == gone["r_id"], "left_anti").select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {'string' if c == text_col else types[c]}" for c in docs.columns)
    return kept.unionByName(common.map_arrow(own.join(gone, own["_id"] == gone["r_id"]).filter("text IS NOT NULL"), _without(docs.columns, text_col), schema))
