"""Near-duplicate detection with min-max hashing.

A document's set of word shingles is hashed under seeded permutations, and
both the smallest and the largest value under each one enter the signature:
half the hash evaluations for a signature of one length, and, as the two
extremes of a permutation rarely agree by the same chance, less variance.
Signatures are cut into bands; documents that share a band are candidates, and
a link is confirmed on the full shingle sets.

Hot groups: documents with equal sets are one class, whatever their number.
Within a bucket the members are compared with one pivot, the member whose
buckets are fullest, which joins a group of near copies in one step.  Members
that are then in different components of one bucket are open: two of them could
still be alike.  Each takes a centre, the pivot of most comparisons, and is reduced to
what sets it apart from that.  Of two with one centre that aren't both like it,
a link needs a large part of these differences in common; a family's shared
text is no part of them.  Members with different centres are held against each
other by their whole sets: alike ones share a shingle among the first fifth of
each.  Both meet by prefix filtering.  The order is by how
many open members hold a shingle: what only one member holds comes first and
meets nobody, and what a large family shares comes last.  Shingles that the
same members hold, as those of a shared passage, are one key.  What meets, has
sizes that allow a link and signatures that a link's could be, is compared on
the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hashes a worker remembers.
MEMO = 250_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), "<u8").astype(np.uint64)


class Words(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


WORDS = Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``k`` words; the whole sequence if it is shorter, none without words.

    Words are runs of characters other than space and U+0009 to U+000D, with A to Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    if not width:
        return h
    run = h[:len(h) - width + 1].copy()
    for j in range(1, width):
        run = run * _A + h[j:len(h) - width + 1 + j]
    return np.unique(_mix(run + np.uint64(width)))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, (2, n), np.uint64)
    return r[0] | np.uint64(1), r[1]


def min_max(shingle_set: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest and largest value of the set under each permutation: ``(permutations, 2)``."""
    out = np.empty((len(factors), 2), np.uint64)
    for at in range(0, len(factors), 16):  # bounds memory on very long texts
        values = factors[at:at + 16, None] * shingle_set + offsets[at:at + 16, None]
        out[at:at + 16, 0], out[at:at + 16, 1] = values.min(1), values.max(1)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of the signature's rows, different between bands."""
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _A
    for column in rows.T:
        key = _mix(key * _A + column)
    return key.view(np.int64)


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """Two bits of each of the signature's values, as longs."""
    low = (_mix(signature.ravel()) & np.uint64(3)).astype(np.uint8)
    bits = np.packbits(np.stack([low & 1, low >> 1], 1).ravel())
    return np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), np.int64)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The :func:`shingles` of each text, one after another, and where each text's begin (and the end)."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(WORDS.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    run, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for width in range(1, k + 1):  # texts of fewer than k words have one run, of all their words
        own = np.flatnonzero(sizes == width) if width < k else np.flatnonzero(sizes >= k)
        if not len(own):
            continue
        counts = sizes[own] - width + 1
        at = np.repeat(first[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        value = h[at]
        for j in range(1, width):
            value = value * _A + h[at + j]
        run.append(_mix(value + np.uint64(width)))
        owner.append(np.repeat(own, counts))
    run, owner = np.concatenate(run), np.concatenate(owner)
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    distinct = np.append(True, (run[1:] != run[:-1]) | (owner[1:] != owner[:-1]))[:len(run)]
    return run[distinct], np.searchsorted(owner[distinct], np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, starts: np.ndarray, factors: np.ndarray, offsets: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketch of each of the sets, which follow each other, none of them empty."""
    signature = np.empty((len(starts), len(factors), 2), np.uint64)
    for i, (factor, offset) in enumerate(zip(factors, offsets, strict=True) if len(starts) else ()):
        values = sets * factor + offset
        signature[:, i, 0] = np.minimum.reduceat(values, starts)
        signature[:, i, 1] = np.maximum.reduceat(values, starts)
    rows = signature.reshape(len(starts), bands, 2 * len(factors) // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _A, rows.shape[:2])
    for column in range(rows.shape[2]):
        key = _mix(key * _A + rows[:, :, column])
    low = (_mix(signature.reshape(len(starts), 2 * len(factors))) & np.uint64(3)).astype(np.uint8)
    bits = np.packbits(np.stack([low & 1, low >> 1], 2).reshape(len(starts), 4 * len(factors)), axis=1)
    return key.view(np.int64), np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.int64)


def _signatures(k: int, bands: int, per_band: int, seed: int):
    def run(batches):
        factors, offsets = permutations(bands * per_band, seed)
        for b in common.slices(batches):
            sets, starts = shingle_sets(b["text"].to_pylist(), k)
            counts = np.diff(starts)
            some = np.flatnonzero(counts)
            key, sketch = signatures(sets, starts[some], factors, offsets, bands)
            ids: list = [None] * len(counts)
            keys: list = [[]] * len(counts)
            sketches: list = [[]] * len(counts)
            for i, at in enumerate(some.tolist()):
                ids[at] = hashlib.blake2b(sets[starts[at]:starts[at + 1]].tobytes(), digest_size=16).digest()
                keys[at], sketches[at] = key[i], sketch[i]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_key"], pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_id", "keys", "sketch"])
    return run


def _compare(k: int):
    """Streams over groups, in each of which the pivot's row comes first: overlaps and sizes."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for b in common.slices(batches):
            out = {"pivot": [], "member": [], "inter": [], "n_pivot": [], "n": []}
            for head, part, member, text in zip(*[b[c].to_pylist() for c in ("pivot", "part", "member", "text")], strict=True):
                own = shingles(text, k)
                if (head, part) != group:
                    group, pivot = (head, part), own
                    continue
                inter = len(np.intersect1d(pivot, own, assume_unique=True))
                for name, value in zip(out, (head, member, inter, len(pivot), len(own)), strict=True):
                    out[name].append(value)
            yield common.batch(out, dict.fromkeys(out, pa.int64()))
    return run


def _differences(k: int):
    """Streams as :func:`_compare` does; also the shingles that one of the two has alone."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for b in common.slices(batches):
            out = {"pivot": [], "member": [], "inter": [], "n_pivot": [], "n": [], "apart": []}
            for head, part, member, text in zip(*[b[c].to_pylist() for c in ("pivot", "part", "member", "text")], strict=True):
                own = shingles(text, k)
                if (head, part) != group:
                    group, pivot = (head, part), own
                    continue
                apart = np.setxor1d(pivot, own, assume_unique=True)
                inter = (len(pivot) + len(own) - len(apart)) // 2
                for name, value in zip(out, (head, member, inter, len(pivot), len(own), apart.view(np.int64)), strict=True):
                    out[name].append(value)
            yield common.batch(out, dict.fromkeys(out, pa.int64()) | {"apart": pa.list_(pa.int64())})
    return run


def _beside(pairs: DataFrame, texts: DataFrame, per_part: int = 1000) -> DataFrame:
    """``pivot, part, member, text`` of ``pairs (pivot, member)``, in each group the pivot's row (member null) first.

    A pivot's members are dealt over parts of about ``per_part``, each with its
    copy of the pivot's text.
    """
    pairs = common.staged(pairs, "pairs")
    sizes = pairs.groupBy(F.col("pivot").alias("p")).agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))
    heads = sizes.select(F.col("p").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = pairs.join(sizes, pairs["pivot"] == sizes["p"]).withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    rows = (members.join(texts, members["member"] == texts["doc_id"]).select("pivot", "part", "member", "text")
            .unionByName(heads.join(texts, heads["pivot"] == texts["doc_id"])
                         .select("pivot", "part", F.lit(None).cast("long").alias("member"), "text")))
    return rows.repartition(F.col("pivot"), F.col("part")).sortWithinPartitions("pivot", "part", F.col("member").asc_nulls_first())


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The full shingle sets of ``pairs (pivot, member)`` compared: ``pivot, member, inter, n_pivot, n``."""
    return common.staged(common.map_arrow(_beside(pairs, texts), _compare(k), "pivot long, member long, inter long, n_pivot long, n long"), "compared")


def _alike(inter, n_a, n_b, percent: int):
    """``100 * intersection >= percent * union``, of exact counts."""
    return inter * (100 + percent) >= (n_a + n_b) * percent


def _may_be_alike(a, b, values: int, percent: int):
    """Whether the sketches differ in no more bits than a link's do but once in 10**10.

    Of ``values`` signature values a link differs in ``1 - percent / 100`` at
    most on average, and a differing value changes each of its two bits by half.
    """
    miss = 1 - percent / 100
    mean, deviation = values * miss, (values * miss * (1 - miss) + values * miss / 2) ** 0.5
    differing = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(-(-2 * values // 64))), F.lit(0))
    return differing <= int(mean + 6.5 * deviation)


def _links(facts: DataFrame, percent: int) -> DataFrame:
    return facts.filter(_alike(F.col("inter"), F.col("n_pivot"), F.col("n"), percent)).select(F.col("pivot").alias("u"), F.col("member").alias("v"))


def _with_company(buckets: DataFrame) -> DataFrame:
    """Rows of ``buckets (key, node)`` that share their key, with the bucket's ``size`` and ``pivot``."""
    sizes = common.staged(buckets.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-keys").hint("shuffle_hash")
    own = common.staged(buckets.join(sizes, buckets["key"] == sizes["k"]).drop("k"), "buckets")
    weight = own.groupBy(F.col("node").alias("w_node")).agg(F.sum("size").alias("weight"))
    weighed = own.join(weight, own["node"] == weight["w_node"])
    pivots = weighed.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    return common.staged(own.join(pivots, own["key"] == pivots["k"]).select("key", "node", "size", (-F.col("top.minus")).alias("pivot")), "pivots")


def _mixed(placed: DataFrame, by: str = "component") -> DataFrame:
    """Rows of ``placed (key, node, component, ..)`` whose key has nodes of several components, or of several values of another column."""
    ends = placed.groupBy(F.col("key").alias("k")).agg(F.min(by).alias("low"), F.max(by).alias("high"))
    return placed.join(ends.filter("low <> high"), placed["key"] == F.col("k"), "left_semi")


def _sets(k: int):
    """The shingles of each text."""
    def run(batches):
        for b in common.slices(batches):
            sets, starts = shingle_sets(b["text"].to_pylist(), k)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(starts), pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sets.view(np.int64)))],
                                             names=["node", "n", "shingles"])
    return run


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``node, component`` of the members of buckets that have several components."""
    # a pair is settled by its comparison; in a bucket of one component there is nothing left to find
    placed = buckets.filter("size > 2").join(found.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left") \
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    return common.staged(_mixed(placed).select("node", "component").distinct(), "open")


def _centred(open_: DataFrame, facts: DataFrame) -> DataFrame:
    """``open_`` with ``centre``: the pivot of most comparisons that a member, or its centre, was compared with.

    A member that differs from its pivots by more shingles than it has is its own centre.
    """
    degrees = facts.groupBy(F.col("pivot").alias("p")).agg(F.count(F.lit(1)).alias("degree"))
    rank = F.struct("degree", (-F.col("p")).alias("minus"))
    near = facts.filter("n_pivot <= 2 * inter").select("pivot", "member")
    best = common.staged(
        near.join(degrees, near["pivot"] == degrees["p"]).select(F.col("member").alias("node"), rank.alias("rank"))
            .unionByName(degrees.select(F.col("p").alias("node"), rank.alias("rank")))
            .groupBy("node").agg((-F.max("rank")["minus"]).alias("centre")), "centres")
    # a centre's centre has more comparisons, so that the steps end; three reach eight pivots on
    for _ in range(3):
        further = best.select(F.col("node").alias("c_node"), F.col("centre").alias("c_centre"))
        best = best.join(further, best["centre"] == further["c_node"]).select("node", F.col("c_centre").alias("centre"))
    best = best.withColumnRenamed("node", "b_node")
    return common.staged(open_.join(best, open_["node"] == best["b_node"], "left")
                         .select("node", "component", F.coalesce("centre", "node").alias("centre")), "centred")


def _by_rarity(held: DataFrame, *by: str) -> DataFrame:
    """``held (node, s, .., size)`` without the shingles of one holder, with ``holders`` and ``who`` they are, and the shingle's ``rank`` among the node's ``size``."""
    shared = (held.groupBy(*[F.col(c).alias(f"h_{c}") for c in by], F.col("s").alias("h_s"))
              .agg(F.count(F.lit(1)).alias("holders"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("holders > 1"))
    same = [held[c] == shared[f"h_{c}"] for c in (*by, "s")]
    both = held.join(shared, same).drop("h_s", *[f"h_{c}" for c in by])
    alone = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("node"))  # these come first
    rank = F.row_number().over(Window.partitionBy("node").orderBy("holders", "who", "s"))
    return both.withColumn("alone", alone).withColumn("rank", rank + F.col("alone"))


def _meeting(open_: DataFrame, texts: DataFrame, sketches: DataFrame, k: int, percent: int, values: int) -> DataFrame:
    """Pairs of open members with different centres, in different components, that prefix filtering, sizes and sketches leave."""
    sets = common.staged(common.map_arrow(texts.join(open_.select("node"), texts["doc_id"] == F.col("node"), "left_semi"), _sets(k),
                                          "node long, n long, shingles array<long>"), "open-sets")
    held = sets.select("node", "n", F.explode("shingles").alias("s"), F.col("n").alias("size"))
    first = (_by_rarity(held).filter(F.col("rank") <= F.floor(F.col("n") * (100 - percent) / 100) + 1)
             .select(F.xxhash64("holders", "who").alias("key"), "node", "n", (F.col("n") - F.col("alone")).alias("n_held")).distinct())
    own = open_.withColumnRenamed("node", "p_node")
    placed = first.join(own, first["node"] == own["p_node"]).drop("p_node").join(sketches, F.col("node") == F.col("s_node")).drop("s_node")
    left = common.staged(_mixed(_mixed(placed), "centre"), "prefixes")
    other = left.withColumnsRenamed({c: f"o_{c}" for c in left.columns})
    # the overlap is no larger than what either one shares with any other
    fits = _alike(F.least("n_held", "o_n_held"), F.col("n"), F.col("o_n"), percent)
    return (left.join(other, (left["key"] == other["o_key"]) & (left["node"] < other["o_node"]) & (left["centre"] != other["o_centre"])
                      & (left["component"] != other["o_component"]) & fits & _may_be_alike(left["sketch"], other["o_sketch"], values, percent))
            .select(F.col("node").alias("pivot"), F.col("o_node").alias("member")).distinct())


def _meeting_apart(open_: DataFrame, apart: DataFrame, sketches: DataFrame, percent: int, values: int) -> DataFrame:
    """Pairs of open members with one centre, in different components, that may be alike by what sets them ``apart`` from it.

    Two sets differ by their differences from a third: by ``size + o_size`` less
    twice what these have in common.  Not more than ``(n + o_n) * (100 -
    percent) / (100 + percent)`` may differ, so a certain part of the two
    differences has to be common: where one is like the centre and the other
    isn't, at least four ninths of either at 80 percent.  Members that are both
    like the centre are linked by it.
    """
    more, less = 100 + percent, 100 - percent
    sized = apart.withColumns({"size": F.size("apart").cast("long"), "near": _alike(F.col("inter"), F.col("n_pivot"), F.col("n"), percent)})
    held = sized.select(F.col("member").alias("node"), F.col("pivot").alias("centre"), "n", "n_pivot", "size", "near", F.explode("apart").alias("s"))
    # what a partner has to share of the difference: one that isn't like the centre, or any one
    least = F.when(F.col("near"), F.floor((F.col("size") * more - (F.col("n") - F.col("n_pivot")) * less) / (2 * more)) + 1) \
        .otherwise(F.ceil((F.col("size") * more - (F.col("n") + F.col("n_pivot")) * less) / 200))
    first = (_by_rarity(held, "centre").filter(F.col("rank") <= F.col("size") - least + 1)
             .groupBy(F.xxhash64("centre", "holders", "who").alias("key"), "node", "n", "size", "near").agg((F.col("size") - F.min("rank") + 1).alias("n_left")))
    own = open_.select(F.col("node").alias("p_node"), "component")
    placed = first.join(own, first["node"] == own["p_node"]).drop("p_node").join(sketches, F.col("node") == F.col("s_node")).drop("s_node")
    far = placed.filter("NOT near").select(F.col("key").alias("f_key"))
    left = common.staged(_mixed(placed).join(far, F.col("key") == F.col("f_key"), "left_semi"), "apart-prefixes")
    other = left.withColumnsRenamed({c: f"o_{c}" for c in left.columns})
    # from the first one that both have on, the overlap is no larger than what is left of either
    fits = F.least("n_left", "o_n_left") * (2 * more) >= (F.col("size") + F.col("o_size")) * more - (F.col("n") + F.col("o_n")) * less
    return (left.join(other, (left["key"] == other["o_key"]) & (left["node"] < other["o_node"]) & ~(left["near"] & other["o_near"])
                      & (left["component"] != other["o_component"]) & fits & _may_be_alike(left["sketch"], other["o_sketch"], values, percent))
            .select(F.col("node").alias("pivot"), F.col("o_node").alias("member")).distinct())


def linked_nodes(classes: DataFrame, texts_of, k: int, percent: int, values: int) -> DataFrame:
    """Components of the classes' nodes: pivots in the bands' buckets, then the open members (see the module's text)."""
    buckets = _with_company(classes.select("node", F.explode("keys").alias("key")))
    texts = texts_of(buckets)
    facts = compared(buckets.filter("node <> pivot").select("pivot", F.col("node").alias("member")).distinct(), texts, k)
    links = _links(facts, percent)
    found = components(links)
    open_ = _open(buckets, found)
    if open_.isEmpty():
        return found
    sketches = classes.groupBy(F.col("node").alias("s_node")).agg(F.first("sketch").alias("sketch"))
    open_ = _centred(open_, facts)
    around = _beside(open_.filter("node <> centre").select(F.col("centre").alias("pivot"), F.col("node").alias("member")), texts)
    apart = common.staged(common.map_arrow(around, _differences(k), "pivot long, member long, inter long, n_pivot long, n long, apart array<long>"), "apart")
    pairs = (_meeting(open_, texts, sketches, k, percent, values)
             .unionByName(_meeting_apart(open_, apart, sketches, percent, values)).distinct())
    more = _links(compared(pairs, texts, k), percent).unionByName(_links(apart, percent))
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, permutations_per_band: int = 2,
                    seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Links join documents whose sets of ``k``-word shingles have a Jaccard
    similarity of at least ``percent`` hundredths; ``component_id`` is the
    smallest id reachable, and ``kept`` marks it.  A band holds the minimum and
    maximum of ``permutations_per_band`` permutations; with the defaults a link
    at a similarity of 0.8 shares none with probability 5e-8.

    Null and empty texts, and texts without words, have empty sets and link
    with nothing.  Repeated rows each give their row, and rows that share an id
    but not their text each get the component of their own text (one of these
    texts stands for the id in comparisons).  Rows with a
    null id follow their equals with an id; without such they stay alone
    (component null) and are kept.
    """
    return _placed(common.id_text(docs, id_col, text_col), k, percent, bands, permutations_per_band, seed).drop("text_key")


def _placed(rows: DataFrame, k: int, percent: int, bands: int, permutations_per_band: int, seed: int) -> DataFrame:
    """:func:`near_duplicates` of ``rows (doc_id, text)``, with ``text_key``, a hash of the whole text."""
    signed = common.staged(common.map_arrow(rows.withColumn("text_key", F.xxhash64("text")), _signatures(k, bands, permutations_per_band, seed),
                                            "doc_id long, text_key long, n_shingles long, set_id binary, keys array<long>, sketch array<long>"), "signatures")
    classes = common.staged(
        signed.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id")
              .agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
              .select("set_id", F.col("least.doc_id").alias("node"), F.col("least.text_key").alias("text_key"), "keys", "sketch"), "classes")

    def texts_of(buckets: DataFrame) -> DataFrame:
        wanted = (classes.join(buckets.select(F.col("node").alias("b_node")).distinct(), F.col("node") == F.col("b_node"), "left_semi")
                  .groupBy(F.col("node").alias("w_id")).agg(F.min("text_key").alias("w_key")))
        keyed = rows.withColumn("_key", F.xxhash64("text"))
        chosen = keyed.join(wanted, (keyed["doc_id"] == wanted["w_id"]) & (keyed["_key"] == wanted["w_key"]), "left_semi")
        return common.staged(chosen.dropDuplicates(["doc_id"]).select("doc_id", "text"), "candidate-texts")
    found = linked_nodes(classes, texts_of, k, percent, 2 * bands * permutations_per_band)
    labels = found.withColumnsRenamed({"node": "l_node"})
    home = (classes.select("set_id", "node").join(labels, F.col("node") == F.col("l_node"), "left")
            .select(F.col("set_id").alias("h_set"), F.coalesce("component", "node").alias("component")))
    out = signed.join(home, signed["set_id"] == home["h_set"], "left")
    # a text without words is its own component
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, permutations_per_band: int = 2,
                 seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one document of each group stays: that with the group's smallest id.

    Of repeated rows one stays.  Texts without words are no one's duplicates;
    rows with a null id stay unless an equal text with an id does.
    """
    rows = common.id_text(docs, id_col, text_col)
    kept = (_placed(rows, k, percent, bands, permutations_per_band, seed).filter("kept")
            .groupBy(F.col("doc_id").alias("_k_id"), F.col("text_key").alias("_k_text")).agg(F.count(F.lit(1)).alias("_k_n")))
    kept = common.staged(kept, "kept")
    own = docs.select(*[docs[f"`{c}`"].alias(f"c_{c}") for c in docs.columns], docs[id_col].cast("long").alias("_id"),
                      F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_text"))

    def meet(keys: DataFrame) -> DataFrame:
        return own.join(keys, own["_id"].eqNullSafe(keys["_k_id"]) & (own["_text"] == keys["_k_text"]), "left_semi")
    # only keys of more than one row need their rows combined, on the map side first
    repeated = meet(kept.filter("_k_n > 1")).dropDuplicates(["_id", "_text"])
    return meet(kept.filter("_k_n = 1")).unionByName(repeated).select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])
