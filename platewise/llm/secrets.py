"""Secret scans with multipart credential linking.

Some parts of a credential mean little alone: forty base64 characters may be
any digest, and most addresses are harmless.  Such weak candidates are
reported only when a complementary part lies in the same scope (a block of
text without an empty line) within ``window`` code points: a key needs an
access identifier, an endpoint needs an access identifier or an assigned
secret.  Candidates come from one pass over the texts; the linking is an
interval join on position bins, where the parts of a bin are reduced to their
first and last position beforehand, so a scope full of parts gives no pairs.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the base kinds, in their order: pattern, group whose length counts, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Hex runs of the least length: the same spans as those of the pattern above that are long enough.
HEX_RUNS = re.compile(r"[0-9a-f]{24,}")
WEAK = {
    "key": re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    "endpoint": re.compile(r"""(?:https?|wss?|amqps?|postgres(?:ql)?|mysql|redis|mongodb|s3)://[^\s"'<>|]{4,}""", re.I | re.A),
}
#: Which parts complement a weak kind.
NEEDS = {"key": ("access",), "endpoint": ("access", "assign")}
ORDER = [*BASE, *WEAK]
EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")

SPAN = "struct<kind: string, start: int, end: int, scope: int>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base kinds: leftmost non-overlapping matches of each, without the short ones."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        for m in (HEX_RUNS if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0]), s[2]))


def candidates(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans and weak candidates with their scopes; texts without a part that could complement give no weak ones."""
    base = base_spans(text)
    weak = []
    kinds = {kind for kind, _, _ in base}
    for kind, pattern in WEAK.items():
        if kinds.intersection(NEEDS[kind]):
            weak += [(kind, m.start(), m.end()) for m in pattern.finditer(text)
                     if not any(s <= m.start() and m.end() <= e for _, s, e in base)]
    if not base:
        return [], []
    breaks = [m.start() for m in EMPTY_LINE.finditer(text)]
    scoped = lambda spans: [{"kind": k, "start": s, "end": e, "scope": bisect.bisect_left(breaks, s)} for k, s, e in spans]
    return scoped(base), scoped(weak)


def _scan(keep: list[str], name: str = "text"):
    def run(batches):
        for b in common.slices(batches):
            both = [candidates(t) for t in common.texts_of(b, name)]
            spans = [pa.array([x[i] for x in both], pa.list_(_SPAN)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *spans], names=[*keep, "base", "weak"])
    return run


def _keyed(docs: DataFrame, name: str = "text") -> DataFrame:
    # rows equal in id and text have equal findings, so this key needs no row number
    text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
    return docs.withColumn("_key", F.xxhash64("doc_id", text)).withColumn("_size", F.octet_length(text))


_KEYS = ["doc_id", "_key", "_size"]


def linked(found: DataFrame, window: int) -> DataFrame:
    """The weak candidates of ``found`` that a complementary part supports, with the position of one such part."""
    parts = sorted({k for need in NEEDS.values() for k in need})
    part = (found.select(*_KEYS, F.explode("base").alias("s")).filter(F.col("s.kind").isin(parts))
            .groupBy(*_KEYS, F.col("s.scope").alias("scope"), F.floor(F.col("s.start") / window).alias("bin"),
                     F.col("s.kind").alias("part"))
            .agg(F.min("s.start").alias("first"), F.max("s.start").alias("last")))
    weak = found.select(*_KEYS, F.explode("weak").alias("s")).distinct()
    at = F.floor(F.col("s.start") / window)
    weak = weak.select(*_KEYS, "s", F.col("s.scope").alias("scope"), F.explode(F.array(at - 1, at, at + 1)).alias("bin"))
    weak = weak.withColumnsRenamed({k: f"w{k}" for k in _KEYS})
    part = part.withColumnsRenamed({"scope": "_scope", "bin": "_bin"})
    same = (weak["scope"] == part["_scope"]) & (weak["bin"] == part["_bin"])
    for k in _KEYS:
        same = same & weak[f"w{k}"].eqNullSafe(part[k])
    allowed = F.lit(False)
    for kind, need in NEEDS.items():
        allowed = allowed | ((F.col("s.kind") == kind) & F.col("part").isin(list(need)))
    gap = lambda c: F.abs(F.col(c) - F.col("s.start"))
    near = F.when(gap("first") <= gap("last"), F.col("first")).otherwise(F.col("last"))
    pairs = weak.join(part, same).withColumn("_near", near).filter(allowed & (F.abs(F.col("_near") - F.col("s.start")) <= window))
    return (pairs.groupBy(*[F.col(f"w{k}").alias(k) for k in _KEYS], "s")
                 .agg(F.min_by("_near", F.struct(F.abs(F.col("_near") - F.col("s.start")), F.col("_near"))).alias("linked_to")))


def _with_linked(found: DataFrame, window: int) -> DataFrame:
    """``found`` with ``spans``: the base spans and the supported weak ones, by start and then kind."""
    support = linked(found, window).groupBy(*[F.col(k).alias(f"l{k}") for k in _KEYS]).agg(F.collect_list("s").alias("_linked"))
    same = F.lit(True)
    for k in _KEYS:
        same = same & found[k].eqNullSafe(support[f"l{k}"])
    kinds = F.array(*[F.lit(k) for k in ORDER])
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["scope"].alias("scope"))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("_linked", F.array().cast(f"array<{SPAN}>"))), place))
    # most rows have no weak candidate and need no join
    without = found.filter(F.size("weak") == 0).withColumn("_linked", F.lit(None).cast(f"array<{SPAN}>"))
    joined = found.filter(F.size("weak") > 0).join(support, same, "left").drop(*[f"l{k}" for k in _KEYS])
    return without.unionByName(joined).withColumn("spans", spans).drop("_linked")


def scan(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row; spans are ``struct<start, place, end, kind, scope>`` in code points.

    ``base`` holds the base kinds, ``spans`` those and the linked weak ones,
    by start and then kind.  Null and empty texts have none.  Repeated rows
    and null ids each give their row.
    """
    rows = _keyed(common.id_text(docs, id_col, text_col))
    found = common.map_arrow(rows, _scan(_KEYS), f"doc_id long, _key long, _size int, base array<{SPAN}>, weak array<{SPAN}>")
    return _with_linked(common.staged(found, "secrets"), window).select("doc_id", "base", "spans")


def digest(scanned: DataFrame) -> DataFrame:
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"),
                          joined("spans").alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every run of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(columns: list[str], text_col: str, name: str):
    def run(batches):
        for b in common.slices(batches):
            texts = [redacted(t, [(s["start"], s["end"], s["kind"]) for s in spans])
                     for t, spans in zip(common.texts_of(b, name), b["spans"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts) if c == text_col else b[f"c_{c}"] for c in columns], names=columns)
    return run


def redact(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each secret in the text replaced by its kind in brackets.

    All rows stay; rows without findings stay as they are (a null text stays
    null).  Only rows with weak candidates are joined with their links.
    """
    own, name = common.carried(docs, text_col)
    rows = _keyed(own.withColumn("doc_id", F.col(f"`c_{id_col}`").cast("long")), name)
    kinds = dict(rows.dtypes)
    found = common.staged(common.map_arrow(rows, _scan(rows.columns, name), ", ".join(f"`{c}` {k}" for c, k in kinds.items())
                                           + f", base array<{SPAN}>, weak array<{SPAN}>"), "secrets-texts")
    back = [F.col(f"`c_{c}`").alias(c) for c in docs.columns]
    clean = found.filter(F.size("base") == 0).select(*back)
    marked = _with_linked(found.filter(F.size("base") > 0), window)
    types = dict(docs.dtypes)
    out = ", ".join(f"`{c}` {'string' if c == text_col else types[c]}" for c in docs.columns)
    return clean.unionByName(common.map_arrow(marked, _redact(docs.columns, text_col, name), out))
