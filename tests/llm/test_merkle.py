import hashlib
import zlib
from itertools import groupby

import pytest

from platewise.llm import merkle, queries
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text, lang, source, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)])


def lowered(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(hashes):
    """The node over all hashes, and each one's ``(before, after)`` siblings level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(at):
            lo = p // 8 * 8
            paths[i].append((hashes[lo:p], hashes[p + 1:lo + 8]))
            at[i] = p // 8
        hashes = [sha(*hashes[k:k + 8]) for k in range(0, len(hashes), 8)]
    return hashes[0], paths


def expected(rows):
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    leaves = sorted(((r, leaf_of(*r)) for r in rows), key=lambda p: (first(p[0][2]), first(p[0][0]), p[1]))
    groups = [list(g) for _, g in groupby(leaves, key=lambda p: p[0][2])]
    trees = [climb([h for _, h in g]) for g in groups]
    if not trees:
        return []
    root, tops = climb([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops, strict=True):
        for (row, leaf), path in zip(group, paths, strict=True):
            doc, text, *rest = row
            bad = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
            fold = leaf_of(doc, lowered(text), *rest) if bad else leaf
            for before, after in [*path, *top]:
                fold = sha(*before, fold, *after)
            proof = sha(*[h for before, after in [*path, *top] for h in (*before, *after)])
            out.append((doc, leaf, subroot, root, proof, fold, fold == root))
    return out


def found(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()]


def by_text(rows):
    return sorted(rows, key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = found(queries.op11_merkle(spark, SF_SMALL))
    assert by_text(got) == by_text(expected([tuple(d) for d in docs]))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_odd_rows(spark):
    docs = odd_docs(spark, extra=("tree", "pos", "run", "up", "size", "members", "root"))
    assert by_text(found(merkle.manifest(docs))) == by_text(expected(ODD_ROWS))


@pytest.mark.parametrize("groups", [[1], [8], [9], [1, 1], [65, 1, 8, 9], [1] * 10, [3] * 70 + [130]])
def test_shapes(spark, groups):
    """Single leaves, full and short runs, more groups than one run holds, groups of unlike depth."""
    rows = [(g * 1000 + i, f"Text {g} {i}", f"lang{g:03d}" if g else None, None, i) for g, n in enumerate(groups) for i in range(n)]
    assert by_text(found(merkle.manifest(spark.createDataFrame(rows, DOC_SCHEMA)))) == by_text(expected(rows))


def test_very_long_text_and_empty_table(spark):
    rows = [(1, prose(60_000), "en", "a", 1), (2, "É" * 200_000 + "A", "en", "a", 2), (3, "", "en", "a", 0)]
    assert by_text(found(merkle.manifest(spark.createDataFrame(rows, DOC_SCHEMA)))) == by_text(expected(rows))
    assert merkle.manifest(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_recursion_limit_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOC_SCHEMA))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_sql_agrees(spark):
    import duckdb

    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    rows = sql.execute(queries.ORACLE["op11_merkle"]).fetchall()
    docs = sql.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    assert by_text(rows) == by_text(expected(docs))
