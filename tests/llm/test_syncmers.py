import hashlib

import numpy as np

from platewise.llm import queries, syncmers
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


def in_order(rows):
    """By descending id, null ids last, equal ids by text."""
    return sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


def check(got, rows):
    order = in_order(rows)
    want = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        third = len(text) // 3
        new = text[:len(text) - third] + following[:third]
        own, changed, after = (syncmers.sketch(t) for t in (text, new, following))
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), syncmers.to_text(own), syncmers.to_text(changed),
                     syncmers.likeness(own, changed), syncmers.likeness(own, after)))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op9_syncmers(spark, SF_SMALL).collect()
    check(rows, [tuple(d) for d in docs])
    long = [r for r in rows if r["n_chars"] > 300]
    assert np.median([r["near_edited"] for r in long]) > 0.4 and np.median([r["near_next"] for r in long]) < 0.05


def test_odd_rows(spark):
    check(syncmers.compare_with_next(odd_docs(spark, extra=("_key", "range", "visitor"))).collect(), [(r[0], r[1]) for r in ODD_ROWS])


def test_one_row_and_none(spark):
    check(syncmers.compare_with_next(spark.createDataFrame([(5, prose(50), "", "", 0)], DOC_SCHEMA)).collect(), [(5, prose(50))])
    assert syncmers.compare_with_next(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def slow_anchors(text):
    """Closed syncmers by definition, over the hashes of single s-mers."""
    smer = [int(syncmers.smers(np.array([ord(c) for c in text[i:i + syncmers.S]], np.uint64))[0])
            for i in range(len(text) - syncmers.S + 1)]
    w = syncmers.K - syncmers.S + 1
    return [i for i in range(len(text) - syncmers.K + 1) if min(smer[i:i + w]) in (smer[i], smer[i + w - 1])]


def test_anchors_follow_the_definition():
    for text in (prose(80), "a" * 100, "ab" * 60, prose(9)[:syncmers.K], "日本語テキスト" * 20):
        assert syncmers.anchors(text)[1].tolist() == slow_anchors(text)


def test_anchors_need_no_context():
    passage = prose(60, 9)
    a, b = syncmers.anchors(passage), syncmers.anchors(prose(20, 1) + passage + prose(20, 2))
    shift = len(prose(20, 1))
    found = dict(zip(b[1].tolist(), b[0].tolist(), strict=True))
    assert all(found[p + shift] == h for h, p in zip(a[0].tolist(), a[1].tolist(), strict=True))


def test_likeness_bounds_and_text_form():
    for a, b in ((prose(200), prose(200)), ("", ""), ("", "x"), (prose(100), prose(100, 3)), ("ab", "ab")):
        x, y = syncmers.sketch(a), syncmers.sketch(b)
        back = syncmers.from_text(syncmers.to_text(x))
        assert all((p == q).all() for p, q in zip(back, x, strict=True))
        assert 0 <= syncmers.likeness(x, y) == syncmers.likeness(y, x) <= 1
        assert (syncmers.likeness(x, y) == 1) == (a == b)
