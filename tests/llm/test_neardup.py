import random
import re

import pytest

from platewise.llm import components, neardup, queries
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent=80):
    """Component of each row index, over all pairs."""
    own = [sets(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, a in enumerate(own):
        for j in range(i):
            both = len(a & own[j])
            if a and own[j] and 100 * both >= percent * (len(a) + len(own[j]) - both):
                top[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return {doc: (len(own[i]), min(groups[find(i)])) for i, (doc, _) in enumerate(rows)}


def check(df, rows, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == brute(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op4_near_duplicates(spark, SF_SMALL), docs, 4)


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [4, 5])
def test_large_groups_and_chains(spark, seed):
    rng = random.Random(seed)
    base = [prose(120, s) for s in range(4)]
    texts = [edited(base[0], rng.randrange(12), rng) for _ in range(90)]  # near copies about the threshold
    texts += [base[1]] * 60 + [base[1].upper()] * 5
    texts += [edited(base[2], 25, rng) for _ in range(40)]  # alike, but too little
    chain = base[3]
    for _ in range(30):  # each like the one before it only
        chain = edited(chain, 2, rng)
        texts.append(chain)
    common_part = prose(100, 9)  # a family whose strays are alike by what its centre lacks, or by being shorter
    texts += [common_part] + [edited(common_part, 3, rng) for _ in range(30)]
    for _ in range(6):
        sub = edited(common_part, 9, rng)
        texts += [edited(sub, rng.randrange(3), rng) for _ in range(5)]
    for n in range(2, 30, 2):
        words = common_part.split()
        texts += [" ".join(words[n:]), " ".join(words[:-n]), " ".join(words[n // 2:-n // 2] + ["end"])]
    texts += ["", "  \n", "one", "one two three", "ONE two\tthree", None]
    rng.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], DOC_SCHEMA)
    check(neardup.near_duplicates(docs, k=4), rows, 4)


def test_odd_rows(spark):
    got = neardup.near_duplicates(odd_docs(spark, extra=("key", "keys", "node", "pivot", "component"))).collect()
    assert len(got) == len(ODD_ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[3]["n_shingles"], by_id[3]["component_id"], by_id[3]["kept"]) == (0, 3, True)
    assert (by_id[None]["component_id"], by_id[None]["kept"]) == (None, True)
    assert sum(r["doc_id"] == 1 for r in got) == 2
    assert neardup.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_min_max_estimates_are_unbiased():
    words = [prose(200, s) for s in (1, 2)]
    a, b = (neardup.shingles(t, 2) for t in (words[0], words[0][:1200] + words[1][1200:]))
    truth = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    f, o = neardup.permutations(2000, 7)
    same = neardup.min_max(a, f, o) == neardup.min_max(b, f, o)
    assert abs(same.mean() - truth) < 0.03
    # two values of one permutation beat two permutations' minima: their chances are negatively related
    assert (same.mean(1)).var() < same[:, 0].var() / 2 + 0.02


def test_components_of_links(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60, 100)] + [(5, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*edges, (7, 7)], "u long, v long")).collect()}
    parent = {}
    for u, v in edges:
        parent.setdefault(u, {u}), parent.setdefault(v, {v})
        joined = parent[u] | parent[v]
        for n in joined:
            parent[n] = joined
    assert got == {n: min(g) for n, g in parent.items() if len(g) > 1}


def test_family_that_shares_a_fifth_and_passages_shared_by_many(spark):
    rng = random.Random(8)
    middle, passages = prose(40, 70), [prose(45, 80 + n) for n in range(6)]
    texts = [f"{prose(80, 1000 + n)} {middle} {prose(80, 3000 + n)}" for n in range(300)]  # share a fifth, none alike
    for n in range(120):  # made of passages that others hold too, in any order
        texts.append(" ".join(rng.sample(passages, 4)) + " " + prose(3 + n % 9, 5000 + n))
    texts += [" ".join(t.split()[2:]) for t in texts[::25]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], DOC_SCHEMA)
    check(neardup.near_duplicates(docs, k=4), rows, 4)
    check(neardup.near_duplicates(docs, k=5), rows, 5)


@pytest.mark.parametrize("percent", [80, 65])
def test_family_of_strays_meets_by_what_sets_it_apart(spark, monkeypatch, percent):
    rng = random.Random(percent)
    base, block = prose(150, 40), prose(60, 41)
    texts = [base] + [edited(base, rng.randrange(14), rng) for _ in range(260)]  # about half aren't like the base
    for n in range(8):  # like each other by the edits that they share, longer and shorter than the base
        stray = edited(base, 12, rng)
        texts += [edited(stray, rng.randrange(3), rng) for _ in range(3)]
        longer = " ".join([*base.split()[:20 * n], *block.split()[:4 + 7 * n], *base.split()[20 * n:]])
        texts += [longer, edited(longer, 1 + n, rng), " ".join(edited(base, 2, rng).split()[5 * n:])]
    rows = list(enumerate(texts))
    pairs, whole = [], neardup.compared

    def counted(these, *more):
        got = whole(these, *more)
        pairs.append(got.count())
        return got
    monkeypatch.setattr(neardup, "compared", counted)
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], DOC_SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, k=4, percent=percent).collect()}
    assert got == brute(rows, 4, percent)
    assert len({c for _, c in got.values()}) > 20 and len(pairs) == 2
    assert pairs[1] < 2 * len(rows)
