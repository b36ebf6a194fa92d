import numpy as np
import pytest

from platewise.llm import decontaminate as D
from platewise.llm import queries
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


def slow_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def brute(docs, items, least_overlap=0.6, least_answer=0.5):
    """Every stretch of every text that could hold an item, without candidates."""
    out = set()
    for doc, text in docs:
        words = D.words_of(text or "")
        for item_id, item_text in items:
            item = D.item_of(item_id, item_text or "")
            n = len(item.words)
            if not n:
                continue
            masks, answer = D.masks_of(item.words), D.masks_of(item.answer)
            for s in range(0, max(1, len(words)), 8):
                stretch = words[s:s + 2 * n + 8]
                if len(set(item.words) & set(stretch)) < least_overlap * len(set(item.words)):
                    continue
                if D.common_length(item.words, masks, stretch) >= least_overlap * n and \
                        D.common_length(item.answer, answer, stretch) >= least_answer * len(item.answer):
                    out.add((doc, item_id))
                    break
    return out


def test_common_length():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = ([bytes([x]) for x in rng.integers(97, 103, n)] for n in rng.integers(1, 90, 2))
        assert D.common_length(a, D.masks_of(a), b) == slow_common_length(a, b)


def test_whole_table_finds_planted_items(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op10_decontamination(spark, SF_SMALL).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    exact = {(d, i) for d, t in docs for i, x in items if b" ".join(D.words_of(x)) in b" ".join(D.words_of(t or ""))}
    assert exact and exact <= pairs == brute(docs, items)


ITEMS = [(i, prose(20 + 12 * i, 100 + i)) for i in range(5)] + [(9, None), (10, ""), (11, "... !")]


@pytest.mark.parametrize("block_words", [30, 20_000])
def test_paraphrases_and_blocks(spark, block_words):
    rng = np.random.default_rng(1)

    def changed(text, share):
        return " ".join(f"other{rng.integers(99)}" if rng.random() < share else w for w in text.split())
    texts = {}
    for i in range(60):
        texts[i] = prose(200, i)
    for i in range(5):
        item = ITEMS[i][1]
        texts[100 + i] = f"{prose(37, i)} {item.upper()}, {prose(90, 50 + i)}"
        texts[200 + i] = f"{prose(75, i)}. {changed(item, 0.15)} {prose(30, 70 + i)}"
        texts[300 + i] = f"{prose(75, i)} {changed(item, 0.75)} {prose(30, 70 + i)}"
    texts[400] = " ".join(["seven"] * 400)
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts.items()], DOC_SCHEMA)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.leaks(docs, benchmark, block_words=block_words).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert {(h + i, i) for h in (100, 200) for i in range(5)} <= pairs
    assert not any(d < 100 or d >= 300 for d, _ in pairs)
    assert all(r["overlap"] == 1 for r in got if r["doc_id"] // 100 == 1)
    left = D.decontaminated(docs, benchmark, block_words=block_words)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in pairs}


def test_latent_space_matches_a_full_svd(spark):
    passages = [D.words_of(prose(32, s)) for s in range(12)] * 3
    vocabulary = np.unique(np.concatenate([D.bins_of(p) for p in passages]))
    rows = np.full(D.BINS, -1)
    rows[vocabulary] = np.arange(len(vocabulary))
    idf = np.ones(D.BINS, np.float32)
    x = np.zeros((len(passages), len(vocabulary)))
    for i, p in enumerate(passages):
        at, w = D._weights(p, rows, idf)
        x[i, at] = w
    df = spark.createDataFrame([(b" ".join(p).decode(),) for p in passages], "passage string").repartition(3)
    space = D.latent_space(df, rows, len(vocabulary), idf, 8)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    assert space.shape == (len(vocabulary), 8)
    assert np.allclose(space.T @ space, np.eye(8), atol=1e-6)
    assert np.allclose(np.linalg.svd(right[:8] @ space)[1], 1, atol=1e-3)


def test_odd_rows_and_empty(spark):
    benchmark = spark.createDataFrame([(1, "plain words don't stop"), (None, "no id here"), (1, "plain words don't stop")], "item_id long, text string")
    docs = odd_docs(spark, extra=("_text", "item_id", "cosine"))
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in D.leaks(docs, benchmark).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (1, 1)]
    assert D.decontaminated(docs, benchmark).count() == len(ODD_ROWS) - 3
    none, no_items = spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(none, benchmark).collect() == [] and D.decontaminated(none, benchmark).collect() == []
    assert D.leaks(docs, no_items).collect() == [] and D.decontaminated(docs, no_items).count() == len(ODD_ROWS)


def test_every_verbatim_copy_of_a_large_benchmark(spark):
    words = [f"t{i}" for i in range(20_000)]
    rng = np.random.default_rng(5)
    items = [(i, " ".join(rng.choice(words, 20))) for i in range(900)]
    texts = {i: f"{prose(21 + i % 16, i)} {item} {prose(40, 900 + i)}" for i, item in items}
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts.items()], DOC_SCHEMA)
    got = D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i, _ in items]
    assert all(r["overlap"] == 1 for r in got)


def test_copied_parts_of_items_count_without_the_answer(spark):
    long, question = prose(200, 40), prose(20, 41)
    items = [(1, long), (2, f"{question}. {prose(15, 42)}"), (3, f"{prose(40, 43)}. the")]
    texts = {1: " ".join(long.split()[70:120]), 2: question, 3: prose(40, 43), 4: prose(50, 44), 5: " ".join(long.split()[70:90])}
    docs = spark.createDataFrame([(d, f"{prose(37, 60 + d)} {t} {prose(45, 70 + d)}", "en", "s", 1) for d, t in texts.items()], DOC_SCHEMA)
    got = D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 3)]
    assert len(D.item_of(3, items[2][1]).answer) == D.LEAST_ANSWER
