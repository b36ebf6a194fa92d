import os
from glob import glob
from inspect import signature
from itertools import combinations

from platewise.llm import common, neardup, passages, queries
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose
from .test_neardup import sets


def sentences(n, seed):
    x, out = seed * 7919 + 3, []
    for _ in range(n):
        words = []
        for _ in range(9):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            words.append(f"w{(x >> 33) % 5000}")
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


def brute(rows, least_words=20):
    """``doc: [words of each run]``: pieces with equal shingles in another document, and paragraphs similar to another's; all pairs."""
    pieces, paragraphs = [], []  # document, start, end, words, shingles, start of the paragraph
    for d, t in rows:
        spans, bounds, cuts = passages._cuts(t or "", 6, least_words)

        def unit(a, z, within, d=d, t=t, spans=spans):
            return d, spans[a][0], spans[z - 1][1], z - a, sets(t[spans[a][0]:spans[z - 1][1]], 5), within
        paragraphs += [unit(a, z, spans[a][0]) for a, z in zip(bounds, bounds[1:])]
        pieces += [unit(a, z, spans[max(x for x in bounds if x <= a)][0]) for a, z in zip(cuts, cuts[1:])]
    holders = {}
    for p in pieces:
        holders.setdefault(frozenset(p[4]), set()).add(p[0])

    def runs(found):
        out, last = {}, {}
        for d, s, e, w, _, within in sorted(found, key=lambda p: p[:3]):
            if not (d in last and s - last[d] <= 60):
                out.setdefault(d, []).append([0, set()])
            out[d][-1][0] += w
            out[d][-1][1].add(within)
            last[d] = e
        return {d: kept for d, rs in out.items() if (kept := [r for r in rs if r[0] >= least_words])}
    equal = [p for p in pieces if len(holders[frozenset(p[4])]) > 1]
    shown = {(d, s) for d, rs in runs(equal).items() for _, held in rs for s in held}
    top = list(range(len(paragraphs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    by_shingle = {}
    for i, u in enumerate(paragraphs):
        for g in u[4]:
            by_shingle.setdefault(g, []).append(i)
    for i, j in {p for held in by_shingle.values() for p in combinations(held, 2)}:
        a, b = paragraphs[i][4], paragraphs[j][4]
        if 100 * len(a & b) >= 80 * len(a | b):
            top[find(i)] = find(j)
    docs = {}
    for i, u in enumerate(paragraphs):
        docs.setdefault(find(i), set()).add(u[0])
    alike = {(u[0], u[1]) for i, u in enumerate(paragraphs) if len(docs[find(i)]) > 1} - shown
    found = {p[:3]: p for p in [*equal, *(p for p in pieces if (p[0], p[5]) in alike)]}
    return {d: [w for w, _ in rs] for d, rs in runs(found.values()).items()}


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in sorted(queries.op6_passages(spark, SF_SMALL).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).append(r["n_words"])
    assert got == brute(rows)


def test_one_id_with_two_texts_and_repeated_rows(spark):
    shared = sentences(6, 31)
    rows = [(1, sentences(9, 32)), (1, f"{sentences(3, 33)} {shared}"), (2, f"{shared} {sentences(4, 34)}"), (2, f"{shared} {sentences(4, 34)}")]
    got = passages.repeated_passages(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA)).collect()
    assert sorted((r["doc_id"], r["first_doc_id"], r["removed"]) for r in got) == [(1, 1, False), (2, 1, True)]
    assert all(40 <= r["n_words"] <= 54 for r in got)


def test_pasted_passages_are_found_and_cut_out(spark):
    passage = sentences(8, 77)
    texts = {i: sentences(20, i) for i in range(30)}
    for i in (3, 9, 21):
        words = texts[i].split()
        texts[i] = " ".join([*words[:40 + i], passage, *words[40 + i:]])
    texts[40] = sentences(2, 5) + " " + sentences(2, 5)  # repeats itself only
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOC_SCHEMA)
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    assert {3, 9, 21} <= set(got) <= {3, 9, 21, 5, 40}
    for i in (3, 9, 21):
        r = got[i]
        assert r["first_doc_id"] == 3 and r["removed"] == (i != 3) and r["n_words"] >= 40
        assert texts[i][r["start"]:r["end"]] in passage or passage[-200:] in texts[i][r["start"]:r["end"]]
    left = passages.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(texts)
    after = {r["doc_id"]: r["text"] for r in left.collect()}
    assert after[3] == texts[3] and len(after[9]) < len(texts[9]) - 200 and after[0] == texts[0]


def test_odd_rows_and_empty(spark):
    assert passages.repeated_passages(odd_docs(spark, extra=("unit", "start", "run", "words"))).collect() == []
    assert passages.without_repeats(odd_docs(spark, extra=("spans",))).count() == len(ODD_ROWS)
    assert passages.repeated_passages(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_passages_without_marks_and_cut_within_sentences(spark):
    texts = {i: prose(150, i) for i in range(24)}
    pasted = {}
    for n in range(6):
        words = sentences(20, 500 + n).split()[4:56]  # from the middle of a sentence to the middle of another
        passage = " ".join(words) if n % 2 else " ".join(words).replace(".", "")
        for i in (2 * n, 2 * n + 1):
            own, at, gap = texts[i].split(), 30 + 7 * i, "\n\n" if n < 3 else " "
            texts[i] = " ".join(own[:at]) + gap + passage + gap + " ".join(own[at:])
            pasted[i] = passage
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOC_SCHEMA)
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == set(pasted)
    for i, r in got.items():
        assert texts[i][r["start"]:r["end"]] in pasted[i] and r["n_words"] >= (46 if i < 6 else 20)
        assert r["removed"] == bool(i % 2) and r["first_doc_id"] == i - i % 2


def test_texts_without_marks_have_short_pieces():
    for text in (prose(3000, 8), prose(3000, 9).replace(" ", "\n"), "same " * 3000):
        pieces = passages.paragraphs(text, 6)
        assert sum(w for *_, w in pieces) == 3000 and all(6 <= w <= 60 for *_, w in pieces)


def test_each_stretch_has_its_own_first_document(spark):
    q, r, own = sentences(4, 901), sentences(4, 902), "Aa bb cc dd ee ff. "
    texts = {2: [sentences(5, 11), q, sentences(5, 12)], 5: [sentences(5, 13), q, r, sentences(5, 14)], 9: [sentences(5, 15), r, sentences(5, 16)],
             11: [sentences(5, 17), q, own, r, sentences(5, 18)]}
    docs = spark.createDataFrame([(i, "\n\n".join(t), "en", "s", 1) for i, t in texts.items()], DOC_SCHEMA)
    rows = passages.repeated_passages(docs)
    got = rows.collect()
    assert {(x["doc_id"], s["first_doc_id"], s["removed"]) for x in got for s in x["spans"]} == {
        (2, 2, False), (5, 2, True), (5, 5, False), (9, 5, True), (11, 2, True), (11, 5, True)}
    assert all(x["removed"] == all(s["removed"] for s in x["spans"]) for x in got)
    left = {x["doc_id"]: x["text"] for x in passages.without_repeats(docs).collect()}
    assert [i for i in left if q in left[i]] == [2] and [i for i in left if r in left[i]] == [5] and own.strip() in left[11]


def near_copies():
    """Pairs of paragraphs of 50 words that differ in the middle one, and share 41 of 51 shingles."""
    for i in range(150):
        words = prose(50, 3000 + i).split()
        yield " ".join(words), " ".join([*words[:24], "changed", *words[25:]])


def test_links_at_the_limit_share_a_band():
    defaults = {k: p.default for k, p in signature(passages.repeated_passages).parameters.items()}
    bands = defaults["bands"]
    factors, offsets = neardup.permutations(bands, defaults["seed"])
    for pair in near_copies():
        a, b = (neardup.band_keys(neardup.min_max(neardup.shingles(t, 5), factors, offsets), bands) for t in pair)
        assert (a == b).any()


def test_every_pair_of_near_copied_paragraphs_is_found(spark):
    texts = {2 * n + m: text for n, pair in enumerate(near_copies()) for m, text in enumerate(pair)}
    assert all(100 * len(a & b) >= 80 * len(a | b) for a, b in ((sets(x, 5), sets(y, 5)) for x, y in near_copies()))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOC_SCHEMA)
    got = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["first_doc_id"] == r["doc_id"] - r["doc_id"] % 2 for r in got)


def test_texts_are_cut_alike_alone_and_together():
    texts = ["", "too short", sentences(9, 3), prose(300, 4).replace(" w", "\n\nw"), "same " * 200, f"　{sentences(5, 6)}\r\n\r\n{prose(90, 7)} \x1c", prose(40, 8)]
    own, starts, ends, _, bounds, wholes, pieces = passages._cut(texts, 6, 20)
    assert own.tolist() == [2, 3, 4, 5, 6]
    for i, a, z in zip(own.tolist(), bounds.tolist(), bounds.tolist()[1:]):
        spans, paragraphs, cuts = passages._cuts(texts[i], 6, 20)
        assert [texts[i][s:e] for s, e in spans] == texts[i].split()
        assert list(zip(starts[a:z].tolist(), ends[a:z].tolist())) == spans
        for of, alone in ((wholes, paragraphs), (pieces, cuts)):
            assert [c - a for c in of.tolist() if a <= c <= z] == alone


def test_no_shuffle_files_and_no_signatures_are_left(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = spark.conf.get(common._CLEANUP, None)

    def shuffles():
        return {os.path.basename(f) for d in blocks.localDirsString() for f in glob(f"{d}/*/shuffle_*.data")}
    before = shuffles()
    stored = common.staged(spark.range(1000).repartition(7), "test")
    assert shuffles() <= before and stored.count() == 1000 and spark.conf.get(common._CLEANUP, None) == setting
    docs = spark.createDataFrame([(i, sentences(9, 5), "en", "s", 1) for i in range(3)], DOC_SCHEMA)
    left = common.shared_folder(spark).removeprefix("file:")
    old = set(glob(f"{left}/passage-*"))
    rows = passages.repeated_passages(docs)
    new = {os.path.basename(f).rpartition("-")[0] for f in set(glob(f"{left}/passage-*")) - old}
    assert "passage-classes" in new and "passage-signatures" not in new
    assert sorted((r["doc_id"], r["removed"]) for r in rows.collect()) == [(0, False), (1, True), (2, True)]
