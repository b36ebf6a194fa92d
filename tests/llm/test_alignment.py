import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import alignment, queries
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


@pytest.fixture(scope="module")
def paths():
    return queries.vocabulary("byte_bpe_50k.json")[0], queries.vocabulary("piece_bpe_32k.model")[0]


@pytest.fixture(scope="module")
def library(paths):
    """Ids and token bytes of both sides, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    alphabet = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}

    def sides(text):
        first = a.encode(" " + text, add_special_tokens=False).ids
        second = b.encode(text)
        return ([(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in first],
                [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in second])
    return sides


def ranges(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def aligned(text, sides):
    """Ids of both sides, groups as text, and all pairs of ids whose byte ranges overlap, pair by pair."""
    a, b = sides(text or "")
    data = (" " + (text or "")).encode()
    if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return [], [], [], []
    a, b = ranges(a), ranges(b)
    ends = {e for *_, e in a} & {e for *_, e in b}
    cut = lambda side: [[i for i, *_ in g] for g in parts(side, ends)]
    groups = ["|".join(",".join(map(str, ids)) for ids in pair) for pair in zip(cut(a), cut(b), strict=True)]
    links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 400 else swept(a, b)
    return a, b, groups, links


def parts(side, ends):
    part = []
    for token in side:
        part.append(token)
        if token[2] in ends:
            yield part
            part = []


def swept(a, b):
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


def expected(rows, sides):
    all_of = [(doc, aligned(text, sides)) for doc, text in rows]
    count = Counter(link for _, (*_, links) in all_of for link in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((doc, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, (a, b, groups, links) in all_of), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


TRICKY = ["a  b", " a", "a ", " ", "  ", "a \n\nb", "\t\n\r x", "has ▁ in it", "<|endoftext|> <s>", "x\0y", "日本 語　x　　y", "é  è é", "x\x1c y \x85 z",
          "🙂🙃 don't're", "a" * 5000 + "  " + "b" * 40]


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op13_alignment(spark, SF_SMALL)) == expected([tuple(d) for d in docs], library)


@pytest.mark.parametrize("block_bytes", [1, 1 << 22])
def test_odd_rows(spark, paths, library, block_bytes, monkeypatch):
    rows = ([(r[0], r[1]) for r in ODD_ROWS] + [(100 + i, t) for i, t in enumerate(TRICKY)] + [(200, prose(60_000))]
            + [(300 + i, "same text") for i in range(50)])
    docs = odd_docs(spark, extra=("block", "pair", "number", "n", "groups")).unionByName(
        spark.createDataFrame([(d, t, "", "", 0) for d, t in rows[len(ODD_ROWS):]], DOC_SCHEMA), allowMissingColumns=True)
    out = alignment.alignment(docs.repartition(3), *paths, with_groups=True, block_bytes=block_bytes)
    assert found(out) == expected(rows, library)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in out.collect() if r["groups"])


def test_empty(spark, paths):
    assert alignment.alignment(spark.createDataFrame([], DOC_SCHEMA), *paths).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 'sé日▁\n\t\x1c\x85 !1", max_size=30), max_size=5))
def test_batches_as_the_libraries(paths, library, texts):
    both = alignment.pair(*paths)
    spelled = [library(t) if t and "▁" not in t else ([], []) for t in texts]
    for side, (ids, counts) in enumerate(both.encode(texts)):
        assert ids.tolist() == [i for t in spelled for i, _ in t[side]] and counts.tolist() == [len(t[side]) for t in spelled]
    assert alignment.group_texts(both, alignment.align(both, texts)) == [";".join(aligned(t, library)[2]) for t in texts]


def test_texts_of_a_batch_do_not_meet(paths, monkeypatch):
    """Places hold the document, so one sorted key is enough; links are those of each text alone."""
    both = alignment.pair(*paths)
    texts, calls, join = ["ab cd", "", "x▁y", "cd", " ", "naïve café", "cd ab "], [], alignment.pd.merge_asof
    monkeypatch.setattr(alignment.pd, "merge_asof", lambda *a, **named: calls.append(named) or join(*a, **named))
    got = alignment.align(both, texts)
    assert calls == [{"on": "at"}] * 2
    links = lambda g, d: sorted(zip(g.a_ids[g.links["a"]][g.link_doc == d].tolist(), g.b_ids[g.links["b"]][g.link_doc == d].tolist(), strict=True))
    assert (got.link_doc == got.b_doc[got.links["b"]]).all()
    for i, text in enumerate(texts):
        assert links(got, i) == links(alignment.align(both, [text]), 0)
