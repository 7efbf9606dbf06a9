"""Alignment by segments against a plain version that tokenises whole texts."""

import random
from collections import Counter
from hashlib import sha256

import pytest

from docloom.llm import alignment as al
from docloom.llm.pieces import default_model
from tests.conftest import DATA

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    """doc_id and results of (doc_id, text) rows: whole texts, byte ranges and counts by plain loops."""
    p = al.pair(al.default_a(), default_model())
    docs, count = [], Counter()
    for i, x in rows:
        a = b = []
        if x:
            a = p.a.encode(" " + x, add_special_tokens=False).ids
            b = p.b.encode(x)
            want = (" " + x).encode()
            if b"".join(p.a_bytes[t] for t in a) != want or b"".join(p.b_bytes[t] for t in b) != want:
                a = b = []
        spans = []
        for ids, data in ((a, p.a_bytes), (b, p.b_bytes)):
            at, s = 0, []
            for t in ids:
                s.append((at, at + len(data[t]), t))
                at += len(data[t])
            spans.append(s)
        links, j = [], 0
        for s, e, t in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((t, spans[1][j][2]))
                j += 1
        count.update(links)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for s0, e0, t in s if last <= s0 and e0 <= e) for s in spans) if len(a) < 400 else "")
            last = e
        if len(a) >= 400:  # the same in one pass
            parts, k = [[[], []] for _ in both], {e: n for n, e in enumerate(both)}
            for side in (0, 1):
                n = 0
                for _, e, t in spans[side]:
                    parts[n][side].append(str(t))
                    n = k[e] + 1 if e in k else n
            groups = ["|".join(map(",".join, g)) for g in parts]
        docs.append((i, len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, t), n in count.items():
        top[t] = max(top[t], n)
    return Counter((i, na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), h) for i, na, nb, ng, links, h in docs)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", *COLUMNS).collect())


def test_given_documents_equal_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert result(al.op12_alignment(spark, DATA)) == plain(rows)


HARD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a\n b", "a \n b ", "\n", "a  b", "x▁y", "▁", "<s> </s> <unk>", "<|endoftext|> x<|endoftext|>", "it's we'll 12 345 6,7", "日本語のテキスト 日本", "é é ﬁ İ", "👩‍👩‍👧 ok 🏳️‍🌈", "\x00 a \x1c b \x85 c", "tab\tand\r\nline 　 wide",
    "word " * 3000, "x" * 5000, "ab" * 4000 + " " + "z" * 40, " " * 300 + "end", "end" + " " * 300, "same text", "same text", "​ ﻿   a   b",
]


def hard(spark):
    rng = random.Random(3)
    alphabet = list("abcdeé '.,0189\n\t  ") + [" ", "日", "👍", "́", "'s", "▁", "\x1c", "　", "ß"]
    rows = list(enumerate(HARD)) + [(1000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(300)]
    return [*rows, (None, "no id"), (27, "same text"), (27, "same text")]


def test_hard_texts(spark):
    rows = hard(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(al.aligned(df)) == plain(rows)
    assert al.aligned(df.limit(0)).count() == 0
    extra = df.selectExpr("doc_id", "text", "1 AS id", "2 AS N_A", "'x' AS groups", "3 AS key")
    assert result(al.aligned(extra)) == plain(rows)


@pytest.mark.parametrize("change", [{"HEAD": 0}, {"HEAD": 7, "PAIRS": 0}, {"TEXT_CHARS": 1, "HELD": 3, "CALL_CHARS": 10}, {"HEAD_BYTES": 100}])
def test_every_way_gives_the_same(spark, monkeypatch, change):
    rows = hard(spark)
    for k, v in change.items():
        monkeypatch.setattr(al, k, v)
    assert result(al.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == plain(rows)


def test_segments_are_whole_and_encode_alone():
    p = al.pair(al.default_a(), default_model())
    assert p.cuts
    rng = random.Random(8)
    for _, x in hard(None):
        if x and "▁" not in x:
            parts = al.segments(x)
            assert "".join(" " + y for y in parts) == " " + x
            got = [(a, b) for a, b in p.encoded(parts)]
            assert [t for a, _ in got for t in a] == p.a.encode(" " + x, add_special_tokens=False).ids and [t for _, b in got for t in b] == p.b.encode(x)
    for _ in range(2000):
        x = chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]))
        if x != "▁":
            (a, b), = p.encoded([x])
            assert b"".join(p.a_bytes[t] for t in a) == b"".join(p.b_bytes[t] for t in b) == (" " + x).encode()


def test_vocabularies_that_may_merge_across_blanks_are_not_cut(monkeypatch):
    p = al.Pair(al.default_a(), default_model())
    import json

    settings = json.load(open(al.default_a()))
    proto = open(default_model(), "rb").read()
    assert not p.verified(settings | {"normalizer": {"type": "NFC"}}, proto) and not p.verified(settings | {"pre_tokenizer": None}, proto)
    p.cuts = False
    assert p.of("a b") == ["a b"]


def test_unverified_vocabularies_take_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(al.Pair, "verified", lambda self, a, b: False)
    al.pair.cache_clear()
    run = al._counts(al.default_a(), default_model())
    import pyarrow as pa

    got = list(run(iter([pa.RecordBatch.from_arrays([pa.array(["a b", "a b", "c", None, "▁"])], names=["text"])])))[0].to_pydict()
    assert dict(zip(got["part"], got["n"])) == {"a b": 2, "c": 1, "▁": 1}
    al.pair.cache_clear()
