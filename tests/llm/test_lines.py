from __future__ import annotations

import random
from collections import Counter, defaultdict

from edge_data import edge_rows, rows_of, sentence
from tidemark.llm import lines


def plain(rows, min_words=25):
    """Spans of every row from all units held at once."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), defaultdict(list)
    for i in order:
        found = lines.units(rows[i][1] or "")
        flags = []
        for *_, normal in found:
            flags.append(normal in seen)
            seen.add(normal)
        run = []
        for (start, end, normal), flag in zip(found + [(0, 0, "")], flags + [False]):
            if flag:
                run.append((start, end, len(normal.split())))
            else:
                if sum(n for *_, n in run) >= min_words:
                    out[i].append(f"{run[0][0]}:{run[-1][1]}")
                run = []
    return Counter((rows[i][0], ",".join(out[i])) for i in range(len(rows)))


def test_equals_brute_force(spark, edges):
    ours = Counter((r.doc_id, r.spans) for r in lines.repeats(edges).collect())
    # Rows of one key rank by their written order, so compare per key.
    assert ours == plain([r[:2] for r in edge_rows()])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ours = Counter((r.doc_id, r.spans) for r in lines.repeats(docs).collect())
    assert ours == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    own = lambda n: ". ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n)) + "."
    passage = own(8)
    rows = [(i, own(6)) for i in range(20)]
    rows += [(100, own(3) + " " + passage + " " + own(3)), (101, own(2) + "\n" + passage.upper() + "\n" + own(2)),
             (102, "mid line, " + passage + " " + own(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in lines.repeats(docs).collect()}
    assert {k for k, v in found.items() if v} == {101, 102}
    rows_ = rows_of(lines.removals(docs))
    assert {(r[0], f"{r[1]}:{r[2]}") for r in rows_} == {(k, v) for k, v in found.items() if v}
    assert all(r[4] >= 25 for r in rows_)
    texts = {r.doc_id: r.text for r in lines.clean(docs).collect()}
    assert texts[100] == dict(rows)[100]
    assert passage.upper() not in texts[101] and len(texts[101]) < 400
    assert all(texts[i] == t for i, t in rows[:20])


def test_units_cover_the_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a b", ". ", "!", "\n", "?!", " ", "é", "3.5", "...", "\t"]) for _ in range(rng.randrange(30)))
        parts = [(m.start(), m.end()) for m in lines.UNIT.finditer(text) if m.end() > m.start()]
        assert [p for p, _ in parts] == [0] * bool(parts) + [e for _, e in parts[:-1]]
        assert not text or parts[-1][1] == len(text)


def test_clean_keeps_columns_and_rows(edges):
    cleaned = lines.clean(edges)
    assert cleaned.columns == edges.columns
    assert cleaned.count() == edges.count()


def test_long_text_without_ends():
    assert len(lines.units("word " * 200_000)) == 1
    assert sentence(random.Random(1), 3)


def test_empty(nothing):
    assert rows_of(lines.repeats(nothing)) == []
    assert rows_of(lines.clean(nothing)) == []
