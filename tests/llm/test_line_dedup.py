from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from edge_data import edge_rows, rows_of
from tidemark.llm import line_dedup
from tidemark.llm.common import prepared

SCHEMA = "doc_id long, text string, h1 long, _key long, pos int, keep string, n_lines long"


def key_of(line):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, min_docs=3):
    """doc_id, n_lines, n_dropped and the text that is left, row by row."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(doc)
    rank = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 20 or len(holders[key_of(x)]) < min_docs
                or doc == max(holders[key_of(x)], key=rank)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digested(rows):
    return sorted([(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in rows], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "k", 4) for d, t in rows], SCHEMA)


def made(seed=7):
    rng = random.Random(seed)
    shared = [f"line number {i} that many documents hold" for i in range(12)] + ["short", "", "ÀÉ" * 10, "ſ" * 25]
    rows = []
    for i in range(120):
        lines = [rng.choice(shared) for _ in range(rng.randrange(9))] + [f"own line of document {i} alone {j}" for j in range(rng.randrange(3))]
        lines = [rng.choice(["", " ", "\t\x0b"]) + rng.choice([str, str.upper])(x) + rng.choice(["", " ", "\r"]) for x in lines]
        rng.shuffle(lines)
        rows.append((i if i % 11 else None, "\n".join(lines)))
    rows += [rows[3], rows[3], (7, rows[3][1]), (None, None), (500, None), (501, ""), (502, "\n\n")]
    # One line in most rows, and one text of very many lines.
    rows += [(600 + i, f"a licence line that a third of all rows hold\nrest {i}") for i in range(80)]
    rows.append((900, "\n".join(["a licence line that a third of all rows hold", f"single line with number {i}"][i % 2] for i in range(1000))))
    rows.append((5, "\n".join(["a licence line that a third of all rows hold", "x"][i % 200 > 0] for i in range(1000))))
    return rows


@pytest.mark.parametrize("hot_lines", [0, 20, 1_000_000])
def test_against_plain_python(spark, hot_lines):
    """Streamed and summed hashes give the same rows, whichever of them count as hot."""
    prepared(spark)
    rows = made()
    expected = plain(rows)
    assert sum(m for _, _, m, _ in expected) > 100
    docs = frame(spark, rows)
    assert sorted(rows_of(line_dedup.digests(docs, hot_lines=hot_lines)), key=repr) == digested(expected)
    left = [(r.doc_id, r.text or "") for r in line_dedup.clean(docs, hot_lines=hot_lines).collect()]
    assert sorted(left, key=repr) == sorted([(d, t) for d, _, _, t in expected], key=repr)


@pytest.mark.parametrize("min_docs", [1, 2, 4])
def test_other_counts(spark, min_docs):
    prepared(spark)
    rows = made(9)
    for hot in (0, 10**6):
        ours = rows_of(line_dedup.digests(frame(spark, rows), min_docs=min_docs, hot_lines=hot))
        assert sorted(ours, key=repr) == digested(plain(rows, min_docs))


def test_bitmaps(spark):
    """Bits of a row's lines; nothing is stored after its last removed line."""
    prepared(spark)
    rows = made()
    expected = sorted(plain(rows), key=repr)
    ours = sorted(rows_of(line_dedup.bitmaps(frame(spark, rows))), key=repr)
    assert [r[:3] for r in ours] == [r[:3] for r in expected]
    for _, n_lines, n_dropped, keep in ours:
        bits = [(keep[i // 64] >> (i % 64)) & 1 if i // 64 < len(keep) else 1 for i in range(n_lines)]
        assert bits.count(0) == n_dropped
        assert (keep == []) == (n_dropped == 0)
        assert all(word >> 63 & 1 or n_lines > 63 + 64 * i for i, word in enumerate(keep))


def test_columns_and_empty_tables(spark, edges, nothing):
    prepared(spark)
    assert line_dedup.clean(edges).columns == edges.columns
    expected = digested(plain([r[:2] for r in edge_rows()]))
    assert sorted(rows_of(line_dedup.digests(edges)), key=repr) == expected
    for empty in (line_dedup.digests(nothing), line_dedup.bitmaps(nothing), line_dedup.clean(nothing)):
        assert rows_of(empty) == []


def test_nothing_leaves_the_jvm(spark):
    prepared(spark)
    plan = line_dedup.digests(frame(spark, made()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
