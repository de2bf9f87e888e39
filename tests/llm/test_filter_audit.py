from __future__ import annotations

import re
from itertools import permutations

import pytest

from edge_data import edge_rows, rows_of
from tidemark.llm import filter_audit
from tidemark.llm.common import prepared

DOCS = "doc_id long, text string, lang string, mask int, part string, prefix string, n long"
LABELS = "doc_id long, quality int, toxic int, mask int, part string"


def failures(rows):
    """The letters that each row fails, and its part."""
    out = []
    for doc, text, lang in rows:
        body = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", body) if w]
        letters = set()
        if len(words) < 100:
            letters.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            letters.add("B")
        if 100 * len(re.findall("[A-Z]", body)) > 10 * len(body):
            letters.add("C")
        if re.search("[#$%&*|]", body):
            letters.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == body for d, t, _ in rows):
            letters.add("E")
        out.append((lang or "", letters))
    return out


def plain(rows, labels):
    """Every order applied to every document, one filter after the other."""
    marks = failures(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = []
    for part in {p for p, _ in marks}:
        here = [(doc, marks[i][1]) for i, (doc, _, _) in enumerate(rows) if marks[i][0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = [x for x in here if letter in x[1]]
                shapley[letter] += len(removed)
                steps.append((part, "".join(order), step, len(left), len(removed), len(failing) - len(removed),
                              sum(x[1] == {letter} for x in here), sum(x[0] in good for x in removed),
                              sum(x[0] in toxic for x in removed)))
        out += [s + (shapley[s[1][s[2] - 1]],) for s in steps]
    return sorted(out)


def ours(spark, rows, labels):
    docs = spark.createDataFrame([r + (1, "x", "y", 2) for r in rows], DOCS)
    marks = spark.createDataFrame([r + (5, "z") for r in labels], LABELS)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(rows_of(filter_audit.audit(docs, marks).select(*names)))


def test_edges(spark):
    """Nulls, repeated rows and labels, equal texts in several parts, one text in most rows."""
    prepared(spark)
    rows = [(r[0], r[1], r[2]) for r in edge_rows()]
    rows += [(1000 + i, "THE SAME # text " * 40, ["en", "fr", None, ""][i % 4]) for i in range(60)]
    rows += [(None, "THE SAME # text " * 40, "en"), (1000, "THE SAME # text " * 40, "en"), (999, "other", "solo")]
    rows += [(2000 + i, " ".join(f"w{i}x{j}" for j in range(100)), "en") for i in range(3)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(1000 + i, 1, 1) for i in range(0, 60, 7)]
    labels += [(3, 0, 1), (3, 1, 0), (None, 1, 1), (5, None, None), (77777, 1, 1), (2001, 1, 1)]
    assert ours(spark, rows, labels) == plain(rows, labels)


def test_at_the_limits(spark):
    """A ratio at its limit passes, one beyond it fails."""
    prepared(spark)
    hundred = " ".join(f"w{j}" for j in range(100))
    rows = [
        (1, hundred, "a"), (2, " ".join(f"v{j}" for j in range(99)), "a"),
        (3, " ".join(f"u{j % 80}" for j in range(100)), "a"), (4, " ".join(f"t{j % 79}" for j in range(100)), "a"),
        (5, "A" * 10 + "b" * 90, "b"), (6, "A" * 11 + "b" * 89, "b"), (7, "É" * 90 + "b" * 10, "b"), (8, hundred, "b"),
    ]
    assert [m for _, m in failures(rows)] == [set(), {"A"}, set(), {"B"}, {"A"}, {"A", "C"}, {"A"}, {"E"}]
    assert ours(spark, rows, [(8, 1, 0)]) == plain(rows, [(8, 1, 0)])


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_empty_tables(spark, labels):
    prepared(spark)
    assert ours(spark, [], labels) == []
    rows = [(1, None, None), (2, "a", None)]
    assert ours(spark, rows, labels) == plain(rows, labels)
    assert len(ours(spark, rows, labels)) == 600
