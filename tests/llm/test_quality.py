from __future__ import annotations

from collections import Counter

import duckdb
import pandas as pd

from edge_data import edge_rows, rows_of
from tidemark.llm import quality


def plain_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_counts_equal_brute_force(edges):
    ours = Counter((r[0], *r[1:6]) for r in rows_of(quality.quality(edges)))
    assert ours == Counter((r[0], *plain_counts(r[1])) for r in edge_rows())


def test_edges_equal_sql(edges):
    rows = pd.DataFrame(edge_rows(), columns=["doc_id", "text", "lang", "source", "n_chars"])
    rows["doc_id"] = rows["doc_id"].astype("Int64")
    db = duckdb.connect()
    db.register("documents", rows)
    theirs = Counter(db.execute(quality.sql()).fetchall())
    assert Counter(rows_of(quality.quality(edges))) == theirs


def test_limits_follow_the_group(spark):
    """Long words are ordinary in one language and outside in the other."""
    rows = []
    for i in range(300):
        rows.append((i, " ".join(["word"] * 4 + [f"w{i}{j}" for j in range(30)]), "en", "s"))
        rows.append((1000 + i, " ".join(f"{'x' * 14}{i}z{j}" for j in range(30)), "de", "s"))
    rows.append((5000, " ".join(f"{'x' * 14}q{j}" for j in range(30)), "en", "s"))
    rows.append((5001, " ".join(f"{'x' * 14}q{j}" for j in range(30)), "de", "s"))
    rows.append((5002, " ".join(f"w5{j}***" for j in range(30)), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not verdict.pop(5000) and not verdict.pop(5002)
    assert all(verdict.values())


def test_each_measure_alone_rejects(spark):
    """Every planted text passes the fixed rule and lies outside one limit; near ones stay."""
    own = lambda tag, n: [f"{tag}w{j}" for j in range(n)]
    rows = [(i, " ".join(own(f"n{i}", 40)), "en", "s") for i in range(200)]
    sentence = own("again", 28)
    planted = {
        1001: " ".join("y" * 20 + w for w in own("l", 30)),
        1002: " ".join(own("s", 30)) + " ####" * 3,
        1003: "\n".join(f"{' '.join(own(f'd{k}', 8))}\nsee below" for k in range(6)),
        1004: " ".join(own("a", 70) + sentence + own("b", 70) + sentence + own("c", 60)),
    }
    near = {
        2001: " ".join(own("p", 40)) + "\nsee below\n" + " ".join(own("q", 40)) + "\nsee below",
        2002: " ".join(own("a2", 20) + sentence[:8] + own("b2", 20) + sentence[:8]),
        2003: " ".join(own("e", 30)) + " #",
    }
    rows += [(k, t, "en", "s") for k, t in (planted | near).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality.quality(docs).where("not kept").collect()
    assert {r.doc_id for r in found} == set(planted) and not any(r.base_failed for r in found)
    measured = quality.written(quality.measure(docs), "t")
    bounds = quality.limits(quality.sketches(measured)).first()["bounds"]
    values = {r[0]: r[1:] for r in rows_of(measured.select("_row.doc_id", *[quality._value(m) for m in quality.MEASURES]))}
    for i, key in enumerate(planted):
        outside = [j for j, v in enumerate(values[key]) if not bounds[j].low <= v <= bounds[j].high]
        assert outside == [i], (key, values[key], bounds)


def test_small_groups_take_the_limits_of_the_language(spark):
    rows = [(i, " ".join(f"w{i}a{j}" for j in range(30)), "en", "big") for i in range(200)]
    rows += [(900, " ".join(f"{'y' * 20}{j}" for j in range(30)), "en", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in quality.quality(docs).where("not kept").collect()] == [900]


def test_filter_keeps_whole_rows(edges):
    kept = {r.doc_id for r in quality.quality(edges).where("kept").collect()}
    stayed = quality.filter_documents(edges)
    assert stayed.columns == edges.columns
    assert {r.doc_id for r in stayed.collect()} == kept


def test_bins_hold_their_values(spark):
    values = list(range(300)) + [2**k + d for k in range(8, 40) for d in (-1, 0, 1)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    df = df.withColumn("bin", quality._bin(df.v))
    for v, bin_, top in rows_of(df.withColumn("top", quality._bin_top(df.bin))):
        assert v <= top <= v + max(0, v // 32)


def test_empty(nothing):
    assert rows_of(quality.quality(nothing)) == []
    assert rows_of(quality.filter_documents(nothing)) == []
