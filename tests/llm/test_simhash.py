from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from edge_data import edge_rows, rows_of
from tidemark.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Component of every row by comparing all fingerprints with all."""
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    label = {p: p for p in distinct}
    changed = True
    while changed:
        changed = False
        for p in distinct:
            for q in distinct:
                if (p ^ q).bit_count() <= 2 and label[q] < label[p]:
                    label[p], changed = label[q], True
    least = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[label[p]] = min(least.get(label[p], key), key)
    return Counter((key, f"{p:016x}", least.get(label[p])) for (key, _), p in zip(rows, prints))


def test_groups_equal_brute_force(spark, edges):
    expected = plain_groups([r[:2] for r in edge_rows()])
    assert Counter(rows_of(simhash.groups(edges))) == expected


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = plain_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter(rows_of(simhash.groups(docs))) == expected


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_planes_find_all_pairs(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**63, 40, dtype=np.int64)
    prints = np.concatenate([centre] + [c ^ (1 << rng.integers(0, 62, 4)) ^ (1 << rng.integers(0, 62, 4)) for c in centre])
    group = np.sort(rng.integers(0, 3, len(prints)))
    a, b = simhash.close_pairs(prints, group, radius)
    expected = {
        (i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
        if group[i] == group[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius
    }
    assert set(zip(a.tolist(), b.tolist())) == expected


def test_one_small_group():
    prints = np.array([5, 4, 1 << 40], np.int64)
    for n in (1, 2, 3):
        a, b = simhash.close_pairs(prints[:n], np.zeros(n, np.int64))
        assert list(zip(a.tolist(), b.tolist())) == [(0, 1), (1, 2)][: n - 1]


def test_buckets_in_blocks_lose_no_link(spark):
    """A chain of fingerprints in one bucket, dealt into blocks of four."""
    rng = random.Random(5)
    prints, at = [0], 0
    for step in range(60):
        at ^= 1 << (step % 14) | 1 << ((step * 5 + 3) % 14)
        prints.append(at)
    prints = sorted(set(prints)) + [rng.getrandbits(62) for _ in range(20)]
    from tidemark.llm.components import components

    found = components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), block=4))
    label = dict(rows_of(found))
    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= 2:
                assert label.get(p, p) == label.get(q, q)


def test_one_of_each_group_stays(spark, edges):
    kept = simhash.deduplicate(edges)
    assert kept.columns == edges.columns
    groups = {c: n for (_, _, c), n in plain_groups([r[:2] for r in edge_rows()]).items()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(groups.keys())


def test_groups_without_keys_keep_one_row_each(spark):
    texts = ["alpha beta gamma delta", "one two three four five"]
    rows = [(None, t) for t in texts * 3] + [(4, "six seven eight nine"), (4, "six seven eight nine")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        [(None, texts[0]), (None, texts[1]), (4, "six seven eight nine")])


def test_empty(spark, nothing):
    assert rows_of(simhash.groups(nothing)) == []
    assert rows_of(simhash.deduplicate(nothing)) == []
