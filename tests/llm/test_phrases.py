from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from edge_data import rows_of
from tidemark.llm import phrases
from tidemark.llm.common import prepared

SCHEMA = "doc_id long, text string, lang string, phrase string, words int, n long, pack long"


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
        words = [w for w in re.split("[ \t]+", piece) if w]
        if words:
            yield words


def plain(rows, min_count, first=2000):
    """All n-grams of all texts, one by one."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    often = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= min_count}
    hidden = set()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= 80 * f[lang, p[i : i + m]]:
                    hidden.add((lang, p[i : i + m]))
    out = []
    for (lang, p), a in often.items():
        if (lang, p) in hidden:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, l, r in out:
        rank[lang] += 1
        if rank[lang] <= first:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", 1, 2, 3) for i, (t, g) in enumerate(rows)], SCHEMA)


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["Sea", "sky", "a", "of", "été", "ÉTÉ", "x y", "the"]
    out = []
    for _ in range(n):
        body = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t", "  "]) for _ in range(rng.randrange(60)))
        out.append((body, rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("pack_bytes", [300, 1 << 20])
def test_against_plain_counting(spark, monkeypatch, pack_bytes):
    """Many packs and buckets give the rows of one; nulls, repeats and ties included."""
    monkeypatch.setattr(phrases, "PACK_BYTES", pack_bytes)
    monkeypatch.setattr(phrases, "BUCKET_GRAMS", 4000 if pack_bytes == 300 else 2_000_000)
    prepared(spark)
    rows = texts(250)
    rows += [(None, "en"), ("", None), (" \n.. ", "fr"), ("one", "fr")] + rows[:40] * 3
    ours = rows_of(phrases.collocations(frame(spark, rows), min_count=30))
    assert sorted(ours) == sorted(plain(rows, 30))
    assert {r[0] for r in ours} >= {"en", "de", "und"}


def test_first_of_each_language(spark):
    prepared(spark)
    rows = texts(200, 8)
    assert sorted(rows_of(phrases.collocations(frame(spark, rows), min_count=3, first=5))) == sorted(plain(rows, 3, 5))


def test_long_pieces(spark):
    """A text without any mark, and one word repeated: every window or none is a trigger."""
    prepared(spark)
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(30_000)), "en"), ("so " * 5000, "en"), ("no, " * 500, "en")]
    assert sorted(rows_of(phrases.collocations(frame(spark, rows)))) == sorted(plain(rows, 30))


def test_empty_tables(spark, nothing):
    prepared(spark)
    assert rows_of(phrases.collocations(nothing)) == []
    assert rows_of(phrases.collocations(frame(spark, [("", "en"), (None, None)]))) == []


def words_of(chunk):
    return chunk.split()


def test_chunks_are_prefix_free_and_overlap():
    rng = random.Random(1)
    body = "\n".join(" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 200))) for _ in range(50)).encode()
    chunks = phrases.chunks_of(body)
    assert len(chunks) > 200
    distinct = sorted(set(chunks))
    assert not any(b.startswith(a + b" ") for a, b in zip(distinct, distinct[1:]) if not a.endswith(b" "))
    # Joined over their overlaps they give the pieces back.
    back, piece = [], []
    for chunk in chunks:
        words = words_of(chunk)
        assert piece[-3:] == words[: len(piece[-3:])]
        piece = piece + words[3 if piece else 0:]
        if chunk.endswith(b" "):
            back.append(b" ".join(piece))
            piece = []
    assert b"\n".join(back) == body


def test_equal_passages_give_equal_chunks():
    rng = random.Random(4)
    shared = " ".join(rng.choice("abcdefghijkl") for _ in range(400))
    a = phrases.chunks_of(f"one two three {shared} end".encode())
    b = phrases.chunks_of(f"four {shared} other end".encode())
    assert len(set(a) & set(b)) >= len(a) - 4
