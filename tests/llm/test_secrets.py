from __future__ import annotations

import hashlib
import random
import string
import re
from collections import Counter

from edge_data import edge_rows, rows_of
from tidemark.llm import secrets

ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
          r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def base(text):
    spans = plain(text)
    kinds = Counter(k for _, k, _ in spans)
    joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (kinds[0], kinds[1], kinds[2], hashlib.sha256(joined.encode()).hexdigest()), set(filter(None, joined.split(",")))


def held(rows, found):
    """Base columns of every row are those of the patterns, and its spans hold them."""
    assert Counter((k, *base(t)[0]) for k, t in rows) == Counter((r[0], *r[1:5]) for r in found)
    wanted = {}
    for k, t in rows:
        wanted.setdefault(k, []).append(base(t)[1])
    for r in found:
        assert any(w <= set(r[5].split(",")) for w in wanted[r[0]])


def test_edges_equal_brute_force(edges):
    held([r[:2] for r in edge_rows()], rows_of(secrets.scan(edges)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held(rows_of(docs), rows_of(secrets.scan(docs)))


def test_random_texts():
    rng = random.Random(9)
    parts = ["token", "ToKeN", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3,
             "ſecret", "secret", "x.y-z", "\n", "passwd", "é", "=="]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secrets.base_spans(text)[0] == plain(text)


def corpus(rng, n):
    """Ordinary texts, a third with a labelled credential; then unlabelled ones of the same format."""
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    words = ["".join(rng.choice(["th", "er", "on", "in", "ed", "be", "ly"]) for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(n):
        extra = [f' password={hexa(18)} ', f' token = "{hexa(40)}" ', f" {key()} ", "", "", "", "", ""][i % 8]
        rows.append((i, prose() + extra + prose()))
    clean = [(10_000 + i, prose()) for i in range(100)]
    hidden = [(20_000 + i, prose() + f" {hexa(18)} " + prose()) for i in range(20)]
    return rows, clean, hidden


def test_formats_find_what_no_pattern_names(spark):
    rows, clean, hidden = corpus(random.Random(2), 800)
    found = {r.doc_id: r.spans for r in secrets.scan(
        spark.createDataFrame(rows + clean + hidden, "doc_id long, text string")).collect()}
    assert not any(found[k] for k, _ in clean)
    assert not any("format" in found[k] for k, _ in rows)
    assert sum("format" in found[k] for k, _ in hidden) >= 18


def test_automaton_keeps_the_language():
    rng = random.Random(5)
    values = ["AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)) for _ in range(200)]
    model = secrets.learned(values)
    assert len({t for n in model.next for t in n.values()}) < 400 * 20
    good = "AKIA" + "ABCDEFGH23456723"
    assert model.likelihood(good) > model.floor > model.likelihood("thereforeandbecause")


def test_masked(spark, edges):
    masked = secrets.redact(edges)
    assert masked.columns == edges.columns and masked.count() == edges.count()
    texts = dict(edges.where("doc_id is not null").select("doc_id", "text").collect())
    for r in masked.where("doc_id is not null").collect():
        spans = plain(texts[r.doc_id])
        if not spans:
            assert r.text == texts[r.doc_id]
        else:
            assert secrets.MASK in r.text and r.n_chars == len(r.text) and not plain(r.text)


def test_empty(nothing):
    assert rows_of(secrets.scan(nothing)) == []
    assert rows_of(secrets.redact(nothing)) == []


def test_one_repeated_run_leaves_the_ordinary_text(spark):
    """Pairs are counted over all runs, however often one of them occurs."""
    rng = random.Random(3)
    long = ["".join(rng.choice(["th", "er", "on", "in", "ed"]) for _ in range(10)) for _ in range(5)]
    rows = [(i, "x" * 20) for i in range(9000)] + [(9000 + i, w) for i, w in enumerate(long)]
    model = secrets.formats(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = Counter((a, b) for _, w in rows for a, b in zip("^" + w, w + "$"))
    assert {(a, b): n for a, c in model.ordinary.pairs.items() for b, n in c.items()} == expected


def test_formats_in_parts_of_runs_and_in_short_runs(spark):
    rng = random.Random(6)
    rows, clean, _ = corpus(rng, 800)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows += [(5_000 + i, f"then password={hexa(12)} here") for i in range(200)]
    parts = [(20_000 + i, f"see www.thereon.ed/inbely/{hexa(18)}/there.on") for i in range(20)]
    short = [(30_000 + i, f"the inbely {hexa(12)} there") for i in range(20)]
    beside = [(40_000 + i, f"on {'ab12' * 8}/{hexa(18)}") for i in range(20)]
    found = {r.doc_id: r.spans for r in secrets.scan(
        spark.createDataFrame(rows + clean + parts + short + beside, "doc_id long, text string")).collect()}
    assert not any(found[k] for k, _ in clean)
    assert sum("format:26:44" in found[k] for k, _ in parts) >= 18
    assert sum("format:11:23" in found[k] for k, _ in short) >= 16
    assert sum("format:36:54" in found[k] for k, _ in beside) >= 18


def test_formats_among_real_texts(spark):
    """Forty labelled values of each of five formats in the given texts: others of those
    formats are found without a keyword, and texts without a secret are left alone.

    Values that no pattern names count as ordinary text themselves. Where hardly anything
    else is written in their letters, as for capitals here, that hides some of them.
    """
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    draw = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    made = {
        "hex": lambda: draw("0123456789abcdef", 18), "upper": lambda: draw("0123456789ABCDEF", 40),
        "plain": lambda: draw(letters, 24), "dash": lambda: "sk-" + draw(letters, 32), "under": lambda: "ghp_" + draw(letters, 36),
    }
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in given]
    rows += [(100_000 + i, f'{given[i].text} token = "{make()}" end') for i in range(40) for make in made.values()]
    hidden = [(200_000 + 10 * i + k, f"{given[i].text} {make()} end") for i in range(30) for k, make in enumerate(made.values())]
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows + hidden, "doc_id long, text string")).collect()}
    clean = [r.doc_id for r in given if not plain(r.text)]
    assert sum("format" in found[k] for k in clean) <= 0.01 * len(clean)
    recall = [sum("format" in found[200_000 + 10 * i + k] for i in range(30)) / 30 for k in range(5)]
    assert recall[0] >= 0.9 and sum(recall) / 5 >= 0.6, recall


def test_one_labelled_value_is_enough_for_an_automaton(spark):
    rows = [(1, "password=3f9a8c7e6b5d4a3f2e1d"), (2, "ordinary words of an ordinary text here")]
    model = secrets.formats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(model.automata) == 1


def test_runs_are_held_a_piece_at_a_time(monkeypatch):
    """Pieces bound what a worker holds and change neither order nor masks."""
    monkeypatch.setattr(secrets, "PIECE", 50)
    texts = ["token = abcdef123456", "", "plain words " * 9, "AKIA" + "Q7" * 9, "x"] * 7
    parts = list(secrets.pieces(texts))
    assert [t for p in parts for t in p] == texts
    assert all(sum(map(len, p[:-1])) < 50 for p in parts) and len(parts) > 7
    model = secrets.Formats([], secrets.Ordinary({}))
    assert secrets.masked(texts, model) == [m for t in texts for m in secrets.masked([t], model)]
