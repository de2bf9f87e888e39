from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from edge_data import edge_rows, rows_of
from tidemark.llm import packing


def test_round_trip(spark, edges):
    """Pieces put together are the tokens of each text; sequences have no gap or overlap."""
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    pieces = packing.pack(edges, length=64, with_ids=True).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        assert len(p.ids) == p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[p.doc_id].append((p.start, p.ids, p.doc_tokens))
    for number, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        if number != max(sequences):
            assert sum(n for _, n in parts) == 64
    expected = defaultdict(list)
    for key, text, *_ in edge_rows():
        expected[key].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    for key, wanted in expected.items():
        if len(wanted) == 1:
            parts = sorted(texts[key])
            assert sum((ids for _, ids, _ in parts), []) == wanted[0]
            assert {n for *_, n in parts} == {len(wanted[0])}
        else:
            assert sorted(sum((ids for _, ids, _ in texts[key]), [])) == sorted(sum(wanted, []))


def test_words_give_the_ids_of_whole_texts(spark):
    """Over whole texts of the given table, with marks, blanks and special strings."""
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["été ßßß ŉ ſ ĳ ĸ Éa éA µ ª ÿ,ÿ. a.. 'll. x,. ß's ß,", "".join(map(chr, range(0x20, 0x250)))]
    texts += [" ".join(map(chr, range(0x20, 0x250))), "ab. ".join(map(chr, range(0x20, 0x250)))]
    texts += ["a ́b c\x1cd e", "İstanbul ΣΑΣ é", "x<|endoftext|>y <|startoftext|>", "it's we'll ''s 12a3"]
    ours = packing.word_tokens(packing.default_vocabulary()).ids(texts)
    for text, ids in zip(texts, ours):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_hilbert_visits_neighbours():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    key = packing.hilbert(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_sections_keep_their_order(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), str(i % 3)) for i in range(90)], "doc_id long, text string, s string")
    placed = packing.pack(docs, length=32, section="s").collect()
    at = {p.doc_id: p.sequence_id * 32 + p.offset for p in placed if p.start == 0}
    assert max(at[i] for i in at if i % 3 == 0) < min(at[i] for i in at if i % 3 == 1)
    assert max(at[i] for i in at if i % 3 == 1) < min(at[i] for i in at if i % 3 == 2)


def test_empty(spark, nothing):
    assert rows_of(packing.pack(nothing)) == []
