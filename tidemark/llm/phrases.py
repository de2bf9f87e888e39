"""Phrases whose words occur together more than apart, by prefix-free parsing.

Every piece of text (between punctuation marks or line breaks) is cut where a hash of the
next three words says so, and each chunk runs on over the three words at its end, which
open the next one. So no chunk is the start of another, cuts depend on content alone, and
equal passages give equal chunks wherever they stand. The distinct chunks of a language
with the number of times each was parsed are the dictionary; n-grams of up to four words
are counted once in each distinct chunk, times its frequency, and an n-gram that starts in
the words that two chunks share belongs to the second.

Few n-grams are frequent, so they are not all shuffled as text. The dictionary is stored in
packs of bounded size. A pack sends 48 bits of hash for each of its n-grams to the bucket
of that hash, sorted and packed as differences, with counts; a bucket adds them up and
answers with one bit for each entry, whether its hash reaches the least count. Only
n-grams that may be frequent then leave the pack as text and are counted exactly; the bits
decide what is sent, never what is counted. Nothing is broadcast and no side of this grows
with the vocabulary beyond a bucket: buckets are as many as the words of the corpus ask for.

A null text is empty, a null language ``und``. Repeated rows count each. Texts without words
and empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder, written

LONGEST = 4
OVERLAP = LONGEST - 1
# One window of three words in this many opens a chunk.
EVERY = 16

MIN_COUNT = 30
SCALE = 2_000_000
COVERED_PERCENT = 80
FIRST = 2000
# Shares that the candidates of a language are dealt to before they are ranked.
SHARES = 64

# Bytes of chunks in a pack, n-grams in a bucket, and bytes parsed at once.
PACK_BYTES = 2 << 20
BUCKET_GRAMS = 2_000_000
PARSE_BYTES = 4 << 20

BITS = 48
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = bytes.maketrans(CAPITALS + BREAKS + b"\t", CAPITALS.lower() + b"\n" * len(BREAKS) + b" ")

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(32))


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of each word, and the line it stands on."""
    buf = np.frombuffer(data, np.uint8)
    line_end = buf == 10
    word = ~(line_end | (buf == 32))
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.cumsum(line_end, dtype=np.int64)[starts]


def _word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and its number among the distinct words."""
    buf = np.frombuffer(data, np.uint8)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return hashes[ids], ids


def chunks_of(data: bytes) -> list[bytes]:
    """Chunks of all pieces (lines) of normalised bytes, words joined by one space.

    A chunk that ends its piece keeps a space at its end; in any other the last three
    words are the first three of the next chunk.
    """
    starts, ends, line = _tokens(data)
    n = len(starts)
    if not n:
        return []
    h, _ = _word_hashes(data, starts, ends)
    opens = np.ones(n, bool)
    opens[1:] = line[1:] != line[:-1]
    if n >= OVERLAP:
        window = _mixed(h[:-2] * _M1 + _mixed(h[1:-1] * _M1 + _mixed(h[2:])))
        opens[: n - 2] |= (window % np.uint64(EVERY) == 0) & (line[:-2] == line[2:])
    first = np.flatnonzero(opens)
    after = np.append(first[1:], n)
    closes = np.ones(len(first), bool)
    closes[:-1] = line[after[:-1]] != line[first[:-1]]
    stop = np.where(closes, after, after + OVERLAP)
    # One space after each word, so that a chunk is a slice.
    buf = np.frombuffer(data + b" ", np.uint8)
    keep = np.zeros(len(buf) + 1, np.int8)
    keep[starts] += 1
    keep[ends + 1] -= 1
    spaced = buf[np.cumsum(keep[:-1], dtype=np.int8).view(bool)].copy()
    at = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    spaced[at[1:] - 1] = 32
    joined = spaced.tobytes()
    return [joined[a:b] for a, b in zip(at[first].tolist(), (at[stop] - ~closes).tolist())]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = defaultdict(list)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column(0).to_pylist(), texts):
            by_lang[lang].append(text)
        for lang, bodies in by_lang.items():
            data = b"\n".join(bodies).translate(_TABLE)
            counts: Counter[bytes] = Counter()
            at = 0
            while at < len(data):
                to = data.find(b"\n", at + PARSE_BYTES)
                to = len(data) if to < 0 else to
                counts.update(chunks_of(data[at:to]))
                at = to
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], names=["lang", "chunk", "n"])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the dictionary in packs: chunks a line each, their language and frequency."""
    partition, seq = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def pack() -> pa.RecordBatch:
        langs = [x for b in held for x in b.column(0).to_pylist()]
        chunks = [x for b in held for x in b.column(1).to_pylist()]
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        at = np.array([number[x] for x in langs], np.int32)
        n = np.array([x for b in held for x in b.column(2).to_pylist()], np.int64)
        body = b"\n".join(chunks)
        return pa.RecordBatch.from_arrays(
            [pa.array([(partition << 32) | seq], pa.int64()), pa.array([names], pa.list_(pa.string())),
             pa.array([body], pa.binary()), pa.array([at.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()),
             pa.array([body.count(b" ") + len(chunks)], pa.int64())],
            names=["pack", "langs", "body", "lang_at", "n", "n_words"])

    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= PACK_BYTES:
            yield pack()
            held, size, seq = [], 0, seq + 1
    if size:
        yield pack()


class _Grams:
    """All n-grams of a pack: first word, length, weight and hash of each."""

    def __init__(self, langs: list[str], body: bytes, lang_at: bytes, n: bytes):
        self.body = body
        self.starts, self.ends, chunk = _tokens(body)
        h, ids = _word_hashes(body, self.starts, self.ends)
        self.ids = ids
        lang = np.frombuffer(lang_at, np.int32)[chunk]
        weight = np.frombuffer(n, np.int64)[chunk]
        lines = np.append(np.flatnonzero(np.frombuffer(body, np.uint8) == 10), len(body))
        closed = np.frombuffer(body, np.uint8)[lines - 1] == 32
        last = np.searchsorted(chunk, np.arange(len(lines)), side="right") - 1
        left = last[chunk] - np.arange(len(chunk))
        counted = closed[chunk] | (left >= OVERLAP)
        salt = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)
        rolling = salt[lang]
        at, size, hashes = [], [], []
        for k in range(LONGEST):
            rolling = _mixed(rolling[: len(h) - k] * _M1 + h[k:]) if len(h) > k else rolling[:0]
            here = np.flatnonzero(counted[: len(rolling)] & (left[: len(rolling)] >= k))
            at.append(here)
            size.append(np.full(len(here), k + 1, np.int8))
            hashes.append(rolling[here])
        self.at, self.size, self.full = np.concatenate(at), np.concatenate(size), np.concatenate(hashes)
        self.weight, self.lang = weight[self.at], lang[self.at]
        # Sorted by hash; equal hashes are one entry.
        order = np.argsort(self.full)
        self.at, self.size, self.full = self.at[order], self.size[order], self.full[order]
        self.weight, self.lang = self.weight[order], self.lang[order]
        short = self.full >> np.uint64(64 - BITS)
        self.first = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
        self.entries = short[self.first]
        self.counts = np.add.reduceat(self.weight, self.first) if len(short) else np.zeros(0, np.int64)
        words = counted.nonzero()[0]
        self.totals = np.bincount(lang[words], weight[words], len(langs)).astype(np.int64) if len(words) else np.zeros(len(langs), np.int64)

    def buckets(self, bits: int) -> Iterator[tuple[int, int, int]]:
        """bucket, and its first and last+1 entry, of the buckets that have entries."""
        of = (self.entries >> np.uint64(BITS - bits)).astype(np.int64)
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
        for a, b in zip(start, [*start[1:], len(of)]):
            yield int(of[a]), int(a), int(b)


def _rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in names)


def _packed_bytes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit words, bytes of equal weight together, which leaves runs of zeros."""
    planes = [np.ascontiguousarray(c).astype(np.uint64).view(np.uint8).reshape(-1, 8).T for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes))


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.uint64).reshape(-1) for c in raw]


def _sender(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, *rest in _rows_of(batches, "pack", "langs", "body", "lang_at", "n"):
            grams = _Grams(*rest)
            found = [(bucket, _packed_bytes(np.diff(grams.entries[a:b], prepend=np.uint64(0)), grams.counts[a:b]))
                     for bucket, a, b in grams.buckets(bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([pack] * len(found), pa.int64()),
                 pa.array([f[1] for f in found], pa.binary())], names=["bucket", "pack", "entries"])

    return send


def _answer(min_count: int):
    def answer(table: pa.Table) -> pa.Table:
        """One bit for each entry of each pack: does its hash reach the least count?"""
        packs = table.column("pack").to_pylist()
        parts = [_unpacked(blob, 2) for blob in table.column("entries").to_pylist()]
        size = np.array([len(p[0]) for p in parts])
        hashes = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        often = np.add.reduceat(counts[order], first) >= min_count
        flags = np.empty(len(hashes), bool)
        flags[order] = np.repeat(often, np.diff(np.append(first, len(hashes))))
        ends = np.cumsum(size)
        bits = [np.packbits(flags[e - s : e]).tobytes() for s, e in zip(size, ends)]
        some = [i for i, b in enumerate(bits) if b.strip(b"\0")]
        return pa.table({
            "pack": pa.array([packs[i] for i in some], pa.int64()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * len(some), pa.int64()),
            "often": pa.array([bits[i] for i in some], pa.binary()),
        })

    return answer


def _reader(bits: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, body, lang_at, n, marks in _rows_of(batches, "langs", "body", "lang_at", "n", "marks"):
            grams = _Grams(langs, body, lang_at, n)
            answers = {m["bucket"]: m["often"] for m in marks or []}
            often = np.zeros(len(grams.entries), bool)
            for bucket, a, b in grams.buckets(bits):
                if bucket in answers:
                    often[a:b] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a).view(bool)
            yield _as_text(grams, langs, often)

    return read


def _as_text(grams: _Grams, langs: list[str], often: np.ndarray) -> pa.RecordBatch:
    """lang, phrase, words and n of the n-grams in ``often``; a row without a phrase has the
    words of a language in all.

    N-grams are one where hash, length, language and all words agree.
    """
    whole = np.flatnonzero(np.repeat(often, np.diff(np.append(grams.first, len(grams.full)))))
    at, size, full, lang, weight = (x[whole] for x in (grams.at, grams.size, grams.full, grams.lang, grams.weight))
    new = np.ones(len(whole), bool)
    if len(whole):
        same = (full[1:] == full[:-1]) & (size[1:] == size[:-1]) & (lang[1:] == lang[:-1])
        final = len(grams.ids) - 1
        for k in range(LONGEST):
            a, b = np.minimum(at[1:] + k, final), np.minimum(at[:-1] + k, final)
            same &= (k >= size[1:]) | (grams.ids[a] == grams.ids[b])
        new[1:] = ~same
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight, first) if len(first) else np.zeros(0, np.int64)
    last = at[first] + size[first] - 1
    body = grams.body
    phrases = [body[a:b] for a, b in zip(grams.starts[at[first]].tolist(), grams.ends[last].tolist())]
    names = [langs[i] for i in lang[first].tolist()] + langs
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(phrases + [None] * len(langs), pa.binary()),
         pa.array(np.append(size[first], np.zeros(len(langs), np.int8)).astype(np.int32)),
         pa.array(np.append(total, grams.totals).astype(np.int64))], names=["lang", "phrase", "words", "n"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, chunk and n: distinct chunks and how often each was parsed."""
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parsed = rows.mapInArrow(_parse, "lang string, chunk binary, n long")
    return parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, words and n of every phrase of up to four words with ``min_count``
    occurrences or more; words 0 and no phrase for the words of a language in all."""
    shape = "pack long, langs array<string>, body binary, lang_at binary, n binary, n_words long"
    path = shared_folder(docs.sparkSession, "phrases-packs")
    # Small row groups, since a reader holds one whole and packs are large rows.
    dictionary(docs, text, lang).mapInArrow(_packs, shape).write.option("parquet.block.size", 16 << 20).parquet(path)
    packs = docs.sparkSession.read.schema(shape).parquet(path)
    words = packs.agg(F.sum("n_words")).first()[0] or 0
    bits = max(words * LONGEST // BUCKET_GRAMS, 1).bit_length()
    given = packs.select("pack", "langs", "body", "lang_at", "n")
    sent = given.mapInArrow(_sender(bits), "bucket long, pack long, entries binary")
    marks = sent.groupBy("bucket").applyInArrow(_answer(min_count), "pack long, bucket long, often binary")
    # As many marks for a pack as it has buckets.
    marks = marks.groupBy("pack").agg(F.collect_list(F.struct("bucket", "often")).alias("marks"))
    joined = given.join(marks.hint("shuffle_hash"), "pack", "left").select("langs", "body", "lang_at", "n", "marks")
    found = joined.mapInArrow(_reader(bits), "lang string, phrase binary, words int, n long")
    exact = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= min_count))
    return written(exact.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "n"), "phrases-counts")


def _cut(phrase: str, start: str, length: str):
    return F.expr(f"array_join(slice(split({phrase}, ' '), {start}, {length}), ' ')")


def scored(counted: DataFrame) -> DataFrame:
    """Candidates with a, l, r and score of their lowest-scoring cut.

    Both parts of a candidate are at least as frequent as it is, so every lookup succeeds.
    A part that very many candidates share is a hot key of the larger side, which adaptive
    execution splits; the other side has each phrase once.
    """
    phrases = counted.where("words > 0").select("lang", "phrase", "words", F.col("n").alias("a"))
    two = phrases.where("words > 1")
    cuts = two.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit(True).alias("left"), _cut("phrase", "1", "k").alias("part")),
        F.struct(F.lit(False).alias("left"), _cut("phrase", "k + 1", "words - k").alias("part")))))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    both = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr(f"cast((cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def covered(counted: DataFrame) -> DataFrame:
    """lang, phrase and longest: the count of the most frequent candidate that contains it."""
    longer = counted.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = longer.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    return inner.select("lang", _cut("phrase", "s", "m").alias("phrase"), "n").groupBy("lang", "phrase").agg(
        F.max("n").alias("longest"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    counted = counts(docs, text, lang, min_count)
    inside = F.col("longest").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * COVERED_PERCENT
    alone = scored(counted).join(covered(counted), ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))
    # The first of each share of a language, then the first of those: no task meets more of a
    # language than ``SHARES`` times as many candidates as are asked for, or one share of all.
    alone = alone.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = alone
    for keys in (["lang", "_share"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        best = best.withColumn("rank", place).where(F.col("rank") <= first)
    totals = counted.where("words = 0").select("lang", "n")
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`collocations`."""
    capitals = CAPITALS.decode()
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM {documents}),
lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i
        FROM (SELECT lang, words, unnest(range(1, {LONGEST + 1})) AS m FROM lists))),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {MIN_COUNT}),
cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(words[1:k], ' ') AS part1, array_to_string(words[k + 1:m], ' ') AS part2
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, (({SCALE}::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.part1 JOIN f y ON y.lang = c.lang AND y.phrase = c.part2
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(words[s:s + len_ - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, m - len_ + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS len_ FROM f WHERE m > 2))
  GROUP BY ALL),
alone AS (
  SELECT s.* FROM scores s LEFT JOIN inner_ i USING (lang, phrase)
  WHERE NOT coalesce(100::HUGEINT * longest >= {COVERED_PERCENT}::HUGEINT * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
       phrase, a, l, r, n, score
FROM alone JOIN totals USING (lang) QUALIFY rank <= {FIRST}
"""
