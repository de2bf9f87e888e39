from __future__ import annotations

import random
import unicodedata

import pytest

from tidemark.fixed_values import UNDECOMPOSED_LETTERS
from tidemark.functions.names import fold_name


def plain_fold(text):
    """The definition as a walk over code points, from a trailing number to the last blank."""
    points = [" " if c == "_" else c for c in text]
    end = len(points) - (1 if points[-1:] == ["\n"] else 0)
    at = end
    while at and points[at - 1].isdecimal():
        at -= 1
    blanks = at
    while blanks and points[blanks - 1].isspace():
        blanks -= 1
    if at < end and blanks < at:
        del points[blanks:end]
    out = []
    for point in points:
        for part in unicodedata.normalize("NFKD", point):
            if unicodedata.combining(part):
                continue
            for low in part.lower():
                if low.isspace():
                    if out and out[-1] != " ":
                        out.append(" ")
                elif not unicodedata.combining(low):
                    out.append(UNDECOMPOSED_LETTERS.get(low, low))
    return "".join(out).rstrip(" ")


def folded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.f for r in rows.orderBy("i").select(fold_name(rows.t).alias("f")).collect()]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Test_Person", "test person"),
        ("Test_Person_41", "test person"),
        ("Đuro Čović", "duro covic"),
        ("Łucja Wąsik", "lucja wasik"),
        ("Bjørn Kjærgård", "bjorn kjaergard"),
        ("  Gro   Harlem ", "gro harlem"),
        ("Weiß Œuvre İstanbul ıı", "weiss oeuvre istanbul ii"),
    ],
)
def test_known_names(spark, raw, expected):
    assert folded(spark, [raw]) == [expected]


def test_agrees_with_the_definition_on_any_text(spark):
    rng = random.Random(11)
    alphabet = (
        "aZ _09\t\n  \x1c" + "éÇñüßøÆ" + "¼½ĲŀŉǄ" + "ﬁ№Å" + "Ωβ Жй" + "한글" + "ȩ́" + "😀ｆ"
    )
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    texts += ["x 12\n", "x 12\n\n", "x ٣٤", "12", "", " 7"]
    assert folded(spark, texts) == [plain_fold(t) for t in texts]


def test_null_stays_null(spark):
    assert folded(spark, [None]) == [None]


def test_nothing_leaves_the_jvm(spark):
    rows = spark.createDataFrame([("Ωβ",)], "t string")
    plan = rows.select(fold_name(rows.t))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
