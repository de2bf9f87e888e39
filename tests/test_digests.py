from __future__ import annotations

import gzip
import hashlib

import pytest

from tidemark.session import settings
from tidemark.sources import captures, digests


def plain_root(body, fan):
    """The tree over lines, level by level."""
    lines = body.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    level = [hashlib.sha256(x).digest() for x in lines]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(d.hex().upper().encode() for d in level[i : i + fan])).digest()
                 for i in range(0, len(level), fan)]
    return level[0].hex(), len(lines)


BODY = b"".join(b"row %d,\xe9\xff,\r%d\r\n" % (i, i * i) for i in range(3000)) + b"\n\nlast without end"


@pytest.mark.parametrize("fan", [3, 1024])
@pytest.mark.parametrize("split", ["64m", "5k", "900b"])
def test_one_root_for_any_split_size(spark, tmp_path, split, fan):
    (tmp_path / "big file+1.csv").write_bytes(BODY)
    (tmp_path / "small.csv").write_bytes(b"a\n")
    cut = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    with settings(spark, cut):
        found = {r.path.split("/")[-1]: r for r in digests.file_digests(spark, str(tmp_path), "*.csv", small=100, fan=fan).collect()}
    root, lines = plain_root(BODY, fan)
    told = f"{root}|{lines}|{len(BODY)}"
    assert found["big file+1.csv"].digest == "tree:" + hashlib.sha256(told.encode()).hexdigest()
    assert found["small.csv"].digest == hashlib.sha256(b"a\n").hexdigest()
    assert {n: r.length for n, r in found.items()} == {"big file+1.csv": len(BODY), "small.csv": 2}


def test_any_change_changes_the_root(spark, tmp_path):
    bodies = [BODY, BODY[:-1], BODY + b"\n", BODY.replace(b"row 7,", b"row 8,"), b"\n".join(sorted(BODY.split(b"\n")))]
    for i, body in enumerate(bodies):
        (tmp_path / f"{i}.csv").write_bytes(body)
    found = digests.file_digests(spark, str(tmp_path), small=0).collect()
    assert len({r.digest for r in found}) == len(bodies)


def test_large_payloads_by_line(spark, tmp_path):
    run = tmp_path / "2098-09-01T00-00-00Z"
    run.mkdir()
    (run / "a.json.gz").write_bytes(gzip.compress(BODY))
    (run / "b.json.gz").write_bytes(gzip.compress(b"{}"))
    found = {r.path: r for r in captures.payload_digests(spark, str(tmp_path), small=60).collect()}
    root, lines = plain_root(BODY, digests.FAN)
    assert found["a.json.gz"].sha256 == f"tree:{root}"
    assert found["a.json.gz"].bytes == len(BODY) - lines + 1
    assert found["b.json.gz"].sha256 == hashlib.sha256(b"{}").hexdigest()


def test_newest_run_without_opening_a_document(spark, tmp_path):
    """The documents are no gzip: reading one would fail."""
    for run in ("2098-09-01T00-00-00Z", "2098-09-01T00-00-00Z.2", "2098-09-01T00-00-00Z.10"):
        folder = tmp_path / run / "element-summary"
        folder.mkdir(parents=True)
        (folder / "1.json.gz").write_bytes(b"broken")
    (tmp_path / "2098-10-01T00-00-00Z").mkdir()
    (tmp_path / "2098-10-01T00-00-00Z" / "bootstrap-static.json.gz").write_bytes(b"broken")
    files = captures.summary_files(spark, str(tmp_path))
    assert files.count() == 3
    assert captures.newest_full_run(files).first().run == "2098-09-01T00-00-00Z.10"
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
    nothing = tmp_path / "none"
    nothing.mkdir()
    assert captures.newest_full_run(captures.summary_files(spark, str(nothing))).count() == 0
