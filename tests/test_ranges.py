from __future__ import annotations

import io
import random

import pyarrow as pa
import pytest

from batchloom.errors import ValidationError
from batchloom.operators import results
from batchloom.plans import fixtures
from batchloom.sources import ranges
from batchloom.sources.files import result_files
from batchloom.sources.ranges import Budgets, Reading, lines_of, listed

SEEN = ["batch_id", "file_kind", "file_id", "file_line_number", "batch_line_count", "record_count", "record", "newline_terminated"]


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return f"file://{folder}"


FILES = {
    "b1.result.jsonl": b'{"a": 1}\r\n\n  \n{"b": "\xc3\xa9\xe2\x80\xa8x"}\n{"c": 3}',
    "b1.error.jsonl": b'{"e": 1}\n',
    "b2.result.jsonl": b"",
    "b3.error.jsonl": b"\n\n" + b"".join(b'{"n": %d}\n' % i for i in range(40)),
}


def rows(df, names=SEEN):
    return sorted(map(tuple, df.select(*names).collect()))


@pytest.mark.parametrize("size", [1, 2, 7, 30, 1 << 20])
def test_any_range_size_gives_the_same_records(spark, tmp_path, size):
    path = write(tmp_path / "in", FILES)
    assert rows(Reading(listed(spark, path), range_bytes=size).records()) == rows(results.records(result_files(spark, path)))


@pytest.mark.parametrize("chunk", [1, 3, 1 << 18])
def test_lines_of_ranges_are_the_file_s(monkeypatch, chunk):
    monkeypatch.setattr("batchloom.sources.ranges.CHUNK", chunk)
    r = random.Random(chunk)
    for _ in range(150):
        data = "".join(r.choice("ab\n\n") for _ in range(r.randint(0, 40))).encode()
        cuts = sorted({0, len(data), *(r.randint(0, len(data)) for _ in range(4))})
        most = r.choice([2, 100])
        got = [(x.start, x.end, x.raw, x.ended) for a, b in zip(cuts, cuts[1:], strict=False) for x in lines_of(pa.PythonFile(io.BytesIO(data), mode="r"), a, b, most)]
        want, at = [], 0
        for part in data.split(b"\n"):
            ended = at + len(part) < len(data)
            if part or ended:
                want.append((at, at + len(part) + ended, part if len(part) <= most else None, ended))
            at += len(part) + 1
        assert got == want


@pytest.mark.parametrize(("budgets", "line", "name"), [({"line_bytes": 9}, 4, "line_bytes"), ({"batch_lines": 4}, 5, "batch_lines"), ({"batch_records": 3}, 6, "batch_records"), ({"file_bytes": 20}, 0, "file_bytes")])
@pytest.mark.parametrize("size", [3, 1000])
def test_each_budget_stops_at_its_line(spark, tmp_path, budgets, line, name, size):
    path = write(tmp_path / "in", {k: v for k, v in FILES.items() if k.startswith("b1")})
    with pytest.raises(ValidationError) as e:
        Reading(listed(spark, path), Budgets(**budgets), range_bytes=size).records()
    assert e.value.details == {"batch_id": "b1", "budget": name, "at_line": line}


def test_a_line_that_is_no_text(spark, tmp_path):
    path = write(tmp_path / "in", {"b.result.jsonl": b'{"a": 1}\n"\xff"\n'})
    with pytest.raises(ValidationError) as e:
        Reading(listed(spark, path)).records()
    assert (e.value.details["budget"], e.value.details["at_line"]) == ("text", 2)
    for bad in ({"file_bytes": 0}, {"line_bytes": True}):
        with pytest.raises(ValidationError):
            Budgets(**bad)


def test_a_restart_goes_on_from_its_offset(spark, tmp_path):
    """The result file grows, one line is not ended yet, then the error file comes."""
    folder = tmp_path / "in"
    path = write(folder, {"b.result.jsonl": b'{"a": 1}\n\n{"b": 2}\n{"c"'})
    first = Reading(listed(spark, path), range_bytes=4, final=False)
    got, offsets = rows(first.records()), first.offsets()
    assert [r[5] for r in got] == [1, 2] and offsets.head()["bytes"] == 19
    write(folder, {"b.result.jsonl": b'{"a": 1}\n\n{"b": 2}\n{"c": 3}\n', "b.error.jsonl": b'\n{"e": 1}\n'})
    second = Reading(listed(spark, path), offsets=offsets, range_bytes=5)
    assert second.counts.where("file_kind = 'result' AND low < 19").count() == 0  # nothing is read twice
    got += rows(second.records())
    assert sorted(got) == rows(Reading(listed(spark, path)).records())
    third = Reading(listed(spark, path), offsets=second.offsets())
    assert third.records().count() == 0 and rows(third.offsets(), third.offsets().columns) == rows(second.offsets(), second.offsets().columns)
    with pytest.raises(ValidationError) as e:  # what was read before counts against a budget
        Reading(listed(spark, path), Budgets(batch_records=2), offsets=offsets).records()
    assert e.value.details["at_line"] == 4


def test_files_within_a_file(tmp_path):
    (tmp_path / "x").write_bytes(b"skip\na\nbb\nccc\nnot mine\n")
    with ranges._open(f"file://{tmp_path}/x#bytes=5-9") as f:
        assert [(x.start, x.end, x.raw) for x in ranges.lines_of(f, 0, 9, 100)] == [(0, 2, b"a"), (2, 5, b"bb"), (5, 9, b"ccc")]
        assert [x.raw for x in ranges.lines_of(f, 3, 9, 100)] == [b"ccc"]


def test_stored_result_files_are_few(spark, tables):
    found = fixtures.stored_result_files(spark, tables).collect()
    whole = {r.path.partition("#")[0] for r in found}
    most = max(int(r.batch_id.split("-")[1]) for r in found)
    assert len(found) > 30 and len(whole) <= most // 4096 + 1
    want = {(r.batch_id, r.file_kind): r.content.removesuffix("\n") + "\n" for r in fixtures.result_files(spark, tables).collect()}
    for r in found:
        with ranges._open(ranges._uri(r.path)) as f:
            assert f.read(r.length + 1).decode() == want[r.batch_id, r.file_kind] and r.length == len(want[r.batch_id, r.file_kind].encode())
