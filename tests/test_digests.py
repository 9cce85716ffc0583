from __future__ import annotations

import hashlib

import pytest

from batchloom.errors import ValidationError
from batchloom.sources import digests


def plain_root(content: bytes, block: int, fanout: int) -> str:
    level = [hashlib.sha256(b"\0" + content[i : i + block]).digest() for i in range(0, len(content), block)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + fanout])).digest() for i in range(0, len(level), fanout)]
    return level[0].hex()


CONTENT = {"b": b"x", "c": bytes(range(256)) * 5, "sub/d": b"0123456789" * 300 + b"!", "e": b"y" * 64, "f": b"z" * 65}


def write(folder, content):
    for name, data in content.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    return str(folder)


@pytest.mark.parametrize(("block", "fanout"), [(1, 7), (64, 2), (100, 3), (5000, 64)])
def test_roots_are_the_plain_ones(spark, tmp_path, block, fanout):
    files = digests.listed(spark, write(tmp_path / "x", CONTENT | {"empty": b""}))
    got = digests.roots(digests.tree(digests.blocks(files, block), fanout), files).collect()
    assert {r.name: (r.length, r.root) for r in got} == {n: (len(c), plain_root(c, block, fanout)) for n, c in CONTENT.items()}


def test_roots_do_not_depend_on_tasks(spark, tmp_path):
    files = digests.listed(spark, write(tmp_path / "x", CONTENT))
    leaves = digests.blocks(files, 16)
    one, many = (sorted(map(tuple, digests.tree(leaves.repartition(n), 3).collect())) for n in (1, 13))
    assert one == many
    assert leaves.rdd.getNumPartitions() > 1


def test_a_changed_byte_names_its_block(spark, tmp_path):
    other = dict(CONTENT)
    other["c"] = CONTENT["c"][:700] + b"?" + CONTENT["c"][701:]
    other["sub/d"] = CONTENT["sub/d"] + b"more" * 200
    other["e"] = b""
    del other["b"]
    other["g"] = b"new" * 40
    a, b = (digests.tree(digests.blocks(digests.listed(spark, write(tmp_path / n, c)), 32), 3) for n, c in (("x", CONTENT), ("y", other)))
    want = {(n, i) for n in CONTENT | other for i in range(200) if CONTENT.get(n, b"")[i * 32 : i * 32 + 32] != other.get(n, b"")[i * 32 : i * 32 + 32]}
    assert {(r.name, r.block) for r in digests.differing(a, b, 3).collect()} == want
    assert {n for n, _ in want} == {"c", "sub/d", "e", "b", "g"} and ("c", 21) in want
    assert digests.differing(a, a, 3).count() == 0


def test_bounds_changes_and_empty_folders(spark, tmp_path):
    path = write(tmp_path / "x", {"a": b"abc"})
    files = digests.listed(spark, path)
    assert digests.whole(files).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    for f in (digests.whole, lambda x, most: digests.blocks(x, 2, most)):
        with pytest.raises(ValidationError, match="size bound"):
            f(files, 2)
    stale = spark.createDataFrame(files.collect(), files.schema)
    (tmp_path / "x" / "a").write_bytes(b"abd!")
    with pytest.raises(Exception, match="changed while it was read"):
        digests.blocks(stale, 2).collect()
    none = digests.tree(digests.blocks(files.limit(0)))
    assert none.count() == 0 and digests.differing(none, none).count() == 0
    for bad in (0, True, 1):
        with pytest.raises(ValidationError):
            digests.tree(digests.blocks(files, 2), bad)
