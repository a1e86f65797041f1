import json

import pytest

from tallyfeed.plans.expectations import Malformed, Manifest, emit, expected_cells, twin_sets
from tallyfeed.plans.reread import chain_again
from tallyfeed.sources.rows import read_rows


def test_manifest_paths():
    m = Manifest('{"a":{"n":3,"s":"x","l":["p","q"],"i":[1,2],"planted":{"c":1,"d":0}},"t":true}')
    assert (m.int("a.n"), m.str("a.s"), m.list("a.l", str), m.list("a.i", int), m.planted("a.planted")) == (3, "x", ["p", "q"], [1, 2], {"c": 1, "d": 0})
    for ask in (lambda: m.get("a.z"), lambda: m.get("a.n.x"), lambda: m.int("a.s"), lambda: m.int("t"), lambda: m.list("a.l", int), lambda: m.planted("a.l"), lambda: m.planted("a"), lambda: Manifest("{"), lambda: Manifest('{"a":1,"a":2}')):
        with pytest.raises(Malformed):
            ask()


def test_expected_cells(spark):
    cell = lambda **x: {"surface": "s-1", "lane": 1, "twins": ["b", "a"]} | x
    read = lambda *cells: expected_cells(spark, json.dumps({"cells": cells}))
    assert [tuple(r) for r in read(cell(), cell(lane=2, twins=[])).collect()] == [("s-1", 1, ["a", "b"]), ("s-1", 2, [])]
    for bad in ([cell(), cell()], [cell(twins=["a", "a"])], [cell(twins="a")], [cell(lane=0)], [cell(lane=True)], [cell(lane="1")], [cell(surface="S")], [cell(more=1)], ["x"], [cell(twins=[""])]):
        with pytest.raises(Malformed):
            read(*bad)
    for text in ("[]", "{", '{"cells":[],"x":1}', '{"cells":[{"surface":"s","surface":"t","lane":1,"twins":[]}]}'):
        with pytest.raises(Malformed):
            expected_cells(spark, text)
    rows = spark.createDataFrame([("s-1", 1, "twin", "a"), ("s-1", 1, "live", None), ("s-1", 2, "live", None), ("t", 1, "twin", "m")], "surface string, lane bigint, cell string, mutation string")
    assert {tuple(r) for r in twin_sets(rows, read(cell(), cell(lane=2, twins=[]))).collect()} == {("s-1", 1, "a, b", "a"), ("t", 1, None, "m")}


def test_emitted_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, {"c": 2}, None), ("b", 2, {}, "é")], "name string, lane bigint, checks map<string,bigint>, scope string")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in emit(rows, str(tmp_path / "out")).collect()) == ["a.json", "b.json"]
    assert {json.dumps(json.loads(r["row"])) for r in read_rows(spark, str(tmp_path / "out")).collect()} == {'{"checks": {"c": 2}, "lane": 1}', '{"checks": {}, "lane": 2, "scope": "\\u00e9"}'}


def test_second_reading(spark, tmp_path):
    from .test_ledger_feed import chain, write

    lines, head = chain(40)
    path = write(tmp_path / "feed", [b"\n".join(lines[:25]) + b"\n", b"torn\n" + b"\r\n".join(lines[25:]) + b"\r\n"])
    assert tuple(chain_again(spark, path).first()) == (40, head, None)
    other, _ = chain(40, 1, "1" * 64)
    path = write(tmp_path / "broken", [b"\n".join(lines[:25] + other[25:]) + b"\n"])
    assert chain_again(spark, path).first()["first_break"] == 26
    path = write(tmp_path / "gap", [b"\n".join(lines[:9] + lines[10:]) + b"\n"])
    assert chain_again(spark, path).first()["first_break"] == 11
