import json

import pytest

from tallyfeed.plans.verdict import SCHEMA_NAME, agreement, credit, expected_cells, judge_folder, judge_rows, set_reasons


def row(**changes):
    base = {"schema": SCHEMA_NAME, "kind": "GATE_VERDICT", "surface": "s-1", "lane": 1, "cell": "live", "result": "GREEN", "checks": {"c": 0}, "evaluated": {"c": 5}, "scope": "", "params": {}, "content_hash": "sha256:" + "0" * 64, "content_hash_basis": "", "gate_sha": "a" * 40, "gate_worktree": "clean", "ran_at": "2026-01-01T00:00:00Z", "runner": "r"}
    return {k: v for k, v in (base | changes).items() if v is not ...}


def twin(n=1, expected=None, **changes):
    return row(cell="twin", result="RED", checks={"c": n}, planted={"mutation": "m", "mutated_rows": 1, "expected_violations": {"c": n if expected is None else expected}}, **changes)


def reasons(spark, rows):
    """Why each row is refused."""
    table = spark.createDataFrame([(str(i), json.dumps(r, sort_keys=True), None) for i, r in enumerate(rows)], "file string, row string, reason string")
    out = [[] for _ in rows]
    for r in judge_rows(table).collect():
        out[int(r["file"])].append(r["reason"])
    return out


def test_sound_rows(spark):
    rows = [row(), twin(), row(result="UNEVALUABLE", evaluated={"c": 0}, unevaluable_reason="none"), row(rows=3, metrics={"x": 1.5}), row(scope="PARTIALLY", params={"a": ["UNCLAIMEDx"]}), row(lane=1.0)]
    assert reasons(spark, rows) == [[]] * len(rows)


def test_refused_rows(spark):
    cases = [
        ("missing", row(scope=...), "missing required field scope"), ("unknown", row(zz=1), "unknown field zz"), ("pattern", row(surface="S"), "surface must match"),
        ("lane", row(lane=0), "lane must be >= 1"), ("type", row(lane="1"), "lane must be integer"), ("empty", row(checks={}, evaluated={}), "at least 1 key"), ("float", row(evaluated={"c": 1.5}), "evaluated.c must be integer"),
        ("reason", row(result="UNEVALUABLE"), "needs an"), ("no reason", row(unevaluable_reason="x"), "only UNEVALUABLE"), ("plant", row(planted={"mutation": "m", "mutated_rows": 1, "expected_violations": {}}), "nothing planted"),
        ("twin", row(cell="twin", result="RED", checks={"c": 1}), "what was planted"), ("keys", row(evaluated={"d": 1}), "different checks"), ("zero", row(evaluated={"c": 0}), "not UNEVALUABLE: c"),
        ("live", row(checks={"c": 1}), "in spite of"), ("none", twin(0), "without a violation"), ("count", twin(2, 1), "those planted"), ("word", row(params={"k": [{"CLAIMABLE": 1}]}), "only crediting"),
        ("escape", row(scope="é\nPARTIAL"), "only crediting"), ("enum", row(cell="dead"), "cell is none of live, twin"), ("line", row(surface="s\n"), "surface must match"), ("big", row(lane=10**30), ""), ("null", row(scope=None), "scope must be string"),
        ("inner", row(cell="twin", result="RED", checks={"c": 1}, planted={"mutation": "m", "zz": 1, "expected_violations": {"c": -1}}), "missing required field planted.mutated_rows"), ("list", row(params=[]), "params must be object"),
    ]
    for (name, bad, why), found in zip(cases, reasons(spark, [c[1] for c in cases]), strict=True):
        assert any(why in r for r in found) or not why, (name, found)
    deep = reasons(spark, [cases[-2][1]])[0]
    assert {"schema: unknown field planted.zz", "schema: planted.expected_violations.c must be >= 0", "violations differ from those planted"} <= set(deep)


def test_a_folder_is_judged_in_stages(spark, tmp_path):
    """Files that can't be read, rows refused alone, sound rows together, and cells against a list."""
    from tallyfeed.sources.rows import read_rows

    files = {"a": row(), "b": row(lane=2), "c": row(), "d": twin(), "e": twin(), "f": row(lane=0), "g": row(surface="x", result="RED", checks={"c": 1})}
    texts = {k: json.dumps(v) for k, v in files.items()} | {"h": '{"a":NaN}', "i": '{"a":1e400}', "j": '{"a":-Infinity}', "k": '{"a":{"b":1,"b":2}}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    want = spark.createDataFrame([("s-1", 1, ["m", "n"]), ("s-1", 2, []), ("x", 1, []), ("y", 1, [])], "surface string, lane bigint, twins array<string>")
    got = {(r["name"][-6:-5] if r["name"].endswith(".json") else r["name"], r["reason"].split(" already")[0]) for r in judge_folder(read_rows(spark, str(tmp_path)), want).collect()}
    assert got == {
        ("h", "not JSON"), ("i", "not JSON"), ("j", "not JSON"), ("k", "a key is repeated"), ("f", "schema: lane must be >= 1"), ("c", "live row of s-1:lane1"), ("e", "twin m of s-1:lane1"), ("g", "look at it: live data fails"),
        ("s-1:lane1", "other twins than expected"), ("y:lane1", "rows are missing"),
    }


def test_sets_and_credit(spark):
    cells = spark.createDataFrame([("a", "s", 1, "live", "GREEN", None), ("b", "s", 1, "live", "RED", None), ("c", "s", 1, "twin", "RED", "m"), ("d", "s", 1, "twin", "GREEN", "m")], "file string, surface string, lane int, cell string, result string, mutation string")
    assert {(r["file"], r["reason"].split(" ")[0]) for r in set_reasons(cells).collect()} == {("b", "live"), ("b", "look"), ("d", "twin"), ("d", "look")}
    want = spark.createDataFrame([("s", 1, ["m", "n"]), ("t", 1, [])], "surface string, lane int, twins array<string>")
    assert {tuple(r) for r in expected_cells(cells, want).collect()} == {("s", 1, "other twins than expected"), ("t", 1, "rows are missing")}
    rows = spark.createDataFrame(
        [
            ("p", 1, "live", "GREEN", {"x": 0, "y": 0}, None), ("p", 1, "twin", "RED", {"x": 1, "y": 0}, {"x": 1, "y": 0}), ("p", 1, "twin", "RED", {"x": 0, "y": 2}, {"x": 0, "y": 1}),
            ("q", 1, "live", "GREEN", {"x": 0}, None), ("q", 1, "twin", "RED", {"x": 1}, {"x": 1}), ("r", 1, "live", "UNEVALUABLE", {"x": 0}, None), ("s", 2, "live", "GREEN", {"x": 0}, None),
        ],
        "surface string, lane int, cell string, result string, checks map<string,bigint>, expected map<string,bigint>",
    )
    done = credit(rows)
    assert {(r["surface"], r["status"], r["twins"], tuple(r["unfalsified"])) for r in done.collect()} == {("p", "PARTIAL", 2, ("y",)), ("q", "CLAIMABLE", 1, ()), ("r", "UNEVALUABLE", 0, ()), ("s", "PARTIAL", 0, ("x",))}
    assert agreement(done, done).count() == 0 and agreement(done, done.where("surface <> 'q'")).count() == 1


def test_strict_rows(spark, tmp_path):
    from tallyfeed.sources.rows import read_rows

    with pytest.raises(Exception):
        read_rows(spark, str(tmp_path / "none"))
    for name, text in {"a": '{"x":1,"y":[{"z":2}]}', "b": '{"x":1,"x":2}', "c": "[1]", "d": "{", "e": '{"y":{"z":1,"z":1}}', "f": "\xff"}.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode("latin-1"))
    got = {r["file"][-6]: (r["row"], r["reason"]) for r in read_rows(spark, str(tmp_path)).collect()}
    assert got == {"a": ('{"x": 1, "y": [{"z": 2}]}', None), "b": (None, "a key is repeated"), "c": (None, "not an object"), "d": (None, "not JSON"), "e": (None, "a key is repeated"), "f": (None, "not JSON")}
