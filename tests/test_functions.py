import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyfeed.functions.canon import CanonError, Number, decode, encode, strip_line
from tallyfeed.functions.money import relieve, relieve_column
from tallyfeed.operators.compare import leaf_differences, leaves
from tallyfeed.operators.events import payload_hash

BIG = (1 << 63) - 1
#: total cost, sold, held, relieved: fixed values.
RELIEF = [(165050, 120, 300, 66020), (1001, 1, 2, 500), (1003, 1, 2, 502), (1005, 1, 2, 502), (10, 1, 3, 3), (20, 2, 3, 13), (20, 1, 3, 7), (99, 99, 99, 99), (7, 0, 5, 0), (0, 3, 5, 0), (1 << 40, 1 << 20, 1 << 21, 1 << 39), (BIG, BIG - 1, BIG, BIG - 1), (44999999, 1, 30000000, 1)]


def test_relieve(spark):
    assert [relieve(*r[:3]) for r in RELIEF] == [r[3] for r in RELIEF]
    rows = spark.createDataFrame(RELIEF, "c bigint, s bigint, h bigint, want bigint")
    assert [r[0] for r in rows.select(relieve_column(rows.c, rows.s, rows.h)).collect()] == [r[3] for r in RELIEF]
    with pytest.raises(ValueError):
        relieve(1, 2, 1)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text("ab\"\\ /<&~"), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("xy\"", max_size=3), x, max_size=3), max_leaves=8)


@given(JSON)
def test_canonical_form_is_a_fixed_point(x):
    data = encode(x)
    assert encode(decode(data)) == data


def test_canonical_bytes():
    assert encode({"b": 1, "a": [None, True, "<>&/"]}) == b'{"a":[null,true,"<>&/"],"b":1}'
    assert encode(decode(b' {"n":1.0,"e":1e3,"z":-0} trailing')) == b'{"e":1e3,"n":1.0,"z":-0}'
    for bad, why in (({"a": "\t"}, "control character '\\t'"), ({"a": "é"}, "non-ASCII rune 'é'"), ({"é": 1}, "(key)"), ({"a": 1.5}, "unsupported type float at .a"), ([object()], "at [0]")):
        with pytest.raises(CanonError, match=".*") as e:
            encode(bad)
        assert why in str(e.value)
    assert [Number(x).as_int64() for x in ("1", "-1", "1.0", "1e3", str(BIG), str(BIG + 1))] == [1, -1, None, None, BIG, None]
    assert [strip_line(x) for x in (b"a\r\n", b"a\n", b"a\r", b"a\n\n", b"\r\r\n", b"")] == [b"a", b"a", b"a", b"a\n", b"\r", b""]
    assert payload_hash({"a": "é"}) == "" and payload_hash('{"a":1}') == hashlib.sha256(b'{"a":1}').hexdigest()


def test_leaf_differences():
    golden = {"a": {"x": 1, "y": [1, 2]}, "b": None}
    assert leaf_differences(golden, {"a": {"x": 2, "y": [1, 2], "z": 9}, "b": {"k": 1}}) == [("a.x", "1", "2"), ("b", "null", '{"k":1}')]
    assert leaf_differences(golden, {"a": 5}) == [("a.x", "1", "<absent>"), ("a.y", "[1,2]", "<absent>"), ("b", "null", "<absent>")]
    assert len(leaves(golden)) == 3
