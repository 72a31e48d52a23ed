"""The incremental JSON reader against the json module, on any portions."""

import json
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.sources import json_stream as j

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=6), v, max_size=4), max_leaves=12,
)


def flat(value, at=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flat(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flat(v, f"{at}/{i}")
    else:
        yield at, value


def read(data, size, piece=1 << 20):
    out = {}
    for at, part, kind, text in j.Parser(iter([data[i : i + size] for i in range(0, len(data), size)]), piece).values():
        if kind == "string":
            assert (part > 0) == (at in out)
            out[at] = out.get(at, "") + text
        else:
            out[at] = {"object": {}, "array": []}[kind] if kind in ("object", "array") else None if kind == "null" else json.loads(text)
    return out


@given(VALUES, st.integers(1, 9), st.booleans(), st.sampled_from([None, 2]), st.integers(30, 60))
@settings(max_examples=300, deadline=None)
def test_any_document_in_any_portions(value, size, ascii_only, indent, piece):
    data = json.dumps(value, ensure_ascii=ascii_only, indent=indent).encode()
    assert read(data, size, piece) == dict(flat(value))


@pytest.mark.parametrize("text", ["\U00010000" * 9, "\x1f\x1f\x1f\x07\U00010000\U00010000\x1f", "\\ud800" * 12, "\\\U00010000" * 9, "a\U0001f600\U0001f600" * 9])
def test_pairs_of_surrogates_stay_whole(text):
    for lead in range(12):
        for piece in range(30, 42):
            value = "x" * lead + text
            assert read(json.dumps([value]).encode(), 1, piece) == {"/0": value}


@given(VALUES, st.data())
@settings(max_examples=300, deadline=None)
def test_broken_documents(value, draw):
    """A byte less or another byte: an error exactly when the json module has one, at a place in the document."""
    data = bytearray(json.dumps(value, ensure_ascii=False).encode())
    at = draw.draw(st.integers(0, len(data) - 1))
    data[at : at + 1] = draw.draw(st.sampled_from([b"", b"}", b"]", b",", b":", b'"', b"x", b"\\", b"\x01", b"\xff", b"0", b" "]))
    try:
        expected = json.loads(bytes(data).decode())
    except ValueError:
        expected = ValueError
    try:
        got = read(bytes(data), 7)
    except j.Broken as error:
        got = ValueError
        assert 0 <= error.offset <= len(data)
    if expected is ValueError or len({p for p, _ in flat(expected)}) == len(list(flat(expected))):
        assert got == (expected if expected is ValueError else dict(flat(expected)))


@pytest.mark.parametrize("text,offset", [('{"a": 1,, }', 8), ("[1, 2", 5), ('{"a" 1}', 5), ("[01]", 1), ("", 0), ('["a\tb"]', 3), ("[1] x", 4), ('["\\ud83d', 8), ("[tru]", 1)])
def test_offsets(text, offset):
    with pytest.raises(j.Broken) as error:
        read(text.encode(), 3)
    assert error.value.offset == offset


def test_memory_is_bounded():
    """A document of 60 MB, one string of which has 20 MB, in a few MB."""

    def source():
        yield b'{"rows": ['
        for i in range(200_000):
            yield f'{{"id": {i}, "t": "{"x" * 180}"}},'.encode()
        yield b'{}], "long": "'
        for _ in range(20):
            yield b"ab\\n\\ud83d\\ude00\xc3\xa9" * 50_000
        yield b'"}'

    tracemalloc.start()
    rows, longest, total = 0, 0, 0
    for at, _, _, text in j.Parser(source()).values():
        rows += 1
        longest, total = max(longest, len(text or "")), total + (len(text or "") if at == "/long" else 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 400_000 and total == 20 * 50_000 * 5 and longest < 3 << 20 and peak < 24 << 20


def test_files(spark, tmp_path):
    rng = random.Random(1)
    value = {"a/b": [{"x": rng.random(), "é": "ü" * 50, "n": None} for _ in range(5000)], "e": {}, "~": []}
    (tmp_path / "a.json").write_text(json.dumps(value, ensure_ascii=False))
    (tmp_path / "b.json").write_text('{"a": [1, 2,]}')
    names = [f"file://{tmp_path}/a.json", f"{tmp_path}/b.json", f"{tmp_path}/none.json"]
    rows = j.read_json(spark, spark.createDataFrame([(n,) for n in names], "file string")).collect()
    got = {r.pointer: r.value for r in rows if r.file == names[0]}
    assert got == {p: None if v in (None, {}, []) else str(v) for p, v in flat(value)}
    bad = {r.file: r for r in j.errors(j.read_json(spark, spark.createDataFrame([(n,) for n in names], "file string"))).collect()}
    assert set(bad) == set(names[1:]) and bad[names[1]].offset == 12 and "No such file" in bad[names[2]].message
