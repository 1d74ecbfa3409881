import sys

import pyarrow as pa

from genomespark.llm import sentences as S


def calls(f, *args):
    """How many functions, built-in ones too, a call enters."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    f(*args)  # caches are filled
    sys.setprofile(count)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


def test_calls_for_a_sentence():
    """Of two sentences, one with a number inside, each takes a bounded number of calls."""
    text = "The valve opens at 5.3 bar in the shown state. It is kept there. " * 200
    parts = S.Splitter().events(text)
    assert len(parts[0]) == 400
    assert calls(S.Splitter().events, text) < 400 * 40
    assert calls(S.join_segments, *parts[:3], S.Model(), *parts[3:]) < 400 * 4


def test_lists_of_parts_come_back():
    lists = [[1, 2], [], [3], [4, 5, 6]]
    for kind in (S.np.int32, S.np.int64):
        column = S._to_arrow(lists, kind)
        assert column.type == pa.list_(pa.from_numpy_dtype(kind)) and column.to_pylist() == lists
        assert S._to_lists(column) == lists and S._to_lists(column.slice(1, 2)) == lists[1:3]
        assert S._to_lists(S._to_arrow([], kind)) == []
