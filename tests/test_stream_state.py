"""State calls of the streams: few per key, none per piece of a message that came whole."""

from __future__ import annotations

from pyspark.sql import Row

from quarry.streaming import sync as st


class State:
    """A value and a map state that count their calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def clear(self):
        self.calls += 1
        self.value, self.map = None, {}

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer


def assembly():
    a = st.Assembly(60_000)
    a.pieces, a.known, a.handle = State(), State(), State()
    return a


def piece(seq, chunk, last=False, ts=1000):
    return Row(seq=seq, chunk=chunk, is_last=last, ts_ms=ts)


def test_a_message_that_comes_whole_keeps_no_pieces():
    a = assembly()
    out = list(a.handleInputRows((1,), iter([piece(i, str(i % 10), i == 99) for i in range(100)]), None))
    assert out == [Row(message_id=1, text="0123456789" * 10, received=100, missing=0)]
    assert a.pieces.calls == 0 and a.known.calls == 2
    assert list(a.handleInputRows((1,), iter([piece(3, "again")]), None)) == []


def test_pieces_that_come_again_do_not_depend_on_the_order_of_rows():
    rows = [piece(0, "A"), piece(0, "a"), piece(0, "z", ts=2000), piece(0, None), piece(2, "c", True)]
    for given in (rows, rows[::-1]):
        a = assembly()
        assert list(a.handleInputRows((1,), iter(given), None)) == [] and a.pieces.map == {(0,): ("a",), (2,): ("c",)}
        assert list(a.handleInputRows((1,), iter([piece(0, "late"), piece(1, "b")]), None)) == [Row(message_id=1, text="abc", received=3, missing=0)]
        assert a.pieces.map == {}


def test_a_file_costs_two_state_calls():
    s = st.NewestChange()
    s.last = State()
    rows = [Row(project="p", path="a", version=v, ord=o, deleted=False, file_hash=h, content=h) for v, o, h in ((2, 0, "x"), (3, 1, "y"), (3, 0, "z"))]
    assert [r.content for r in s.handleInputRows(("p", "a"), iter(rows), None)] == ["y"]
    assert s.last.calls == 2 and s.last.value == (3, "y", False)
    assert list(s.handleInputRows(("p", "a"), iter(rows), None)) == []
