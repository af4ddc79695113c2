"""A book's state is read once and written once for a ticker in a micro-batch, however many levels change."""

import pandas as pd

from courtside.streaming.book import Books


class OneValue:
    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def messages(first, count, kind):
    import numpy as np

    rows = [(1, a, a, a * 10**6, kind if a == first else "delta", ["yes"], np.array([a % 50 + 1]), np.array([5])) for a in range(first, first + count)]
    return pd.DataFrame(rows, columns=["ticker", "arrival", "seq", "ts", "kind", "sides", "prices", "sizes"])


def test_calls_do_not_grow_with_levels():
    store, books = OneValue(), Books()
    books.init(store)
    (told,) = books.handleInputRows((1,), iter([messages(1, 40, "snapshot")]), None)
    assert store.calls == ["get", "update"] and len(store.value[1]) == 40
    assert (told["status"].iloc[0], told["bid"].dropna().iloc[-1]) == ("snapshot", 41)
    (told,) = books.handleInputRows((1,), iter([messages(41, 3, "delta")]), None)
    assert store.calls == ["get", "update"] * 2 and len(store.value[1]) == 43
    # nothing new: an old number changes nothing, so nothing is written
    (told,) = books.handleInputRows((1,), iter([messages(43, 1, "delta")]), None)
    assert store.calls == ["get", "update"] * 2 + ["get"] and told["status"].tolist() == ["duplicate"]
