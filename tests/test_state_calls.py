"""What the processors of streaming state ask of the store: each question is a round trip."""

import random

import pandas as pd
import pytest

from lodestone import queries
from lodestone.streaming import state


class Store:
    """A handle whose states are dicts, and how often they were asked."""

    def __init__(self):
        self.calls, self.value, self.entries = 0, None, {}

    def getValueState(self, *a):  # noqa: N802
        return self

    def getMapState(self, *a):  # noqa: N802
        return Map(self)

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, v):
        self.calls += 1
        self.value = v

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, t):  # noqa: N802
        pass

    deleteTimer = registerTimer  # noqa: N815
    getCurrentWatermarkInMs = lambda self: 0  # noqa: E731, N815


class Map:
    def __init__(self, store):
        self.store, self.entries = store, store.entries

    def _said(self, x):
        self.store.calls += 1
        return x

    def exists(self):
        return self._said(bool(self.entries))

    def containsKey(self, k):  # noqa: N802
        return self._said(k in self.entries)

    def getValue(self, k):  # noqa: N802
        return self._said(self.entries.get(k))

    def updateValue(self, k, v):  # noqa: N802
        self._said(self.entries.update({k: v}))

    def iterator(self):
        return self._said(iter(list(self.entries.items())))

    def clear(self):
        self._said(self.entries.clear())


def _naive(events, width):
    out, start = [], None
    for ms, path in sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or "")):
        if start is None or ms >= start + width:
            start, held = ms, {}
            out.append((start, held))
        held[path] = held.get(path, 0) + 1
    return [(s, k, p, n) for s, held in out for k, (p, n) in enumerate(held.items())]


def test_windows_of_a_batch_do_not_go_through_the_store(monkeypatch):
    monkeypatch.setattr(state, "GIVEN", 50)
    rng = random.Random(5)
    batches = [[(rng.randrange(lo, lo + 5000), rng.choice(["a", "b", "c", None])) for _ in range(900)] for lo in (10_000, 14_990, 20_000)]
    watch, store, got = state._Watch(250, True), Store(), []
    watch.init(store)
    for k, events in enumerate(batches):
        events = [e for e in events if k == 0 or e[0] >= max(m for m, _ in batches[k - 1])]
        batches[k] = events
        frames = [pd.DataFrame({"path": pd.Series([p for _, p in part], dtype=object), "ts": pd.to_datetime([m for m, _ in part], unit="ms")}) for part in (events[::2], events[1::2])]
        store.calls = 0
        for out in watch.handleInputRows(("r",), iter(frames), store):
            got += out[["start", "place", "path", "n"]].itertuples(index=False, name=None)
        assert store.calls < 20
    want = _naive([e for b in batches for e in b], 250)
    still = [(store.value[0], place, p, n) for (p,), (place, n) in store.entries.items()]
    assert [(s, k, p if p == p else None, n) for s, k, p, n in got] + sorted(still, key=lambda x: x[1]) == want


@pytest.mark.parametrize("start", [False, True])
def test_a_new_session_has_nothing_to_ask_for(start):
    own, store = state._Ranges(["file_path"], None), Store()
    own.init(store)
    rows = pd.DataFrame({"seq": range(30), "start": [start] + [False] * 29, "line_start": [float(k % 7) for k in range(30)], "line_end": [9.0] * 30, "file_path": [f"f{k % 5}" for k in range(30)]})
    out = pd.concat(list(own.handleInputRows(("s",), iter([rows]), None)))
    assert store.calls <= 1 + 5 and len(store.entries) == 5
    # the second batch is measured against what the first has left
    again = list(own.handleInputRows(("s",), iter([rows.assign(start=False)]), None))
    assert not again and len(out) == 5 + sum(k % 7 < min(j % 7 for j in range(k) if j % 5 == k % 5) for k in range(5, 30))


def test_tokens_are_counted_where_their_document_is(spark):
    plan = queries.term_stats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "Exchange" not in above and "Exchange hashpartitioning(doc_id" in below
