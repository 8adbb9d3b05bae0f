"""Streams of reputation make no table per payer beyond their answers, and answer null slots and labels as before."""

import pandas as pd

from txlens.operators import labels as L
from txlens.streaming import operators as O
from txlens.streaming import reputation as R


class _Map:
    def __init__(self):
        self.at, self.requests = {}, 0

    def exists(self):
        return bool(self.at)

    def iterator(self):
        self.requests += 1
        return iter(list(self.at.items()))

    def updateValue(self, key, value):
        self.requests += 1
        self.at[key] = value


class _One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.maps = {}

    def getValueState(self, name, schema):
        return self.maps.setdefault(name, _One())

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, _Map())

    def registerTimer(self, at):
        self.timer = at


def test_a_key_asks_its_state_once_per_entry(monkeypatch):
    counts, handle = R._Counts(2, 60, 0.0), _Handle()
    counts.init(handle)
    batch = lambda slot, landed, own: pd.DataFrame({"slot": slot, "landed": landed, "own": own})
    first = [batch([5, 5, 6], [1, 0, 1], [True, True, False]), batch([6, 9], [0, 1], [True, True])]
    later = [batch([5, 7], [1, 1], [True, False])]
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    made = pd.DataFrame
    monkeypatch.setattr(R.pd, "DataFrame", None)
    assert list(counts.handleInputRows((1, 0), iter(first), None)) == []
    assert handle.maps["recent"].at == {(5,): (1, 1), (6,): (0, 1), (9,): (1, 0)} and set(handle.maps["asked"].at) == {(5,), (6,), (9,)}
    assert handle.maps["recent"].requests == 3 and handle.timer == 3 * 1000 - 1
    assert list(counts.handleInputRows((1, 0), iter(later), None)) == []
    assert handle.maps["recent"].at[5,] == (2, 1) and (7,) in handle.maps["asked"].at and handle.maps["recent"].requests == 5
    monkeypatch.setattr(R.pd, "DataFrame", made)


def test_reputation_step_uses_no_grouped_table(spark, tmp_path, monkeypatch):
    held = {}

    class Events:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            held["step"] = step

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    O.reputation(Events(), 2, 60, late_slots=100)
    state, rows = State(), pd.DataFrame({"tx_id": [1, 2, 3, 4], "slot": [10, 10, 20, 500], "landed": [1, 0, 1, 1]})
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    monkeypatch.setattr(O.pd, "concat", None)
    out = next(iter([*held["step"]((7,), iter([rows]), state)]))
    assert out["rep_landed"].tolist() == [0, 0, 1, 2 / 2**8] and out["rep_failed"].tolist() == [0, 0, 1, 1 / 2**8]
    assert out["rep_seen"].tolist() == [0, 0, 1, 1] and not out["late"].any()
    assert state.get[:4] == (2.0, 1.0, 0, 20) and state.get[4:] == ([500], [1.0], [0.0])


def test_coverage_is_not_expanded_by_routes(spark):
    """A pair counts once however many routes it shares; rows that repeat stay, null routes match nothing."""
    eligible = spark.createDataFrame([(1, "K1", 0, True), (1, "K1", 0, True), (1, "K2", 1, True), (2, "K1", 0, True), (3, "K3", 0, False), (4, "K1", 0, True)], "tx_id long, pack_id string, pack_rank long, live boolean")
    packs = spark.createDataFrame([("K1", "a"), ("K1", "b"), ("K1", None), ("K2", "c"), ("K3", None)], "pack_id string, route string")
    routes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, None), (4, "a")], "tx_id long, route string")
    out = L.covering(eligible, packs, routes)
    assert out.columns == eligible.columns
    assert sorted(map(tuple, out.collect())) == [(1, "K1", 0, True), (1, "K1", 0, True), (4, "K1", 0, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join") == 2
