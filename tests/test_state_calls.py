"""A lineage's fold over micro-batches, on a state store in memory that counts calls."""

import pandas as pd
import pytest

from annalist.operators.compilation import Compiler
from annalist.streaming.compile import PART_IDS, CompilingProcessor, Done


class Store:
    def __init__(self, calls):
        self.calls, self.list, self.map, self.one = calls, [], {}, None

    def __getattribute__(self, name):
        if name not in ("calls", "list", "map", "one"):
            self.calls.append(name)
        return object.__getattribute__(self, name)

    def exists(self):
        return self.one is not None

    def get(self):
        return iter(self.list) if self.one is None else self.one

    def update(self, value):
        self.one = value

    def appendValue(self, value):
        self.list.append(value)

    def appendList(self, values):
        self.list += values

    def clear(self):
        self.list, self.map = [], {}

    def getValue(self, key):
        return self.map.get(key)

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))

    def iterator(self):
        return iter(list(self.map.items()))


class Handle:
    def __init__(self):
        self.calls = []

    def getMapState(self, *_):
        return Store(self.calls)

    getListState = getValueState = getMapState


def items(n, recaps=()):
    when = pd.date_range("2024-01-01", periods=n, freq="h")
    return pd.DataFrame({
        "lineage_id": "a", "evidence_id": [f"{i:05}" for i in range(n)], "ordering_key": [f"{i:05}" for i in range(n)], "subject": [f"s{i // 2 % 50}." for i in range(n)], "content": [f"c{i}" for i in range(n)],
        "occurred_at": when, "known_at": when, "topics": [["p", "q"] if i % 40 == 7 else [] for i in range(n)], "recap": [i in recaps for i in range(n)],
    })


def folded(frames, provider=None, handle=None):
    processor = CompilingProcessor()
    processor.init(handle or Handle())
    out = []
    for frame, by in frames:
        processor.provider = by
        for made in processor.handleInputRows(("a",), iter([frame]), None):
            out += made.to_dict("records")
    return [r for r in out if r["block_id"] is not None]


def plain(frame):
    compiler = Compiler("a")
    return [s for row in frame.to_dict("records") for s in compiler.process(row)]


KEYS = ["action", "evidence_id", "block_id", "state_version", "subject", "content", "occurred_start", "occurred_end", "derived_known_at", "raw_evidence_ids"]


def same(got, want):
    assert [[r[k] for k in KEYS] for r in got] == [[r[k] for k in KEYS] for r in want]


def refuse(compiler, row):
    if row["evidence_id"] == "00100":
        raise ValueError("not now")
    return compiler.decide(row)


def test_a_batch_makes_few_calls_and_the_same_states():
    frame, handle = items(600), Handle()
    got = folded([(frame, refuse), (frame.iloc[100:101], None)], handle=handle)
    same(got, plain(frame))
    assert len(handle.calls) < 40


@pytest.mark.parametrize("width", [1, 7, 100])
def test_blocks_that_are_left_and_recalled_keep_their_last_state(width):
    frame = items(200, recaps=range(20, 200, 9))
    batches = [(frame.iloc[i : i + width], None) for i in range(0, len(frame), width)]
    same(folded([b for x in batches for b in (x, x)]), plain(frame))  # each batch comes twice


def test_ids_are_found_after_their_parts_double():
    store, n = Store([]), 0
    ids = [f"e{i}" for i in range(5 * PART_IDS)]
    for start in range(0, len(ids), 100):
        done = Done(store, n)
        assert not any(i in done for i in ids[start : start + 100])
        for i in ids[start : start + 100]:
            done[i] = []
        done.flush()
        n = done.n
    done = Done(store, n)
    assert n == len(ids) and all(i in done for i in ids) and "x" not in done and len(store.map) == 8


@pytest.mark.parametrize("few", [1 << 16, 3000, 0])
def test_lineages_of_a_group_share_frames_and_a_short_one_is_one_value(monkeypatch, few):
    from annalist.streaming import compile as compile_

    monkeypatch.setattr(compile_, "FEW_BYTES", few, raising=False)
    frames = {name: items(n, recaps=(9, 17)).assign(lineage_id=name) for name, n in (("a", 30), ("b", 4), ("c", 120), ("d", 30))}
    mixed = pd.concat(frames.values()).sort_values(["evidence_id", "lineage_id"])
    fail = lambda compiler, row: refuse(compiler, row) if compiler.lineage == "c" else compiler.decide(row)
    handle = Handle()
    batches = [(mixed[mixed.evidence_id < "00020"], fail), (mixed[mixed.evidence_id >= "00015"], fail), (frames["c"].iloc[100:101], None)]
    got = folded(batches, handle=handle)
    for name, frame in frames.items():
        compiler = Compiler(name)
        same([r for r in got if r["lineage_id"] == name], [s for row in frame.to_dict("records") for s in compiler.process(row)])
    if few == 1 << 16:
        assert len(handle.calls) == 2 * (4 + 3 + 1)  # b has nothing in the second batch
