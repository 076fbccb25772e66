"""Compaction against first fit done file by file, and against the bytes of the files it leaves."""

import hashlib
import math
import os
import random
from collections import defaultdict
from datetime import datetime, timedelta
from zlib import crc32

import pyarrow.parquet as pq
import pytest

from annalist.llm import compaction, queries

SF = "/root/testdata/sf0.001"
FIELDS = ("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "rewritten")


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def by_loop(rows, columns):
    """The report of (id, time, value) rows: files one at a time."""
    total = len(rows)
    share = lambda x: 1 + total // x
    day = lambda t: None if t is None else (t - datetime(1970, 1, 1)).days
    text = lambda i: "" if i is None else str(i)
    days, files = defaultdict(int), defaultdict(list)
    for _, t, _ in rows:
        days[day(t)] += 1
    for i, t, v in rows:
        h = crc32(text(i).encode())
        files[day(t), h // 16 % (1 + days[day(t)] // share(150)), min(h % 4, h // 4 % 4)].append((i, t, v))
    for held in files.values():
        held.sort(key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0] is not None, r[0] or 0))
    groups = [[k] for k, held in files.items() if len(held) >= share(600)]
    for d in days:
        opened = []
        for k in sorted((k for k in files if k[0] == d and len(files[k]) < share(600)), key=lambda k: (-len(files[k]), k[1:])):
            fit = next((g for g in opened if sum(len(files[x]) for x in g) + len(files[k]) <= share(500)), None)
            if fit is None:
                opened.append([k])
            else:
                fit.append(k)
        groups += opened
    out = []
    for of in groups:
        held = [r for k in of for r in files[k]]
        ids = [r[0] for r in held if r[0] is not None]
        cents = sum(math.floor(100 * v + 0.5) for _, _, v in held if v is not None)
        digest = hashlib.sha256(",".join(text(r[0]) for r in held).encode()).hexdigest()
        out.append((*of[0], len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{lot}-{piece}" for _, lot, piece in of), digest, columns, len(of) > 1))
    return sorted(out, key=repr)


def told(report):
    return sorted((tuple(r[f] for f in FIELDS) for r in report), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_a_plain_loop_and_its_files(spark):
    got = queries.QUERIES["op13_compaction"](spark, SF).collect()
    clicks = pq.read_table(f"{SF}/clicks.parquet")
    rows = list(zip(*(clicks.column(c).to_pylist() for c in ("click_id", "arrived_at", "value"))))
    assert told(got) == by_loop(rows, ",".join(clicks.column_names))
    folder = os.path.dirname(local(got[0].path))
    assert sorted(f for f in os.listdir(folder) if not f.startswith((".", "_"))) == sorted(os.path.basename(r.path) for r in got)
    held = []
    for r in got:
        t = pq.ParquetFile(local(r.path)).read()
        assert ",".join(t.column_names) == r.columns and hashlib.sha256(",".join(map(str, t["click_id"].to_pylist())).encode()).hexdigest() == r.ids_sha256
        held += t.to_pylist()
    assert sorted(map(repr, held)) == sorted(map(repr, clicks.to_pylist()))
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    again = queries.QUERIES["op13_compaction"](spark, SF).limit(1).collect()
    assert os.path.dirname(local(again[0].path)) != folder and os.path.isdir(folder)


def test_untouched_files_keep_their_bytes(spark, tmp_path, monkeypatch):
    before = {}
    write = compaction.write_numbered

    def watched(rows, number, n, order, folder, mode):
        out = write(rows, number, n, order, folder, mode)
        if mode != "append":
            before.update({name: open(os.path.join(local(folder), name), "rb").read() for name in out.values()})
        return out

    monkeypatch.setattr(compaction, "write_numbered", watched)
    rows = [(i, datetime(2024, 1, 1 + i % 3, i % 24), float(i)) for i in range(3000)]
    got = compaction.compact(spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double"), folder=f"file://{tmp_path}/files").collect()
    kept = [r for r in got if not r.rewritten]
    assert kept and all(open(local(r.path), "rb").read() == before[os.path.basename(r.path)] for r in kept)
    assert told(got) == by_loop(rows, "click_id,arrived_at,value")


def test_nulls_repeated_rows_hot_days_and_clashing_names(spark):
    r = random.Random(13)
    rows = []
    for i in range(2500):
        t = None if r.random() < 0.05 else datetime(2024, 1, 1) + timedelta(days=0 if r.random() < 0.4 else r.randint(-20, 20), seconds=r.randint(0, 86399), microseconds=r.randint(0, 999999))
        rows.append((None if r.random() < 0.02 else r.randint(-50, 10**12), t, r.choice([None, 1.005, -2.675, 0.0, 19.99])))
    rows += [rows[7]] * 200
    more = [(*row, "x", 1, 2, 3) for row in rows]
    table = spark.createDataFrame(more, "click_id long, arrived_at timestamp_ntz, value double, day string, number int, row int, `a.b` int")
    assert told(compaction.compact(table).collect()) == by_loop(rows, "click_id,arrived_at,value,day,number,row,a.b")


def test_an_empty_table_and_a_single_row(spark):
    schema = "click_id long, arrived_at timestamp_ntz, value double"
    empty = compaction.compact(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == [f.split()[0] for f in compaction.REPORT.split(", ")]
    one = [(5, datetime(2024, 2, 29, 23, 59), None)]
    assert told(compaction.compact(spark.createDataFrame(one, schema)).collect()) == by_loop(one, "click_id,arrived_at,value")


def test_runs_pack_as_first_fit_does(spark):
    r = random.Random(3)
    for most in (40, 97):
        files = [(d, lot, piece, r.choice([1, 2, 3, 5, 8, 13, 21, r.randint(1, 39)])) for d in range(4) for lot in range(25) for piece in range(4)]
        want = {}
        for d in range(4):
            opened = []
            for f in sorted((f for f in files if f[0] == d), key=lambda f: (-f[3], f[1], f[2])):
                at = next((g for g, held in enumerate(opened) if sum(x[3] for x in held) + f[3] <= most), len(opened))
                if at == len(opened):
                    opened.append([])
                opened[at].append(f)
                want[f[:3]] = (at, len(opened[at]))
        got = compaction.packed(spark.createDataFrame(files, "day long, lot long, piece long, n_rows long"), 40, most).collect()
        assert {(x.day, x.lot, x.piece): (x.group, x.place) for x in got} == want
