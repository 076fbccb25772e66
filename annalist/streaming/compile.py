"""The compilation fold over a stream, its atomic commit, and steps in micro-batches."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from annalist.operators.compilation import NAMES, STATES, Compiler, as_frame

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = (
    "block_id string, subject string, version int, content string, occurred_start timestamp, occurred_end timestamp, known_at timestamp, evidence array<string>"
)
ITEM = "evidence_id string, ordering_key string, subject string, content string, occurred_at timestamp, known_at timestamp, topics array<string>, recap boolean"
BLOCK_NAMES, ITEM_NAMES = ([c.split()[0] for c in schema.split(", ")] for schema in (BLOCK, ITEM))


#: Rows that a value in the state store holds at most, and ids that a part of :class:`Done` holds on average at most.
CALL_ROWS, PART_IDS = 1000, 512
#: Groups of lineages, each with its own state; bytes up to which a lineage's blocks, ids and waiting items lie in one value; rows of a frame.
GROUPS, FEW_BYTES, FRAME_ROWS = 1024, 1 << 16, 10_000


def append(store, rows: list[tuple]) -> None:
    """Rows go to a list of the state store many a value: a call and a conversion for each would cost more than the fold."""
    for start in range(0, len(rows), CALL_ROWS):
        store.appendValue((pickle.dumps(rows[start : start + CALL_ROWS]),))


def held_in(store) -> Iterator[tuple]:
    for value in store.get():
        yield from pickle.loads(bytes(value[0]))


class Few(dict):
    """What a map of the state store is asked for, in memory."""

    getValue, updateValue = dict.get, dict.__setitem__

    def removeKey(self, key: tuple) -> None:
        self.pop(key, None)


class Listed:
    """A lineage's list in a map of the state store, by places."""

    def __init__(self, store, lineage: str, n: int):
        self.store, self.lineage, self.n = store, lineage, n

    def get(self) -> Iterator[tuple]:
        return (self.store.getValue((self.lineage, i)) for i in range(self.n))

    def appendValue(self, value: tuple) -> None:
        self.store.updateValue((self.lineage, self.n), value)
        self.n += 1

    def clear(self) -> None:
        for i in range(self.n):
            self.store.removeKey((self.lineage, i))
        self.n = 0


class Parted:
    """A lineage's parts of ids in a map of the state store, some of ``n``."""

    def __init__(self, store, lineage: str, n: int):
        self.store, self.lineage, self.n = store, lineage, n

    def getValue(self, key: tuple) -> tuple | None:
        return self.store.getValue((self.lineage, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.store.updateValue((self.lineage, *key), value)

    def iterator(self) -> Iterator[tuple]:
        return (((k,), found) for k in range(self.n) if (found := self.getValue((k,))) is not None)

    def clear(self) -> None:
        for key, _ in list(self.iterator()):
            self.store.removeKey((self.lineage, *key))


class Blocks:
    """A lineage's blocks as the list the compiler expects: the open one is at hand, the others lie in the state store.

    There a block has a row for each time that it was left changed, the last one counts; all are read when one is asked for.
    """

    def __init__(self, store, n: int, open_: int | None, block: tuple):
        self.store, self.n, self.held, self.stored, self.rows = store, n, {}, {}, None
        if open_ is not None:
            self.held[open_] = self.block(block)

    def block(self, values: tuple) -> dict:
        row = dict(zip(BLOCK_NAMES, values))
        return row | {c: pd.Timestamp(row[c]) for c in ("occurred_start", "occurred_end", "known_at")} | {"evidence": list(row["evidence"])}

    def values(self, i: int) -> tuple:
        return tuple(_plain(self.held[i][n]) if n != "version" else self.held[i][n] for n in BLOCK_NAMES)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> dict:
        if not -self.n <= i < self.n:
            raise IndexError(i)
        i %= self.n
        if i not in self.held:
            told = [(row[0], row[1:]) for row in held_in(self.store)]
            self.rows = len(told)
            known = {k: self.block(values) for k, values in dict(told).items()}
            self.stored |= {k: b["version"] for k, b in known.items()}
            self.held = known | self.held
        return self.held[i]

    def append(self, block: dict) -> None:
        self.held[self.n] = block
        self.n += 1

    def flush(self, open_: int | None) -> tuple:
        """Writes what has changed but the open block, whose values it gives."""
        closed = [i for i in sorted(self.held) if i != open_]
        if self.rows is not None and self.rows > 2 * self.n:
            self.store.clear()
            self.stored = {}
        append(self.store, [(i, *self.values(i)) for i in closed if self.stored.get(i) != self.held[i]["version"]])
        return (None,) * len(BLOCK_NAMES) if open_ is None else self.values(open_)


class Done:
    """Ids compiled before, in the state store by parts of their hash: the more there are, the more parts."""

    def __init__(self, store, n: int):
        self.store, self.n, self.parts, self.held, self.changed = store, n, self.wanted(n), {}, set()

    @staticmethod
    def wanted(n: int) -> int:
        return 1 << max(0, (max(n, 1) - 1) // PART_IDS).bit_length()

    def part(self, evidence_id: str) -> int:
        at = zlib.crc32((evidence_id or "").encode()) % self.parts
        if at not in self.held:
            found = self.store.getValue((at,)) if self.n else None
            self.held[at] = set(found[0]) if found else set()
        return at

    def __contains__(self, evidence_id: str) -> bool:
        return evidence_id in self.held[self.part(evidence_id)]

    def __setitem__(self, evidence_id: str, blocks: list[str]) -> None:
        at = self.part(evidence_id)
        self.n += evidence_id not in self.held[at]
        self.held[at].add(evidence_id)
        self.changed.add(at)

    def flush(self) -> None:
        if (parts := self.wanted(self.n)) != self.parts:
            ids = set().union(*self.held.values(), *(value[0] for key, value in self.store.iterator() if key[0] not in self.held))
            self.store.clear()
            self.parts, self.held = parts, {k: set() for k in range(parts)}
            for i in ids:
                self.held[self.part(i)].add(i)
            self.changed = set(self.held)
        for at in sorted(self.changed):
            self.store.updateValue((at,), (list(self.held[at]),))


class CompilingProcessor(StatefulProcessor):
    """The folds of a group's lineages. Items behind a failed one wait in the state store, and follow it when it has come again and passed.

    A call to the state store, and a frame, cost more than many an item's work: a short lineage is one value, read and written
    once a micro-batch, and the lineages of a group come and go in the same frames.
    """

    def __init__(self, provider: Callable | None = None):
        self.provider = provider

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("heads", "lineage string", "head binary")
        self.stores = [
            handle.getMapState("blocks", "lineage string, place int", "rows binary"),
            handle.getMapState("done", "lineage string, part int", "ids array<string>"),
            handle.getMapState("waiting", "lineage string, place int", "rows binary"),
        ]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, list[dict]] = {}
        for table in rows:
            for values in zip(*(table[c].tolist() for c in table.columns)):
                row = dict(zip(table.columns, values))
                came.setdefault(str(row["lineage_id"]), []).append(row)
        made: list[dict] = []
        for lineage in list(came):
            made += self.fold(lineage, came.pop(lineage))
            if len(made) >= FRAME_ROWS:
                yield as_frame(made)
                made = []
        if made:
            yield as_frame(made)

    def fold(self, lineage: str, came: list[dict]) -> list[dict]:
        """The rows of one lineage, whose state is written back."""
        held = self.heads.getValue((lineage,))
        n, at, last, pending, ids, block, lists, few = pickle.loads(bytes(held[0])) if held else (0, None, None, None, 0, (), (0, 0), ({}, {}, {}))
        stores = self.stores if few is None else [Few(values) for values in few]
        listed, waiting = Listed(stores[0], lineage, lists[0]), Listed(stores[2], lineage, lists[1])
        blocks, done = Blocks(listed, n, at, block), Done(Parted(stores[1], lineage, Done.wanted(ids)), ids)
        state = {"blocks": blocks, "open": at, "last": last, "done": done, "pending": pending}
        compiler = Compiler(lineage, state, self.provider)
        order = lambda x: (x is None or x != x, x)  # noqa: E731  what is missing comes last
        came.sort(key=lambda r: (r["evidence_id"] != pending, order(r["ordering_key"]), order(r["evidence_id"])))  # the failed item first, wherever it stands
        made: list[dict] = []
        wait: list[tuple] = []

        def take(row: dict) -> bool:
            topics = row["topics"]
            out = compiler.process(row | {"topics": [] if topics is None else list(topics)})
            made.extend({"lineage_id": lineage} | s for s in out)
            return bool(out) and out[0]["action"] == "BLOCKED"

        for row in came:
            was = state["pending"]
            if take(row):
                wait.append(tuple(_plain(row.get(c)) for c in ITEM_NAMES))
            elif was is not None and state["pending"] is None:
                wait = self.drain(take, state, waiting, wait)
        append(waiting, wait)
        done.flush()
        block = blocks.flush(state["open"])
        few = None if few is None else [dict(values) for values in stores]  # plain: workers may not find this module by its name
        if few is not None and len(pickle.dumps(few)) > FEW_BYTES:
            for store, values in zip(self.stores, few):
                for place, value in values.items():
                    store.updateValue(place, value)
            few = None
        self.heads.updateValue((lineage,), (pickle.dumps((len(blocks), state["open"], state["last"], state["pending"], done.n, block, (listed.n, waiting.n), few)),))
        return made

    def drain(self, take: Callable[[dict], bool], state: dict, waiting: Listed, more: list[tuple]) -> list[tuple]:
        """The waiting items, and ``more``, in their order, until one fails; gives what is left, and leaves none in the store."""
        items = {(row["ordering_key"], row["evidence_id"]): row for row in (dict(zip(ITEM_NAMES, values)) for values in [*held_in(waiting), *more])}
        waiting.clear()
        left = sorted(items)
        while left and state["pending"] is None:
            row = items[left.pop(0)]
            take(row | {c: pd.Timestamp(row[c]) if row[c] is not None else None for c in ("occurred_at", "known_at")})
        return [tuple(items[k][c] for c in ITEM_NAMES) for k in left]

    def close(self) -> None:
        pass


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value if isinstance(value, bool) else list(value) if hasattr(value, "__iter__") else bool(value)


def compile_stream(evidence: DataFrame, provider: Callable | None = None) -> DataFrame:
    """As ``compile_batch``, for a stream: state lies in the query's checkpoint, by lineage, and lineages are dealt into GROUPS.

    An item that fails comes out as FAILED, those of its lineage behind it as BLOCKED; they are kept and follow, in order, when
    the failed one is given again and passes. Late rows come out with action LATE; repeated rows come out not at all, so a
    replayed micro-batch changes nothing. The session is set to keep state in RocksDB, which keyed state needs.
    """
    evidence.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = evidence.select(F.col("lineage_id").cast("string").alias("lineage_id"), *ITEM_NAMES)
    return rows.withColumn("part", F.pmod(F.xxhash64("lineage_id"), F.lit(GROUPS))).groupBy("part").transformWithStateInPandas(CompilingProcessor(provider), STATES, "Append", "none")


COMMITS = "batch_id long, rows long"


def committing(root: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a micro-batch's states appear below ``root`` as a whole or not at all, and once.

    The rows go to a folder of their own, which a retry writes again from the start; the batch's line in the commit log comes
    last, and a batch that has one is passed over.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not committed(spark, root).filter(F.col("batch_id") == batch_id).isEmpty():
            return
        path = f"{root}/states/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        n = spark.read.schema(STATES).parquet(path).count()
        spark.createDataFrame([(batch_id, n)], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{batch_id}")

    return commit


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, rows): the commit log."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(f"{root}/commits")


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all committed micro-batches, with batch_id."""
    done = committed(spark, root)
    if done.isEmpty():
        return spark.createDataFrame([], f"{STATES}, batch_id long")
    return spark.read.schema(f"{STATES}, batch_id long").parquet(f"{root}/states").join(done.select("batch_id"), "batch_id", "left_semi")


def process(items: DataFrame, root: str, provider: Callable | None = None) -> StreamingQuery:
    """Compile what has arrived on the stream ``items`` into the committed tables below ``root``, then stop."""
    return in_batches(compile_stream(items, provider), committing(root), f"{root}/checkpoint")


def in_batches(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply`` on each micro-batch: for steps that rewrite revision tables, such as attaching
    arrived blocks to lines. A failed batch is retried as a whole before any later one.
    """
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
