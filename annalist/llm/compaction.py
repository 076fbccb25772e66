"""Compaction of a table's many files, planned by run-length packing and executed.

The rows are dealt into files by day, lot and piece, one task a file. Files that are too small are
then packed into groups, first fit by descending size, day by day. A day's files of one size are a
run: an ordered multiplicity. Each run is offered to the groups in the order they were opened, and a
group takes floor(room / size) of it at once, which is where first fit would put them one by one; what
is left opens new groups. The plan is made of ranges of ordinals inside runs, and a join expands them
back to files. Each group of several files is then written as one, row by row in the order of its
files, the sources go, and everything else stays as it was written.

How many files there are depends on the shares and the days, not on the rows: at most
4 * (150 + number of days) for the default lots. Only their names and sizes meet in one place.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.scratch import materialize, remove, shared_dir

#: Stands for the day of rows without a time; no date is so far back.
NO_DAY = -(1 << 40)
FILE = ["day", "lot", "piece"]


@dataclass(frozen=True)
class Shares:
    """Sizes as shares of the table: 1 + floor(rows / share)."""

    lot: int = 150
    small: int = 600
    group: int = 500

    @staticmethod
    def of(rows: int, share: int) -> int:
        return 1 + rows // share


def dealt(rows: DataFrame, shares: Shares, id_col: str, time_col: str) -> tuple[DataFrame, int]:
    """(row, id, time, day, lot, piece) and the number of rows; ``row`` holds all columns, whatever their names."""
    at, h = F.col(f"row.{time_col}"), F.crc32(F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit("")).cast("binary"))
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    keyed = packed.select("row", at.alias("time"), F.col(f"row.{id_col}").alias("id"), F.coalesce(F.unix_date(at.cast("date")).cast("long"), F.lit(NO_DAY)).alias("day"), h.alias("h"))
    days = materialize(keyed.groupBy("day").agg(F.count("*").alias("in_day")), "days")
    total = days.agg(F.coalesce(F.sum("in_day"), F.lit(0))).first()[0]
    lots = 1 + F.floor(F.col("in_day") / F.lit(Shares.of(total, shares.lot)))
    lot = F.pmod(F.floor(F.col("h") / 16), lots).cast("long")
    piece = F.least(F.col("h") % 4, F.floor(F.col("h") / 4) % 4).cast("long")
    return keyed.join(days, "day").select("row", "id", "time", "day", lot.alias("lot"), piece.alias("piece")), total


def listed(spark: SparkSession, folder: str) -> dict[str, str]:
    """name -> path of the data files of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = (str(status.getPath().toString()) for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    return {path.rsplit("/", 1)[1]: path for path in found if path.endswith(".parquet")}


def by_number(names: dict[str, str], n: int) -> dict[int, str]:
    """number of a task -> name of the file it wrote; every task must have written one."""
    out = {int(re.match(r"part-(\d+)-", name)[1]): name for name in names}
    if sorted(out) != list(range(n)) or len(names) != n:
        raise RuntimeError(f"{len(names)} files were written in place of {n}")
    return out


def write_numbered(rows: DataFrame, number: str, n: int, order: list[str], folder: str, mode: str) -> dict[int, str]:
    """One file for each of the numbers 0 to n - 1, of its rows in ``order``; number -> name."""
    spark = rows.sparkSession
    old = listed(spark, folder) if mode == "append" else {}
    rows.repartitionById(n, F.col(number).cast("int")).sortWithinPartitions(*order).select("row.*").write.mode(mode).option("maxRecordsPerFile", 0).parquet(folder)
    return by_number({name: path for name, path in listed(spark, folder).items() if name not in old}, n)


def packed(files: DataFrame, small: int, most: int) -> DataFrame:
    """(day, lot, piece, group, place) of the files under ``small`` rows: first fit by descending size, groups of ``most`` rows.

    Files come by descending n_rows, then lot, then piece; ``place`` counts the files of a group from 1.
    """

    def fill(runs: pd.DataFrame) -> pd.DataFrame:
        room: list[int] = []
        out = []
        for size, left in sorted(zip(runs.n_rows.tolist(), runs.n.tolist()), reverse=True):
            at, group = 1, 0
            while left:
                if group == len(room):
                    room.append(most)
                takes = min(left, room[group] // size)
                if takes:
                    out.append((runs.day.iat[0], size, group, at, at + takes - 1))
                    room[group] -= takes * size
                    at, left = at + takes, left - takes
                group += 1
        return pd.DataFrame(out, columns=["day", "n_rows", "group", "from", "to"])

    few = files.filter(F.col("n_rows") < small)
    ranges = few.groupBy("day", "n_rows").agg(F.count("*").alias("n")).groupBy("day").applyInPandas(fill, "day long, n_rows long, group long, from long, to long")
    ordinal = F.row_number().over(Window.partitionBy("day", "n_rows").orderBy("lot", "piece"))
    each = few.withColumn("ordinal", ordinal).join(ranges, ["day", "n_rows"]).filter(F.col("ordinal").between(F.col("from"), F.col("to")))
    place = F.row_number().over(Window.partitionBy("day", "group").orderBy(F.desc("n_rows"), "lot", "piece"))
    return each.select(*FILE, "group", place.alias("place"))


def digest(rows: DataFrame) -> DataFrame:
    """(number, n_rows, min_click_id, max_click_id, cents, ids_sha256) of partitions that hold one file each, read in its order."""
    fields = "number long, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, number, n, low, high, cents = hashlib.sha256(), None, 0, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, ids, values = batch.columns
            number = numbers[0].as_py()
            text = ",".join(pc.fill_null(pc.cast(ids, pa.string()), "").to_pylist())
            sha.update(((b"," if n else b"") + text.encode()))
            n, cents = n + batch.num_rows, cents + (pc.sum(values).as_py() or 0)
            ends = pc.min_max(ids)
            low = min((x for x in (low, ends["min"].as_py()) if x is not None), default=None)
            high = max((x for x in (high, ends["max"].as_py()) if x is not None), default=None)
        if n:
            types = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((number, n, low, high, cents, sha.hexdigest()), types)], names=[f.split()[0] for f in fields.split(", ")])

    return rows.mapInArrow(run, fields)


def cents(value: Column) -> Column:
    return F.coalesce(F.floor(100 * value.cast("double") + 0.5).cast("long"), F.lit(0))


REPORT = (
    "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, "
    "columns string, path string, rewritten boolean"
)


def compact(
    rows: DataFrame,
    shares: Shares = Shares(),
    folder: str | None = None,
    id_col: str = "click_id",
    time_col: str = "arrived_at",
    value_col: str = "value",
) -> DataFrame:
    """Write ``rows`` as files by day, lot and piece into a new folder, compact it, and report its files as they are read back.

    Columns of the report: those of ``REPORT``. ``sources`` names a file's starting files as
    ``lot-piece`` in the order they were joined, day, lot and piece are those of the first.

    Rows without a time form a day of their own, reported as null, and come first where a file holds
    others; a null id counts as an empty text, for its checksum and in ``ids_sha256``; null values
    and others that are no number are 0 cents. Repeated rows are all written; rows equal in time and
    id may stand in either order. All columns are kept in their order, whatever they are called. An
    empty table writes no file and reports none. The folder stays; a call without ``folder`` makes a
    new one below the shared one.
    """
    spark, names = rows.sparkSession, rows.columns
    folder = folder or f"{shared_dir(spark)}/compaction-{uuid.uuid4().hex}"
    keyed, total = dealt(rows, shares, id_col, time_col)
    if not total:
        return spark.createDataFrame([], REPORT)

    number = F.row_number().over(Window.orderBy(*FILE)) - 1  # of names of files, not of rows
    files = materialize(keyed.groupBy(*FILE).agg(F.count("*").alias("n_rows")).withColumn("number", number), "files")
    n_files = files.count()
    first = write_numbered(keyed.join(files.drop("n_rows"), FILE), "number", n_files, ["time", "id"], folder, "errorifexists")

    plan = packed(files, Shares.of(total, shares.small), Shares.of(total, shares.group)).join(files, FILE)
    grouped = plan.select("day", "group", "place", "lot", "piece", "number").orderBy("day", "group", "place").collect()
    groups: dict[tuple, list] = {}
    for row in grouped:
        groups.setdefault((row.day, row.group), []).append(row)
    merging = [of for of in groups.values() if len(of) > 1]

    finals = []  # number, day, lot, piece, sources, name, rewritten
    if merging:
        old = listed(spark, folder)
        source = spark.read.schema(rows.schema).parquet(*(old[first[row.number]] for of in merging for row in of))
        meta = source.metadataColumn("_metadata")
        placed = spark.createDataFrame([(first[row.number], target, row.place) for target, of in enumerate(merging) for row in of], "name string, target int, place int")
        again = source.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), meta["file_name"].alias("name"), meta["row_index"].alias("at")).join(placed, "name")
        made = write_numbered(again, "target", len(merging), ["place", "at"], folder, "append")
        for of in merging:
            for row in of:
                remove(spark, old[first[row.number]])
        finals += [(of[0].day, of[0].lot, of[0].piece, ",".join(f"{row.lot}-{row.piece}" for row in of), made[target], True) for target, of in enumerate(merging)]
    gone = {row.number for of in merging for row in of}
    finals += [(row.day, row.lot, row.piece, f"{row.lot}-{row.piece}", first[row.number], False) for row in files.collect() if row.number not in gone]

    there = listed(spark, folder)
    if set(there) != {name for *_, name, _ in finals}:
        raise RuntimeError(f"{folder} holds other files than the plan says")
    told = spark.createDataFrame(
        [(i, None if day == NO_DAY else day, lot, piece, sources, name, there[name], rewritten) for i, (day, lot, piece, sources, name, rewritten) in enumerate(finals)],
        "number long, day long, lot long, piece long, sources string, name string, path string, rewritten boolean",
    )
    final = spark.read.parquet(folder)
    meta = final.metadataColumn("_metadata")
    read = final.select(F.col(f"`{id_col}`").cast("long").alias("id"), cents(F.col(f"`{value_col}`")).alias("cents"), meta["file_name"].alias("name"), meta["row_index"].alias("at"))
    whole = read.join(told.select("name", "number"), "name").repartitionById(len(finals), F.col("number").cast("int")).sortWithinPartitions("at")
    return digest(whole.select("number", "id", "cents")).join(told, "number").withColumn("columns", F.lit(",".join(final.columns))).select(*(f.split()[0] for f in REPORT.split(", ")))
