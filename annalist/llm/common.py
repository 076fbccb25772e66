"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word separators of every contract: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, body binary): only these two columns are read, whatever else ``docs`` has.

    Texts travel as bytes, so malformed UTF-8 cannot break a worker; ``bytes.split()`` without an
    argument splits at exactly the separators of ``SPACE_CLASS``. Null texts count as empty.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )


def rows_out(fields: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in fields.items()], names=list(fields))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes: Python holds little at once."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Memo:
    """word -> value for the words of recent texts, computed many at a time.

    ``make`` maps a list of words to as many values. The table is forgotten as a whole when it would
    hold more than ``limit`` entries or ``key_bytes`` bytes of words, so memory has a bound.
    """

    def __init__(self, make: Callable[[list], Sequence], limit: int = 500_000, key_bytes: int = 32_000_000):
        self.make, self.limit, self.key_bytes = make, limit, key_bytes
        self.table: dict = {}
        self.held = 0

    def learn(self, texts: Iterable[list]) -> Callable:
        """Compute what is new in the word lists; gives the look-up, good until the next call."""
        seen = set().union(*texts)
        new = list(seen.difference(self.table))
        if len(self.table) + len(new) > self.limit or self.held > self.key_bytes:
            self.table.clear()
            self.held, new = 0, list(seen)
        self.table.update(zip(new, self.make(new)))
        self.held += sum(map(len, new))
        return self.table.__getitem__


def kept_in_process(key, make: Callable):
    """``make()``, once in the life of a Python worker: Spark gives a worker one task after another.

    Used for tables that are costly to build and whose content never changes a result.
    """
    held = sys.modules.setdefault("_annalist_kept", ModuleType("_annalist_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
