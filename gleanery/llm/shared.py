"""What the corpus operators share: scratch tables, white space, batch reading."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gleanery.sources.scratch import drop_path, scratch_path, shared_dir  # noqa: F401
from gleanery.sources.scratch import materialise as stash  # noqa: F401

#: Deleted from a text before words are told apart: space, tab, \n, \v, \f, \r.
WHITE = b" \t\n\x0b\x0c\r"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def place(docs: DataFrame, name: str) -> int:
    """Where the column of this name stands: exactly so called, else the only one so called but for case."""
    names = docs.columns
    if name in names:
        return names.index(name)
    alike = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name} among {', '.join(names)}" if not alike else f"several columns called {name}")
    return alike[0]


def numbered(docs: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: whatever they are called, nothing that an operator adds can clash with them."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def columns_of(docs: DataFrame, **named: str) -> DataFrame:
    """Some columns under an operator's own names; a column ``text`` is never null."""
    own = numbered(docs)
    made = ((alias, F.col(f"c{place(docs, name)}")) for alias, name in named.items())
    return own.select(*((F.coalesce(c, F.lit("")) if alias == "text" else c).alias(alias) for alias, c in made))


def integer_column(docs: DataFrame, name: str) -> None:
    """Ids are integers (of any width): anything else is refused before a job starts."""
    kind = docs.schema.fields[place(docs, name)].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"ids must be integers; column {name} holds {kind.simpleString()}")


def text_of(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


_owner: list = [None, None]


def take_cache(name: str, clear: Callable[[], None]) -> None:
    """Say that this worker now runs operator ``name``: what another one had remembered is dropped."""
    if _owner[0] != name:
        if _owner[1]:
            _owner[1]()
        _owner[:] = [name, clear]


def batches_of(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds about ``max_bytes`` (one row at least); give unused memory back."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * max_bytes // max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
        del batch
        pa.default_memory_pool().release_unused()
