"""Many rows of a key as one row with a packet of them, on their way to and between stateful operators.

A stateful operator in Python is given its rows one by one. What costs then is their number, not their size; so a task packs
its rows by key, some ``PACKET_ROWS`` at once, and the operator opens a key's packets as one table of columns. A packet is
an Arrow stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a task that are packed at once.
PACKET_ROWS = 100_000


def closed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write(table)
    return sink.getvalue().to_pybytes()


def read(packet: bytes) -> pa.Table:
    return pa.ipc.open_stream(packet).read_all()


def opened(rows: Iterator[pd.DataFrame]) -> pa.Table:
    """All rows of the packets of a key."""
    return pa.concat_tables([read(packet) for frame in rows for packet in frame.packet])


def _by_key(table: pa.Table, by: list[str]) -> Iterator[tuple[list, pa.Table]]:
    """The table's rows key by key, each key's in their order."""
    code = np.zeros(table.num_rows, "int64")
    for name in by:
        column = table[name].combine_chunks().dictionary_encode("encode")
        code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, table.num_rows)
    rows, begin = table.take(order), 0
    for end in ends.tolist():
        part = rows.slice(begin, end - begin)
        yield [part[name][0].as_py() for name in by], part
        begin = end


def packed(rows: DataFrame, by: list[str], size: int = PACKET_ROWS) -> DataFrame:
    """by, packet: the rows of every key in packets, without the key's columns."""
    kinds = {name: rows.schema[name].dataType.simpleString() for name in by}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            made = [(*key, closed(part.drop_columns(by).combine_chunks())) for key, part in _by_key(table, by)]
            fields = [*[table.schema.field(name).type for name in by], pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), fields, strict=True)], names=[*by, "packet"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= size:
                yield close(held)
                held, n = [], 0
        if held:
            yield close(held)

    return rows.mapInArrow(pack, ", ".join([f"{name} {kind}" for name, kind in kinds.items()] + ["packet binary"]))
