"""A bit table of fixed size over 64-bit hashes: drops rows that no join needs.

It only ever drops hashes that are not in the table, whatever their number;
when very many hashes fill it up, rows pass and the join behind does the work.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLE_BITS = 24


def passes(table, hashes):
    """Flags of the unsigned ``hashes`` that may be in the table of bytes."""
    slot = hashes >> np.uint64(64 - TABLE_BITS)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _part(batches):
    flags = np.zeros(1 << TABLE_BITS, bool)
    for b in batches:
        flags[b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - TABLE_BITS)] = True
    words = np.packbits(flags, bitorder="little").view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])


def bit_table(hashes: DataFrame) -> bytes:
    """Flags of the leading bits of a column of hashes: 2**TABLE_BITS / 8 bytes,
    merged on the executors into at most that many bits for the driver."""
    rows = hashes.mapInArrow(_part, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << TABLE_BITS) // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.tobytes()
