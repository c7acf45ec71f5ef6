"""Packing documents into training sequences: cutting-stock column generation.

A document's tokens are cut into pieces of the full sequence length and one
rest. Lengths are rounded up to classes of `unit` tokens, and the histogram of
classes (capacity / unit entries, whatever the corpus) goes to the driver; a
linear program over patterns of classes, priced by knapsack dynamic
programming, is rounded to whole patterns. The pieces of a class are ranked,
and a rank is mapped to pattern, sequence and slot by arithmetic on a bounded
table; offsets are running sums within a sequence.

Scale: documents are encoded once, without a shuffle; the piece table (six
numbers a piece) is written, then ranked by windows over (length, chunk) where
the number of chunks follows the number of pieces, so that one common length
does not land in one task. The table that is broadcast has at most a few rows
for each length and pattern. Sequences are padded to `capacity`, except where
their total is a power of two, which stays as it is: `padded` says to what.

Defined cases: ids are integers or cast to them; null text is empty (one end token); repeated rows are packed
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _rows
from ._bpe import encoder
from ._cutting import plan
from ._store import stage

CAPACITY = 1024
UNIT = 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CHUNK_ROWS = 500_000


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts every document's ids (with the end id) into pieces of `capacity` and a rest."""

    def run(batches):
        enc = encoder(tokenizer_path, spans=False)
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, ids, bounds in enc.encode(texts):
                ids = ids.astype("<u4", copy=False)
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(len(bounds) - 1):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], end).astype("<u4").tobytes()
                    n = len(own) // 4
                    rows += [(first + k, s, min(capacity, n - s), zlib.crc32(own[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(_rows.named(id_col).cast("long").alias("doc_id"), _rows.named(text_col).alias("text")).mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("class", F.ceil(F.col("length") / unit)), "pieces")
    histogram = sorted(tuple(r) for r in cut.groupBy("class").count().collect())  # at most capacity / unit rows
    total = sum(n for _, n in histogram)
    taken: dict[int, int] = {}
    table, sequence = [], 0
    for pattern, times in plan([c for c, _ in histogram], [n for _, n in histogram], capacity // unit):
        for at, (c, n) in enumerate(sorted(pattern.items(), reverse=True)):
            low = taken.get(c, 0)
            table.append((c, low, low + n * times, n, sequence, at))
            taken[c] = low + n * times
        sequence += times
    slots = spark.createDataFrame(table, "slot_class long, low long, high long, copies long, base long, at long")
    chunks = max(64, -(-total // CHUNK_ROWS))
    dealt = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)))
    by_chunk = dealt.groupBy("class", "chunk").count()
    before = by_chunk.select("class", "chunk", (F.sum("count").over(Window.partitionBy("class").orderBy("chunk")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("class", "chunk").orderBy("doc_id", "start")) - 1).join(before, ["class", "chunk"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    hit = (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    own = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(slots), hit).withColumn("sequence_id", F.col("base") + F.floor(own / F.col("copies"))).withColumn("copy", own % F.col("copies"))
    sequence = Window.partitionBy("sequence_id")
    rows = placed.withColumn("offset", F.sum("length").over(sequence.orderBy("at", "copy")) - F.col("length")).withColumn("sequence_tokens", F.sum("length").over(sequence))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", padded(F.col("sequence_tokens"), capacity).alias("padded"))


def padded(tokens: Column, capacity: int) -> Column:
    """The length to which a sequence of so many tokens is padded."""
    return F.when(F.bit_count(tokens) == 1, tokens).otherwise(F.lit(capacity).cast("long"))
