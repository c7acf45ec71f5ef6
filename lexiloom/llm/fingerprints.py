"""Document fingerprints: one-permutation MinHash (DataFrame operations only).

Every 5-word shingle is hashed once; the hash's high bits name its bin and the
smallest hash of a bin stays. Empty bins are filled by optimal densification:
every bin has a sequence of bins of its own, the same for all texts, and takes the
first one in it that is filled. The sequence is PROBES bins drawn at random and
then all bins in the order of a hash of both, so that it always finds one and no
two bins share its order. The low-order bits of the bins are packed into longs;
likeness is the share of equal cells, corrected for chance matches.

Scale: a fingerprint is computed within its row, from whole texts. `with_next`
needs each document's successor in the order of ids: ids alone are sorted by
range, and the successor of a partition's last id comes from a table with one
row per partition. Texts are shuffled once by id; of a successor only the
prefix that is needed travels.

Defined cases: null text counts as empty; a text of 1 to 4 words has one
shingle of all its words and an empty one a shingle of its own; rows that
repeat a doc_id share its successor, the next smaller id (of whose rows the one
with the smallest text digest counts); a null doc_id is the smallest; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _rows
from ._store import stage

SHINGLE, BINS, BITS, PROBES = 5, 256, 4, 8
PER_LONG = 64 // BITS
_NULL_ID = -(2**63)


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def probe_bins() -> list[list[int]]:
    """The first bins that each empty bin tries, by attempt."""
    rnd = random.Random(20_240_607)
    return [[rnd.randrange(BINS) for _ in range(BINS)] for _ in range(PROBES)]


def fingerprint(text: str) -> Column:
    """array<long> of a text column given by name: BINS cells of BITS bits."""
    shift = 64 - BINS.bit_length() + 1
    empty = (1 << shift) - 1
    half = BINS // 2
    probes = ["array(" + ",".join(map(str, own)) + ")" for own in probe_bins()]
    marks = "array(" + ",".join(f"{((b + 1) << shift) - 1}L" for b in range(-half, half)) + ")"
    words = f"split(btrim(lower({text}), ' \\t\\n\\r\\f'), '\\\\s+')"
    grams = f"if(size(w) >= {SHINGLE}, transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({', '.join(f'w[i + {k}]' for k in range(SHINGLE))})), array(xxhash64(array_join(w, ' '))))"
    # each bin's smallest hash, in the order of bins; a mark where the bin has none
    lowest = f"filter(u, (x, i) -> i = 0 or shiftright(x, {shift}) <> shiftright(u[i - 1], {shift}))"
    cells = f"transform(f, x -> if((x & {empty}L) = {empty}L, null, x))"
    filled = "filter(transform(d, (x, j) -> if(x is null, -1, j)), j -> j >= 0)"
    rest = f"d[cast(array_min(transform(s, b -> (xxhash64(j, b) & {-BINS}L) | b)) & {BINS - 1} as int)]"
    dense = f"transform(d, (x, j) -> coalesce(x, {', '.join(f'd[{p}[j]]' for p in probes)}, {rest}))"
    packed = f"transform(sequence(0, {BINS // PER_LONG - 1}), g -> " + " | ".join(f"shiftleft(e[{PER_LONG} * g + {t}] & {(1 << BITS) - 1}L, {BITS * t})" for t in range(PER_LONG)) + ")"
    body = _let(words, "w", _let(f"sort_array(concat({grams}, {marks}))", "u", _let(lowest, "f", _let(cells, "d", _let(filled, "s", _let(dense, "e", packed))))))
    return F.expr(body)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of two fingerprint columns given by name."""
    ones = int("1" * PER_LONG, 16)
    other = " | ".join(["z", *(f"shiftrightunsigned(z, {k})" for k in range(1, BITS))])
    unlike = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count({_let('x ^ y', 'z', f'({other}) & {ones}L')})), 0, (n, c) -> n + c)"
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (1 - F.expr(unlike) / F.lit(float(BINS)) - chance) / (1 - chance))


def successors(ids: DataFrame) -> DataFrame:
    """ids: doc_id (distinct, not null), n. Adds next_id (the next smaller; the largest after the last), prev_id and prev_n."""
    ordered = stage(ids.orderBy(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ordered-ids")
    # one row per partition, in one task: as many rows as there are partitions
    every = Window.partitionBy(F.lit(1)).orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = ordered.groupBy("part").agg(F.max_by(F.struct("doc_id", "n"), "doc_id").alias("first"), F.min_by(F.struct("doc_id", "n"), "doc_id").alias("last"))
    edge = edge.select(
        "part",
        F.coalesce(F.lead("first.doc_id").over(every), F.first("first.doc_id").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(every), F.last("last").over(whole)).alias("before"),
    )
    run = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    return ordered.join(F.broadcast(edge), "part").select(
        "doc_id", "n", F.coalesce(F.lead("doc_id").over(run), "after").alias("next_id"),
        F.coalesce(F.lag("doc_id").over(run), "before.doc_id").alias("prev_id"), F.coalesce(F.lag("n").over(run), "before.n").alias("prev_n"),
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = _rows.named(id_col).cast("long")
    base = docs.select(own.alias("own_id"), F.coalesce(own, F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(_rows.named(text_col), F.lit("")).alias("text"))
    order = stage(successors(base.groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("n"))), "successors")
    keyed = base.withColumn("fp", fingerprint("text"))
    following = keyed.join(order.select(F.col("doc_id").alias("o_id"), "prev_id", (F.floor(F.col("prev_n") / 3)).cast("int").alias("room")), F.col("doc_id") == F.col("o_id"))
    following = following.select("prev_id", F.struct(F.sha2("text", 256).alias("digest"), F.col("text").substr(F.lit(1), F.col("room")).alias("head"), "fp", "own_id").alias("next"))  # the same columns as the other side of the join below, so that both read one exchange
    following = following.groupBy("prev_id").agg(F.min("next").alias("next"))
    n = F.length("text")
    kept = n - F.floor(n / 3).cast("int")
    joined = keyed.join(following, F.col("doc_id") == F.col("prev_id")).select("own_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), F.concat(F.col("text").substr(F.lit(1), kept), F.col("next.head").substr(F.lit(1), n - kept)).alias("edited"))
    joined = joined.withColumn("edited_fp", fingerprint("edited"))
    return joined.select(
        F.col("own_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
