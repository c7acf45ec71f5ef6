"""Exact dedup by deterministic block naming (DataFrame operations only).

Texts are cut into blocks of a fixed number of characters. The distinct blocks
are sorted and numbered; then adjacent names are paired, the distinct pairs are
sorted and numbered, and so on, until one integer names the whole document.
Two documents have the same (level, name) exactly when their texts are equal.

Scale: a distinct block is shuffled once (after map-side dedup); everything
later moves only digests and integers. The number of levels is the logarithm
of the longest document's length. A block or a group of copies that holds a
large share of all rows meets only map-side combined aggregates and joins of written
tables, whose hot partitions adaptive execution splits. Digests (SHA-256) stand for blocks in one join;
that they are collision-free over all blocks is checked, and a collision
raises an error instead of merging documents.

Defined cases: ids are integers or cast to them; null text counts as empty; rows
that repeat a doc_id with the same text are copies of one document, of which one
row stays (where other columns differ, the one with the smallest digest of the
whole row); a null doc_id is smaller than any other; an empty table gives an
empty result; extra columns, whatever their names, pass through `deduplicated`
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _rows
from ._store import stage

BLOCK_CHARS, SECTION_BLOCKS = 4096, 64
#: Of a row that repeats, one task writes out so many at most.
REPEATS = 100_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), *_LOWER)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _cut(text: Column, size: int) -> Column:
    """array<string>: consecutive parts of `size` characters; one empty part of an empty text."""
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * size + 1, F.lit(size)))


def _named(items: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct rows of `keys`, sorted within hash partitions and numbered.

    A number is (partition, rank): it depends on nothing but the rows, so a
    task that runs again gives the same numbers; the table is written before
    anything reads it.
    """
    return items.select(*keys).distinct().sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, digest (binary), copies (repeated rows), level, name."""
    base = docs.select(_rows.named(id_col).cast("long").alias("doc_id"), normalised(_rows.named(text_col)).alias("t"))
    # cut in two steps, sections and their blocks, so that a very long text is not walked from its start for every block;
    # the digest is computed below the explode, once for each text
    base = base.withColumn("digest", _digest(F.col("t")))
    sections = base.select("doc_id", "digest", F.posexplode(_cut(F.col("t"), SECTION_BLOCKS * block_chars)).alias("s", "part"))
    blocks = sections.select("doc_id", "digest", "s", F.posexplode(_cut(F.col("part"), block_chars)).alias("p", "b"))
    blocks = blocks.select("doc_id", "digest", (F.col("s") * SECTION_BLOCKS + F.col("p")).alias("i"), "b")
    # level 0: distinct blocks get integer names; only their digests travel on
    names = stage(_named(blocks, ["b"], "name").select(_digest(F.col("b")).alias("block"), "name"), "block-names")
    clash = names.groupBy("block").count().where("count > 1").limit(1).count()
    if clash:
        raise ValueError("two different blocks have one SHA-256 digest; choose another block size")
    placed = blocks.select("doc_id", "digest", "i", _digest(F.col("b")).alias("block"))
    level = stage(placed.join(names, "block").select("doc_id", "digest", "i", "name"), "level-0")
    done, k = [], 0
    while True:
        pairs = level.groupBy("doc_id", "digest", (F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("r"), F.max("i").alias("top")
        )
        # a document whose only block is the first has its name
        done.append(level.groupBy("doc_id", "digest").agg(F.max("i").alias("m"), F.max("name").alias("name")).where("m = 0").select("doc_id", "digest", F.lit(k).alias("level"), "name"))
        longest = level.agg(F.max("i")).first()[0]
        if not longest:
            break
        # pairs of documents that still have more than one block
        unfinished = level.where("i = 1").select(F.col("doc_id").alias("d"), F.col("digest").alias("g")).distinct()
        pairs = stage(pairs.join(unfinished, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left_semi").select("doc_id", "digest", "i", "l", F.coalesce("r", F.lit(-1)).alias("r")), "pairs")
        names = stage(_named(pairs, ["l", "r"], "name"), "pair-names")
        level = stage(pairs.join(names, ["l", "r"]).select("doc_id", "digest", "i", "name"), f"level-{k + 1}")
        k += 1
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    copies = base.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    same = F.col("n.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("n.digest") == F.col("c.digest"))
    return named.alias("n").join(copies.alias("c"), same).select("c.doc_id", "c.digest", "c.copies", "n.level", "n.name")


def _grouped(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, digest, copies, keep_id, group_size."""
    ids = stage(identities(docs, id_col, text_col, block_chars), "identities")
    groups = stage(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return stage(ids.join(groups, ["level", "name"]).select("doc_id", "digest", "copies", "keep_id", "group_size"), "grouped")


def _each_copy(rows: DataFrame) -> DataFrame:
    """rows, each as often as its `copies`, with `copy` from 1; a row with very many is dealt out in parts."""
    few = rows.where(F.col("copies") <= REPEATS).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    parts = rows.where(F.col("copies") > REPEATS).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(REPEATS).cast("long"))))
    dealt = parts.repartition(F.col("doc_id"), F.col("first"))
    return few.unionByName(dealt.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("copies"), F.col("first") + REPEATS - 1)))).drop("first"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _each_copy(_grouped(docs, id_col, text_col, block_chars))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    odd = _grouped(docs, id_col, text_col, block_chars).where(~stays | (F.col("copies") > 1))
    odd = stage(odd.select(F.col("doc_id").alias("o_id"), F.col("digest").alias("o_digest"), stays.alias("stays")), "odd")
    rows = _rows.held(docs).withColumn("id", _rows.field(id_col).cast("long")).withColumn("digest", _digest(normalised(_rows.field(text_col))))
    match = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("digest") == F.col("o_digest"))
    kept = rows.join(odd, match, "left_anti").select("row")
    if odd.where("stays").limit(1).count():  # rows that repeat, of which one stays
        kept = kept.unionByName(_rows.one_of(rows.join(odd.where("stays"), match, "left_semi"), "id", "digest"))
    return _rows.released(kept)
