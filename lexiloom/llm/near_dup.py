"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents are sets of 5-word shingles. Band and row counts follow from the
target recall at the threshold. Band hashes are shuffled; documents that share
one are tied to the smallest of them, which gives candidate groups. Within a
group all links are found on the full shingle sets. A large group is first held
against one set of it: two sets that are each within half of the threshold's
distance of that one are links by the triangle inequality, so that the core of a
group (copies of one template with few changes) is never compared pair by pair.
What is left is dealt into chunks by a hash, one task per pair of chunks, and a
task gives back only one row per member (its links, and a neighbour for the
classes).

Documents with equal shingle sets form one set node; only one of them is
compared, and the copies count as links of each other.

Scale: text is read twice and shuffled once, with candidate documents only (those
of large groups once more). Groups of any size are verified whole, a task at a
time of bounded size. For a group with c sets in its core and r beyond it, work
and shuffled texts grow with r * (r + c) over the chunk size, not with c * c.

Defined cases: null text counts as empty; a text without words has no links and
is a class of its own; repeated rows are copies; rows are told apart by id and
text, so null or repeated ids may stand in any number of rows; `one_of_each`
keeps one row of a class (a null id only where no row of it has one), and all
columns of its input, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _rows, _vector
from ._components import components
from ._store import stage

SHINGLE, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 280
#: A block task holds at most about two chunks: so many members and shingles each.
CHUNK_ROWS, CHUNK_SHINGLES = 256, 400_000


def banding(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding within max_hashes that finds a pair at the threshold with the target recall; an error where none does."""
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall are between 0 and 1")
    fits = []
    for rows in range(1, 30):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            fits.append((bands, rows))
    if not fits:
        raise ValueError(f"a recall of {recall} at {threshold} takes {math.ceil(math.log1p(-recall) / math.log1p(-threshold))} hashes or more, not {max_hashes}")
    return fits[-1]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_501)
    return r.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def _minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(low, (a[:, None] * s[None, k : k + 2048] + b[:, None]).min(axis=1), out=low)
    return low


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, t1 and t2 (the text's key), digest of the shingle set (null without words), n (shingles), bands (array of long)."""

    def run(batches):
        a, b = _permutations(bands * rows)
        for batch, texts in _vector.pieces(batches, lambda x: x.column(1)):
            digests, sizes, keys = [], [], []
            for s in _vector.shingle_sets(texts, shingle):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    keys.append(np.zeros(0, np.int64))
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = _minhash(s, a, b).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(rows):
                    key = _vector.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ low[:, j])
                keys.append(key.view(np.int64))
            cut = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], ["doc_id", "t1", "t2", "digest", "n", "bands"])

    t1, t2 = _text_keys(_rows.named(text_col))
    own = docs.select(_rows.named(id_col).cast("long").alias("doc_id"), _rows.named(text_col).alias("text"), t1.alias("t1"), t2.alias("t2"))
    return own.mapInArrow(run, "doc_id long, t1 long, t2 long, digest binary, n int, bands array<long>")


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each pair of the sets in a and b reaches the Jaccard threshold."""
    sets = a + b
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    vals, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1  # only shingles of two sets or more add to an intersection
    column = np.cumsum(common) - 1
    on = common[back]
    row, col = row[on], column[back[on]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(a), len(b)), np.float32)
    step = 8192
    for k in range(0, int(common.sum()), step):
        lo, hi = np.searchsorted(col, (k, k + step))
        m = np.zeros((len(sets), min(step, int(common.sum()) - k)), np.float32)
        m[row[lo:hi], col[lo:hi] - k] = 1
        inter += m[: len(a)] @ m[len(a) :].T
    union = size[: len(a), None] + size[None, len(a) :] - inter
    return inter >= threshold * union - 1e-6


def _forest(link: np.ndarray) -> np.ndarray:
    """Each member's smallest connected member, within a symmetric link matrix."""
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float, shingle: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        sets = _vector.shingle_sets(pdf["text"].fillna("").tolist(), shingle)
        node, copies, side = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), (pdf["chunk"] != pdf["left"]).to_numpy()
        if (pdf["left"] != pdf["right"]).any():  # two chunks, either of which may be empty: pairs across
            link = np.zeros((len(node), len(node)), bool)
            i, j = np.flatnonzero(~side), np.flatnonzero(side)
            if len(i) and len(j):
                link[np.ix_(i, j)] = linked([sets[k] for k in i], [sets[k] for k in j], threshold)
            link |= link.T
        else:
            link = linked(sets, sets, threshold)
            np.fill_diagonal(link, False)
        return pd.DataFrame({"node": node, "anchor": node[_forest(link)], "n_sets": link.sum(axis=1), "n_docs": link.astype(np.int64) @ copies})

    return run


def _beside_pivot(threshold: float, shingle: int):
    """Whether a set is a core member: its distance from the pivot's is at most half of the distance at the threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = _vector.shingle_sets(pdf["text"].fillna("").tolist(), shingle)
        pivot = sets[int(np.flatnonzero(pdf["pivot"].to_numpy())[0])]
        own = [(n, s) for n, s, p in zip(pdf["node"], sets, pdf["pivot"]) if not p]
        inter = [np.isin(s, pivot, assume_unique=True).sum() for _, s in own]
        core = [2 * x >= (1 + threshold) * (len(s) + len(pivot) - x) + 1e-9 for x, (_, s) in zip(inter, own)]
        return pd.DataFrame({"node": [n for n, _ in own], "core": core})

    return run


def _parts(count: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(count / CHUNK_ROWS), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def _blocks(found: DataFrame, members: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """node, anchor, n_sets, n_docs: for each block that a set stands in, a set of its class and its links there.

    found: node, root, chunk, chunks, copies, text (a written table). A small group is one block. A large one is first
    held against its pivot, its smallest node: Jaccard distance is a metric, so any two core members are links of each
    other without being compared. Blocks are made of the rest: its chunks with each other and with those of the core.
    """
    kind = "node long, anchor long, n_sets long, n_docs long"
    check = _verify(threshold, shingle)
    small = found.where("chunks = 1").select("node", "root", "copies", "text", *(F.lit(0).alias(c) for c in ("chunk", "left", "right")))
    verified = small.groupBy("root", "left", "right").applyInPandas(check, kind)
    large = members.where("chunks > 1")
    if not large.limit(1).count():
        return verified
    pivots = stage(large.groupBy("root").agg(F.min("node").alias("p"), F.first("chunks").alias("n")), "pivots")
    texts = found.where("chunks > 1").select("root", "chunk", "node", "text", F.lit(False).alias("pivot"))
    shown = found.where("chunks > 1").join(pivots.select(F.col("p").alias("node"), "n"), "node").select("root", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"), "node", "text", F.lit(True).alias("pivot"))
    core = stage(texts.unionByName(shown).groupBy("root", "chunk").applyInPandas(_beside_pivot(threshold, shingle), "node long, core boolean"), "core")
    sided = stage(large.select("node", "root", "copies", "n").join(core, "node"), "sided")
    yes, no = (lambda c: F.sum(F.when(F.col("core"), c).otherwise(0))), (lambda c: F.sum(F.when(F.col("core"), 0).otherwise(c)))
    sums = sided.groupBy("root").agg(yes(F.lit(1)).alias("k"), yes(F.col("copies")).alias("k_docs"), _parts(yes(F.lit(1)), yes(F.col("n"))).alias("cores"), _parts(no(F.lit(1)), no(F.col("n"))).alias("rims"))
    placed = stage(sided.join(stage(sums, "sums"), "root"), "placed")
    linked_core = placed.where("core").join(pivots.select("root", "p"), "root").select("node", F.col("p").alias("anchor"), (F.col("k") - 1).alias("n_sets"), (F.col("k_docs") - F.col("copies")).alias("n_docs"))
    chunk = F.when(F.col("core"), F.pmod(F.xxhash64("node"), F.col("cores"))).otherwise(F.col("cores") + F.pmod(F.xxhash64("node"), F.greatest(F.col("rims"), F.lit(1)))).cast("int")
    first = F.when(F.col("core"), F.col("cores")).otherwise(F.lit(0))
    dealt = placed.where("rims > 0").select("node", "root", "copies", chunk.alias("chunk"), F.explode(F.sequence(first, F.col("cores") + F.col("rims") - 1)).alias("other"))
    pairs = dealt.select("node", "root", "copies", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"))
    rest = pairs.join(found.select("node", "text"), "node").groupBy("root", "left", "right").applyInPandas(check, kind)
    return verified.unionByName(rest).unionByName(linked_core.select("node", "anchor", F.col("n_sets").cast("long"), F.col("n_docs").cast("long")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, class_id, keep_id, set_id, n_links, n_set_links.

    class_id and keep_id: the smallest and largest doc_id of the connected
    documents; set_id: the smallest among those with the same shingle set;
    n_links: other documents at or over the threshold; n_set_links: other
    shingle sets at or over it.
    """
    return _classes(docs, threshold, recall, id_col, text_col, shingle)[0].select("doc_id", "class_id", "keep_id", "set_id", "n_links", "n_set_links")


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, bool]:
    """near_classes with t1, t2 and keep (the struct doc_id, t1, t2 of the row that stays, null for a text without words), and whether an id, or null, stands in several rows."""
    bands, rows = banding(threshold, recall, MAX_HASHES)
    sig = stage(signatures(docs, bands, rows, id_col, text_col, shingle), "signatures")
    own = F.struct("doc_id", "t1", "t2")
    sets = sig.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("one"), F.max(own).alias("last"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    sets = sets.withColumn("set_id", F.col("one.doc_id"))
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    keys = sets.select("node", F.explode("bands").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"), "v"), "shared-bands")
    ties = keys.join(shared, F.col("key") == F.col("k")).select(F.col("node").alias("u"), "v").where("u <> v").distinct()
    groups = stage(components(ties).join(sets.select("node", "set_id", "copies", "n"), "node"), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    chunks = stage(sizes.select("root", _parts(F.col("c"), F.col("s")).alias("chunks")), "chunks")
    members = stage(groups.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "members")
    # one text of each candidate set, found by its id, or by id and text where ids repeat
    wanted = members.select("node", "root", "chunks", "chunk", "copies", F.col("set_id").alias("w_id"))
    texts = docs.select(_rows.named(id_col).cast("long").alias("t_id"), _rows.named(text_col).alias("text"))
    repeated = sig.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    same = F.col("t_id").eqNullSafe(F.col("w_id"))
    if repeated:
        k1, k2 = _text_keys(F.col("text"))
        texts = texts.withColumn("k1", k1).withColumn("k2", k2)
        wanted = wanted.join(sets.select("node", "one.t1", "one.t2"), "node")
        same = same & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    found = texts.join(wanted, same)
    found = found.select("node", "root", "chunk", "chunks", "copies", "text")
    found = found.dropDuplicates(["node"]) if repeated else found
    blocks = stage(_blocks(stage(found, "candidates"), members, threshold, shingle), "blocks")
    links = blocks.groupBy("node").agg(F.sum("n_sets").alias("n_set_links"), F.sum("n_docs").alias("n_docs"))
    roots = components(blocks.select(F.col("node").alias("u"), F.col("anchor").alias("v")))
    nodes = sets.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stage(nodes.select("node", "digest", "set_id", "last", "copies", "root", F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"), (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "nodes")
    classes = stage(nodes.groupBy("root").agg(F.min("set_id").alias("class_id"), F.max("last").alias("keep")), "classes")
    named = nodes.join(classes, "root").select("digest", "class_id", F.col("keep.doc_id").alias("keep_id"), "set_id", "n_links", "n_set_links", "keep")
    full = sig.where("digest is not null").select("doc_id", "t1", "t2", "digest").join(named, "digest").drop("digest")
    zero = F.lit(0).cast("long")
    empty = sig.where("digest is null").select("doc_id", "t1", "t2", *(F.col("doc_id").alias(c) for c in ("class_id", "keep_id", "set_id")), zero.alias("n_links"), zero.alias("n_set_links"), F.lit(None).cast(named.schema["keep"].dataType).alias("keep"))
    return full.unionByName(empty), repeated


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: of each class one row, which has the largest id, with docs' columns."""
    found, repeated = _classes(docs, threshold, recall, id_col, text_col, shingle)
    t1, t2 = _text_keys(_rows.field(text_col))
    own = {"doc_id": _rows.field(id_col).cast("long")} | ({"t1": t1, "t2": t2} if repeated else {})
    stays = F.struct("doc_id", "t1", "t2").eqNullSafe(F.col("keep"))
    by_row = found.where("n_links > 0").groupBy(*(F.col(c).alias(f"o_{c}") for c in own)).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = stage(by_row.where("not stays or n > 1"), "dropped")
    rows = _rows.held(docs).withColumns(own)
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in own))
    kept = rows.join(odd, same, "left_anti").select("row")
    if repeated:  # equal id and text in several rows, of which one stays
        kept = kept.unionByName(_rows.one_of(rows.join(odd.where("stays"), same, "left_semi"), *own))
    return _rows.released(kept)
