"""URL filters: a sorted digest array, probed by vectorised binary search.

Rules are (action, host, path prefix). Their keys (host + path) are stored as a
sorted array of 64-bit xxhash digests with the full strings and the actions
beside it; the file is written to the shared folder, fetched once by every
executor and memory-mapped there. A URL probes the digests of its host suffixes
of as many labels as any rule's host has with all the rule path lengths at once,
and a hit counts only if the stored string equals the probed one. The longest
rule that fits wins (in bytes; of two as long, the one with the longer host). Where no rule fits, the verdict is the method's: a second
array of blocked names (labels of a host), otherwise allow.

Scale: one pass without a shuffle; a task's closure holds the files' names and
the lengths that occur, all else is read from the maps, which are bounded by the
rule list, not by the pages, and shared by all workers of a host through the page
cache. A page probes (label counts x path lengths) digests, however long its host.

Defined cases: page ids are integers or cast to them; a null url or one without
`://` has an empty host and path and is allowed; repeated rows are judged each;
an empty table gives an empty result; an empty rule list fits nothing; of rules
with one host and path the last counts; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _rows
from ._store import shared_file

#: Names under which nothing is wanted where no rule decides.
BLOCKED_NAMES = ("spam-farm", "cheap-pills")
ACTIONS = ("allow", "block")


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(action, host, path prefix) of a text file's lines `action host/path`; blank lines and those that begin with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    out = []
    for (line,) in lines.toLocalIterator():  # the rule list, which the driver holds
        action, _, key = line.partition(" ")
        host, slash, rest = key.strip().partition("/")
        if action not in ACTIONS or not host:
            raise ValueError(f"not a rule: {line}")
        out.append((action, host.lower(), slash + rest))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class DigestArray:
    """Strings sorted by 64-bit digest: digests, offsets, marks and UTF-8 bytes in one file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view(np.uint64)[0])
        self.digests = data[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = data[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.marks = data[16 + 16 * n : 16 + 17 * n]
        self.text = data[16 + 17 * n :]

    @staticmethod
    def parts(strings: dict[str, int]) -> list[bytes]:
        """The file's parts; each string has a mark of one byte."""
        keyed = sorted((xxhash.xxh64_intdigest(r), r, m) for r, m in ((s.encode("utf-8", "surrogatepass"), m) for s, m in strings.items()))
        offsets = np.append(0, np.cumsum([len(r) for _, r, _ in keyed])).astype(np.uint64)
        return [np.array([len(keyed)], np.uint64).tobytes(), np.array([d for d, _, _ in keyed], np.uint64).tobytes(), offsets.tobytes(), bytes(m for _, _, m in keyed), b"".join(r for _, r, _ in keyed)]

    def string(self, k: int) -> str:
        return self.text[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes().decode("utf-8", "surrogatepass")

    def find(self, strings: list[str]) -> np.ndarray:
        """The stored position of each string, -1 where it is not stored."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.digests) or not strings:
            return out
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        key = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw))
        low = np.searchsorted(self.digests, key, side="left")
        for i in np.flatnonzero(self.digests[np.minimum(low, len(self.digests) - 1)] == key):
            j = int(low[i])
            while j < len(self.digests) and self.digests[j] == key[i]:  # equal digests: compare the full strings
                if self.text[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == raw[i]:
                    out[i] = j
                    break
                j += 1
        return out


def _ship(spark: SparkSession, strings: dict[str, int], name: str) -> str:
    """Writes an array to the shared folder, from where executors, new ones too, fetch it."""
    name = f"{name}-{uuid.uuid4().hex[:12]}.digests"
    spark.sparkContext.addFile(shared_file(spark, name, DigestArray.parts(strings)))
    return name


_open: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    if name not in _open:
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def _suffixes(host: str, labels: list[int]) -> list[str]:
    """The host's last n labels, for each n of `labels` (the largest first) that it has."""
    parts = host.rsplit(".", labels[0]) if labels else []
    return [".".join(parts[-n:]) for n in labels if len(parts) >= n]


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]], blocked: Iterable[str] = BLOCKED_NAMES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (host + path of the winning rule or null), verdict."""
    action, names = {}, dict.fromkeys(blocked, 0)
    lengths, labels = set(), set()
    for a, host, path in rules:
        action[host + path] = ACTIONS.index(a)
        lengths.add(len(path))
        labels.add(host.count(".") + 1)
    spark = pages.sparkSession
    rule_file, block_file = _ship(spark, action, "rules"), _ship(spark, names, "blocked")
    lengths, labels, longest = sorted(lengths), sorted(labels, reverse=True), max(map(len, names), default=0)

    def run(batches):
        rules_, blocked_ = _array(rule_file), _array(block_file)
        size = np.append(np.diff(rules_.offsets.astype(np.int64)), -1)  # the last stands for no rule
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            probe, row = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                if h:
                    own = [s + p[:n] for s in _suffixes(h, labels) for n in lengths if len(p) >= n]
                    probe += own
                    row += [i] * len(own)
            at = rules_.find(probe)
            best = np.full(len(hosts), -1, np.int64)
            for i, j in zip(np.array(row, np.int64)[at >= 0], at[at >= 0]):
                if size[j] > size[best[i]]:
                    best[i] = j
            own = [(i, part) for i, h in enumerate(hosts) if best[i] < 0 for part in set(h.split(".")) if 0 < len(part) <= longest]
            bad = {own[k][0] for k in np.flatnonzero(blocked_.find([part for _, part in own]) >= 0)}
            rule = [rules_.string(j) if j >= 0 else None for j in best]
            verdict = [ACTIONS[rules_.marks[j]] if j >= 0 else "block" if i in bad else "allow" for i, j in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    own = pages.select(_rows.named(id_col).cast("long").alias("page_id"), _rows.named(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    return own.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
