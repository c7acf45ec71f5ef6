import hashlib
from collections import defaultdict

import pytest

from lexiloom.llm import exact_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_against_brute_force(spark, odd_docs, block):
    rows = odd_docs.where("doc_id is null or doc_id not in (5, 6, 7)") if block < 100 else odd_docs
    rows = rows.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, odd_docs.schema), block_chars=block).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for g in got:
        text = next(lower(r.text) for r in rows if r.doc_id == g.doc_id and hashlib.sha256(lower(r.text).encode()).hexdigest() == g.text_sha256)
        ids = groups[text]
        assert g.group_size == len(ids)
        assert g.keep_id == max((i for i in ids if i is not None), default=None)
        kept[text] += g.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_blocks_do_not_mix(spark):
    texts = ["aaaa", "aaaaa", "aaaaaaaa", "aaaabbbb", "bbbbaaaa", "aaaabbbbaaaa", "aaaabbbbaaaabbbb", "aaaabbbbbbbbaaaa", "aaaa" * 5, "aaaa" * 6, "aaaa" * 5 + "aaa"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, block_chars=4).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id % 11 + 11 for r in got)


def test_deduplicated_keeps_columns(odd_docs):
    out = exact_dedup.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [lower(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r.text) for r in odd_docs.collect()})


def test_clashing_names_pass_unchanged(clashing_docs):
    rows = {r.doc_id: r for r in clashing_docs.collect()}
    out = exact_dedup.deduplicated(clashing_docs)
    assert out.columns == clashing_docs.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 5, 7] and all(r == rows[r.doc_id] for r in got)


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(1, "same", "a"), (1, "SAME", "b"), (1, "same", "a"), (None, "same", "c"), (None, "x", "d"), (None, "x", "e")]
    kept = {tuple(exact_dedup.deduplicated(spark.createDataFrame(own, "doc_id long, text string, more string").repartition(n)).collect()) for own in (rows, rows[::-1]) for n in (1, 3)}
    assert len({frozenset(k) for k in kept}) == 1  # the same rows whatever the order
    assert sorted(t.text.lower() for t in next(iter(kept))) == ["same", "x"]


def test_rows_that_repeat_very_often(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATS", 4)
    docs = spark.createDataFrame([(7, "a")] * 11 + [(8, "A")] * 4 + [(9, "b")], "doc_id long, text string")
    got = [(r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(got) == sorted([(7, 15, False)] * 11 + [(8, 15, False)] * 3 + [(8, 15, True)] + [(9, 1, True)])


def test_empty_table(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.deduplicated(no_docs).count() == 0
