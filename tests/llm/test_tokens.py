import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lexiloom.llm import _bpe, _cutting, packing, token_counts  # noqa: E402
from lexiloom.llm.queries import tokenizer_file  # noqa: E402


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_file())


def odd_texts(n=1500):
    rnd = random.Random(3)
    signs = "ab's'tlrevem d  \n\t\r.,!é日本  1२٣_-\U0001f600​\x1c\x85 <|endoftext|>'"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "\n\n", "it's we'll I'LL 'tis x' 's", "hello <|endoftext|> there", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "a  <|endoftext|>  b's<|endoftext|>'s", "<|endoftext|", "x <|<|endoftext|>|>"]


@pytest.mark.parametrize("spans", [True, False])
def test_ids_and_spans_equal_the_library(tok, spans):
    texts = odd_texts()
    want = tok.encode_batch(texts, add_special_tokens=False)
    for got in _bpe.Encoder(tokenizer_file(), spans).encode(texts, spans=spans):
        first, ids, bounds = got[:3]
        for k in range(len(bounds) - 1):
            lo, hi = bounds[k], bounds[k + 1]
            assert ids[lo:hi].tolist() == want[first + k].ids
            if spans:
                assert list(zip(got[3][lo:hi].tolist(), got[4][lo:hi].tolist())) == want[first + k].offsets


@pytest.mark.parametrize("end", ["it's", "can't", "I'm", "he'd", "we'll", "you're", "it'", "'s", "it'sé", "it's\n"])
@pytest.mark.parametrize("before", [[], ["some text", "it's"]])
def test_contraction_at_the_end_of_a_slice(tok, before, end):
    texts = [*before, end]
    for spans in (True, False):
        first, ids, bounds = next(_bpe.encoder(tokenizer_file(), spans).encode(texts, spans=spans))[:3]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [c.ids for c in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_add_up(odd_docs, tok, rule):
    rows = token_counts.section_token_counts(odd_docs, tokenizer_file(), rule=rule).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d in odd_docs.collect():
        own, text = by[d.doc_id], d.text or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        times = sum(x.doc_id == d.doc_id for x in odd_docs.collect())
        assert sum(r.n_tokens for r in own) == n * times and all(r.doc_tokens == n for r in own)
        assert max(r.end for r in own) == len(text)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_the_library(spark, tok, rule):
    """Each section's tokens counted one by one from the library's own offsets."""
    texts = [t + "\n" + u for t, u in zip(odd_texts(300), reversed(odd_texts(300)))]
    want = {}
    for d, t in enumerate(texts):
        starts = [0] + [i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t)]
        counts = [0] * len(starts)
        for a, b in tok.encode(t, add_special_tokens=False).offsets:
            own = [sum(starts[k] <= c < (starts[k + 1] if k + 1 < len(starts) else len(t)) for c in range(a, max(b, a + 1))) for k in range(len(starts))]
            counts[own.index(max(own)) if rule == "majority" else max(k for k, s in enumerate(starts) if s <= a)] += 1
        want[d] = list(zip(starts, counts))
    rows = token_counts.section_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_file(), rule=rule).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.section)):
        got[r.doc_id].append((r.start, r.n_tokens))
    assert got == want


def test_boundary_rules():
    starts = np.array([0, 3])
    assert token_counts.attribute(starts, 10, np.array([2]), np.array([6]), "first").tolist() == [1, 0]
    assert token_counts.attribute(starts, 10, np.array([2]), np.array([6]), "majority").tolist() == [0, 1]
    assert token_counts.attribute(starts, 10, np.array([2]), np.array([4]), "majority").tolist() == [1, 0]


def test_packing_is_a_partition(odd_docs, tok):
    rows = packing.packed(odd_docs, tokenizer_file()).collect()
    ids = defaultdict(list)
    for d in odd_docs.collect():
        ids[d.doc_id].append(tok.encode(d.text or "", add_special_tokens=False).ids + [0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, docs in ids.items():
        assert sum(r.length for r in pieces[k]) == sum(map(len, docs))
        for r in pieces[k]:
            assert any(r.doc_tokens == len(d) and zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d in docs)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_plan_covers_demand_with_little_waste():
    rnd = np.random.default_rng(1)
    lengths, demand = np.unique(rnd.integers(1, 65, 20_000), return_counts=True)
    got = defaultdict(int)
    count = 0
    for pattern, times in _cutting.plan(lengths, demand, 64):
        assert sum(l * n for l, n in pattern.items()) <= 64
        count += times
        for l, n in pattern.items():
            got[l] += n * times
    assert got == dict(zip(lengths.tolist(), demand.tolist()))
    assert count <= 1.01 * (lengths * demand).sum() / 64 + 5


def test_empty_table(no_docs):
    assert packing.packed(no_docs, tokenizer_file()).count() == 0
    assert token_counts.section_token_counts(no_docs, tokenizer_file()).count() == 0
