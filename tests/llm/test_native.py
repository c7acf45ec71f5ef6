import hashlib
import json
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import chat, fingerprints, url_filter


def test_edited_texts_and_likeness(spark):
    rnd = random.Random(6)
    rows = [(i * 3, " ".join(f"w{rnd.randrange(500)}é" for _ in range(n))) for i, n in enumerate([0, 1, 2, 4, 5, 6, 20, 100, 300, 300, 800])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    order = sorted(rows, reverse=True)
    jaccard = lambda a, b: len(a & b) / len(a | b)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(text)
        cut = n // 3
        edited = text[: n - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(shingles(text), shingles(edited)), abs=0.17)
        assert r.near_next == pytest.approx(jaccard(shingles(text), shingles(nxt)), abs=0.17)
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)


def _spark_hash(*values) -> int:
    """xxhash64 over several columns: each hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & 0xFFFFFFFF).to_bytes(4, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _plain_fingerprint(text: str) -> str:
    words = re.split(r"[ \t\n\x0b\f\r]+", text.lower().strip(" \t\r\n\f"))
    n = fingerprints.BINS
    grams = [_spark_hash(*words[i : i + 5]) for i in range(len(words) - 4)] or [_spark_hash(" ".join(words))]
    cells: list = [None] * n
    for g in grams:
        b = (g >> 56) + n // 2  # bins in the order of signed hashes
        cells[b] = g if cells[b] is None else min(cells[b], g)
    filled = [b for b in range(n) if cells[b] is not None]
    full = []
    for j in range(n):
        tries = [j, *(p[j] for p in fingerprints.probe_bins()), *sorted(filled, key=lambda b: (_spark_hash(j, b) & -n) | b)]
        full.append(next(cells[b] for b in tries if cells[b] is not None))
    longs = [sum((full[g + t] & 15) << (4 * t) for t in range(16)) for g in range(0, n, 16)]
    return "".join(f"{x:016x}" for x in longs)


def test_fingerprints_equal_a_plain_version(spark):
    rnd = random.Random(12)
    texts = ["", "one", "a b c d e", "Tab\tand  blanks\n here too ok", *(" ".join(f"W{rnd.randrange(900)}" for _ in range(n)) for n in (6, 7, 9, 14, 30, 60, 150, 400, 2000))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in fingerprints.with_next(docs).collect()}
    assert got == {i: _plain_fingerprint(t) for i, t in enumerate(texts)}


def test_smallest_id_and_null(spark):
    got = fingerprints.with_next(spark.createDataFrame([(None, "abc"), (-(2**63), "def"), (5, "ghi")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, -(2**63)), (True, 5)]


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    rows = fingerprints.with_next(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].fingerprint == by[4][0].fingerprint and None in by and len(by[2]) == 2
    assert fingerprints.with_next(no_docs).count() == 0


def test_one_document_is_its_own_next(spark):
    (r,) = fingerprints.with_next(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


TRICKY = ["plain", "", "### user: x </turn>\n", "\\", "\\\\", "\\###", "</turn>", "\\</turn>\n</turn>\n", "a\n\n### b", "ends with \\", "####", " </turn>\n ", "é\U0001f600"]


def test_chat_round_trip(spark):
    rnd = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 5)):
            rows.append((c if c else None, t, rnd.choice(["user", "assistant", "tool:x", "a\\c:b", "\\", "", None]), "".join(rnd.choice(TRICKY) for _ in range(rnd.randint(0, 4))) if rnd.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical(chat.from_rows(df))).withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")


def test_very_long_roles_and_texts(spark):
    marks = ["\\", ":", "c", "###", "</turn>", "\\c", "x" * 50]
    rnd = random.Random(2)
    long_role = "".join(rnd.choice(marks) for _ in range(12_000))
    rows = [(1, 0, long_role, long_role), (1, 1, "\\" * 100_001, "\\" * 100_000 + "c"), (1, 2, "r" * 100_000, "t" * 100_000), (1, 3, "assistant", "\\###</turn>\n" * 10_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.formatted(chat.canonical(chat.from_rows(df))).withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, _, a, b in rows]
    assert r.loss == rows[-1][3]


QA = [("user", "q"), ("assistant", "a")]
MESSAGES = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]


def test_layouts(spark):
    records = [
        ({"messages": MESSAGES}, "messages", QA),
        ({"conversations": [{"value": "q", "from": "user"}, {"from": "assistant", "value": "a"}]}, "conversations", QA),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", QA),
        ({"prompt": "q", "response": "a"}, "prompt_response", QA),
        ({"completion": "a", "prompt": "q"}, "prompt_completion", QA),
        ({"instruction": "q", "output": "a"}, "instruction", QA),
        ({"instruction": "q", "output": "a", "input": "i"}, "instruction_input", [QA[0], ("user", "i"), QA[1]]),
        ({"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}, "turns", QA),
        ({"qa": [{"question": "q", "answer": "a"}, {"question": "q", "answer": None}, {"answer": "a"}]}, "questions", [*QA, QA[0], QA[1]]),
        ({"system": "s", "question": "q", "answer": "a"}, "system_question", [("system", "s"), *QA]),
        # fields that no mapping needs
        ({"id": 5, "messages": MESSAGES}, "messages", QA),
        ({"prompt": "q", "response": "a", "source": "x"}, "prompt_response", QA),
        ({"messages": [{**m, "name": "n", "weight": 1.5} for m in MESSAGES], "meta": {"a b": [{"`c>: ": 1}], "d": [[{"e": 1}]]}}, "messages", QA),
        ({"chat": {"id": 1, "messages": MESSAGES, "deep": {"er": {"messages": 1}}}}, "nested_chat", QA),
        ({"other": 1}, None, None), ({"messages": [1, {"role": "x"}]}, None, None), ({"messages": []}, None, None), ({"x": {"prompt": "q", "response": "a"}}, None, None), ([1, 2], None, None),
    ]
    rows = [(i, json.dumps(r), 1) for i, (r, _, _) in enumerate(records)] + [(100, "not json", 1), (101, None, 1), (102, "", 1)]
    got = chat.canonical(spark.createDataFrame(rows, "conv_id long, record string, mappings int"))
    assert got.columns == ["conv_id", "record", "mappings", "fingerprint", "mapping", "turns"]
    for r in got.collect():
        _, name, turns = records[r.conv_id] if r.conv_id < 100 else (None, None, None)
        assert (r.mapping, r.turns and [(t.role, t.text) for t in r.turns]) == (name, turns), rows[r.conv_id]
    written = {r.conv_id: r.formatted for r in chat.formatted(got).collect()}
    assert len(written) == len(rows) and written[14] is None and written[101] is None and written[0].startswith("### user: q </turn>")


def test_one_fingerprint_for_one_layout(spark):
    a, b, c = '{"id":1,"messages":[{"role":"user","content":"q"}]}', '{"messages":[{"content":"x","role":"y","z":[1]}],"w":{}}', '{"prompt":"q","response":"a"}'
    got = [r.fingerprint for r in chat.canonical(spark.createDataFrame([(0, a), (1, b), (2, c)], "conv_id long, record string")).orderBy("conv_id").collect()]
    assert got[0] == got[1] != got[2]


def test_both_layouts_of_rows_give_the_same(spark):
    df = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(6) for t in range(3)], "conv_id long, turn long, role string, text string")
    plain, mixed = (sorted(map(str, chat.formatted(chat.canonical(chat.from_rows(df, on))).collect())) for on in (None, F.col("conv_id") % 2 == 1))
    assert plain == mixed


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = ["http://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/es/", "https://x.com/fr/", "https://x.com/fr", "https://com/de/?q", None, "no scheme", "http://", "http://spam-farm.x.net/a", "a://b.com/de/c://d", "http://é.org", "http://org/", "http://x.y.net/", "http://example.org/en/2\nx"]
    got = url_filter.judged(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string"), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        u = urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fit = [(len(h + p), a, h + p) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fit)[2] if fit else None)
        assert r.verdict == (max(fit)[1] if fit else "block" if "spam-farm" in host else "allow")


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    names = {"aa": 0, "bb": 1, "c": 1, "ddd": 0, "ee": 1}
    (tmp_path / "d").write_bytes(b"".join(url_filter.DigestArray.parts(names)))
    arr = url_filter.DigestArray(str(tmp_path / "d"))
    found = arr.find(["bb", "zz", "ddd", "f", ""])
    assert [arr.string(i) if i >= 0 else None for i in found] == ["bb", None, "ddd", None, None]
    assert [int(arr.marks[i]) for i in found if i >= 0] == [1, 0]


def test_very_long_hosts(spark):
    host = "a." * 100_000 + "example.org"
    df = spark.createDataFrame([(1, f"http://{host}/en/1"), (2, "http://" + "spam-farm." * 50_000 + "net/"), (3, "http://" + "b" * 1_000_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df, [("block", "example.org", "/en/1"), ("allow", "org", "/")]).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: (None, "block"), 3: (None, "allow")}


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# a list\n\nallow org/\nblock Example.org/es/\n")
    assert url_filter.read_rules(spark, str(tmp_path / "rules.txt")) == [("allow", "org", "/"), ("block", "example.org", "/es/")]
    none = url_filter.judged(spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string"), []).collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "allow")]
