import random
import re
import zipfile
from html import unescape

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus
from lexiloom.plans import reports
from lexiloom.sources import epub, files, html
from lexiloom.streaming import incremental


def test_markdown_and_settings(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\nCorps\r\nfin", encoding="utf-8")
    (tmp_path / "words.txt").write_text("# c\nmot:ne\ncatégorie: pronom\n", encoding="utf-8")
    (tmp_path / "bad.txt").write_text("autre:x\n", encoding="utf-8")
    (tmp_path / "o.yml").write_text('# c\nun: {date: "1901", title: "Un"}\ndeux: 1950\n', encoding="utf-8")
    (r,) = files.read_markdown(spark, str(tmp_path)).collect()
    assert r.meta == {"title": "T"} and r.body == "Corps\nfin"
    assert {tuple(x) for x in files.read_function_words(spark, str(tmp_path / "words.txt")).collect()} == {("mot", "ne"), ("catégorie", "pronom")}
    with pytest.raises(Exception, match="unknown kind"):
        files.read_function_words(spark, str(tmp_path / "bad.txt")).collect()
    o = files.read_overrides(spark, str(tmp_path / "o.yml"))
    assert {tuple(x) for x in o.collect()} == {("un", "1901", "Un"), ("deux", "1950", None)}
    books = spark.createDataFrame([("un", "x", "A B", "2999", "t"), ("trois", "", "A B", "", "© Editions, 1987"), ("quatre", "Q", "É F", None, "")], "file_key string, title string, author string, publication_date string, text string")
    years = spark.createDataFrame([("e f", "q", "1977")], "author_key string, title_key string, year string")
    got = {r.file_key: (r.title, r.year) for r in files.with_metadata(books, o, years).collect()}
    assert got == {"un": ("Un", 1901), "trois": ("Trois", 1987), "quatre": ("Q", 1977)}


def book(path, title, creator, toc, documents, more=""):
    page = lambda body: f"<html><body>{body}</body></html>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="d{k}" href="{n}"/>' for k, (n, _) in enumerate(documents)) + ('<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if toc else "")
        refs = "".join(f'<itemref idref="d{k}"/>' for k in range(len(documents)))
        z.writestr("O/c.opf", f"<package><metadata><title>{title}</title><creator>{creator}</creator>{more}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>")
        if toc:
            z.writestr("O/toc.ncx", "<ncx>" + "".join(f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{n}"/></navPoint>' for label, n in toc) + "</ncx>")
        for n, body in documents:
            if body is not None:
                z.writestr(f"O/{n}", page(body))


def test_epub(spark, tmp_path):
    book(
        tmp_path / "Un Livre.epub", "Livre", "Hugo, Victor", [("Couverture", "cover.xhtml"), ("Chapitre 1", "one.xhtml#x"), ("Chapitre 1 bis", "one.xhtml#y")],
        [("cover.xhtml", "<p>cover</p>"), ("one.xhtml", "<h1>I</h1><p>Un.</p><p>Un.</p>"), ("two.xhtml", "<p>Deux.</p><p>Livre</p>"), ("lost.xhtml", None)],
        '<date event="publication">1862-03-01T00</date><subject>Grand Roman, historique</subject>',
    )
    (r,) = epub.read_epubs(spark, str(tmp_path)).collect()
    assert r.text == "# Chapitre 1\n\nUn.\n\nDeux." and r.toc == ["Couverture", "Chapitre 1"] and r.error is None
    assert (r.meta.title, r.meta.author, r.meta.author_lastname, r.meta.publication_date, r.meta.genre) == ("Livre", "Victor Hugo", "Hugo", "1862-03-01", "Roman")
    (m,) = epub.as_markdown(epub.read_epubs(spark, str(tmp_path))).collect()
    assert m.name == "un-livre.md" and m.text.startswith('---\ntitle: "Livre"\nauthor: "Victor Hugo"') and 'publication_date: "1862-03-01"\nsize: 24\nsource: "un-livre.epub"\n---\n\n# Chapitre 1' in m.text


def test_epub_choices(spark, tmp_path):
    para = lambda *ps: "".join(f"<p>{p}</p>" for p in ps)
    # after a preface the next entry that is no front matter begins the narrative; numbered entries go before others
    book(tmp_path / "a.epub", "Le Titre", "X", [("Préface", "p.xhtml"), ("Du même auteur", "q.xhtml"), ("1. Evan", "one.xhtml"), ("Annexe", "z.xhtml")], [("p.xhtml", para("pré")), ("q.xhtml", para("même")), ("one.xhtml", "<h2>one</h2><h3>Evan</h3><h3>12.</h3>" + para("LE TITRE", "Il court.")), ("z.xhtml", para("Fin."))])
    # no table of contents: from the first chapter heading
    book(tmp_path / "b.epub", "Victor Hugo", "Quatre 93", [], [("x.xhtml", para("garde") + "<h1>Avant</h1><h1>Chapitre II</h1>" + para("Texte.")), ("copyright.xhtml", para("droits"))])
    book(tmp_path / "c.epub", "C", "Hugo Victor", [("Couverture", "i.xhtml"), ("Midi - Le départ", "j.xhtml")], [("i.xhtml", para("garde")), ("j.xhtml", para("Midi", "Le départ", "On part."))])
    book(tmp_path / "d.epub", "D", "Dupont Jean", [], [("x.xhtml", para("Rien que du texte."))])
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    got = {r.path.rsplit("/", 1)[1][:-5]: r for r in epub.read_epubs(spark, str(tmp_path)).collect()}
    assert got["a"].text == "# 1. Evan\n\nIl court.\n\nFin."
    assert got["b"].text == "# Chapitre II\n\nTexte." and (got["b"].meta.title, got["b"].meta.author) == ("Quatre 93", "Victor Hugo")
    assert got["c"].text == "# Midi - Le départ\n\nOn part." and got["c"].meta.author == "Hugo Victor"
    assert got["d"].text == "Rien que du texte." and got["d"].meta.author == "Jean Dupont"
    assert got["bad"].error.startswith("BadZipFile") and got["bad"].text == ""


def plain_blocks(markup):
    """The same rules by one walk over the tags."""
    m = re.search(r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\Z)", markup or "")
    body = re.sub(r"(?is)<!--.*?-->|<(script|style|svg|nav)\b[^>]*>.*?(?:</\1\s*>|\Z)", "", m[1] if m else "")
    names = "|".join((*html.BLOCK_TAGS, "hr"))
    out, open_, below, sub, quote, run = [], "", False, False, 0, ""

    def put(ended):
        nonlocal run
        text = " ".join(unescape(re.sub(r"(?s)</?[A-Za-z][^>]*(?:>|\Z)", "", run)).split())
        run = ""
        short = 1 <= len(text) <= 120 and len(text.split(" ")) <= 15 and text[-1] not in ".!?;:"
        if text and not re.match(r"(?i)inconnu\s*\(e\)\s*$", text):
            mark = "" if not ended or not open_ or (sub and not short) else ">" if quote else "##" if sub else html.MARKS.get(open_, "")
            out.append(f"{mark} {text}" if mark else text)

    at = 0
    for t in re.finditer(rf"(?is)<(/?)({names})(?=[\s/>])([^>]*)(?:>|\Z)", body):
        run += body[at : t.start()]
        at = t.end()
        tag, end = t[2].lower(), bool(t[1])
        if tag == "hr":
            put(False)
            out.append("---")
        elif end:
            put(True)
            below, open_, sub = open_ in html.HEADINGS, "", False
            quote = max(0, quote - (tag == "blockquote"))
        elif t[3].endswith("/"):
            put(False)
        else:
            put(False)
            quote += tag == "blockquote"
            open_, sub = tag, tag == "p" and below and bool(re.search(r"""(?i)\sclass\s*=\s*["']?[^"'\s]""", t[3]))
    run += body[at:]
    put(False)
    lines = []
    for line in out:
        line = "---" if line == "*" else line
        if lines and lines[-1].startswith("> ") and 3 <= len(line) <= 120 and "," in line and line[-1] not in ".!?;:" and not line.startswith(("#", ">", "---")):
            line = "> " + line
        if not lines or line != lines[-1]:
            lines.append(line)
    return lines


def test_blocks_against_a_plain_walk(spark):
    rnd = random.Random(4)
    bits = ["<p>", "</p>", '<p class="a">', "<h1>", "</h1>", "<h3>", "</h3>", "<blockquote>", "</blockquote>", "<br>", "<br/>", "<hr/>", "<b>", "</b>", "Un mot", "Hugo, 1850", "Fin.", "*", "inconnu (e)", " ", "&amp; &eacute;t&eacute;", "<li>", "</li>", "a < b", "<nav><p>x</p></nav>", "<!-- <p> -->"]
    pages = ["<html><body>" + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) + rnd.choice(["</body>", "", "<p cla"]) for _ in range(400)] + [None, "", "<p>no body</p>"]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows = html.blocks(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.pos)):
        got.setdefault(r.page_id, []).append(r.block)
    for k, page in enumerate(pages):
        assert got.get(k, []) == plain_blocks(page), page


def test_incremental_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    now = incremental.digests(docs)
    state = now.where("doc_id = 1").withColumn("version", F.lit("v1"))
    assert [r.doc_id for r in incremental.changed(now, state, "v1").collect()] == [2]
    assert incremental.changed(now, state, "v2").count() == 2
    assert [r.doc_id for r in incremental.vanished(docs.where("doc_id = 2"), state).collect()] == [1]
    src = str(tmp_path / "in")
    run = lambda k: incremental.follow(spark, src, "doc_id long, text string", str(tmp_path / "state"), "v1", lambda d: d.select("doc_id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / f"ck{k}")).awaitTermination()
    docs.write.parquet(src)
    run(0)
    run(1)  # the same files again: nothing is new
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_canonical_authors(spark):
    a = spark.createDataFrame([("Jean Valjean", 0), ("Valjean Jean", 1), ("Solo", 2)], "author string, seen long")
    assert {r.author: r.canonical for r in corpus.canonical_authors(a).collect()} == {"Jean Valjean": "Jean Valjean", "Valjean Jean": "Jean Valjean", "Solo": "Solo"}
    p = spark.createDataFrame([("Valjean Jean",)], "author string")
    assert {r.author: r.canonical for r in corpus.canonical_authors(a, p).collect()}["Jean Valjean"] == "Valjean Jean"


def test_mds_keeps_plane_distances(spark):
    import math

    pts = {"a": (0, 0), "b": (3, 0), "c": (0, 4), "d": (3, 4)}
    pairs = [(x, y, math.dist(pts[x], pts[y])) for x in pts for y in pts if x < y]
    got = {r.entity: r for r in corpus.mds(spark.createDataFrame(pairs, "left string, right string, distance double")).collect()}
    assert all(abs(math.dist((got[x].x, got[x].y), (got[y].x, got[y].y)) - d) < 1e-9 for x, y, d in pairs) and got["a"].stress < 1e-9


def test_reports(spark):
    long = spark.createDataFrame([("e", "m", 1.5), ("f", "m", None)], "entity string, metric string, value double")
    text = reports.comparison(long, spark.createDataFrame([("m", 3.0)], "metric string, sigma double"), ["e", "f"])
    assert "| m | 1.5 | — | 3 |" in text
    assert reports.bars_svg([("x", 2.0)]).startswith("<svg")


def test_reports_of_one_text(spark, tmp_path):
    from lexiloom.operators import repetition, tokens
    from lexiloom.plans import metrics
    from lexiloom.sources import lexicons

    (tmp_path / "notes.md").write_text("# Burstiness #6\n<!-- hidden\n# no -->\nComment les phrases\nvarient sur {windows} k.\n# **Autre** / chose #99 #tab1_2\nx\n# Sans numéro\ny\n", encoding="utf-8")
    notes = files.read_notes(spark, str(tmp_path / "notes.md"), "20")
    assert [tuple(r) for r in notes.collect()] == [(6, "Burstiness", "Comment les phrases varient sur 20 k."), (99, "Autre / chose", "x"), (None, "Sans numéro", "y")]
    long = spark.createDataFrame([("e", "burstiness", 0.5), ("e", "word_count", 12.0), ("e", "pos_verb_ratio", 0.25)], "entity string, metric string, value double")
    noted = metrics.with_notes(long, metrics.registry(spark), notes)
    assert {r.metric: (r.metric_id, r.note) for r in noted.collect()} == {"burstiness": (6, "Comment les phrases varient sur 20 k."), "word_count": (30, None), "pos_verb_ratio": (60, None)}
    text = reports.text_report("e", noted, ["burstiness"])
    assert "| burstiness[^1] | 0.5 |" in text and "[^1]: Comment les phrases" in text and "| Verbes | 25.0 % |" in text and text.index("Synthèse") < text.index("| word_count | 12 |")
    docs = spark.createDataFrame([(1, "Fleur, l'arbre: fleurs à 2 mains!"), (2, "")], "doc_id long, text string")
    words = repetition.repetition_words(tokens.repetition_tokens(docs), lexicons.small_lexicon(spark))
    got = {r.doc_id: r.report for r in reports.lemma_report(docs, repetition.annotations(words, lexicons.small_families(spark))).collect()}
    assert got == {1: "**fleur**, l'arbre: **fleur** à 2 mains!", 2: ""}
    shares = spark.createDataFrame([("e", 0.6, 0.1, 0.1, 0.1, 0.1)], "entity string, " + ", ".join(f"{m} double" for m in reports.POS_LABELS))
    assert reports.pies_svg(shares).count("<path") == 5


def test_orders_registry_and_payload(spark, tmp_path):
    from lexiloom.plans import metrics

    works = spark.createDataFrame([("a", "Zut", "IA"), ("b", "Alpha", "X Y"), ("c", "Beta", "ia ")], "entity string, title string, author string")
    assert [r.entity for r in reports.in_order(works).orderBy("n").collect()] == ["c", "a", "b"]
    entries = spark.createDataFrame([("un.epub", "1950", "Un"), ("vieux.epub", None, None)], "file_key string, date string, title string")
    books = spark.createDataFrame([("un.epub", "Zoé Z", "1951"), ("deux.epub", "Ana A", "1901-02-03"), ("vieux.epub", "Zoé Z", "")], "file_key string, author string, publication_date string")
    lines = [r.line for r in files.registry_lines(entries, books).orderBy("n").collect()]
    assert lines == ['deux.epub: {date: "1901"}', '\nun.epub: {date: "1950", title: "Un"}', 'vieux.epub: {date: ""}']
    (tmp_path / "site.yml").write_text("# c\ntitle: \"Mon site\" # x\ndefault:\n  - 'un.epub'\n  - deux.md\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_site(spark, str(tmp_path / "site.yml")).orderBy("key", "n").collect()] == [("default", 1, "un.epub"), ("default", 2, "deux.md"), ("title", 0, "Mon site")]
    registry = metrics.registry(spark)
    long = spark.createDataFrame([("a", "burstiness", 0.5)], "entity string, metric string, value double")
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "books.json").write_text(reports.web_payload(long, works.where("entity = 'a'"), registry), encoding="utf-8")
    assert [tuple(r) for r in reports.read_payload(spark, str(tmp_path / "web"), registry).collect()] == [("Zut", "IA", "burstiness", 0.5)]


def test_configuration_changes_results(spark, tmp_path):
    from lexiloom.operators import lexical, syntax, tokens
    from lexiloom.sources import lexicons

    docs = spark.createDataFrame([(1, "Le chien chante comme un enfant. Il court à l’image du vent.")], "doc_id long, text string")
    known = tokens.with_lexicon(tokens.tokens(docs), lexicons.small_lexicon(spark))
    (tmp_path / "words.txt").write_text("mot:chien\ncatégorie:déterminant\ngarder:le\nlemme:courir\n", encoding="utf-8")
    rules = tokens.FunctionWords.of(files.read_function_words(spark, str(tmp_path / "words.txt")))
    assert rules == tokens.FunctionWords(("chien",), ("déterminant",), ("courir",), ("le",))
    kept = lambda *r: {x.word for x in lexical.content_words(known, *r).collect()}
    assert "le" in kept(rules) and "chien" not in kept(rules) and "chien" in kept() and "le" not in kept()
    (tmp_path / "markers.txt").write_text("# c\nà l’image\n", encoding="utf-8")
    markers = tuple(r.phrase for r in files.read_markers(spark, str(tmp_path / "markers.txt")).collect())
    parses = syntax.shallow_parses(docs, lexicons.small_lexicon(spark)).where("sent_id = 1")
    assert [r.comparison for r in syntax.sentence_measures(parses, markers).collect()] == [True]
    assert [r.comparison for r in syntax.sentence_measures(parses, ("tel un",)).collect()] == [False]


def test_zipped_lexicon(spark, tmp_path):
    from lexiloom.sources import lexicons

    rows = ["titre;;;;;;;;;", "GRAPHIE;a;b;c;d;e;f;g;h;GRAPHIE", "Fleur;x;nom commun;;;;;;;fleur", ";;;;;;;;;FLEURS", ";;;;;;;;;", "e\u0301t\u00e9;x;nom commun;;;;;;;e\u0301t\u00e9s", "autre;x;verbe;;;;;;;fleurs"]
    with zipfile.ZipFile(tmp_path / "lex.zip", "w") as z:
        z.writestr("in/lex.csv", "\ufeff" + "\r\n".join(rows))
    got = {tuple(r) for r in lexicons.read_zipped_forms(spark, str(tmp_path / "lex.zip"), "in/lex.csv").collect()}
    assert got == {("fleur", "fleur", "nom commun"), ("fleurs", "fleur", "nom commun"), ("\u00e9t\u00e9s", "\u00e9t\u00e9", "nom commun")}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert incremental.read_cache(spark, path, "f", {}) is None
    incremental.write_cache(path, spark.createDataFrame([("e", "m", 1.0), ("e", "k", 2.0)], "entity string, metric string, value double"), "f", {"m": 2})
    kept, stale = incremental.read_cache(spark, path, "f", {"m": 3})
    assert stale == ["m"] and [tuple(r) for r in kept.collect()] == [("e", "k", 2.0)]
    assert incremental.read_cache(spark, path, "other", {}) is None


def test_a_batch_that_is_tried_again_writes_no_row_twice(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    follow = lambda k: incremental.follow(spark, src, "doc_id long, text string", state, "v1", lambda d: d.select("doc_id"), out, str(tmp_path / f"ck{k}")).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(src)
    follow(0)
    follow(1)  # a new checkpoint: batch 0 runs a second time
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2] and spark.read.parquet(state).count() == 2


def test_merged_and_evolution(spark):
    old = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "doc_id long, m double")
    fresh = spark.createDataFrame([(2, 0.9)], "doc_id long, m double")
    now = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sorted(map(tuple, incremental.merged(old, fresh, now).collect())) == [(1, 0.1), (2, 0.9)]
    scaled = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0), ("c", "m", 3.0)], "entity string, metric string, scaled double")
    works = spark.createDataFrame([("a", "1950"), ("b", "1901-02-03"), ("c", "?")], "entity string, publication_date string")
    assert [r.entity for r in reports.evolution(scaled, works).collect()] == ["b", "a"]
    sigs = spark.createDataFrame([(0, "SUJET VERBE .", True), (1, "INCONNU", False)], "unit int, roles string, eligible boolean")
    assert "| 1 | SUJET VERBE . | oui |" in reports.structure_report(sigs)
    radii = spark.createDataFrame([("a", k, f"m{k}", 0.5) for k in range(4)], "entity string, axis int, metric string, radius double")
    assert reports.radar_svg(radii).count("<polygon") == 1


def test_required_measures(spark):
    from lexiloom.plans import metrics

    wide = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.1, None)], "doc_id long, a double, b double")
    assert metrics.complete(wide, ("a",)).count() == 2 and [r.doc_id for r in metrics.complete(wide, ("a",)).collect()] == [1, 2]
    with pytest.raises(Exception, match="incomplete measures of document 2"):
        metrics.complete(wide, ("a", "b")).collect()
    with pytest.raises(Exception, match="incomplete"):
        metrics.complete(spark.createDataFrame([(3, float("nan"))], "doc_id long, a double"), ("a",)).collect()
    assert metrics.registry(spark).where("burrows").count() == 30
