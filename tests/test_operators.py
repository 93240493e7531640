import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium import queries as q, samples as sa
from scriptorium.functions import scoring as sc
from scriptorium.operators import catalog as cat, concepts as con, keywords as kw, neardup as nd, pages as pg, render, search as se, sync
from scriptorium.plans.components import connected_components
from scriptorium.plans.workspace import Workspace
from scriptorium.sources import enrich, files
from scriptorium.streaming import incremental


def test_exact_duplicates_prefer_names_without_signs_of_a_copy(spark):
    rows = [("a", "h", "x copy.pdf", 2000), ("b", "h", "longer-name.pdf", 2000), ("c", "h", "x.pdf", 1990), ("d", "z", "y.pdf", None)]
    x = spark.createDataFrame(rows, "doc_id string, sha256 string, filename string, year int").withColumn("source_class", F.lit("paper"))
    got = {r["doc_id"]: (r["canonical_doc_id"], r["source_class"]) for r in cat.resolve_exact(x).collect()}
    assert got == {"a": ("b", "duplicate"), "b": ("b", "paper"), "c": ("b", "duplicate"), "d": ("d", "paper")}


def test_unique_ids_avoid_taken_names(spark):
    x = spark.createDataFrame([("x", 1), ("x", 2), ("x-2", 3)], "id string, path int")
    ids = [r["id"] for r in cat.unique_ids(x, "id", "path").collect()]
    assert len(set(ids)) == 3 and {"x", "x-2"} <= set(ids)


def test_override_with_null_and_new_column(spark):
    x = spark.createDataFrame([("a", "t"), ("b", "u")], "doc_id string, title string")
    o = spark.createDataFrame([("a", None, "new")], "doc_id string, title string, status string")
    assert sorted(map(tuple, cat.override(x, o).collect())) == [("a", None, "new"), ("b", "u", None)]


def test_status_rename_and_lookup(spark):
    x = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert {tuple(r) for r in cat.set_status(x, ["a"], "rejected", "bad").collect()} == {("a", "rejected", "bad"), ("b", None, None)}
    assert {r[0] for r in cat.rename(x, "a", "z").collect()} == {"z", "b"}
    assert cat.one(x, "a").count() == 1 and cat.keep_ids(x, []).count() == 2
    with pytest.raises(ValueError):
        cat.one(x, "nope")


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (100, 101), (200, 199)]
    x = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(x, Workspace(spark)).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {100} and got[200] == 199
    assert connected_components(x.where("false"), Workspace(spark)).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    base = [[rnd.randrange(2000) for _ in range(40)] for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(5):
            c = set(b)
            for _ in range(rnd.randrange(8)):
                c.discard(rnd.choice(b))
                c.add(rnd.randrange(2000))
            sets.append(sorted(c))
    x = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in nd.similar_pairs(x).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) >= 0.75 * len({*a} | {*b}) - 1e-9}
    assert got == want and want


def test_pages(spark):
    x = spark.createDataFrame(sa.MARKDOWN, "doc_id long, text string")
    got = [(r["doc_id"], r["page_key"], r["text"]) for r in pg.by_header(x).orderBy("doc_id", "page_no").collect()]
    assert got == [(1, "frontmatter", "intro"), (1, "first", "text one"), (1, "sub-part", "text two"), (1, "last", "end"), (2, "frontmatter", ""), (2, "only", "body"), (3, "frontmatter", "no header at all"), (4, "frontmatter", "")]
    p = pg.by_form_feed(spark.createDataFrame(sa.PAGED, "doc_id long, text string"))
    assert [(r["doc_id"], r["page_no"], r["page_key"]) for r in p.orderBy("doc_id", "page_no").collect()][:3] == [(1, 1, "p1"), (1, 2, "p2"), (1, 3, "p4")]
    assert {r["doc_id"]: r["needs_ocr"] for r in pg.needs_ocr(p).collect()} == {1: True, 3: True, 4: True}
    flags = {r["doc_id"]: r["quality_flags"] for r in pg.quality_flags(pg.by_header(x)).collect()}
    assert flags[4] == ["section_chunked", "empty_text"]


def test_book(spark):
    rows = q.QUERIES["chapters"](spark, "").orderBy("page_start").collect()
    assert [(r["chapter_number"], r["page_start"], r["page_end"]) for r in rows] == [(1, 3, 5), (2, 6, 7), (3, 8, 9)]
    assert rows[0]["section_previews"] == ["Conservation laws", "Boundary conditions"] and rows[1]["title"] == "Finite Volume Methods"
    assert all(r["summary"] for r in rows)
    words = [r["phrase"] for r in q.QUERIES["keywords_book"](spark, "").orderBy("rank").collect()]
    assert "finite volume method" in words and "boundary conditions" not in words
    assert "This book provides" in q.QUERIES["summaries_book"](spark, "").first()["summary"]


def test_paper_keywords_list_wins(spark):
    t = spark.createDataFrame([(1, "Flow", None), (2, "Turbulent flow methods", None)], "doc_id long, title string, author string")
    p = spark.createDataFrame([(1, 1, "Abstract x Keywords: mesh quality, Flow ; , " + "y" * 60), (2, 1, "Turbulent flow methods in pipes")], "doc_id long, page_no int, text string")
    got = [(r["doc_id"], r["phrase"]) for r in kw.paper(t, p).orderBy("doc_id", "rank").collect()]
    assert got[:2] == [(1, "mesh quality"), (1, "flow")] and (2, "turbulent flow method") in got


def test_bibtex(spark):
    got = {r["doc_id"]: r["entry"] for r in q.QUERIES["bibtex_entries"](spark, "").collect()}
    assert set(got) == {"d1", "d2", "d6"}
    assert got["d1"].startswith("@article{d1,\n  title = {Flow \\& Heat},\n  author = {Lee, Ann and Ray, Bo},") and got["d2"].startswith("@book{d2,") and "author = {Unknown}" in got["d2"]


def test_yaml_and_stub(spark):
    x = spark.createDataFrame([('a "b"', None, 3, ["x"], [])], "t string, n string, i int, l array<string>, e array<string>")
    r = x.select(render.front_matter(render.field("t", render.yaml_text(F.col("t"))), render.field("n", render.yaml_text(F.col("n"))), render.field("i", render.yaml_bare(F.col("i"))), render.yaml_list("l", F.col("l")), render.yaml_list("e", F.col("e")))).first()[0]
    assert r == '---\nt: "a \\"b\\""\nn: null\ni: 3\nl:\n  - "x"\ne: []\n---'
    s = spark.createDataFrame([("b", "T", "duplicate", "a", "near_duplicate_of", 9312, "b.pdf", True)], "doc_id string, title string, source_class string, canonical_doc_id string, dedupe_kind string, similarity_1e4 int, filename string, is_redundant boolean")
    assert "Near-duplicate of [[source/a]] (similarity=0.9312)." in render.stub(s).first()["markdown"]


def test_search_needs_a_term(spark):
    with pytest.raises(ValueError):
        se.two_stage(spark, "the of", None, None)


class Client:
    def __init__(self):
        self.calls, self.clash = [], {"k2"}

    def create(self, items):
        self.calls.append(("create", len(items)))
        return {"successful": {str(i): {"key": f"new{i}", "version": 1} for i in range(len(items))} | {"x": {}}}

    def update(self, key, payload, version):
        self.calls.append(("update", key, version))
        if key in self.clash and version != 9:
            raise sync.Conflict
        return 10

    def delete(self, key, version):
        self.calls.append(("delete", key))

    def version(self, key):
        return 9


def test_sync(spark):
    base = dict(title="T", author="A B", doi="10.1/x", isbn=None, journal=None, publisher=None, source_class="paper", producer=None)
    docs = spark.createDataFrame([dict(base, doc_id=f"d{i}", sha256=f"s{i}", year=2000, path=f"p{i}.pdf", filename=f"p{i}.pdf") for i in range(3)] + [dict(base, doc_id="no", sha256="s9", year=None, path="x", filename="x")], "doc_id string, sha256 string, year int, path string, filename string, title string, author string, doi string, isbn string, journal string, publisher string, source_class string, producer string")
    local = sync.records(docs)
    assert local.count() == 3
    maps = spark.createDataFrame([("s1", None, "x"), ("s2", "k2", "old"), ("s5", "k5", "y"), ("s6", None, "z")], "sha256 string, key string, last_fingerprint string")
    plan = sync.plan(local, maps)
    assert {tuple(r) for r in plan.collect()} == {("s0", "create"), ("s1", "create"), ("s2", "update"), ("s5", "delete"), ("s6", "delete")}
    assert [r["action"] for r in sync.trimmed(plan, 3).collect()] == ["create", "create", "update"] and sync.trimmed(plan, 0).count() == 0 and sync.trimmed(plan, None).count() == 5
    items = local.select("sha256", "doc_id", "path", "fingerprint").join(sync.payloads(local, "C"), "sha256")
    payload = json.loads(items.where("sha256 = 's0'").first()["payload"])
    assert payload["itemType"] == "journalArticle" and payload["creators"][0]["lastName"] == "B" and payload["collections"] == ["C"] and "SHA256: s0" in payload["extra"]
    stored = {"s2": {"key": "k2", "version": 1}, "s5": {"key": "k5", "version": 2}, "s6": {"key": None}}
    waits = []
    pacer = sync.Pacer(1.0, clock=lambda: 0.0, sleep=waits.append)
    out = sync.run(Client(), plan, items, stored, pacer, "local")
    assert (out.created, out.updated, out.deleted, out.skipped) == (2, 1, 1, 0) and set(out.mappings) == {"s0", "s1", "s2"} and waits
    assert sync.run(Client(), plan, items, stored, sync.Pacer(0.0), "skip").skipped == 1
    assert sync.backoff_seconds({"Backoff": "x", "Retry-After": "3"}) == 3.0 and sync.backoff_seconds(None) is None
    with pytest.raises(ValueError):
        sync.config({"sync_mode": "two_way"})
    assert sync.secret({"api_key_env": "K"}, {"K": "v"}, "api_key") == "v"


CROSSREF = json.dumps({"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published-print": {"date-parts": [[2001, 3]]}, "publisher": "P", "container-title": ["J"]}})
DATACITE = json.dumps({"data": {"attributes": {"titles": [{"title": "D"}], "creators": [{"givenName": "X", "familyName": "Y"}, {"name": "Group"}], "publicationYear": 2020, "publisher": "Repo"}}})
BOOK = json.dumps({"ISBN:9783161484100": {"title": "B", "authors": [{"name": "W"}], "publish_date": "May 1998", "publishers": [{"name": "Pub"}]}})


def transport(url):
    if "crossref" in url:
        return (200, CROSSREF) if "10.1/a" in url else (404, None) if "10.1/d" in url else (500, None)
    if "datacite" in url:
        return 200, DATACITE
    return (200, BOOK) if "9783161484100" in url else (200, "{}")


def test_enrichment(spark):
    dois = spark.createDataFrame([("10.1/a",), ("10.1/d",), ("10.1/e",), (None,)], "doi string")
    isbns = spark.createDataFrame([("9783161484100",), ("0000000000",)], "isbn string")
    by_doi, by_isbn = enrich.parsed(enrich.fetch_dois(dois, transport)), enrich.parsed(enrich.fetch_isbns(isbns, transport))
    got = {r["id"]: tuple(r)[1:] for r in by_doi.union(by_isbn).collect()}
    assert got == {"10.1/a": ("T", "A B; C", 2001, "P", "J", "crossref"), "10.1/d": ("D", "X Y; Group", 2020, "Repo", "Repo", "datacite"), "9783161484100": ("B", "W", 1998, "Pub", None, "openlibrary")}
    e = spark.createDataFrame([("1", "own", None, None, "10.1/a", None), ("2", None, None, None, None, "9783161484100"), ("3", "own", "me", 1, None, None)], "doc_id string, title string, author string, year int, doi string, isbn string")
    assert {r["doc_id"]: (r["title"], r["author"], r["year"]) for r in enrich.enriched(e, by_doi, by_isbn).collect()} == {"1": ("T", "A B; C", 2001), "2": ("B", "W", 1998), "3": ("own", "me", 1)}
    a = enrich.asked(spark.createDataFrame([("1", "ok"), ("2", "bad")], "doc_id string, text string"), lambda t: '```json\n{"title": "Q", "year": 3}\n```' if t == "ok" else 1 / 0)
    assert [tuple(r) for r in enrich.answered_metadata(a).collect()] == [("1", "Q", None, 3)]
    assert enrich.incomplete(e).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "rejected").mkdir()
    (tmp_path / "2001-a.txt").write_text("one")
    (tmp_path / "b.MD").write_text("# H\ntwo")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "rejected" / "d.txt").write_text("no")
    assert files.scan(spark, str(tmp_path)).count() == 2
    x = {r["doc_id"]: (r["year"], r["text"], r["size_bytes"]) for r in files.plain_text(files.contents(spark, str(tmp_path))).collect()}
    assert x == {"2001-a": (2001, "one", 3), "b": (None, "# H\ntwo", 7)}
    assert [r["text"] for r in files.extracted(files.contents(spark, str(tmp_path)), lambda s, c: s).orderBy("text").collect()] == [".md", ".txt"]
    files.write_json(str(tmp_path / "o" / "x.json"), {"overrides": {"a": {"title": "T"}}})
    assert files.overrides(spark, str(tmp_path / "o" / "x.json")).first()["doc_id"] == "a"
    assert files.program("no-such-program")(".pdf", b"") is None and files.ocr()(".txt", b"") is None and files.ocr()(".pdf", b"no pdf") is None
    x = spark.createDataFrame([("Title: A: B\nPages: 3\nnoise",)], "x string").select(files.info_map(F.col("x")).alias("m")).first()["m"]
    assert x == {"Title": "A: B", "Pages": "3"}
    seen = []
    incremental.watch(spark, str(tmp_path), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) >= 4


def test_incremental(spark):
    d = spark.createDataFrame([("a", "h1"), ("b", "h2")], "doc_id string, sha256 string")
    now, other = incremental.page_fingerprints(d), incremental.page_fingerprints(d, "model")
    assert now.join(other, ["doc_id", "fingerprint"]).count() == 0
    before = now.where("doc_id = 'a'").union(spark.createDataFrame([("z", "f")], "doc_id string, fingerprint string"))
    assert {tuple(r) for r in incremental.rebuild_plan(now, before).collect()} == {("a", "reuse"), ("b", "build"), ("z", "remove")}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from scriptorium.plans import workspace

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://x"})

    with pytest.raises(ValueError):
        workspace.shared_dir(Fake())


def test_pdf_info_and_text_of_other_formats(spark):
    x = spark.createDataFrame([("a.pdf", ".pdf", b"Title:  A B\nAuthor:\nPages: 12\nTitle: again"), ("b.pdf", ".pdf", b""), ("c.html", ".html", b"<h2>Top</h2><p>one<br>two &lt;3</p>"), ("d.epub", ".epub", b"z")], "path string, suffix string, content binary")
    say = lambda suffix, content: content.decode() or None
    assert [tuple(r) for r in files.pdf_info(x, say).collect()] == [("a.pdf", "A B", None, None, 12)]
    texts = {r["path"]: r["text"] for r in files.with_text(x, lambda f: files.extracted(f, say)).collect()}
    assert texts == {"a.pdf": "Title:  A B\nAuthor:\nPages: 12\nTitle: again", "b.pdf": None, "c.html": "# Top\none\ntwo <3", "d.epub": "z"}


def concept_tables(spark):
    """Events, index and pages of documents whose titles share phrases by families of three."""
    words = [f"w{c}x" for c in "abcdefghijklmnopqrst"]
    titles = [" ".join((words[i // 3], words[(i // 3 + 1) % 20], words[(i // 3 + 2) % 20])) for i in range(60)]
    rows = [(i, t, "paper", False, [], f"About {t}.", f"{t}\nAbout {t}. {t}") for i, t in enumerate(titles)]
    ix = spark.createDataFrame(rows, "doc_id long, title string, source_class string, is_redundant boolean, keywords array<string>, summary string, search_text string")
    said = lambda i, n: None if n == 3 else f"{titles[i]}! " * (n % 7) + f"{words[i // 3].upper()}, {words[i // 3]}. {words[i % 20]}"
    pages = spark.createDataFrame([(i, n, "" if n == 2 else f"Line {n} of {i}", said(i, n)) for i in range(60) for n in range(5 if i % 9 else 1)], "doc_id long, page_no int, preview string, text string")
    return con.phrase_events(ix).localCheckpoint(), ix, pages


def test_supporting_documents_are_those_of_each_phrase_alone(spark):
    events, ix, pages = concept_tables(spark)
    found = con.candidates(events)
    got = {(r["phrase"], r["doc_id"]): r["score2"] for r in con.supporting(events, found, ix, pages, 99).collect()}
    pairs = events.select("phrase", "doc_id").distinct().join(found.select("phrase"), "phrase", "left_semi")
    s = lambda c: sc.score2_by(F.col("phrase"), F.coalesce(c, F.lit("")))
    f = pairs.join(ix, "doc_id").select("phrase", "doc_id", (5 * s(F.col("title")) + 3 * s(F.array_join("keywords", " ")) + 2 * s(F.col("summary")) + s(F.col("search_text"))).alias("f"))
    p = pairs.join(pages, "doc_id").select("phrase", "doc_id", (sc.score2_by(F.col("phrase"), F.col("text")) - sc.signal_penalty2(F.col("preview"))).alias("s")).where("s > 0")
    best = {}
    for r in p.collect():
        best.setdefault((r["phrase"], r["doc_id"]), []).append(r["s"])
    want = {k: r["f"] + sum(sorted(best.get(k, []))[-2:]) for r in f.collect() if r["f"] > 0 for k in [(r["phrase"], r["doc_id"])]}
    assert got == want and len(got) > 150


def test_concepts_look_for_sources_only_where_the_walk_gets_to(spark, monkeypatch):
    events, ix, pages = concept_tables(spark)
    asked, plain = [], con.supporting

    def counted(events, found, *rest):
        asked.append(found.count())
        return plain(events, found, *rest)

    whole = con.selected(spark, events, ix, pages).collect()
    monkeypatch.setattr(con, "supporting", counted)
    for step in (7, 512):
        assert con.selected(spark, events, ix, pages, step=step).collect() == whole
    assert len(whole) >= 20 and asked
    asked.clear()
    assert con.selected(spark, events, ix, pages, most=3, step=4).collect() == whole[:3]
    assert 0 < sum(asked) < con.candidates(events).count() / 2


def test_levels_of_a_topic_are_the_tokens_by_weight(spark):
    rows = [(["t"], ["a", "b", "a", "t", "c", "a", "b"] + ["d"] * 9), ([], []), (["t", "u"], []), ([], ["x"])]
    got = spark.createDataFrame(rows, "title array<string>, terms array<string>").select("title", "terms", sc.levels(F.col("title"), F.col("terms")).alias("l")).collect()
    for r in got:
        weights = Counter(r["terms"]) + Counter({t: 8 for t in r["title"]})
        assert [sorted(x) for x in r["l"]] == [sorted(t for t, n in weights.items() if n >= k) for k in range(1, sc.LEVELS + 1)]


def test_previews_of_a_book_and_phrases_are_normalised_once(spark):
    t = spark.createDataFrame([(1, "Finite volume methods", None)], "doc_id long, title string, author string")
    said = ["Chapter 1 Finite volume methods", "2.1 Turbulence models of flow", "Preface", None, "Boundary conditions", "Boundary conditions", "The SIMPLE method"]
    p = spark.createDataFrame([(1, i, x, f"{x} " + "boundary conditions and OpenCL in the finite difference method " * 4) for i, x in enumerate(said, 1)], "doc_id long, page_no int, preview string, text string")
    book, paper = kw.book(t, p), kw.paper(t, p)
    assert [r["phrase"] for r in book.orderBy("rank").collect()] == [
        "finite difference method", "opencl", "finite volume method", "turbulence models", "turbulence models flow", "turbulence models of flow", "the simple method",
    ]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(book).count("(?iU)^chapter") == 1  # of clean_preview
    assert plan(paper).count("turbulence with models") == 1  # of normal_phrase
