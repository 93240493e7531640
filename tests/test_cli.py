import io
import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium import cli
from scriptorium.operators import sync

BODY = "Finite volume methods conserve mass in every cell of the mesh, and turbulent flows need models for the unresolved stresses near walls.\n"
SPECTRAL = "Spectral methods expand the solution in smooth functions and converge very fast for periodic problems.\n"


def call(spark, *argv, **how):
    out = io.StringIO()
    cli.run(cli.parser().parse_args(list(argv)), spark, out, **how)
    return out.getvalue()


def table(spark, root, name):
    return spark.read.parquet(f"{root}/{name}")


def test_add_update_search_rename(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "kb")
    raw.mkdir()
    (raw / "2001-flow.txt").write_text("Finite volume flow\n" + BODY * 2)
    (raw / "2002-flow-copy.txt").write_text("Finite volume flow\n" + BODY * 2)
    (raw / "2003-other.md").write_text("Spectral mesh\n" + SPECTRAL)
    assert "documents=3" in call(spark, "--root", root, "add", "--raw", str(raw))
    assert "- catalog: 3" in call(spark, "--root", root, "update")
    found = call(spark, "--root", root, "search", "finite volume")
    assert "[source] 2001-flow" in found and "2003-other" not in found
    assert "skipped_duplicate=1" in call(spark, "--root", root, "extract")
    call(spark, "--root", root, "rename", "2001-flow", "2001-renamed")
    assert "2001-renamed" in call(spark, "--root", root, "search", "finite volume", "--json")
    named = {r["doc_id"]: r for r in table(spark, root, "catalog").collect()}
    assert named["2002-flow-copy"]["canonical_doc_id"] == "2001-renamed" and named["2002-flow-copy"]["relationship"]["target_doc_id"] == "2001-renamed"
    assert "[[source/2001-renamed]]" in table(spark, root, "markdown").where("doc_id = '2002-flow-copy'").first()["markdown"]
    assert "rejected 2003-other" in call(spark, "--root", root, "reject", "2003-other", "--reason", "x")
    assert call(spark, "--root", root, "sync-plan") == ""


def test_near_duplicates_rejects_and_changes(spark, tmp_path):
    """String ids with near copies, rejecting before an update, and updates that build only what changed."""
    rnd = random.Random(1)
    words = "".join(rnd.choices("abcdefghijklmnop", k=4000))
    text = " ".join(words[i : i + 5] for i in range(0, 4000, 5))
    raw, root = tmp_path / "raw", str(tmp_path / "kb")
    raw.mkdir()
    (raw / "2001-a.txt").write_text(text)
    (raw / "2002-b.txt").write_text(text + " more words here")
    (raw / "2003-c.md").write_text("# Spectral mesh\n" + SPECTRAL * 3)
    (raw / "2004-d.html").write_text("<html><head><title>t</title></head><body><h1>Heading</h1><p>Finite &amp; volume</p><script>x</script></body></html>")
    assert "documents=4 read=4 without_text=0" in call(spark, "--root", root, "add", "--raw", str(raw))
    assert "near_duplicates=1" in call(spark, "--root", root, "resolve")
    said = call(spark, "--root", root, "update")
    assert "- near_duplicate: 1" in said and "- build: 4" in said and "Generated: " in said
    near = {r["doc_id"]: r for r in table(spark, root, "catalog").where("is_redundant").collect()}
    assert len(near) == 1 and next(iter(near.values()))["dedupe_kind"] == "near_duplicate_of"
    assert [r["section_title"] for r in table(spark, root, "pages").where("doc_id = '2003-c'").orderBy("page_no").collect()] == ["Frontmatter", "Spectral mesh"]
    assert table(spark, root, "pages").where("doc_id = '2004-d' and section_title = 'Heading'").first()["text"] == "Finite & volume"

    before = {r["doc_id"]: r["markdown"] for r in table(spark, root, "markdown").collect()}
    said = call(spark, "--root", root, "update")
    assert "- reuse: 4" in said and "build:" not in said
    assert {r["doc_id"]: r["markdown"] for r in table(spark, root, "markdown").collect()} == before
    assert "- build: 4" in call(spark, "--root", root, "update", "--force")

    (raw / "2003-c.md").write_text("# Changed heading\n" + SPECTRAL * 4)
    assert "documents=4 read=1" in call(spark, "--root", root, "add", "--raw", str(raw))
    said = call(spark, "--root", root, "update")
    assert "- build: 1" in said and "- reuse: 3" in said
    assert table(spark, root, "pages").where("doc_id = '2003-c' and section_title = 'Changed heading'").count() == 1

    call(spark, "--root", root, "reject", "2004-d")
    assert "removed 2004-d from pages" in call(spark, "--root", root, "clean") and table(spark, root, "pages").where("doc_id = '2004-d'").count() == 0
    said = call(spark, "--root", root, "update")
    assert "- remove: 1" in said and "- catalog: 3" in said
    for name in ("catalog", "index", "markdown"):
        assert table(spark, root, name).where("doc_id = '2004-d'").count() == 0
    assert "documents=4 read=0" in call(spark, "--root", root, "add", "--raw", str(raw))  # the rejected row stays rejected
    assert table(spark, root, "entries").where("doc_id = '2004-d'").first()["status"] == "rejected"
    assert "- build: 1" in call(spark, "--root", root, "update", "--doc-id", "2003-c")
    assert "concepts=" in call(spark, "--root", root, "concepts")


def test_incoming_metadata_and_models(spark, tmp_path):
    raw, root, incoming = tmp_path / "raw", str(tmp_path / "kb"), tmp_path / "in"
    raw.mkdir(), incoming.mkdir()
    (raw / "2001-x.txt").write_text("Some heading\nsee 10.1234/abc for this\n" + BODY)
    answer = {"message": {"title": ["A Resolved Title"], "author": [{"given": "Ann", "family": "Lee"}], "published-print": {"date-parts": [[1999]]}, "publisher": "P", "container-title": ["J"]}}
    transport = lambda url: (200, json.dumps(answer)) if "crossref" in url else (404, None)
    call(spark, "--root", root, "add", "--raw", str(raw), "--resolve", transport=transport)
    row = table(spark, root, "entries").first()
    assert (row["title"], row["author"], row["year"], row["journal"]) == ("A Resolved Title", "Ann Lee", 1999, "J")
    assert json.loads(call(spark, "--root", root, "lookup", "--doi", "10.1234/abc", transport=transport))["year"] == 1999
    assert "nothing found" in call(spark, "--root", root, "lookup", "--isbn", "9783161484100", transport=transport)

    (incoming / "new paper.txt").write_text("The Flow of Water\n" + BODY)
    (incoming / "again.txt").write_text("Some heading\nsee 10.1234/abc for this\n" + BODY)
    said = call(spark, "--root", root, "add", "--raw", str(raw), "--incoming", str(incoming))
    assert "moved=1" in said and "known=1" in said and "documents=2" in said
    assert (incoming / "rejected/duplicates/again.txt").exists() and not (incoming / "new paper.txt").exists()
    assert table(spark, root, "entries").where("title = 'A Resolved Title'").count() == 1

    model = """sh -c 'cat > /dev/null; echo "{\\"title\\": \\"T\\", \\"author\\": \\"Model Author\\", \\"year\\": 2005}"'"""
    assert "would set" in call(spark, "--root", root, "recover", "--model-command", model, "--dry-run")
    call(spark, "--root", root, "recover", "--model-command", model)
    got = table(spark, root, "entries").where("author = 'Model Author'").first()
    assert got["year"] == 2005 and got["title"] == "The Flow of Water"
    call(spark, "--root", root, "update", "--model-command", "echo A summary by a model.")
    assert {r["summary"] for r in table(spark, root, "index").collect()} == {"A summary by a model."}
    out = tmp_path / "all.bib"
    call(spark, "--root", root, "bibtex", "--output", str(out))
    assert "A Resolved Title" in out.read_text()


class Library:
    """An outside library in memory."""

    def __init__(self):
        self.items, self.last_headers = {}, {}

    def create(self, payloads):
        done = {}
        for i, p in enumerate(payloads):
            key = f"K{len(self.items)}"
            self.items[key] = json.loads(p)
            done[str(i)] = {"key": key, "version": 1}
        return {"successful": done}

    def update(self, key, payload, version):
        if version != 1:
            raise sync.Conflict
        self.items[key] = json.loads(payload)
        return 2

    def delete(self, key, version):
        del self.items[key]

    def version(self, key):
        return 1


def test_sync_stores_its_mappings(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "kb")
    raw.mkdir()
    for n in (1, 2):
        (raw / f"200{n}-doc.txt").write_text(f"Title {n}\n10.1234/d{n} is the identifier\n" + BODY * n)
    call(spark, "--root", root, "add", "--raw", str(raw))
    call(spark, "--root", root, "update")
    assert "wrote" in call(spark, "--root", root, "sync-init")
    with pytest.raises(ValueError):
        call(spark, "--root", root, "sync-init")
    library, waits = Library(), []
    assert "create=2" in call(spark, "--root", root, "sync", "--dry-run", client=library) and not library.items
    assert "created=2" in call(spark, "--root", root, "sync", "--include-attachments", client=library, sleep=waits.append)
    assert len(library.items) == 4 and sum(v.get("itemType") == "attachment" and v["parentItem"] in library.items for v in library.items.values()) == 2
    state = table(spark, root, "sync_state")
    assert state.count() == 2 and state.where("attachment_key is null or last_attachment is null").count() == 0
    assert call(spark, "--root", root, "sync-plan") == ""
    library.last_headers = {"Backoff": "7"}
    _ = [call(spark, "--root", root, "reject", "2001-doc"), call(spark, "--root", root, "update")]
    assert "delete" in call(spark, "--root", root, "sync-plan")
    assert "deleted=1" in call(spark, "--root", root, "sync", client=library, sleep=waits.append) and table(spark, root, "sync_state").count() == 1


def test_http_library(monkeypatch):
    import urllib.error

    class Response:
        headers = {"Last-Modified-Version": "9", "Retry-After": "3"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return b'{"successful": {"0": {"key": "A", "version": 4}}, "version": 8}'

    seen = []

    def send(request):
        seen.append((request.method, request.full_url, dict(request.header_items()), request.data))
        if request.method == "DELETE":
            raise urllib.error.HTTPError(request.full_url, 412, "conflict", {"Backoff": "2"}, None)
        return Response()

    settings = sync.config({"api_base": "http://host/", "library_id": 5, "api_key": "secret"})
    client = sync.HttpLibrary(sync.library_url(settings, {}), sync.secret(settings, {}, "api_key"), send)
    assert sync.created_rows(client.create(['{"a": 1}'])) == {0: {"key": "A", "version": 4}} and client.update("A", "{}", 3) == 9 and client.version("A") == 8
    assert seen[0][:2] == ("POST", "http://host/users/5/items") and seen[1][2]["If-unmodified-since-version"] == "3" and sync.backoff_seconds(client.last_headers) == 3
    with pytest.raises(sync.Conflict):
        client.delete("A", 1)
    assert sync.backoff_seconds(client.last_headers) == 2


def test_rename_reaches_concepts(spark):
    from scriptorium.operators import catalog as cat

    x = spark.createDataFrame([("c", ["a", "b"], "see [[source/a]]", ["[[source/a#p1]]"])], "concept_id string, supporting_doc_ids array<string>, summary string, related array<string>")
    r = cat.relinked(cat.rename(x, "a", "z"), "a", "z").first()
    assert tuple(r) == ("c", ["z", "b"], "see [[source/z]]", ["[[source/z#p1]]"])
    assert cat.rename(spark.range(1).select(F.lit("@book{a,\n}").alias("entry"), F.lit("a").alias("doc_id")), "a", "z").first()["entry"] == "@book{z,\n}"
