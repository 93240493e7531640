"""Command line over a knowledge base of Parquet tables below a root folder: ``python -m scriptorium.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import identity as idf, scoring as sc, text as tx
from scriptorium.operators import catalog as cat, neardup as nd, pages as pg, render, search as se, sync
from scriptorium.plans import update
from scriptorium.plans.workspace import Workspace
from scriptorium.sources import enrich, files

#: Tables with rows that belong to a document, and those that name documents.
ARTIFACTS = ("pages", "chapters", "index", "markdown")
NAMING = ("entries", "catalog", "resolution", *ARTIFACTS, "concepts", "bibtex", "fingerprints")


def session() -> SparkSession:
    return SparkSession.builder.appName("scriptorium").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scriptorium")
    top.add_argument("--root", default=".", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text)

    c = command("add", "scan a folder of files into the catalog; files that did not change are not read again")
    c.add_argument("--raw", required=True)
    c.add_argument("--incoming", help="a folder whose files are moved to the raw folder first")
    c.add_argument("--overrides")
    c.add_argument("--no-recursive", dest="recursive", action="store_false")
    c.add_argument("--resolve", action="store_true", help="ask the identifier services about DOI and ISBN")
    c.add_argument("--force", action="store_true", help="read all files again")
    c = command("update", "build everything from the catalog; documents that did not change keep their rows")
    c.add_argument("--force", action="store_true", help="build even if nothing changed")
    c.add_argument("--doc-id", action="append", default=[], help="build these documents only")
    c.add_argument("--model-command", help="a program that summarises: prompt in, answer out")
    command("concepts", "build the concepts again from the stored index")
    c = command("recover", "let a model read title, author and year where they are missing")
    c.add_argument("--model-command", required=True)
    c.add_argument("--doc-id", action="append", default=[])
    c.add_argument("--dry-run", action="store_true")
    c = command("lookup", "ask the identifier services about one identifier")
    which = c.add_mutually_exclusive_group(required=True)
    which.add_argument("--doi")
    which.add_argument("--isbn")
    c = command("resolve", "find near-duplicates")
    c.add_argument("--doc-id", action="append", default=[])
    c.add_argument("--shingle-size", type=int, default=nd.SHINGLE)
    c.add_argument("--window-chars", type=int, default=nd.WINDOW)
    c.add_argument("--min-similarity", type=float, default=nd.LOW)
    c.add_argument("--high-similarity", type=float, default=nd.HIGH)
    c = command("extract", "say which documents need their pages extracted")
    c.add_argument("--doc-id", action="append", default=[])
    c.add_argument("--force", action="store_true")
    c = command("search", "search documents and concepts")
    c.add_argument("query")
    c.add_argument("--top-results", type=int, default=5)
    c.add_argument("--top-pages", type=int, default=3)
    c.add_argument("--json", action="store_true")
    c = command("compare", "an evidence pack of two documents")
    c.add_argument("--doc-a", required=True)
    c.add_argument("--doc-b", required=True)
    c.add_argument("--query", required=True)
    c.add_argument("--output", help="a file to write to")
    c = command("bibtex", "print the citeable documents")
    c.add_argument("--output", help="a file to write to")
    c = command("clean", "remove artifacts without a document")
    c.add_argument("--dry-run", action="store_true")
    c = command("rename", "give a document another id, in all tables and links")
    c.add_argument("old_id")
    c.add_argument("new_id")
    c.add_argument("--no-link-update", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c = command("reject", "mark a document as rejected; the next update leaves it out")
    c.add_argument("doc_id")
    c.add_argument("--reason", default="")
    c.add_argument("--dry-run", action="store_true")
    c = command("sync-init", "write a template of the sync's settings")
    c.add_argument("--config")
    c = command("sync-plan", "show what a sync would do")
    c.add_argument("--limit", type=int)
    c = command("sync", "bring the outside library up to date and store the mappings")
    c.add_argument("--config")
    c.add_argument("--limit", type=int)
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--include-attachments", action="store_true")
    c.add_argument("--on-conflict", choices=("skip", "local"), default="skip")
    return top


def _rewrite(table: DataFrame, layout: update.Layout, name: str) -> None:
    """Replace a table that the new one is read from: written beside it first."""
    spark = table.sparkSession
    spark_copy = Workspace(spark, "rewrite").save(table, name)
    spark_copy.write.mode("overwrite").parquet(layout.path(name))


def config_path(layout: update.Layout, given: str | None) -> str:
    return given or layout.path("sync_config.json")


def _described(found: DataFrame) -> DataFrame:
    """Catalog rows of read files: what they, their text and their name say."""
    text = F.coalesce("text", F.lit(""))
    info = files.pdf_info(found).select(F.col("path").alias("_path"), F.col("title").alias("_title"), "author", "producer", "pages")
    pages = F.when(F.col("suffix") == ".pdf", F.coalesce("pages", F.size(F.split(text, "\f"))))
    x = found.join(info, F.col("path") == F.col("_path"), "left")
    x = x.withColumns({"page_count": pages.cast("int"), "title": F.coalesce("_title", F.when(F.col("text").isNotNull(), tx.preview(F.col("text")))), "text": text}).drop("_path", "_title", "pages")
    x = x.withColumns({"doi": idf.doi(idf.head(F.col("text"))), "isbn": idf.isbn(idf.head(F.col("text")))})
    return x.withColumn("source_class", idf.source_class(F.col("filename"), F.col("title"), F.col("page_count"))).drop("content", "suffix")


def add(args: argparse.Namespace, spark: SparkSession, layout: update.Layout, say: Callable, transport: enrich.Transport) -> None:
    ws = Workspace(spark, "add")
    try:
        old = ws.save(spark.read.parquet(layout.path("entries")), "old")
    except AnalysisException:
        old = None
    if args.incoming:
        came = ws.save(_described(files.with_text(files.contents(spark, args.incoming, args.recursive))), "incoming")
        known = old if old is not None else came.where("false")
        plan = ws.save(cat.incoming_plan(came, known), "incoming-plan")
        into = plan.withColumn("target", F.regexp_replace("target", "^library/", ""))
        say(f"moved={files.moved(spark, into.where(F.col('action') == 'move'), args.raw)}")
        say(f"known={files.moved(spark, into.where(F.col('action') == 'reject'), args.incoming)}")
    now = files.scan(spark, args.raw, args.recursive)
    kept = None
    if old is not None and not args.force:
        same = cat.changes(now, old, "path", ("size_bytes", "modified")).where("action = 'reuse'").select("path")
        kept = old.join(same, "path", "left_semi")
        paths = [r["path"] for r in now.join(same, "path", "left_anti").select("path").limit(files.MOST_PATHS + 1).collect()]
        found = files.contents(spark, paths if 0 < len(paths) <= files.MOST_PATHS else args.raw, args.recursive).join(same, "path", "left_anti")
    else:
        found = files.contents(spark, args.raw, args.recursive)
    found = ws.save(_described(files.with_text(found)), "found")
    if args.resolve:
        found = ws.save(enrich.resolved(found, transport), "resolved")
    if args.overrides:
        values = files.overrides(spark, args.overrides).select("doc_id", F.from_json("overrides", "title string, author string, year int, source_class string").alias("o")).select("doc_id", "o.title", "o.author", "o.year")
        found = cat.override(found, values, columns=["title", "author", "year"])
    if kept is not None:
        # ids of the rows that stay are taken
        ids = kept.select(F.col("doc_id").alias("_id")).distinct()
        found = found.join(ids, F.col("doc_id") == F.col("_id"), "left").withColumn("doc_id", F.when(F.col("_id").isNull(), F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("-"), F.substring(F.sha2("path", 256), 1, 8)))).drop("_id")
    new = cat.unique_ids(found, "doc_id", "path")
    _rewrite(kept.unionByName(new, allowMissingColumns=True) if kept is not None else new, layout, "entries")
    entries = spark.read.parquet(layout.path("entries"))
    say(f"documents={entries.count()}", f"read={found.count()}", f"without_text={entries.where(F.col('text') == '').count()}")


def sync_state(spark: SparkSession, layout: update.Layout) -> DataFrame:
    try:
        return spark.read.parquet(layout.path("sync_state"))
    except AnalysisException:  # no state yet
        return sync.mapping_rows(spark, {})


def synced(args: argparse.Namespace, spark: SparkSession, layout: update.Layout, say: Callable, client, sleep: Callable | None) -> None:
    settings = sync.config(files.read_json(config_path(layout, args.config)))
    local, state = sync.records(spark.read.parquet(layout.path("catalog"))), sync_state(spark, layout)
    actions = Workspace(spark, "sync").save(sync.trimmed(sync.plan(local, state), args.limit), "plan")
    for r in actions.groupBy("action").count().orderBy("action").collect():
        say(f"{r['action']}={r['count']}")
    if args.dry_run:
        return
    client = client or sync.HttpLibrary(sync.library_url(settings, os.environ), sync.secret(settings, os.environ, "api_key"))
    items = local.select("sha256", "doc_id", "path", "fingerprint").join(sync.payloads(local, settings["collection_key"]), "sha256")
    linked = None
    if args.include_attachments or settings["include_attachments"]:
        linked = sync.attachments(local).join(local.select("sha256", F.col("attachment_fingerprint").alias("fingerprint")), "sha256")
    pacer = sync.Pacer(settings["min_interval_ms"] / 1000, **({"sleep": sleep} if sleep else {}))
    done = sync.run(client, actions, items, sync.mappings_of(state), pacer, args.on_conflict, linked)
    _rewrite(sync.mapping_rows(spark, done.mappings).withColumn("synced_at", F.lit(files.utc_now())), layout, "sync_state")
    say(" ".join(f"{k}={getattr(done, k)}" for k in ("created", "updated", "deleted", "attached", "skipped", "failed")))


def run(args: argparse.Namespace, spark: SparkSession, out=sys.stdout, transport: enrich.Transport = enrich.http, client=None, sleep: Callable | None = None) -> None:
    layout = update.Layout(args.root)
    read = lambda name: spark.read.parquet(layout.path(name))
    say = lambda *x: print(*x, file=out)
    if args.command == "add":
        add(args, spark, layout, say, transport)
    elif args.command == "update":
        entries = cat.live(read("entries"))
        model = enrich.command_model(args.model_command) if args.model_command else None
        kb = update.build(spark, entries, pg.by_format(entries), update.stored(spark, layout), args.force, args.doc_id, model)
        said = update.report(kb)
        update.write(kb, layout)
        say(said)
    elif args.command == "concepts":
        ws = Workspace(spark, "concepts")
        index, pages = read("index"), read("pages")
        _rewrite(update.concepts(spark, index, pages, ws), layout, "concepts")
        say(f"concepts={read('concepts').count()}")
    elif args.command == "recover":
        entries = cat.keep_ids(cat.live(read("entries")), args.doc_id)
        found = Workspace(spark, "recover").save(enrich.recovered(entries, pg.by_format(entries), enrich.command_model(args.model_command)), "found")
        for r in found.orderBy("doc_id").toLocalIterator():
            say(("would set " if args.dry_run else "set ") + json.dumps(r.asDict(), ensure_ascii=False))
        if not args.dry_run:
            _rewrite(cat.override(read("entries"), found), layout, "entries")
    elif args.command == "lookup":
        one = spark.createDataFrame([(args.doi or args.isbn,)], "id string")
        answers = enrich.fetch_dois(one, transport, "id") if args.doi else enrich.fetch_isbns(one, transport, "id")
        rows = enrich.parsed(answers).collect()
        say(json.dumps(rows[0].asDict(), ensure_ascii=False, indent=2) if rows else "nothing found")
    elif args.command == "resolve":
        ws = Workspace(spark, "resolve")
        entries = cat.keep_ids(cat.resolve_exact(cat.live(read("entries"))), args.doc_id)
        pairs = ws.save(nd.matches(entries, ws, args.high_similarity, args.min_similarity, args.shingle_size, args.window_chars), "pairs")
        nd.resolution(entries, pairs, ws).write.mode("overwrite").parquet(layout.path("resolution"))
        say(f"near_duplicates={read('resolution').where(F.col('status') == 'near_duplicate').count()}")
    elif args.command == "extract":
        now = cat.keep_ids(cat.resolve_exact(cat.live(read("entries"))), args.doc_id)
        done = read("catalog").select("doc_id", F.col("sha256").alias("source_sha256"), F.lit("extracted").alias("status"))
        for r in pg.to_extract(now, done, args.force).groupBy("action").count().orderBy("action").collect():
            say(f"{r['action']}={r['count']}")
    elif args.command == "search":
        found = se.two_stage(spark, args.query, read("index"), read("pages"), read("concepts"), read("chapters"), args.top_results, args.top_pages).orderBy("rank").collect()
        if args.json:
            say(json.dumps({"query": args.query, "results": [{"kind": r["kind"], "id": r["id"], "score": r["score100"] / 100} for r in found]}, indent=2))
        else:
            for r in found:
                say(f"{r['rank']}. [{r['kind']}] {r['id']} score={r['score100'] / 100}")
    elif args.command == "compare":
        index = read("index").withColumn("doc_id", F.col("doc_id").cast("string"))
        parts = ["---\nkind: comparison\nstatus: generated\n---\n"]
        for r in se.compare(index, args.doc_a, args.doc_b).collect():
            parts.append("\n".join(f"{name}: {', '.join(r[c])}" for name, c in (("Shared", "shared"), ("Only a", "only_a"), ("Only b", "only_b"))) + "\n")
        pages = read("pages").withColumn("doc_id", F.col("doc_id").cast("string"))
        for label, doc in (("A", args.doc_a), ("B", args.doc_b)):
            best = se.page_matches(pages.where(F.col("doc_id") == doc), args.query, sc.terms_of(spark, args.query), 5).join(pages.select("doc_id", "page_no", "preview"), ["doc_id", "page_no"])
            parts.append(render.evidence(label, cat.one(index, doc), best).first()["markdown"])
        if args.output:
            Path(args.output).write_text("\n".join(parts) + "\n")
        else:
            say("\n".join(parts))
    elif args.command == "bibtex":
        entries = (r["entry"] + "\n" for r in read("bibtex").orderBy("doc_id").toLocalIterator())
        if args.output:
            with open(args.output, "w") as f:
                f.writelines(e + "\n" for e in entries)
        else:
            for e in entries:
                say(e)
    elif args.command == "clean":
        known = cat.live(read("entries")).select("doc_id")
        for name in ARTIFACTS:
            gone = cat.orphans(read(name), known)
            for r in gone.select("doc_id").distinct().orderBy("doc_id").toLocalIterator():
                say(f"{'would remove' if args.dry_run else 'removed'} {r['doc_id']} from {name}")
            if not args.dry_run and not gone.isEmpty():
                _rewrite(read(name).join(known, "doc_id", "left_semi"), layout, name)
    elif args.command == "rename":
        cat.one(read("catalog"), args.old_id)
        if not read("catalog").where(F.col("doc_id") == args.new_id).isEmpty():
            raise ValueError(f"the id {args.new_id!r} is taken")
        for name in NAMING:
            new = cat.rename(read(name), args.old_id, args.new_id)
            if not args.no_link_update:
                new = cat.relinked(new, args.old_id, args.new_id)
            say(("would rename in " if args.dry_run else "renamed in ") + name)
            if not args.dry_run:
                _rewrite(new, layout, name)
    elif args.command == "reject":
        cat.one(read("entries"), args.doc_id)
        if not args.dry_run:
            _rewrite(cat.set_status(read("entries"), [args.doc_id], "rejected", args.reason), layout, "entries")
        say(f"rejected {args.doc_id}")
    elif args.command == "sync-init":
        path = config_path(layout, args.config)
        if Path(path).exists():
            raise ValueError(f"{path} is there already")
        files.write_json(path, sync.DEFAULT_CONFIG)
        say(f"wrote {path}")
    elif args.command == "sync-plan":
        for r in sync.trimmed(sync.plan(sync.records(read("catalog")), sync_state(spark, layout)), args.limit).collect():
            say(r["action"], r["sha256"])
    elif args.command == "sync":
        synced(args, spark, layout, say, client, sleep)


def main(argv: list[str] | None = None) -> None:
    run(parser().parse_args(argv), session())


if __name__ == "__main__":
    main()
