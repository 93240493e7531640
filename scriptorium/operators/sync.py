"""One-way sync with an outside library: candidates, plan, payloads, and a paced client loop.

The plan and the payloads are DataFrames; only the calls themselves run on the driver,
in batches, because the outside service takes them one after the other.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import identity as idf

BATCH = 50


def candidates(documents: DataFrame) -> DataFrame:
    """The citeable documents with a hash that are no duplicates and not rejected."""
    col = lambda c, kind="string": F.col(c) if c in documents.columns else F.lit(None).cast(kind)
    ok = (F.coalesce(col("source_class"), F.lit("")) != "duplicate") & ~F.coalesce(col("is_redundant", "boolean"), F.lit(False)) & (F.coalesce(col("status"), F.lit("")) != "rejected")
    ok = ok & (F.coalesce(col("sha256"), F.lit("")) != "")
    return documents.where(ok & idf.citeable(F.col("title"), F.col("year"), col("doi"), col("isbn"), col("cite", "boolean")))


def records(documents: DataFrame) -> DataFrame:
    """Candidates, one per hash (the last doc_id), with fingerprint and attachment_fingerprint."""
    x = documents
    for c in (*idf.FINGERPRINTED, "filename"):
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast("int" if c == "year" else "string"))
    x = candidates(x).withColumns({"fingerprint": idf.fingerprint(*idf.FINGERPRINTED), "attachment_fingerprint": idf.fingerprint("path", "filename")})
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("sha256").orderBy(F.desc("doc_id")))).where("_n = 1").drop("_n")


def plan(local: DataFrame, mappings: DataFrame) -> DataFrame:
    """(sha256, action): create without a key, update where the fingerprint differs, delete what is not local."""
    a = local.select(F.col("sha256").alias("_a"), F.col("fingerprint").alias("_fp"))
    b = mappings.select(F.col("sha256").alias("_b"), F.col("key").alias("_key"), F.col("last_fingerprint").alias("_last"))
    x = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    action = F.when(F.col("_a").isNull(), "delete").when(F.coalesce("_key", F.lit("")) == "", "create").when(~F.col("_fp").eqNullSafe(F.col("_last")), "update")
    return x.select(F.coalesce("_a", "_b").alias("sha256"), action.alias("action")).where("action is not null")


def trimmed(actions: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` actions, creates before updates before deletes; all for None or a negative limit."""
    if limit is None or limit < 0:
        return actions
    rank = F.when(F.col("action") == "create", 0).when(F.col("action") == "update", 1).otherwise(2)
    return actions.orderBy(rank, "sha256").limit(limit)


def payloads(local: DataFrame, collection: str | None = None) -> DataFrame:
    """(sha256, payload): the item of the library as JSON, without empty fields."""
    filled = lambda c: F.nullif(F.col(c), F.lit("")) if c in local.columns else F.lit(None).cast("string")
    people = F.transform(idf.creators(F.col("author")), lambda c: F.struct(F.lit("author").alias("creatorType"), c["last"].alias("lastName"), c["first"].alias("firstName"), c["name"].alias("name")))
    extra = F.concat_ws("\n", filled("extra"), F.concat(F.lit("SHA256: "), F.col("sha256")), F.concat(F.lit("doc_id: "), F.col("doc_id").cast("string")), F.concat(F.lit("path: "), F.coalesce("path", F.lit(""))))
    item = F.struct(
        idf.entry_type(F.col("doi"), F.col("isbn"), F.col("journal"), F.col("source_class"), "journalArticle", "book", "document").alias("itemType"), filled("title").alias("title"), people.alias("creators"),
        F.col("year").cast("string").alias("date"), filled("doi").alias("DOI"), filled("isbn").alias("ISBN"), filled("journal").alias("publicationTitle"), F.coalesce(filled("publisher"), filled("producer")).alias("publisher"),
        extra.alias("extra"), (F.array(F.lit(collection)) if collection else F.lit(None).cast("array<string>")).alias("collections"),
    )
    return local.select("sha256", F.to_json(item).alias("payload"))


def attachments(local: DataFrame) -> DataFrame:
    """(sha256, payload): a linked file as JSON."""
    name = F.coalesce(F.nullif("filename", F.lit("")), F.substring_index("path", "/", -1))
    return local.select("sha256", F.to_json(F.struct(F.lit("linked_file").alias("linkMode"), F.coalesce(F.nullif(name, F.lit("")), F.col("doc_id").cast("string")).alias("title"), F.col("path"), name.alias("filename"), idf.content_type(F.col("path")).alias("contentType"))).alias("payload"))


def backoff_seconds(headers: dict | None) -> float | None:
    """The first valid wait that the service asks for."""
    lower = {str(k).lower(): v for k, v in (headers or {}).items()}
    for name in ("backoff", "retry-after"):
        try:
            wait = float(lower[name])
        except (KeyError, TypeError, ValueError):
            continue
        if wait >= 0:
            return wait
    return None


class Pacer:
    """At least ``interval`` seconds between calls, more where the service asks for it."""

    def __init__(self, interval: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.ready = 0.0

    def call(self, function: Callable, *args):
        now = self.clock()
        if now < self.ready:
            self.sleep(self.ready - now)
        out = function(*args)
        self.ready = self.clock() + self.interval
        return out

    def heed(self, headers: dict | None) -> None:
        self.ready = max(self.ready, self.clock() + (backoff_seconds(headers) or 0.0))


def chunks(rows: Iterable, size: int = BATCH) -> Iterator[list]:
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


class Conflict(Exception):
    """The item changed outside since its stored version."""


@dataclass
class Outcome:
    created: int = 0
    updated: int = 0
    deleted: int = 0
    attached: int = 0
    skipped: int = 0
    failed: int = 0
    mappings: dict = field(default_factory=dict)


def created_rows(response: dict) -> dict[int, dict]:
    """Successes of a create call by the index of the item; indices that are no numbers go."""
    out = {}
    for index, item in ((response or {}).get("successful") or {}).items():
        if str(index).isdigit():
            out[int(index)] = item
    return out


MAPPING = "sha256 string, key string, version long, doc_id string, last_fingerprint string, last_path string, attachment_key string, last_attachment string"


def mapping_rows(spark: SparkSession, mappings: dict[str, dict]) -> DataFrame:
    """The state of a sync as a table; empty for no mappings."""
    names = [c.split()[0] for c in MAPPING.split(", ")]
    return spark.createDataFrame([(sha, *(m.get(n) for n in names[1:])) for sha, m in sorted(mappings.items())], MAPPING)


def mappings_of(state: DataFrame) -> dict[str, dict]:
    """The stored mappings by sha256: what a run works on, a row for each item of the outside library."""
    return {r["sha256"]: {k: v for k, v in r.asDict().items() if k != "sha256" and v is not None} for r in state.toLocalIterator()}


def run(client, actions: DataFrame, items: DataFrame, mappings: dict[str, dict], pacer: Pacer, on_conflict: str = "skip", files: DataFrame | None = None) -> Outcome:
    """Apply the plan. items: sha256, doc_id, path, fingerprint, payload. mappings: by sha256, key and version.

    client has create(list), update(key, payload, version), delete(key, version) and
    version(key), and may have last_headers, whose wait is kept; update and delete raise Conflict. on_conflict: skip, or local to try
    again with the latest version. files: sha256, payload and fingerprint of linked files, created below their new item.
    """
    if on_conflict not in ("skip", "local"):
        raise ValueError("on_conflict is skip or local")
    out = Outcome(mappings={k: dict(v) for k, v in mappings.items()})

    def ask(function, *args):
        try:
            return pacer.call(function, *args)
        finally:
            pacer.heed(getattr(client, "last_headers", None))

    def stored(r, key, version):
        entry = out.mappings.get(r["sha256"], {})
        out.mappings[r["sha256"]] = entry | {"key": key, "version": version, "doc_id": None if r["doc_id"] is None else str(r["doc_id"]), "last_fingerprint": r["fingerprint"], "last_path": r["path"]}

    def settled(call, sha):
        entry = out.mappings[sha]
        for attempt in range(2):
            try:
                return ask(call, entry["key"], entry.get("version")), True
            except Conflict:
                if attempt or on_conflict == "skip":
                    out.skipped += 1
                    return None, False
                entry["version"] = ask(client.version, entry["key"])
        return None, False

    todo = actions.where("action <> 'delete'").join(items, "sha256").orderBy("sha256")
    for part in chunks(todo.where("action = 'create'").toLocalIterator()):
        done = created_rows(ask(client.create, [r["payload"] for r in part]))
        for i, r in enumerate(part):
            if i in done:
                stored(r, done[i]["key"], done[i].get("version"))
                out.created += 1
            else:
                out.failed += 1
    for r in todo.where("action = 'update'").toLocalIterator():
        version, ok = settled(lambda key, v, r=r: client.update(key, r["payload"], v), r["sha256"])
        if ok:
            stored(r, out.mappings[r["sha256"]]["key"], version)
            out.updated += 1
    if files is not None:
        wanted = (r for r in files.orderBy("sha256").toLocalIterator() if (m := out.mappings.get(r["sha256"])) and m.get("key") and not m.get("attachment_key"))
        for part in chunks(wanted):
            below = [json.dumps(json.loads(r["payload"]) | {"itemType": "attachment", "parentItem": out.mappings[r["sha256"]]["key"]}) for r in part]
            done = created_rows(ask(client.create, below))
            for i, r in enumerate(part):
                if i in done:
                    out.mappings[r["sha256"]] |= {"attachment_key": done[i]["key"], "last_attachment": r["fingerprint"]}
                    out.attached += 1
                else:
                    out.failed += 1
    for r in actions.where("action = 'delete'").orderBy("sha256").toLocalIterator():
        sha = r["sha256"]
        if not out.mappings.get(sha, {}).get("key"):
            out.mappings.pop(sha, None)
            continue
        if settled(client.delete, sha)[1]:
            del out.mappings[sha]
            out.deleted += 1
    return out


def library_url(settings: dict, environment: dict) -> str:
    """The items of the configured library."""
    return f"{settings['api_base'].rstrip('/')}/{settings['library_type']}s/{secret(settings, environment, 'library_id')}/items"


class HttpLibrary:
    """Client of a library's web interface: JSON items, versions in headers, 412 for a conflict. ``send(request)`` gives a response as urlopen does."""

    def __init__(self, url: str, key: str, send: Callable = urllib.request.urlopen):
        self.url, self.key, self.send, self.last_headers = url, key, send, {}

    def _call(self, method: str, path: str, body: str | None = None, version: int | None = None) -> tuple[dict, str]:
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        if version is not None:
            headers["If-Unmodified-Since-Version"] = str(version)
        try:
            with self.send(urllib.request.Request(self.url + path, data=body.encode() if body else None, headers=headers, method=method)) as r:
                self.last_headers = dict(r.headers)
                return self.last_headers, r.read().decode()
        except urllib.error.HTTPError as e:
            self.last_headers = dict(e.headers or {})
            if e.code == 412:
                raise Conflict(path) from e
            raise

    def _version(self, headers: dict) -> int | None:
        value = {k.lower(): v for k, v in headers.items()}.get("last-modified-version")
        return int(value) if value is not None else None

    def create(self, payloads: list[str]) -> dict:
        return json.loads(self._call("POST", "", "[" + ",".join(payloads) + "]")[1])

    def update(self, key: str, payload: str, version: int | None) -> int | None:
        return self._version(self._call("PATCH", f"/{key}", payload, version)[0])

    def delete(self, key: str, version: int | None) -> None:
        self._call("DELETE", f"/{key}", None, version)

    def version(self, key: str) -> int | None:
        return json.loads(self._call("GET", f"/{key}")[1]).get("version")


DEFAULT_CONFIG = {"schema_version": 1, "library_type": "user", "library_id": None, "library_id_env": "LIBRARY_ID", "api_key_env": "LIBRARY_API_KEY", "sync_mode": "one_way", "collection_key": None, "include_attachments": False, "api_base": None, "min_interval_ms": 1000}


def config(given: dict | None) -> dict:
    """The defaults with the given values; ValueError for another mode or type of library."""
    out = DEFAULT_CONFIG | (given or {})
    if out["sync_mode"] != "one_way" or out["library_type"] not in ("user", "group"):
        raise ValueError("the sync is one_way, to a user's or group's library")
    return out


def secret(settings: dict, environment: dict, name: str) -> str:
    """A setting itself or from the variable that the setting ``<name>_env`` names; ValueError if neither is there."""
    value = settings.get(name) or environment.get(settings.get(f"{name}_env") or "")
    if not value:
        raise ValueError(f"no {name}")
    return str(value)
