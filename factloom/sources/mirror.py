"""A one-way mirror of the store as linked Markdown notes.

Notes are rendered as a frame of (path, content); the sink writes what differs and removes notes of an
earlier run that are no longer rendered. It never touches a file that it can't prove it made.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import html_escaped, quoted, safe_display, safe_stem, sort_key
from factloom.operators.entity import with_names
from factloom.operators.snapshot import Snapshot

MARK = "<!-- factloom:generated -->"
MANIFEST = ".factloom-manifest.json"


@dataclass(frozen=True)
class SyncReport:
    written: int
    unchanged: int
    removed: int
    skipped_removals: int


def entity_path(name: Column, key: Column) -> Column:
    return F.concat(F.lit("Entities/"), safe_stem(name, "Entity"), F.lit("--"), F.substring(F.replace(key, F.lit("ent_"), F.lit("")), 1, 8))


def memory_path(key: Column) -> Column:
    return F.concat(F.lit("Memories/"), safe_stem(key, "memory"))


def wiki(path: Column, label: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("|"), safe_display(label), F.lit("]]"))


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _section(title: str, lines: Column) -> Column:
    """A heading and its lines, or nothing without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n## {title}\n\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))


def _listed(rows: DataFrame, key: str, order: list[Column], line: Column, out: str, most: int = 500) -> DataFrame:
    """Lines of each key in order, at most ``most``: cut by rank first, inside the tasks that read them, so that
    a key of very many rows never comes together."""
    named = [c.alias(f"o{k}") for k, c in enumerate(order)]
    each = rows.select(key, *named, line.alias("line"))
    rank = Window.partitionBy(key).orderBy(*[f"o{k}" for k in range(len(order))], "line")
    few = each.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most)
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]).alias(out))


PAGE = 2000  # lines of an index note, about


def _index(title: str, rows: DataFrame, order: list[Column], line: Column, count: int) -> DataFrame:
    """An index note of all rows' lines; of more than ``PAGE`` lines, pages dealt by a hash of the lines, each in
    order, and a note that lists them."""
    pages = max(1, -(-count // PAGE))
    head = F.concat(F.lit("---\nfactloom: true\nkind: index\n---\n\n# "), F.col("title"), F.lit("\n\n"))
    each = rows.select(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], line.alias("line")).alias("r"))
    page = F.pmod(F.xxhash64("r.line"), F.lit(pages)) + 1 if pages > 1 else F.lit(0).cast("long")
    listed = each.groupBy(page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("lines"))
    if pages == 1 and not count:
        listed = rows.sparkSession.createDataFrame([(0, "")], "page long, lines string")
    named = listed.withColumn("title", F.when(F.col("page") > 0, F.concat(F.lit(f"{title} "), F.col("page"))).otherwise(F.lit(title)))
    notes = named.select(F.concat(F.lit("00-Index/"), "title").alias("path"), F.concat(head, "lines", F.lit("\n")).alias("content"))
    if pages > 1:
        links = "\n".join(f"- [[00-Index/{title} {k}|{title} {k}]]" for k in range(1, pages + 1))
        notes = notes.union(rows.sparkSession.createDataFrame([(f"00-Index/{title}", f"---\nfactloom: true\nkind: index\n---\n\n# {title}\n\n{links}\n")], "path string, content string"))
    return notes


def render(store: Snapshot, include_inactive: bool = False) -> DataFrame:
    """path and content of all notes: one per entity and fact, and four indexes."""
    memories = store.memories if include_inactive else store.memories.filter("status = 'active'")
    memories = memories.withColumn("path", memory_path(F.col("id")))
    entities = store.entities.withColumn("path", entity_path(F.col("canonical_name"), F.col("id")))
    none = F.array().cast("array<string>")
    edges = with_names(store)
    subject, object_ = entity_path(F.col("subject_name"), F.col("subject_entity_id")), entity_path(F.col("object_name"), F.col("object_entity_id"))
    tick = F.concat(F.lit("- `"), safe_display(F.col("predicate")), F.lit("` "))
    out = edges.select(F.col("subject_entity_id").alias("id"), "predicate", F.concat(tick, F.lit("→ "), wiki(object_, F.col("object_name"))).alias("line"))
    into = edges.filter("subject_entity_id <> object_entity_id").select(F.col("object_entity_id").alias("id"), "predicate", F.concat(tick, F.lit("← "), wiki(subject, F.col("subject_name"))).alias("line"))
    related = _listed(out.union(into), "id", [F.col("predicate")], F.col("line"), "edges")
    linked = store.memory_entities.join(memories.select(F.col("id").alias("memory_id"), "content", "status", "path", "updated_at"), "memory_id")
    mentioned = _listed(linked, "entity_id", [-F.unix_timestamp("updated_at"), F.col("memory_id")], F.concat(F.lit("- "), wiki(F.col("path"), F.substring("content", 1, 90)), F.lit(" — `"), F.col("status"), F.lit("`")), "facts").withColumnRenamed("entity_id", "id")
    e = entities.join(related, "id", "left").join(mentioned, "id", "left")
    aliases = F.coalesce("aliases", none) if "aliases" in store.entities.columns else none
    alias_lines = F.when(F.size(aliases) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(F.slice(aliases, 1, 100), lambda a: F.concat(F.lit("  - "), quoted(a))), "\n"))).otherwise(F.lit(""))
    head = _lines("---", "factloom: true", "kind: entity", F.concat(F.lit("entity_id: "), quoted(F.col("id"))), F.concat(F.lit("entity_type: "), quoted(F.col("entity_type"))), F.concat(F.lit("canonical_name: "), quoted(F.col("canonical_name"))), "aliases:")
    entity_notes = e.select("path", F.concat(head, alias_lines, F.lit("\n---\n\n# "), safe_display(F.col("canonical_name")), _section("Relationships", F.coalesce("edges", none)), _section("Memories", F.coalesce("facts", none)), F.lit("\n")).alias("content"))

    names = entities.select(F.col("id").alias("entity_id"), "canonical_name", F.col("path").alias("entity_path"))
    own = _listed(store.memory_entities.join(names, "entity_id"), "memory_id", [sort_key("canonical_name"), F.col("entity_id")], F.concat(F.lit("- "), wiki(F.col("entity_path"), F.col("canonical_name")), F.lit(" — `"), safe_display(F.col("role")), F.lit("`")), "names").withColumnRenamed("memory_id", "id")
    told = store.memory_relationships.join(edges.withColumnRenamed("id", "relationship_id"), "relationship_id")
    said = _listed(told, "memory_id", [F.col("subject_name"), F.col("predicate"), F.col("object_name")], F.concat(F.lit("- "), wiki(subject, F.col("subject_name")), F.lit(" `--"), safe_display(F.col("predicate")), F.lit("→` "), wiki(object_, F.col("object_name"))), "said").withColumnRenamed("memory_id", "id")
    m = memories.join(own, "id", "left").join(said, "id", "left")
    time = F.col("event_ts").cast("string") if "event_ts" in memories.columns else F.col("event_time")
    head = _lines("---", "factloom: true", "kind: memory", *[F.concat(F.lit(f"{n}: "), quoted(c)) for n, c in (("memory_id", F.col("id")), ("memory_type", F.col("memory_type")), ("subtype", F.col("subtype")), ("status", F.col("status")), ("created_at", F.col("created_at").cast("string")), ("updated_at", F.col("updated_at").cast("string")), ("event_time", time))], F.concat(F.lit("confidence: "), F.round("confidence", 6).cast("string")), F.concat(F.lit("importance: "), F.round("importance", 6).cast("string")), "---")
    replaced = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit("\n\n## Superseded by\n\n`"), safe_display(F.col("superseded_by")), F.lit("`"))).otherwise(F.lit(""))
    memory_notes = m.select("path", F.concat(head, F.lit("\n\n# Memory\n\n## Content\n\n<pre>\n"), html_escaped(F.col("content")), F.lit("\n</pre>"), _section("Entities", F.coalesce("names", none)), _section("Relationships", F.coalesce("said", none)), replaced, F.lit("\n")).alias("content"))

    many_entities, many_facts = entities.count(), memories.count()
    entity_index = _index("Entities", entities, [sort_key("canonical_name"), F.col("id")], F.concat(F.lit("- "), wiki(F.col("path"), F.col("canonical_name"))), many_entities)
    kind = F.concat(F.lit(" — `"), F.col("memory_type"), F.lit("/"), F.coalesce("subtype", F.lit("-")), F.lit("` · `"), F.col("status"), F.lit("`"))
    memory_index = _index("Memories", memories, [-F.unix_timestamp("updated_at"), F.col("id")], F.concat(F.lit("- "), wiki(F.col("path"), F.substring("content", 1, 100)), kind), many_facts)
    when = F.coalesce(time.try_cast("timestamp"), F.col("created_at"))
    # A day's facts in parts, by a hash of the id, as few as keep a part near a page; no fact is left out.
    parts = max(1, -(-many_facts // PAGE))
    by_day = memories.withColumn("day", F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("Unknown date"))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    each = by_day.select("day", "part", F.struct("id", F.concat(F.lit("- "), wiki(F.col("path"), F.substring("content", 1, 90))).alias("line")).alias("r"))
    by_day = each.groupBy("day", "part").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("lines"))
    timeline = _index("Timeline", by_day, [F.translate("day", "0123456789", "9876543210"), F.col("part")], F.concat(F.lit("## "), F.col("day"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")), many_facts)
    counts = store.memories.sparkSession.createDataFrame([(many_entities, many_facts)], "e long, m long")
    home = counts.select(F.lit("00-Index/Home").alias("path"), F.concat(F.lit("---\nfactloom: true\nkind: index\n---\n\n# Facts\n\n- Entities: **"), F.col("e").cast("string"), F.lit("**\n- Memories: **"), F.col("m").cast("string"), F.lit("**\n\n- [[00-Index/Entities|Entities]]\n- [[00-Index/Memories|Memories]]\n- [[00-Index/Timeline|Timeline]]\n\n> Generated from the store, which is authoritative; changes here are lost.\n")).alias("content"))
    notes = reduce(DataFrame.union, [entity_notes, memory_notes, entity_index, memory_index, timeline, home])
    return notes.select(F.concat("path", F.lit(".md")).alias("path"), F.concat(F.lit(MARK + "\n"), "content").alias("content"))


class MirrorFolder:
    """A local folder with notes; a driver-side sink, as notes are for a person's machine."""

    def __init__(self, root: str | Path) -> None:
        self.root = Path(root).expanduser()
        self.root.mkdir(parents=True, exist_ok=True)
        if self.root.is_symlink():
            raise ValueError("the mirror's folder must not be a symlink")

    def _confined(self, relative: str) -> Path:
        path = Path(relative)
        if path.is_absolute() or ".." in path.parts:
            raise ValueError("path leaves the mirror")
        at = self.root
        for part in path.parts:
            at = at / part
            if at.is_symlink():
                raise ValueError("symlinks are not allowed in the mirror")
        return at

    def _put(self, at: Path, text: str) -> None:
        at.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(prefix=".factloom-", dir=at.parent)
        try:
            with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as out:
                out.write(text)
            os.replace(name, at)
        finally:
            Path(name).unlink(missing_ok=True)

    def _known(self) -> dict[str, str]:
        at = self._confined(MANIFEST)
        if not at.exists():
            return {}
        try:
            data = json.loads(at.read_text("utf-8"))
        except ValueError as e:
            raise FileExistsError("the manifest is not one of this mirror") from e
        if not isinstance(data, dict) or data.get("generated_by") != "factloom":
            raise FileExistsError("the manifest is not one of this mirror")
        return {k: v for k, v in data.get("files", {}).items() if isinstance(k, str)}

    def sync(self, notes: DataFrame, prune: bool = True) -> SyncReport:
        """Write the notes that differ. Paths and digests come to the driver first, a partition at a time; of the
        contents only those whose digest is not that of the file that is there."""
        known, seen, stale = self._known(), {}, []
        digested = notes.withColumn("digest", F.sha2("content", 256))
        for row in digested.select("path", "digest").toLocalIterator():
            at, path = self._confined(row["path"]), row["path"]
            seen[path] = row["digest"]
            if at.exists():
                text = at.read_text("utf-8", errors="replace")
                if MARK not in text[:256]:
                    raise FileExistsError(f"{path} was not made by this mirror")
                if hashlib.sha256(text.encode()).hexdigest() == row["digest"]:
                    continue
            stale.append(path)
        written = 0
        if stale:
            wanted = notes.sparkSession.createDataFrame([(p,) for p in stale], "path string")
            for row in (notes if len(stale) == len(seen) else notes.join(wanted, "path", "left_semi")).toLocalIterator():
                self._put(self._confined(row["path"]), row["content"])
                written += 1
        removed = skipped = 0
        for path in sorted(set(known) - set(seen)) if prune else []:
            try:
                at = self._confined(path)
                mine = at.is_file() and MARK in at.read_text("utf-8", errors="replace")[:256]
            except (ValueError, OSError):
                mine = False
            if mine:
                at.unlink()
                removed += 1
            else:
                skipped += 1
        self._put(self._confined(MANIFEST), json.dumps({"format": 1, "generated_by": "factloom", "files": dict(sorted(seen.items()))}, indent=2) + "\n")
        return SyncReport(written, len(seen) - written, removed, skipped)
