"""The segment store: immutable Parquet segments, a manifest, tombstones and a log.

A segment is a folder of two Parquet tables, documents and postings; the manifest lists
the committed ones and is replaced by an atomic rename. Postings are partitioned by field
and ranged by term and document, so that a lookup reads the row groups of its own terms, and
a frequent term's list spreads over files. Deletes of sealed documents are lines of text
files in a tombstone folder beside the segment, which is read as a table. Documents put one
at a time wait in a small buffer backed by a log that is synced on every record. Bulk loads
and deletes go straight from a DataFrame. The folder must be on a file system that the
driver and all executors share; only the manifest and log are handled by the driver.

Scores use corpus figures over live documents of all segments, so flushing or merging
never changes a result.
"""

from __future__ import annotations

import functools
import json
import os
import re
import shutil
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdex.operators.index import build_postings, number_documents, ranged_postings, stored_documents
from fathomdex.operators.search import DEFAULT_LIMIT, index_scores
from fathomdex.plans.query_lang import FIELDS, QueryError
from fathomdex.sources.segment_text import escape

#: Live documents that seal the buffer, and the width of a merge tier.
AUTO_FLUSH = 8
MERGE_FACTOR = 2
#: Up to this limit, the hits' own numbers are given to the scan of their titles and bodies.
MOST_SHOWN = 1000

_DOCS = "seg int, doc long, id string, title string, body string"
_STORED = f"{_DOCS}, title_len int, body_len int"
_POSTINGS = "seg int, field string, term string, doc long, tf int, positions array<int>"


class StoreError(RuntimeError):
    """An operation the store refuses."""


@dataclass(frozen=True)
class PutResult:
    active: int
    flushed: str = ""
    documents: int = 0


@dataclass(frozen=True)
class FlushInfo:
    segment: str = ""
    documents: int = 0


@dataclass(frozen=True)
class MergeInfo:
    outcome: str  # merged, emptied, none, single, kept
    segment: str = ""


@dataclass(frozen=True)
class Stats:
    sealed_segments: int
    active_docs: int
    live_docs: int
    dead_docs: int
    posting_lists: int
    bytes_on_disk: int


@dataclass
class SearchResponse:
    hits: DataFrame
    total: int


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.removeprefix("file://")
        os.makedirs(self.path, exist_ok=True)
        self.active: dict[str, tuple[str, str]] = {}
        self.epoch, self.sealed = self._load_manifest()
        self._counts: dict[str, int] = {}
        self._remove_unreferenced()
        self.dead = {name: self._count_tombstones(name) for name in self.sealed}
        self._replay()

    # files

    def _file(self, name: str) -> str:
        return os.path.join(self.path, name)

    def _load_manifest(self) -> tuple[int, list[str]]:
        if not os.path.exists(self._file("manifest")):
            return 0, []
        with open(self._file("manifest"), encoding="utf-8") as f:
            head, *names = f.read().splitlines()
        for name in names:
            if not os.path.isdir(self._file(name)):
                raise StoreError(f"manifest names a missing segment: {name}")
        return int(head.removeprefix("epoch ")), names

    def _publish(self) -> None:
        self.epoch += 1
        with open(self._file("manifest.tmp"), "w", encoding="utf-8") as f:
            f.write("".join(f"{x}\n" for x in (f"epoch {self.epoch}", *self.sealed)))
            f.flush()
            os.fsync(f.fileno())
        os.replace(self._file("manifest.tmp"), self._file("manifest"))

    def _tombstones(self, names: list[str]) -> DataFrame | None:
        """seg and id of dead documents, as a table; None if there are none."""
        frames = [self.spark.read.text(f"file://{path}", lineSep="\n").select(F.lit(int(n[4:])).alias("seg"), F.regexp_replace("value", r"\\(.)", "$1").alias("id")) for n in names if os.path.exists(path := self._file(f"{n}.dead"))]
        return functools.reduce(DataFrame.unionByName, frames).distinct() if frames else None

    def _count_tombstones(self, name: str) -> int:
        gone = self._tombstones([name])
        return 0 if gone is None else gone.count()

    def _remove_unreferenced(self) -> None:
        for name in os.listdir(self.path):
            base = name.removesuffix(".dead")
            if name == "manifest.tmp" or re.fullmatch(r"seg-\d+(\.dead)?", name) and base not in self.sealed:
                path = self._file(name)
                shutil.rmtree(path) if os.path.isdir(path) else os.unlink(path)

    def _log(self, *record: str) -> None:
        """One record: a checksum and the epoch, so neither a torn line nor an old log is replayed."""
        body = json.dumps([self.epoch, *record])
        with open(self._file("translog"), "a", encoding="utf-8") as f:
            f.write(f"{zlib.crc32(body.encode()):08x} {body}\n")
            f.flush()
            os.fsync(f.fileno())

    def _replay(self) -> None:
        if not os.path.exists(self._file("translog")):
            return
        with open(self._file("translog"), encoding="utf-8") as f:
            for line in f:
                check, _, body = line.rstrip("\n").partition(" ")
                if not line.endswith("\n") or check != f"{zlib.crc32(body.encode()):08x}":
                    break
                epoch, kind, id_, *rest = json.loads(body)
                if epoch != self.epoch:
                    continue
                if kind == "PUT" and id_ not in self.active:
                    self.active[id_] = (rest[0], rest[1])
                elif kind == "DEL":
                    self.active.pop(id_, None)

    def _clear_log(self) -> None:
        if os.path.exists(self._file("translog")):
            os.unlink(self._file("translog"))

    def _next_segment(self) -> int:
        return 1 + max((int(name[4:]) for name in self.sealed), default=0)

    # tables

    def _numbered(self, rows: DataFrame, seg: int) -> DataFrame:
        return number_documents(rows, seg)

    def _active_rows(self) -> DataFrame:
        rows = [(0, n, id_, *x) for n, (id_, x) in enumerate(self.active.items())]
        return self.spark.createDataFrame(rows, _DOCS)

    def _sealed(self, table: str, names: list[str] | None = None) -> DataFrame | None:
        names = self.sealed if names is None else names
        if not names:
            return None
        paths = [f"file://{self._file(n)}/{table}" for n in names]
        if table == "documents":
            return self.spark.read.schema(_STORED).parquet(*paths)
        return functools.reduce(DataFrame.unionByName, (self.spark.read.schema(_POSTINGS).parquet(p) for p in paths))

    def _live(self, frame: DataFrame, names: list[str]) -> DataFrame:
        gone = self._tombstones([n for n in names if self.dead.get(n)])
        return frame if gone is None else frame.join(gone, ["seg", "id"], "left_anti")

    def documents(self) -> DataFrame:
        """Live documents of all segments and the buffer, with seg and doc."""
        active = stored_documents(self._active_rows())
        sealed = self._sealed("documents")
        return active if sealed is None else self._live(sealed, self.sealed).unionByName(active)

    def postings(self) -> DataFrame:
        """Postings of live documents."""
        active = build_postings(self._active_rows())
        sealed = self._sealed("postings")
        if sealed is None:
            return active
        if any(self.dead[n] for n in self.sealed):
            gone = self._sealed("documents").select("seg", "doc", "id")
            gone = gone.join(self._live(gone, self.sealed), ["seg", "doc"], "left_anti").select("seg", "doc")
            sealed = sealed.join(gone, ["seg", "doc"], "left_anti")
        return sealed.unionByName(active)

    def _ordered(self) -> DataFrame:
        order = F.create_map(*(F.lit(x) for n, name in enumerate(self.sealed) for x in (int(name[4:]), n))) if self.sealed else None
        place = F.coalesce(order[F.col("seg")], F.lit(len(self.sealed))) if self.sealed else F.lit(0)
        return self.documents().withColumn("place", place)

    # operations

    def _find(self, id_: str) -> str | None:
        """The newest segment that holds the id among its live documents."""
        if not self.sealed:
            return None
        here = self._sealed("documents").filter(F.col("id") == id_).select("seg", "id")  # a row for each segment at most
        segs = {r["seg"] for r in here.distinct().collect()}
        names = [n for n in self.sealed if int(n[4:]) in segs]
        if names and (gone := self._tombstones(names)) is not None:
            dead = {r["seg"] for r in gone.filter(F.col("id") == id_).collect()}
            names = [n for n in names if int(n[4:]) not in dead]
        return names[-1] if names else None

    def put(self, id_: str, title: str, body: str) -> PutResult:
        if not id_:
            raise StoreError("document id is empty")
        if "\n" in id_ or "\r" in id_:
            raise StoreError("document id cannot contain a newline")
        if id_ in self.active or self._find(id_):
            raise StoreError(f"document already indexed: {id_}")
        self._log("PUT", id_, title, body)
        self.active[id_] = (title, body)
        if len(self.active) >= AUTO_FLUSH:
            info = self.flush()
            return PutResult(0, info.segment, info.documents)
        return PutResult(len(self.active))

    def put_all(self, docs: DataFrame) -> FlushInfo:
        """Loads (id, title, body) rows as one new segment; ids that are live already are left
        out. Of rows with one id, that of the smallest title and body is loaded."""
        self.flush()
        rows = docs.select("id", *(F.coalesce(f, F.lit("")).alias(f) for f in FIELDS)).filter((F.length("id") > 0) & ~F.col("id").rlike("[\r\n]"))
        rows = rows.groupBy("id").agg(F.min(F.struct(*FIELDS)).alias("x")).select("id", "x.*")
        rows = rows.join(self.documents().select("id"), "id", "left_anti")
        return self._seal(rows)

    def _seal(self, rows: DataFrame, replace: list[str] = (), keep_numbers: bool = False) -> FlushInfo:
        seg = self._next_segment()
        name = f"seg-{seg:06d}"
        path = f"file://{self._file(name)}"
        numbered = rows.withColumn("seg", F.lit(seg)) if keep_numbers else self._numbered(rows, seg)
        stored_documents(numbered).write.mode("overwrite").parquet(f"{path}/documents")
        again = self.spark.read.parquet(f"{path}/documents").select("seg", "doc", "id", "title", "body")
        count = again.count()
        if count:
            for f in FIELDS:
                rows = ranged_postings(again, f).select(F.lit(seg).alias("seg"), "term", "doc", "tf", "positions")
                rows.write.mode("overwrite").parquet(f"{path}/postings/field={f}")
            self.sealed = [n for n in self.sealed if n not in replace] + [name]
            self.dead[name] = 0
            self._counts[name] = count
        else:
            shutil.rmtree(self._file(name), ignore_errors=True)
            self.sealed = [n for n in self.sealed if n not in replace]
        self._publish()
        return FlushInfo(name if count else "", count)

    def remove(self, id_: str) -> None:
        if id_ in self.active:
            self._log("DEL", id_)
            del self.active[id_]
            return
        name = self._find(id_)
        if name is None:
            raise StoreError(f"no such document: {id_}")
        os.makedirs(self._file(f"{name}.dead"), exist_ok=True)
        with open(os.path.join(self._file(f"{name}.dead"), "removed.txt"), "a", encoding="utf-8", newline="\n") as f:
            f.write(escape(id_) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.dead[name] += 1

    def remove_all(self, ids: DataFrame) -> int:
        """Deletes the documents of these ids (column id) as one bulk operation; ids that
        aren't live are left out. Gives how many went."""
        self.flush()
        gone, before = ids.select("id").distinct(), sum(self.dead.values())
        for name in self.sealed:
            mine = self._live(self._sealed("documents", [name]).select("seg", "id"), [name]).join(gone, "id")
            mine.select(F.replace("id", F.lit("\\"), F.lit("\\\\")).alias("value")).write.mode("append").text(f"file://{self._file(name)}.dead", lineSep="\n")
            self.dead[name] = self._count_tombstones(name)
        return sum(self.dead.values()) - before

    def get(self, id_: str) -> tuple[str, str, str] | None:
        if id_ in self.active:
            return (id_, *self.active[id_])
        name = self._find(id_)
        if name is None:
            return None
        row = self._sealed("documents", [name]).filter(F.col("id") == id_).select("id", "title", "body").first()
        return tuple(row)

    def list(self) -> DataFrame:
        """id and title of live documents, in the order of segments and insertion."""
        return self._ordered().orderBy("place", "doc").select("id", "title")

    def search(self, query: str, limit: int = DEFAULT_LIMIT) -> SearchResponse:
        """Titles and bodies are read for the hits that are shown only."""
        docs = self.documents()
        scores = index_scores(docs, self.postings(), query)
        best = scores.orderBy(F.desc("score"), F.asc("id")).limit(limit)
        shown = docs.select("seg", "doc", *FIELDS)
        if limit <= MOST_SHOWN:
            found = best.collect()
            shown = shown.filter(F.col("doc").isin([r["doc"] for r in found]))
            best = self.spark.createDataFrame(found, scores.schema)
        hits = best.join(shown, ["seg", "doc"]).orderBy(F.desc("score"), F.asc("id")).select("id", *FIELDS, "score")
        return SearchResponse(hits, scores.count())

    def flush(self) -> FlushInfo:
        if not self.active:
            self._clear_log()
            return FlushInfo()
        info = self._seal(self._active_rows().select("id", "title", "body").coalesce(1))
        self.active = {}
        self._clear_log()
        return info

    def _live_count(self, name: str) -> int:
        if name not in self._counts:
            self._counts[name] = self._sealed("documents", [name]).count()
        return self._counts[name] - self.dead[name]

    def pick_merge_group(self) -> list[str]:
        live = {n: self._live_count(n) for n in self.sealed}
        ranked_names = sorted(self.sealed, key=lambda n: (live[n], self.sealed.index(n)))
        if not ranked_names:
            return []
        tier = [n for n in ranked_names if live[n] <= MERGE_FACTOR * live[ranked_names[0]]]
        if len(tier) >= 2:
            return sorted(tier, key=self.sealed.index)
        return next(([n] for n in ranked_names if self.dead[n]), [])

    def merge(self) -> MergeInfo:
        self.flush()
        if not self.sealed:
            return MergeInfo("none")
        group = self.pick_merge_group()
        if not group:
            return MergeInfo("single" if len(self.sealed) == 1 else "kept")
        rows = self._live(self._sealed("documents", group), group)
        # Numbers stay unique and keep the segments' order: each segment's begin after those
        # of the segments before it, however often these have been merged themselves.
        ends = {r["seg"]: r["end"] for r in self._sealed("documents", group).groupBy("seg").agg((F.max("doc") + 1).alias("end")).collect()}
        firsts, at = [], 0
        for seg in (int(n[4:]) for n in group):
            firsts += [F.lit(seg), F.lit(at).cast("long")]
            at += ends.get(seg, 0)
        if at >= 1 << 62:
            raise StoreError("document numbers are used up; load the documents into a new store")
        doc = (F.col("doc") + F.create_map(*firsts)[F.col("seg")]).cast("long")
        info = self._seal(rows.select(doc.alias("doc"), "id", "title", "body"), replace=group, keep_numbers=True)
        self._remove_unreferenced()
        return MergeInfo("merged" if info.documents else "emptied", info.segment)

    def stats(self) -> Stats:
        dead = sum(self.dead[n] for n in self.sealed)
        live = sum(self._live_count(n) for n in self.sealed) + len(self.active)
        sealed = self._sealed("postings")
        lists = build_postings(self._active_rows()).select("seg", "field", "term")
        lists = lists if sealed is None else lists.unionByName(sealed.select("seg", "field", "term"))
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.path) for f in names)
        return Stats(len(self.sealed), len(self.active), live, dead, lists.distinct().count(), size)


__all__ = ["FIELDS", "Engine", "FlushInfo", "MergeInfo", "PutResult", "QueryError", "SearchResponse", "Stats", "StoreError"]
