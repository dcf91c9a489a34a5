"""CaseSession: the command surface as methods that return DataFrames (survey 2.15)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report as reports
from .operators import attack, correlate, entities, growth, lineage, query, rules, sigma, summaries
from .schema import SEVERITIES, severity_rank
from .sources import hives, ingest, records
from .store import SCHEMA_VERSION, TABLES, Store, now
from .tables import numbered, written

#: Parts of a case's summaries from which on they become one.
MOST_PARTS = 32
#: What events are numbered by, and the columns of stored findings.
EVENT_ORDER = ("provenance.source_file", "provenance.record_index", "timestamp")
STORED = tuple(c.split()[0] for c in TABLES["findings"].split(", "))


class CaseSession:
    def __init__(self, spark: SparkSession, folder: str, case_id: str) -> None:
        self.spark, self.store, self.case_id = spark, Store(spark, folder), case_id

    def create(self, name: str = "") -> CaseSession:
        self.store.create_case(self.case_id, name)
        return self

    def migrate(self) -> int:
        """Brings the case to this engine's layout, and returns the one it had. Findings that lack an explanation, or a part of it, are explained anew."""
        was = self.store.version(self.case_id)
        if was is None:
            raise KeyError(f"no case {self.case_id}")
        old = self.store.table("findings", self.case_id)
        if was < SCHEMA_VERSION or old.filter("rule_version IS NULL").head(1):
            have = old.select(*[c for c in STORED if c not in rules.EXPLAINED])
            told = rules.explained(written(have), self.all_events()).withColumn("case_id", F.lit(self.case_id))
            self.store.replace("findings", told.select(*STORED))
            row = self.store.table("cases", self.case_id).first()
            self.store.replace("cases", self.spark.createDataFrame([(row["case_id"], row["name"], row["created"], SCHEMA_VERSION)], TABLES["cases"]))
            self._audit("migrate", was=was)
        return was

    def _audit(self, command: str, **arguments: object) -> None:
        self.store.add("audit", [(self.case_id, now(), command, json.dumps({k: v for k, v in arguments.items() if v is not None}, default=str, sort_keys=True))])

    def _numbered(self, df: DataFrame, column: str, table: str, *order: str) -> DataFrame:
        """Ids after those in the table, in an order. One writer a case: two at once would hand out the same ids."""
        return written(numbered(df, column, [F.col(c) for c in order], self.store.next_id(table, column, self.case_id)))

    def ingest(self, path: str, recursive: bool = True, source: str | None = None, parse: bool = True, dedupe: bool = False, default_host: str | None = None) -> dict[str, object]:
        """Registers files (once each by content) and appends their events; dedupe skips the events of files already there."""
        files = ingest.evidence(self.spark, path, recursive)
        facts = written(files.drop("content"))
        known = self._register(facts)
        out: dict[str, object] = {"registered": facts.count(), "events": 0, "warnings": []}
        if parse:
            todo = written(facts.join(known, "sha256", "left_anti")) if dedupe else facts
            events, warnings = ingest.scan(self.spark, todo, default_host=default_host, kind=source)
            out["events"] = self._append(events)
            out["warnings"] = [f"{r['path']}: {r['warning']}" for r in warnings.limit(25).collect()]
        self._audit("ingest", path=path, source=source)
        return out

    def _register(self, facts: DataFrame) -> DataFrame:
        """Adds files that the case doesn't know by content; gives the hashes that it knew."""
        known = written(self.store.table("evidence", self.case_id).select("sha256"))
        fresh = facts.dropDuplicates(["sha256"]).join(known, "sha256", "left_anti")
        new = self._numbered(fresh, "evidence_id", "evidence", "path").withColumn("case_id", F.lit(self.case_id))
        self.store.append("evidence", new.select("case_id", "evidence_id", "path", "size", "sha256", "md5", "kind"))
        return known

    def ingest_batch(self, files: DataFrame, stream: str, batch: int, after: Callable[[str], None] = lambda _: None) -> None:
        """The files of a stream's batch (evidence() rows): run again, it adds what is missing and nothing else. See streaming.intake."""
        facts = written(files.drop("content"))
        self._register(facts)
        after("registered")
        events, _ = ingest.scan(self.spark, facts)
        noted = self.store.table("batches", self.case_id).filter((F.col("stream") == stream) & (F.col("batch") == batch)).first()
        first = noted["first_id"] if noted else self.store.next_id("events", "id", self.case_id)
        new = self._with_evidence(written(numbered(events.drop("id"), "id", [F.col(c) for c in EVENT_ORDER], first)))
        if noted is None:
            self.store.add("batches", [(self.case_id, stream, batch, first, new.count())])
        after("noted")
        there = self.store.table("events", self.case_id).filter(F.col("id") >= first).select("id")
        self.store.append("events", new.join(written(there), "id", "left_anti").withColumn("case_id", F.lit(self.case_id)))
        after("appended")

    def load_jsonl(self, path: str) -> dict[str, int]:
        good, bad = records.load_jsonl(self.spark, path)
        out = {"loaded": self._append(good), "rejected": bad.count()}
        self._audit("ingest", fixture=path)
        return out

    def _append(self, events: DataFrame) -> int:
        new = self._numbered(events.drop("id"), "id", "events", *EVENT_ORDER)
        self.store.append("events", self._with_evidence(new).withColumn("case_id", F.lit(self.case_id)))
        return new.count()

    def _with_evidence(self, events: DataFrame) -> DataFrame:
        """events with the ids of the files that they come from."""
        held = self.store.table("evidence", self.case_id).select(F.col("sha256").alias("_s"), F.col("evidence_id").alias("_e"))
        return events.join(held, F.col("provenance.source_sha256") == F.col("_s"), "left").withColumn("evidence_id", F.coalesce("_e", "evidence_id")).drop("_s", "_e")

    def all_events(self) -> DataFrame:
        return self.store.table("events", self.case_id).drop("case_id")

    def events(self, limit: int = query.EVENT_LIMIT, offset: int = 0, **where: str) -> DataFrame:
        return query.page(query.events_where(self.all_events(), **where), limit, offset)

    def events_after(self, after: tuple[str | None, int] | None = None, limit: int = query.EVENT_LIMIT, **where: str) -> DataFrame:
        """The page behind the event (timestamp, id); the first page without one."""
        return query.page_after(query.events_where(self.all_events(), **where), after, limit)

    def _parts(self) -> tuple[list[str], int]:
        """The parts that count, and the last event id in them: one row for each part that was noted, at most MOST_PARTS since the last merging."""
        noted = self.store.table("parts", self.case_id).collect()
        gone = {m for r in noted for m in r["merged"]}
        return [r["part"] for r in noted if r["part"] not in gone], max((r["upto"] for r in noted), default=0)

    def summarize(self) -> int:
        """Makes a part of the events that no part has, and gives the last event id in parts.

        A part counts once it is noted, after its rows were written; so one that was cut off is made again. Parts
        past MOST_PARTS become one.
        """
        live, upto = self._parts()
        last = self.store.settled(self.case_id)
        if last <= upto:
            return upto
        new = self.all_events().filter(F.col("id").between(upto + 1, last))
        made = {"coverage_parts": summaries.coverage_part(new), "entity_parts": summaries.entity_part(new)}
        merged = []
        if len(live) >= MOST_PARTS:
            merged = live
            for table, merge in (("coverage_parts", summaries.merged_coverage), ("entity_parts", summaries.merged_entities)):
                old = self.store.table(table, self.case_id).filter(F.col("part").isin(live)).drop("case_id", "part")
                made[table] = merge(old.unionByName(made[table]))
        part = uuid.uuid4().hex
        for table, rows in made.items():
            self.store.append(table, rows.withColumns({"case_id": F.lit(self.case_id), "part": F.lit(part)}), "part")
        self.store.add("parts", [(self.case_id, part, last, merged)])
        return last

    def _with_parts(self, table: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The parts of a table, and one of the events that none has."""
        live, upto = self._parts()
        held = self.store.table(table, self.case_id).filter(F.col("part").isin(live)).drop("case_id", "part")
        return held.unionByName(make(self.all_events().filter(F.col("id") > upto)))

    def quick_coverage(self) -> DataFrame:
        """coverage() from parts: only events that came after the last summarize() are read."""
        return summaries.coverage(self._with_parts("coverage_parts", summaries.coverage_part))

    def quick_entities(self, kind: str | None = None) -> DataFrame:
        """entities() from parts."""
        return summaries.entities(self._with_parts("entity_parts", summaries.entity_part), kind).orderBy("type", "value")

    def grown_clusters(self) -> DataFrame:
        """(id, root) of all events, from the labels that are stored and the events since then; new labels are stored.

        Labels count once their growth is noted. Events behind a stream's batch that isn't there whole are labelled
        for this answer alone.
        """
        noted = self.store.table("growths", self.case_id).orderBy(F.desc("upto")).first()
        part, upto = (noted["part"], noted["upto"]) if noted else ("", 0)
        mine = lambda table: self.store.table(table, self.case_id).filter(F.col("part") == part).drop("case_id", "part")
        labels, hubs = mine("labels"), mine("hubs")
        every, last = self.all_events(), self.store.settled(self.case_id)
        if last > upto:
            labels, hubs = growth.grow(every.filter(F.col("id") <= upto), labels, hubs, every.filter(F.col("id").between(upto + 1, last)))
            fresh = uuid.uuid4().hex
            for table, rows in (("labels", labels), ("hubs", hubs)):
                self.store.append(table, rows.withColumns({"case_id": F.lit(self.case_id), "part": F.lit(fresh)}), "part")
            self.store.add("growths", [(self.case_id, fresh, last)])
        ahead = every.filter(F.col("id") > max(upto, last))
        if ahead.head(1):
            labels, _ = growth.grow(every.filter(F.col("id") <= max(upto, last)), labels, hubs, ahead)
        return labels

    def timeline(self, start: str | None = None, end: str | None = None, source: str | None = None, limit: int = query.TIMELINE_LIMIT) -> DataFrame:
        return query.page(query.timeline(self.all_events(), start, end, source), limit)

    def coverage(self) -> DataFrame:
        return query.coverage(self.all_events())

    def lineage(self, pid: int | None = None, image: str | None = None) -> DataFrame:
        """Instances with their parents; of one pid, or of images with a name in them, these and all that is below them."""
        if pid is not None and image is not None:
            raise ValueError("either a pid or an image")
        inst = written(lineage.instances(self.all_events()))
        links = written(lineage.parents(inst))
        out = inst.join(links.drop("start"), "first_id")
        if pid is None and image is None:
            return out
        heads = inst.filter(F.col("pid") == pid if pid is not None else F.col("img").contains(image.lower())).select("first_id")
        return out.join(lineage.focused(inst, links, heads), "first_id", "left_semi")

    def process_tree(self, pid: int | None = None, image: str | None = None, lines: int = 1000) -> list[str]:
        """The forest as indented lines; of one pid or image, the trees from there down."""
        inst = written(lineage.instances(self.all_events()))
        links = written(lineage.parents(inst))
        rows = lineage.tree_rows(inst, links)
        if pid is not None or image is not None:
            rows = rows.join(self.lineage(pid, image).select(F.col("first_id").alias("id")), "id", "left_semi")
        return [r["line"] for r in rows.orderBy("place").limit(lines).collect()]

    def entities(self, kind: str | None = None) -> DataFrame:
        return entities.entities(self.all_events(), kind).orderBy("type", "value")

    def detect(self, ids: list[str] | None = None, severity: str | None = None, save: bool = True) -> DataFrame:
        """severity 'high' is just that, 'high+' that and worse. Findings are appended each time."""
        found = rules.detect(self.all_events(), ids)
        if severity is not None:
            rank = SEVERITIES.index(severity.rstrip("+").lower())
            have = severity_rank(F.col("severity"))
            found = found.filter(have >= rank if severity.endswith("+") else have == rank)
        if not save:
            return found
        return self._save(found)

    def _save(self, found: DataFrame, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
        taken = self.store.table("findings", self.case_id).count()
        told = rules.explained(rules.numbered(found, taken), self.all_events(), extra)
        self.store.append("findings", told.withColumn("case_id", F.lit(self.case_id)).select(*STORED))
        uid = F.substring_index("uid", "-", -1).cast("long")
        return self.findings().filter(uid > taken)

    def findings(self, rule: str | None = None, severity: str | None = None) -> DataFrame:
        out = self.store.table("findings", self.case_id).drop("case_id")
        if rule is not None:
            out = out.filter(F.col("rule_id") == rule)
        return out if severity is None else out.filter(F.col("severity") == severity)

    def rules(self) -> DataFrame:
        return rules.catalog(self.spark).orderBy("rule_id")

    def sigma(self, rule: sigma.Rule | str | list[sigma.Rule | str] | None = None) -> DataFrame:
        """Findings of one rule or of many, from one scan of the events; without a rule, of the samples."""
        given = sigma.samples() if rule is None else rule if isinstance(rule, list) else [rule]
        every = [sigma.load_file(r) if isinstance(r, str) else r for r in given]
        out = sigma.run_all(self.all_events(), every)
        found = out.select("rule_id", "severity", "confidence", "event_id", F.lit("condition satisfied").alias("detail"), F.array("event_id").alias("evidence"))
        return self._save(found, {r.id: (r.title, sigma.techniques(r)) for r in every})

    def attack_coverage(self) -> DataFrame:
        return attack.coverage(self.findings())

    def techniques(self) -> DataFrame:
        return attack.techniques(self.spark)

    def linkages(self) -> DataFrame:
        return correlate.linkages(self.all_events()).orderBy("event_a", "event_b", "kind")

    def link_classes(self) -> DataFrame:
        """Links by class, with their numbers: what to ask of a case in which many events share a path."""
        return correlate.link_classes(written(correlate.prepared(self.all_events())))

    def cluster_links(self, n: int = 0) -> DataFrame:
        """The links of one cluster, pair by pair."""
        own = self.all_events()
        members = written(correlate.clusters(own))
        return correlate.cluster_links(own, members, self._root(own, members, n)).orderBy("event_a", "event_b", "kind")

    def _root(self, own: DataFrame, members: DataFrame, n: int) -> int:
        top = correlate.ranked(own, self.findings(), members).filter(F.col("cluster_id") == n).first()
        if top is None:
            raise KeyError(f"no cluster {n}")
        return top["root"]

    def clusters(self) -> DataFrame:
        own = self.all_events()
        return correlate.ranked(own, self.findings(), correlate.clusters(own))

    def narrative(self, n: int = 0) -> dict[str, object]:
        own = self.all_events()
        members = written(correlate.clusters(own))
        return reports.narrative(own, self.findings(), members, self._root(own, members, n))

    def report(self, folder: str, formats: tuple[str, ...] = ("json",)) -> list[str]:
        built = reports.build(self.case_id, self.all_events(), self.findings(), self.store.table("evidence", self.case_id), self.notes(), now())
        makers = {"json": lambda: reports.to_json(built), "md": lambda: reports.to_markdown(built), "html": lambda: reports.to_html(built), "csv": lambda: reports.to_csv(self.findings())}
        names = tuple(makers) if "all" in formats else formats
        Path(folder).mkdir(parents=True, exist_ok=True)
        out = []
        for f in names:
            path = Path(folder, f"{self.case_id}.{f}")
            path.write_text(makers[f](), encoding="utf-8")
            out.append(str(path))
        return out

    def add_note(self, text: str, author: str = "") -> None:
        self.store.add("notes", [(self.case_id, now(), author, text)])

    def notes(self) -> DataFrame:
        return self.store.table("notes", self.case_id).drop("case_id")

    def audit(self, limit: int = 50) -> DataFrame:
        return self.store.table("audit", self.case_id).drop("case_id").orderBy(F.desc("at")).limit(limit)

    def export(self, what: str, path: str) -> None:
        """JSON lines, in order of time and id for events, of uid for findings."""
        if what == "events":
            lines = records.export_lines(query.order(self.all_events()), "event", tuple(c for c in self.all_events().columns))
        else:
            lines = records.export_lines(self.findings().orderBy("uid"), "finding", tuple(self.findings().columns))
        lines.select("value").write.mode("overwrite").text(path)

    def read_hive(self, path: str, key: str) -> dict[str, object]:
        """One key of one hive: its last write, subkeys and values. Only its path is gone down."""
        values = [r.asDict() for r in hives.hives(self.spark, path).filter(F.col("lkey") == key.replace("/", "\\").strip("\\").lower()).collect()]
        if not values:
            raise KeyError(key)
        below = [r["key"].rpartition("\\")[2] for r in hives.subkeys(self.spark, path, key).collect()]
        return {"path": key, "last_write": values[0]["last_write"], "subkeys": sorted(below, key=str.lower), "values": [(r["value"], r["kind"], r["data"]) for r in values if r["value"] is not None]}
