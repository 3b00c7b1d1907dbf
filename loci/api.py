"""The engine behind one object: tables on shared storage and the 26 tools over them.

Every tool takes plain arguments for one request (as an agent would send
them) or a DataFrame of many, and returns DataFrames.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions.vectors import embed
from loci.operators import consolidate as cons
from loci.operators import facts as kg
from loci.operators import memory, routing, saving, search, taxonomy, topology
from loci.operators.store import DrawerTable, as_deletes, as_upserts, reembed
from loci.schemas import CLOSETS_GONE, ENTITIES, PALACES, PEOPLE, ROUTES, TRIPLES, conform
from loci.session import cut_lineage


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class _Table:
    """A small table kept as numbered Parquet versions; the newest finished one counts."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{versions[-1]:06d}")

    def write(self, rows: DataFrame) -> None:
        versions = self._versions()
        conform(rows, self.schema).write.mode("overwrite").parquet(f"{self.path}/v-{(versions[-1] if versions else 0) + 1:06d}")


class Memory:
    """A memory at a folder; ``now`` can be fixed to make results repeatable."""

    def __init__(self, spark: SparkSession, path: str, now=utc_now):
        self.spark, self.path, self._now = spark, path.rstrip("/"), now
        self.table = DrawerTable(spark, f"{self.path}/drawers").create()
        self._palaces = _Table(spark, f"{self.path}/palaces", PALACES)
        self._triples = _Table(spark, f"{self.path}/triples", TRIPLES)
        self._entities = _Table(spark, f"{self.path}/entities", ENTITIES)
        self._people = _Table(spark, f"{self.path}/people", PEOPLE)
        self._routes = _Table(spark, f"{self.path}/routes", ROUTES)
        self._closets_gone = _Table(spark, f"{self.path}/closets_gone", CLOSETS_GONE)

    # tables -------------------------------------------------------------------------------

    def drawers(self, palace: str | None = None) -> DataFrame:
        rows = self.table.current()
        return rows if palace is None else rows.where(F.col("palace") == palace)

    def palaces(self) -> DataFrame:
        return self._palaces.read()

    def triples(self) -> DataFrame:
        return self._triples.read()

    def entities(self) -> DataFrame:
        return self._entities.read()

    def people(self) -> DataFrame:
        return self._people.read()

    def _filed(self, palace: str) -> DataFrame:
        names = [F.coalesce(f"{lv}_name", lv).alias(lv) for lv in taxonomy.LEVELS]
        return self.drawers(palace).select("palace", *names).na.drop()

    # reading ------------------------------------------------------------------------------

    def status(self, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        return memory.status(self.drawers(palace))

    def list_wings(self, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        return memory.list_wings(self.drawers(palace))

    def list_rooms(self, wing: str | None = None, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        return memory.list_rooms(self.drawers(palace), wing)

    def get_taxonomy(self, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        return taxonomy.in_order(taxonomy.tree_lines(taxonomy.paths(self._edges(palace))))

    def _closets(self, palace: str) -> DataFrame:
        """Closets of drawers with the time something was filed there last."""
        closet = taxonomy.node_id(F.lit("clo"), F.col("palace"), F.coalesce("closet_name", "closet"))
        return self.drawers(palace).select("palace", closet.alias("closet_id"), "filed_at").groupBy("palace", "closet_id").agg(F.max("filed_at").alias("last"))

    def _edges(self, palace: str) -> DataFrame:
        """Taxonomy edges without closets deleted since something was filed there."""
        gone = self._closets_gone.read().join(self._closets(palace), ["palace", "closet_id"]).where("last <= deleted_at")
        return taxonomy.delete_closets(taxonomy.edges(self._filed(palace)), gone)

    def recall(self, wing=None, room=None, limit: int | None = None, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        return memory.recall(self.drawers(palace), wing, room, limit)

    def list_identities(self) -> DataFrame:
        return routing.list_palaces(self.palaces())

    def illuminate(self, context: str | None = None, wing: str | None = None, saves: DataFrame | None = None) -> DataFrame:
        ranked = None
        if context:
            asked = self.spark.createDataFrame([(context,)], "text string").withColumn("vector", embed(F.col("text")))
            ranked = routing.rank_palaces(asked, self.palaces(), limit=1)
        return memory.illuminate(self.palaces(), self.drawers(), ranked, wing, saves, self._now()[:10])

    # search -------------------------------------------------------------------------------

    def search(self, query: str | DataFrame, limit: int = fixed.SEARCH_K, wing=None, room=None, palace=None) -> tuple[DataFrame, DataFrame]:
        """Hits and routing diagnostics; remembers good routes and counts usage."""
        asked = query if isinstance(query, DataFrame) else self.spark.createDataFrame([(0, query, palace)], "query_id long, query string, palace string")
        log = self._routes.read()
        hits, routes = search.search_routed(asked, self.palaces(), self.drawers(), routing.remember(log), limit, wing=wing, room=room)
        now = self._now()
        new = routes.where("remember").select("query", F.col("searched_palace").alias("palace"), "source", F.lit(now).alias("ts"), F.xxhash64(F.lit(now), "query_id").alias("seq"))
        start = F.coalesce(log.agg(F.max("seq")).scalar(), F.lit(0))
        self._routes.write(log.unionByName(new.withColumn("seq", start + 1)))
        used = routes.select(F.col("searched_palace").alias("name"), F.lit(now).alias("ts"))
        self._palaces.write(routing.with_usage(self.palaces(), used))
        return hits, routes

    def check_duplicate(self, content: str, threshold: float = fixed.DUPLICATE_THRESHOLD, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        asked = self.spark.createDataFrame([(0, palace, content)], "query_id long, palace string, content string")
        return search.check_duplicates(asked, self.drawers(palace), threshold)

    # writing ------------------------------------------------------------------------------

    def save(self, requests: DataFrame | None = None, **one) -> DataFrame:
        """Answers per request; see ``saving.save_batch`` for the columns."""
        if requests is None:
            kinds = {"importance": "double", "tags": "array<string>"}
            cols = {"seq": 0, **{k: one.get(k) for k in ("palace", "content", "wing", "hall", "room", "closet", "topic", "importance", "project", "source", "tags")}}
            cols["importance"] = None if cols["importance"] is None else float(cols["importance"])
            schema = ", ".join(f"{k} {'long' if k == 'seq' else kinds.get(k, 'string')}" for k in cols)
            requests = self.spark.createDataFrame([tuple(cols.values())], schema)
        now = self._now()
        saved = saving.save_batch(requests, self.drawers(), self.palaces(), version=self.table.next_version(), now=now)
        # Answers and log are worked out against the state before this batch.
        answers, log = cut_lineage(saved.answers), cut_lineage(saved.log)
        decided, after = saving.save_facts(saved.filed, self.triples(), self.people(), now)
        named = kg.entities_of(kg.with_ids(decided.where("action = 'add'")), self.entities())
        self._entities.write(self.entities().unionByName(conform(named, ENTITIES)))
        self._triples.write(after)
        self._palaces.write(routing.upsert_palaces(self.palaces(), saved.palaces))
        self.table.append(log)
        return answers

    def _delete_closet(self, closet_id: str, palace: str) -> DataFrame:
        found = self._closets(palace).where(F.col("closet_id") == closet_id).select("palace", "closet_id", F.lit(self._now()).alias("deleted_at"))
        known = not found.isEmpty()
        if known:
            self._closets_gone.write(self._closets_gone.read().unionByName(found))
        answer = (palace, closet_id, known, "deleted" if known else None, None if known else f"Closet not found: {closet_id}")
        return self.spark.createDataFrame([answer], "palace string, drawer_id string, success boolean, status string, error string")

    def flush_pending_deletes(self, palace: str | None = None, max_deletes: int | None = None, dry_run: bool = False) -> DataFrame:
        """Delete the drawers queued for it; the rows found."""
        found = cut_lineage(cons.pending_deletes(self.drawers(), palace, max_deletes).select("palace", "point_id", "original_id"))
        if not dry_run:
            self.table.append(as_deletes(found, self.table.next_version()))
        return found

    def reembed(self) -> None:
        """Every vector built anew from its document, as one version."""
        self.table.append(as_upserts(reembed(self.table.current()).drop("op", "version", "seq"), self.table.next_version()))

    def palace_delete(self, name: str) -> None:
        """Take a palace off the list; its drawers stay."""
        self._palaces.write(self.palaces().where(F.col("name") != name))

    def delete_drawer(self, drawer_id: str, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        if drawer_id.startswith("clo_"):
            return self._delete_closet(drawer_id, palace)
        asked = self.spark.createDataFrame([(palace, drawer_id, "delete_drawer")], "palace string, drawer_id string, reason string")
        log, answers = cons.queue_deletes(self.drawers(), asked, self.table.next_version(), self._now())
        self.table.append(log)
        return answers

    def diary_write(self, entry: str, agent_name: str = "agent", topic: str = "general", session_id=None) -> DataFrame:
        rows = self.spark.createDataFrame([(agent_name, entry, topic, session_id)], "agent string, entry string, topic string, session_id string")
        filed = saving.diary_rows(rows, self._now())
        self.table.upsert(filed)
        return filed.select("original_id", "agent", "topic", "filed_at")

    def diary_read(self, agent_name: str = "agent", last_n: int | None = None, session_id=None) -> DataFrame:
        return memory.diary_read(self.drawers(fixed.SESSIONS_PALACE), agent_name, last_n, session_id)

    def diary_search(self, query: str, agent_name: str = "agent", limit: int = 5, topic=None, session_id=None) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return search.diary_search(asked, self.drawers(fixed.SESSIONS_PALACE), limit, agent=agent_name, topic=topic, session_id=session_id)

    def session_summary(self, facts: DataFrame, staging: str, project: str = "unknown") -> DataFrame:
        """Stage the facts worth keeping as a JSON file in a folder."""
        now = self._now()
        staged = saving.stage_facts(facts, self.palaces())
        saving.staged_batch(staged, project, now).coalesce(1).write.mode("append").json(staging)
        return staged.select("topic", "palace")

    def setup(self, name: str, about=None, preferences=(), rules=(), language: str = "English") -> None:
        log, palace = saving.setup(self.spark, name, about, preferences, rules, language, self._now())
        self.table.append(log.withColumn("version", F.lit(self.table.next_version()).cast("long")))
        self._palaces.write(routing.upsert_palaces(self.palaces(), palace))

    def palace_create(self, name: str, description="", keywords=(), scope="", wing_focus="", l0_body="") -> DataFrame:
        schema = "name string, description string, keywords array<string>, scope string, wing_focus string, l0_body string, is_default boolean"
        asked = self.spark.createDataFrame([(name, description, list(keywords), scope, wing_focus, l0_body, False)], schema)
        rows = routing.create_palace_rows(asked)
        good = rows.where(F.col("error").isNull()).drop("error").withColumn("vector", embed(F.col("scope")))
        self._palaces.write(routing.upsert_palaces(self.palaces(), good))
        return rows.select("name", "error")

    # facts --------------------------------------------------------------------------------

    def _facts(self, palace: str) -> tuple[DataFrame, DataFrame, Column]:
        """Triples and entities of a palace's namespace, and the namespace."""
        name = tx.namespace_id(F.lit(palace))
        own = F.col("namespace") == name
        return self.triples().where(own), self.entities().where(own), name

    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both", palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        triples, entities, name = self._facts(palace)
        wanted = self.spark.createDataFrame([(entity, as_of)], "entity string, as_of string").withColumn("namespace", name)
        return kg.by_time(kg.query_entities(triples, entities, wanted, direction))

    def kg_add(self, subject: str, predicate: str, object: str, valid_from=None, source_closet=None, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        rows = self.spark.createDataFrame(
            [(subject, predicate, object, valid_from, source_closet, 0)],
            "subject string, predicate string, object string, valid_from string, source_closet string, seq long",
        ).withColumn("namespace", tx.namespace_id(F.lit(palace)))
        new = kg.add_triples(self.triples(), rows, self._now())
        named = kg.entities_of(kg.with_ids(rows), self.entities())
        self._entities.write(self.entities().unionByName(conform(named, ENTITIES)))
        self._triples.write(self.triples().unionByName(new))
        key = kg.with_ids(rows).select(*kg.KEY)
        return self.triples().join(key, kg.KEY).where(F.col("valid_to").isNull()).select("id")

    def kg_invalidate(self, subject: str, predicate: str, object: str, ended=None, palace: str = fixed.DEFAULT_PALACE) -> None:
        ends = self.spark.createDataFrame([(subject, predicate, object, ended)], "subject string, predicate string, object string, ended string")
        ends = ends.withColumn("namespace", tx.namespace_id(F.lit(palace)))
        self._triples.write(kg.invalidate(self.triples(), ends, self._now()[:10]))

    def kg_timeline(self, entity: str | None = None, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        triples, entities, _ = self._facts(palace)
        return kg.timeline(triples, entities, entity)

    def kg_stats(self, palace: str = fixed.DEFAULT_PALACE) -> DataFrame:
        triples, entities, _ = self._facts(palace)
        return kg.stats(triples, entities)

    # review and navigation --------------------------------------------------------------------

    def audit(self, palace: str, limit: int | None = None, min_score=fixed.MIN_SCORE, min_gap=fixed.MIN_GAP) -> DataFrame:
        return cons.audit(self.drawers(), self.palaces(), palace, limit=limit, min_score=min_score, min_gap=min_gap)

    def consolidate(self, palace: str, limit: int | None = None, max_moves: int | None = None, min_score=fixed.MIN_SCORE, min_gap=fixed.MIN_GAP, dry_run=True) -> DataFrame:
        found, log = cons.consolidate(
            self.drawers(), self.palaces(), palace, version=self.table.next_version(), now=self._now(), dry_run=dry_run,
            max_moves=max_moves, limit=limit, min_score=min_score, min_gap=min_gap,
        )
        if dry_run:
            return found
        # The findings describe the state before the changes, so they are stored first.
        report = _Table(self.spark, f"{self.path}/reports/{palace}", found.drop("candidates").schema)
        report.write(found.drop("candidates"))
        self.table.append(log)
        return report.read()

    def traverse(self, start_room: str, max_hops: int = 2) -> DataFrame:
        return topology.traverse(topology.rooms(self.drawers()), start_room, max_hops)

    def find_tunnels(self, palace_a=None, palace_b=None) -> DataFrame:
        return topology.tunnels(topology.rooms(self.drawers()), palace_a, palace_b)

    def graph_stats(self) -> DataFrame:
        return topology.graph_stats(topology.rooms(self.drawers()), self.palaces())

    # upkeep -------------------------------------------------------------------------------

    def repair(self) -> None:
        """Write all current drawers again as one generation."""
        self.table.compact()
