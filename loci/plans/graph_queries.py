"""Queries on the fact graph, the room topology and the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.operators import facts as kg
from loci.operators import taxonomy, topology
from loci.plans import workload as w
from loci.plans.catalog import query
from loci.plans.workload import Tables
from loci.schemas import TRIPLES, conform
from loci.session import cut_lineage, kept

NOW = "2026-01-01"
_F = f"WITH {w.FACTS_SQL}"


def _rows(t: Tables) -> DataFrame:
    return kg.with_ids(w.facts(t))


def _triples(t: Tables) -> DataFrame:
    """Every fact as a stored triple (no duplicates removed)."""
    rows = _rows(t).withColumn("id", kg.triple_id(F.lit(NOW))).withColumn("confidence", F.lit(1.0))
    return conform(rows, TRIPLES)


def _entities(t: Tables) -> DataFrame:
    """Entities of the facts, worked out once for all that look names up."""
    return cut_lineage(kg.entities_of(_rows(t)))


# --- writing -------------------------------------------------------------------------------

_ADDED = _F + """,
opened AS (SELECT subject_id, pred, object_id, min(seq) FILTER (valid_to IS NULL) AS first_open FROM facts GROUP BY ALL),
added AS (SELECT f.* FROM facts f JOIN opened USING (subject_id, pred, object_id) WHERE first_open IS NULL OR seq <= first_open)
"""


@query("kg_dedup_open_triples", _ADDED + """
SELECT subject_id, pred AS predicate, object_id, valid_from, valid_to,
       't_' || subject_id || '_' || pred || '_' || object_id || '_'
         || left(md5('default:' || subject_id || ':' || pred || ':' || object_id || ':' || valid_from || ':2026-01-01#' || seq), 12) AS id
FROM added
""")
def kg_dedup(t):
    """The triples a batch adds: an open fact blocks its repeats."""
    none = t.spark.createDataFrame([], TRIPLES)
    return kg.add_triples(none, w.facts(t), NOW).select("subject_id", "predicate", "object_id", "valid_from", "valid_to", "id")


@query("kg_add_to_existing", _F + """,
old AS (SELECT * FROM facts WHERE valid_to IS NULL AND valid_from < '1996-01-01'),
new AS (SELECT * FROM facts WHERE valid_from >= '1996-01-01'),
opened AS (SELECT subject_id, pred, object_id, min(seq) FILTER (valid_to IS NULL) AS first_open FROM new GROUP BY ALL)
SELECT f.subject_id, f.pred AS predicate, f.object_id, f.valid_from, f.valid_to FROM new f JOIN opened USING (subject_id, pred, object_id)
WHERE (first_open IS NULL OR seq <= first_open)
  AND NOT EXISTS (SELECT 1 FROM old o WHERE o.subject_id = f.subject_id AND o.pred = f.pred AND o.object_id = f.object_id)
""")
def kg_add_existing(t):
    """Later facts added to the earlier open ones."""
    old = _triples(t).where(F.col("valid_to").isNull() & (F.col("valid_from") < "1996-01-01"))
    new = w.facts(t).where(F.col("valid_from") >= "1996-01-01")
    return kg.add_triples(old, new, NOW).select("subject_id", "predicate", "object_id", "valid_from", "valid_to")


@query("kg_entities", _F + """,
sides AS (SELECT subject_id AS id, subject AS name, seq, 0 AS side FROM facts UNION ALL SELECT object_id, object, seq, 1 FROM facts)
SELECT id, arg_min(name, (seq, side)) AS name, 'unknown' AS type FROM sides GROUP BY id
""")
def kg_entities(t):
    """Entities that facts bring along."""
    return kg.entities_of(_rows(t)).select("id", "name", "type")


@query("kg_entity_upsert", """
SELECT replace(lower(c_name), ' ', '_') AS id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'person' ELSE 'unknown' END AS type FROM customer
""")
def kg_entity_upsert(t):
    """Customers as entities; every second nation's are overwritten as persons."""
    from loci.schemas import ENTITIES

    base = t.customer.select(
        F.lit("default").alias("namespace"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("properties"), F.col("c_custkey").alias("seq"), "c_nationkey",
    )
    first = kg.add_entities(t.spark.createDataFrame([], ENTITIES), base.drop("c_nationkey"))
    again = base.where(F.col("c_nationkey") % 2 == 0).withColumn("type", F.lit("person")).drop("c_nationkey")
    return kg.add_entities(first, again).select("id", "name", "type")


@query("kg_invalidate", _F + """,
ends AS (SELECT subject_id, pred, object_id, arg_min(coalesce(valid_to, '2026-01-01'), seq) AS ended FROM facts WHERE valid_from > '1997-01-01' GROUP BY ALL)
SELECT f.subject_id, f.pred AS predicate, f.object_id, f.valid_from, coalesce(f.valid_to, e.ended) AS valid_to
FROM facts f LEFT JOIN ends e USING (subject_id, pred, object_id)
""")
def kg_invalidate(t):
    """Open facts closed by later mentions of the same fact."""
    ends = w.facts(t).where(F.col("valid_from") > "1997-01-01").withColumn("ended", F.col("valid_to"))
    return kg.invalidate(_triples(t), ends, NOW).select("subject_id", "predicate", "object_id", "valid_from", "valid_to")


@query("kg_last_closed", _F + """
SELECT subject_id, pred AS predicate, object_id, max(valid_to) AS last_valid_to FROM facts WHERE valid_to IS NOT NULL GROUP BY ALL
""")
def kg_last_closed(t):
    return kg.last_closed(_triples(t)).select("subject_id", "predicate", "object_id", "last_valid_to")


_RECONCILE = f"""
WITH RECURSIVE {w.FACTS_SQL},
coarse AS (SELECT seq, subject_id, pred, object, valid_from, valid_to AS ended,
                  row_number() OVER (PARTITION BY subject_id, pred, object ORDER BY seq) AS n
           FROM (SELECT seq, 'nation#' || (CAST(substr(subject, 10) AS BIGINT) % 25) AS subject_id, pred, object, valid_from, valid_to FROM facts)),
fold AS (
  SELECT subject_id, pred, object, CAST(0 AS BIGINT) AS n, false AS active, CAST(NULL AS VARCHAR) AS since, CAST(NULL AS VARCHAR) AS last_end,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS reason
  FROM coarse GROUP BY ALL
  UNION ALL
  SELECT c.subject_id, c.pred, c.object, c.n,
    CASE WHEN c.ended IS NULL THEN f.active OR f.last_end IS NULL OR c.valid_from >= f.last_end
         ELSE f.active AND f.since IS NOT NULL AND c.ended < f.since END,
    CASE WHEN c.ended IS NULL THEN CASE WHEN f.active THEN f.since WHEN f.last_end IS NULL OR c.valid_from >= f.last_end THEN c.valid_from END
         WHEN f.active AND f.since IS NOT NULL AND c.ended < f.since THEN f.since END,
    CASE WHEN c.ended IS NOT NULL AND f.active AND NOT (f.since IS NOT NULL AND c.ended < f.since) THEN greatest(c.ended, coalesce(f.last_end, c.ended)) ELSE f.last_end END,
    c.seq,
    CASE WHEN c.ended IS NOT NULL THEN CASE WHEN f.active AND NOT (f.since IS NOT NULL AND c.ended < f.since) THEN 'invalidate' ELSE 'skip' END
         WHEN f.last_end IS NOT NULL AND c.valid_from < f.last_end THEN 'skip' ELSE 'add' END,
    CASE WHEN c.ended IS NOT NULL THEN CASE WHEN NOT f.active THEN 'no_active_fact_to_invalidate'
              WHEN f.since IS NOT NULL AND c.ended < f.since THEN 'temporal_conflict_end_before_start' END
         WHEN f.last_end IS NOT NULL AND c.valid_from < f.last_end THEN 'temporal_conflict_start_before_previous_end' END
  FROM fold f JOIN coarse c ON c.subject_id = f.subject_id AND c.pred = f.pred AND c.object = f.object AND c.n = f.n + 1)
"""


def _coarse(t: Tables) -> DataFrame:
    """Facts of nations instead of customers, so that keys repeat."""
    number = F.substring("subject", 10, 20).cast("bigint")
    return w.facts(t).withColumns({
        "subject": F.concat(F.lit("nation#"), (number % 25).cast("string")), "ended": F.col("valid_to"), "confidence": F.lit(0.9),
    })


@query("kg_reconcile_action", _RECONCILE + "SELECT seq, action, reason FROM fold WHERE n > 0")
def kg_reconcile(t):
    """What becomes of each extracted fact, in order."""
    none = t.spark.createDataFrame([], TRIPLES)
    return kg.reconcile(none, _coarse(t)).select("seq", "action", "reason")


@query("kg_reconcile_summary", _RECONCILE + "SELECT pred AS predicate, action, reason, count(*) AS n FROM fold WHERE n > 0 GROUP BY ALL")
def kg_reconcile_summary(t):
    none = t.spark.createDataFrame([], TRIPLES)
    return kg.reconcile(none, _coarse(t)).groupBy("predicate", "action", "reason").agg(F.count("*").alias("n"))


# --- reading -------------------------------------------------------------------------------


@query("kg_asof", _F + """,
wanted AS (SELECT subject AS entity, subject_id, max(valid_from) AS as_of FROM facts GROUP BY ALL)
SELECT entity, as_of, pred AS predicate, object, valid_from, valid_to FROM facts JOIN wanted USING (subject_id)
WHERE valid_from <= as_of AND (valid_to IS NULL OR valid_to >= as_of)
""")
def kg_asof(t):
    """What held for every customer on the day of its last order."""
    wanted = w.facts(t).groupBy(F.col("subject").alias("entity")).agg(F.max("valid_from").alias("as_of"))
    found = kg.query_entities(_triples(t), _entities(t), wanted)
    return found.select("entity", "as_of", "predicate", "object", "valid_from", "valid_to")


@query("kg_direction_both", _F + """,
both_ways AS (SELECT subject AS entity, 'outgoing' AS direction, valid_to FROM facts UNION ALL SELECT object, 'incoming', valid_to FROM facts)
SELECT entity, direction, count(*) AS facts, count(*) FILTER (valid_to IS NULL) AS active FROM both_ways GROUP BY ALL
""")
def kg_direction_both(t):
    """Outgoing and incoming facts of every entity."""
    names = _entities(t)
    wanted = names.select(F.col("name").alias("entity"))
    found = kg.query_entities(_triples(t), names, wanted, "both")
    return found.groupBy("entity", "direction").agg(F.count("*").alias("facts"), F.count_if("active_now").alias("active"))


@query("kg_relationship", _F + """
SELECT valid_from, valid_to, subject, pred AS predicate, object, valid_to IS NULL AS active_now, true AS active_as_of
FROM facts WHERE pred = '4-not_specified' AND valid_from <= '1997-06-30' AND (valid_to IS NULL OR valid_to >= '1997-06-30')
""")
def kg_relationship(t):
    """Facts of one kind that held on a day."""
    return kg.query_relationship(_triples(t), _entities(t), "4-NOT SPECIFIED", "1997-06-30")


_TID = """'t_' || subject_id || '_' || pred || '_' || object_id || '_'
  || left(md5('default:' || subject_id || ':' || pred || ':' || object_id || ':' || valid_from || ':2026-01-01'), 12)"""


@query("kg_timeline", _F + f"""
SELECT valid_from, valid_to, subject, pred AS predicate, object, valid_to IS NULL AS active_now
FROM facts ORDER BY valid_from, pred, subject_id, object_id, {_TID}
""")
def kg_timeline(t):
    """All facts in time."""
    # The facts are put together once, for the entities, the names and the listing.
    rows = kg.with_ids(kept(w.facts(t)))
    triples = rows.select(*kg.KEY, "valid_from", "valid_to")
    return kg.timeline(triples, kept(kg.entities_of(rows)), ident=kg.triple_id(F.lit(NOW)))


@query("kg_timeline_entity", _F + f"""
SELECT valid_from, valid_to, subject, pred AS predicate, object, valid_to IS NULL AS active_now
FROM facts WHERE object = 'Brand#12' ORDER BY valid_from, pred, subject_id, object_id, {_TID}
""")
def kg_timeline_entity(t):
    """All facts about one brand, in time."""
    return kg.timeline(_triples(t), _entities(t), "Brand#12")


@query("kg_stats", _F + """
SELECT (SELECT count(*) FROM (SELECT subject_id FROM facts UNION SELECT object_id FROM facts)) AS entities, count(*) AS triples,
       count(*) FILTER (valid_to IS NULL) AS current_facts, count(*) FILTER (valid_to IS NOT NULL) AS expired_facts,
       count(DISTINCT pred) AS relationship_types
FROM facts
""")
def kg_stats(t):
    return kg.stats(_triples(t), _entities(t))


@query("kg_relationship_types", _F + "SELECT DISTINCT pred AS predicate FROM facts")
def kg_relationship_types(t):
    return kg.relationship_types(_triples(t))


@query("kg_namespace", r"""
SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]+$', ''), '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS raw_ns,
       coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]+$', ''), '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'default') AS namespace
FROM pages
""".replace("lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]+$', ''), '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS raw_ns,\n       ", "", 1))
def kg_namespace(t):
    """Fact namespaces of pages, from their last path part."""
    from loci.functions import text as tx

    return t.pages.select("page_id", tx.namespace_id(F.col("url")).alias("namespace"))


# --- topology ------------------------------------------------------------------------------

_ROOMS = f"WITH {w.DRAWERS_SQL}, rooms AS (SELECT palace, room AS slug, count(*) AS n FROM drawers GROUP BY ALL)\n"
_SUPPLY = "WITH RECURSIVE member AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS palace, p_brand || '/' || p_size AS slug FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _rooms(t: Tables) -> DataFrame:
    return topology.rooms(w.drawers(t))


def _supply(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string")).alias("slug"))
    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("palace"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return rows.groupBy("palace", "slug").agg(F.count("*").alias("drawer_count"))


@query("rooms", _ROOMS + "SELECT palace, slug, n AS drawer_count FROM rooms")
def rooms(t):
    return _rooms(t)


@query("tunnels_all", _ROOMS + """
SELECT a.slug AS tunnel, a.palace AS palace_a, b.palace AS palace_b FROM rooms a JOIN rooms b ON a.slug = b.slug AND a.palace < b.palace
""")
def tunnels_all(t):
    return topology.tunnels(_rooms(t))


@query("tunnels_one", _ROOMS + """
SELECT a.slug AS tunnel, a.palace AS palace_a, b.palace AS palace_b FROM rooms a JOIN rooms b ON a.slug = b.slug AND a.palace = 'de' AND b.palace <> 'de'
""")
def tunnels_one(t):
    return topology.tunnels(_rooms(t), "de")


@query("tunnels_pair", _ROOMS + """
SELECT a.slug AS tunnel, a.palace AS palace_a, b.palace AS palace_b FROM rooms a JOIN rooms b ON a.slug = b.slug AND a.palace = 'en' AND b.palace = 'fr'
""")
def tunnels_pair(t):
    return topology.tunnels(_rooms(t), "en", "fr")


@query("shared_rooms", _SUPPLY.replace("RECURSIVE ", "") + """
SELECT slug, count(*) AS palaces, count(*) * (count(*) - 1) // 2 AS tunnels FROM member GROUP BY slug HAVING count(*) > 1
""")
def shared_rooms(t):
    """Rooms in several palaces with their number of tunnels."""
    return topology.shared_rooms(_supply(t))


@query("bfs_hops", _SUPPLY + """,
walk AS (
  SELECT 'Brand#1/1' AS slug, 0 AS hop WHERE EXISTS (SELECT 1 FROM member WHERE slug = 'Brand#1/1')
  UNION
  SELECT b.slug, w.hop + 1 FROM walk w JOIN member a ON a.slug = w.slug JOIN member b ON b.palace = a.palace WHERE w.hop < 2),
near AS (SELECT slug, min(hop) AS distance FROM walk GROUP BY slug),
first_pal AS (SELECT a.palace, min(n.distance) AS d FROM near n JOIN member a USING (slug) GROUP BY a.palace)
SELECT n.slug, n.distance, min(m.palace) AS palace FROM near n JOIN member m ON m.slug = n.slug JOIN first_pal p ON p.palace = m.palace AND p.d = n.distance - 1
WHERE n.distance > 0 GROUP BY ALL
""")
def bfs_hops(t):
    """Rooms within two hops of a room, with the palace they were reached through."""
    return topology.traverse(_supply(t), "Brand#1/1", 2)


@query("graph_stats", _ROOMS + """
SELECT count(DISTINCT palace) AS palaces, count(*) AS rooms, CAST(sum(n) AS BIGINT) AS drawers,
       (SELECT count(*) FROM (SELECT slug FROM rooms GROUP BY slug HAVING count(*) > 1)) AS tunnels FROM rooms
""")
def graph_stats(t):
    return topology.graph_stats(_rooms(t))


@query("rooms_per_palace", _ROOMS + "SELECT palace, count(*) AS room_count FROM rooms GROUP BY palace")
def rooms_per_palace(t):
    return topology.rooms_per_palace(_rooms(t))


# --- taxonomy ------------------------------------------------------------------------------

_TAX = """
WITH filed AS (
  SELECT 'all' AS palace, r_name AS wing, n_name AS hall, c_mktsegment AS room, c_name AS closet
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
edge AS (SELECT DISTINCT palace, 'wing' AS parent_level, wing AS parent, hall AS child FROM filed
         UNION SELECT palace, 'hall', hall, room FROM filed UNION SELECT palace, 'room', room, closet FROM filed)
"""


def _filed(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.lit("all").alias("palace"), F.col("r_name").alias("wing"), F.col("n_name").alias("hall"),
        F.col("c_mktsegment").alias("room"), F.col("c_name").alias("closet"),
    )


@query("taxonomy_sizes", _TAX + """
SELECT level, name, count(*) AS size, prefix || '_' || left(md5(prefix || chr(1) || 'all' || chr(1) || name), 12) AS id
FROM (SELECT 'wing' AS level, 'win' AS prefix, wing AS name FROM filed UNION ALL SELECT 'hall', 'hal', hall FROM filed
      UNION ALL SELECT 'room', 'roo', room FROM filed UNION ALL SELECT 'closet', 'clo', closet FROM filed) GROUP BY ALL
""")
def taxonomy_sizes(t):
    """Nodes of the tree with the rows filed under them."""
    return taxonomy.nodes(_filed(t)).drop("palace")


@query("taxonomy_edges", _TAX + "SELECT parent_level, parent, child FROM edge")
def taxonomy_edges(t):
    return taxonomy.edges(_filed(t)).drop("palace")


@query("taxonomy_tree_paths", _TAX + """
SELECT a.parent AS wing, a.child AS hall, b.child AS room, c.child AS closet
FROM edge a JOIN edge b ON a.child = b.parent AND b.parent_level = 'hall' JOIN edge c ON b.child = c.parent AND c.parent_level = 'room'
WHERE a.parent_level = 'wing'
""")
def taxonomy_tree_paths(t):
    """Complete paths along edges by name (shared rooms mix their closets)."""
    return taxonomy.paths(taxonomy.edges(_filed(t)), "all").drop("palace")


@query("taxonomy_lines", _TAX + """
SELECT DISTINCT 0 AS depth, wing, NULL AS hall, NULL AS room, NULL AS closet, wing AS line FROM filed
UNION ALL SELECT DISTINCT 1, wing, hall, NULL, NULL, '  ' || hall FROM filed
UNION ALL SELECT DISTINCT 2, wing, hall, room, NULL, '    ' || room FROM filed
UNION ALL SELECT DISTINCT 3, wing, hall, room, closet, '      ' || closet FROM filed
""")
def taxonomy_lines(t):
    """The tree as indented lines."""
    return taxonomy.in_order(taxonomy.tree_lines(taxonomy.strict_paths(_filed(t)))).drop("palace")


@query("taxonomy_closet_delete", _TAX + """
SELECT parent, child FROM edge WHERE parent_level = 'room' AND child NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0)
""")
def taxonomy_closet_delete(t):
    """Closets left after those of customers in debt are deleted by id."""
    gone = t.customer.where(F.col("c_acctbal") < 0).select(
        F.lit("all").alias("palace"), taxonomy.node_id(F.lit("clo"), F.lit("all"), F.col("c_name")).alias("closet_id")
    )
    left = taxonomy.delete_closets(taxonomy.edges(_filed(t)), gone)
    return left.where(F.col("parent_level") == "room").select("parent", "child")
