"""Queries of the engine's own operators over the domain tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.functions import confidence as C
from lorefold.functions import ids
from lorefold.functions.dates import resolve_date
from lorefold.functions.text import name_similarity, normalise, note_of
from lorefold.functions.vectors import hash_vector
from lorefold.operators import captures, evaluation, event_store, fold, reads, resolution, salience, search, stores, triage
from lorefold.session import cut
from lorefold.sources.tables import table

#: The instant that time-dependent queries look from.
NOW = "2026-06-01 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def now():
    return F.lit(NOW).cast("timestamp")


# ---- captures and the event store -------------------------------------------------------------------------------

_IDENTITY = """
WITH c AS (SELECT DISTINCT source, raw_text, source_timestamp, sha256(raw_text) AS content_hash FROM captures WHERE raw_text IS NOT NULL AND source IS NOT NULL AND source_timestamp IS NOT NULL)
SELECT 'cap-' || substr(sha256(source || ' ' || strftime(source_timestamp, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_ms(source_timestamp) % 1000)::VARCHAR, 3, '0') || 'Z' || ' ' || content_hash), 1, 32) AS capture_id, content_hash FROM c
"""


@query(f"SELECT DISTINCT capture_id, content_hash FROM ({_IDENTITY})")
def capture_identity(spark, sf_dir):
    arriving = table(spark, sf_dir, "captures").select("source", F.col("raw_text").alias("text"), "source_timestamp").filter("text IS NOT NULL AND source IS NOT NULL AND source_timestamp IS NOT NULL")
    return captures.with_identity(arriving).select("capture_id", "content_hash").distinct()


@query(f"SELECT DISTINCT capture_id, content_hash FROM ({_IDENTITY}) WHERE capture_id NOT IN (SELECT capture_id FROM captures WHERE source = 'voice')")
def capture_ingest_dedupe(spark, sf_dir):
    stored = table(spark, sf_dir, "captures")
    arriving = stored.select("source", F.col("raw_text").alias("text"), "source_timestamp")
    return captures.ingest(arriving, stored.filter("source = 'voice'")).select("capture_id", "content_hash")


@query("SELECT DISTINCT capture_id FROM captures WHERE capture_id NOT IN (SELECT aggregate_id FROM event_log WHERE type = 'CaptureIngested' AND aggregate_id IS NOT NULL)")
def captures_without_ingestion_event(spark, sf_dir):
    return captures.without_event(table(spark, sf_dir, "captures"), table(spark, sf_dir, "event_log")).select("capture_id").distinct()


@query("SELECT capture_id, min(coalesce(corrected_text, raw_text)) AS text FROM captures GROUP BY capture_id")
def effective_texts(spark, sf_dir):
    return captures.effective_text(table(spark, sf_dir, "captures"))


@query("SELECT capture_id, nfc_normalize(trim(regexp_replace(raw_text, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g'))) AS text FROM captures WHERE raw_text IS NOT NULL")
def unicode_normalise(spark, sf_dir):
    return table(spark, sf_dir, "captures").filter("raw_text IS NOT NULL").select("capture_id", normalise("raw_text").alias("text"))


@query("""
SELECT event_id, position, CASE WHEN provider = 'human' THEN 'provider' ELSE '' END || CASE WHEN confidence + 0.1 > 1 THEN (CASE WHEN provider = 'human' THEN ',' ELSE '' END) || 'confidence' ELSE '' END AS violations
FROM event_log WHERE provider = 'human' OR confidence + 0.1 > 1
""")
def event_validation(spark, sf_dir):
    strained = table(spark, sf_dir, "event_log").withColumn("confidence", F.col("confidence") + 0.1).withColumn("provider", F.when(F.col("provider") != "human", F.col("provider")))
    return event_store.split_valid(strained)[1].select("event_id", "position", F.concat_ws(",", "violations").alias("violations"))


@query("""
SELECT event_id, (SELECT max(position) FROM event_log WHERE aggregate_type = 'Capture') + row_number() OVER (ORDER BY arrival, event_id) AS position
FROM (SELECT event_id, min(position) AS arrival FROM event_log WHERE event_id NOT IN (SELECT event_id FROM event_log WHERE aggregate_type = 'Capture') GROUP BY 1)
""")
def event_append_idempotent(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    return event_store.append_events(log.filter("aggregate_type = 'Capture'"), log.withColumnRenamed("position", "arrival"), "arrival").select("event_id", "position")


@query("SELECT position, event_id, type FROM event_log WHERE position > 1000")
def read_forward(spark, sf_dir):
    return event_store.read_forward(table(spark, sf_dir, "event_log").select("position", "event_id", "type"), 1000)


@query("SELECT aggregate_id, max(aggregate_version) + 1 AS next_version FROM event_log GROUP BY aggregate_id")
def current_version(spark, sf_dir):
    return event_store.current_versions(table(spark, sf_dir, "event_log"))


@query("""
WITH v AS (SELECT aggregate_id, max(aggregate_version) + 1 AS n FROM event_log WHERE type <> 'FieldCleared' GROUP BY aggregate_id)
SELECT DISTINCT event_id, aggregate_version AS expected_version, coalesce(n, 0) AS current_version, coalesce(n, 0) <> aggregate_version AS is_stale
FROM event_log l LEFT JOIN v ON l.aggregate_id = v.aggregate_id WHERE type = 'FieldCleared'
""")
def stale_commands(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    commands = log.filter("type = 'FieldCleared'").select("event_id", "aggregate_id", F.col("aggregate_version").alias("expected_version")).distinct()
    return event_store.stale_commands(commands, log.filter("type <> 'FieldCleared'")).select("event_id", "expected_version", "current_version", "is_stale")


@query("SELECT position, event_id, CASE WHEN type = 'FieldSet' THEN 'v2:' || payload ELSE payload END AS payload, CASE WHEN type = 'FieldSet' THEN 2 ELSE version END AS version FROM event_log")
def event_upcast(spark, sf_dir):
    steps = {("FieldSet", 1): lambda payload: F.concat(F.lit("v2:"), payload)}
    return event_store.upcast(table(spark, sf_dir, "event_log"), {"FieldSet": 2}, steps).select("position", "event_id", "payload", "version")


@query("SELECT provider, model_version, count(*) AS corrections FROM event_log WHERE type = 'CaptureTranscriptCorrected' GROUP BY ALL")
def correction_counts(spark, sf_dir):
    return table(spark, sf_dir, "event_log").filter("type = 'CaptureTranscriptCorrected'").groupBy("provider", "model_version").agg(F.count(F.lit(1)).alias("corrections"))


# ---- the fold ---------------------------------------------------------------------------------------------------

_LEVELS = 4  # merges that build on merges in the oracle; no data of the tests has more


def _settled(n: int, source: str) -> str:
    """CTEs st{n} (rows with absorbed values turned into writes, members and notes) and hd{n} (what is held at the end of each life)."""
    return f"""
sa{n} AS (
  SELECT r.*, b.entity_type, r.type = 'Absorbed' AND coalesce((SELECT arg_max(q.type, q.position) FROM {source} q WHERE q.aid = r.aid AND q.life = r.life AND q.field = r.field AND q.position < r.position), 'FieldCleared') = 'FieldCleared' AS taken
  FROM {source} r LEFT JOIN births b ON b.aid = r.aid AND b.life = r.life
), sb{n} AS (
  SELECT *, (SELECT max(q.position) FROM sa{n} q WHERE q.aid = r.aid AND q.life = r.life AND q.field = r.field AND q.position <= r.position AND (q.taken OR q.type NOT IN ('SetMemberAdded', 'Absorbed'))) AS reset,
    field IN ('aliases', 'notes') OR (field = 'contact' AND entity_type = 'Person') AS grows FROM sa{n} r
), st{n} AS (
  SELECT aid, life, field, value, CASE WHEN type <> 'Absorbed' THEN type WHEN taken THEN 'FieldSet' ELSE 'SetMemberAdded' END AS type, position, event_id,
    CASE WHEN type <> 'Absorbed' THEN ptr WHEN field = 'notes' THEN mid WHEN taken THEN ptr END AS ptr, mid
  FROM sb{n} WHERE type <> 'Absorbed' OR taken OR grows
  UNION ALL
  SELECT aid, life, 'notes', 's:' || field || ': ' || CASE WHEN value LIKE 'd:%' THEN split_part(substr(value, 3), '|', 1) ELSE substr(value, 3) END, 'SetMemberAdded', position, mid, mid, mid
  FROM sb{n} r WHERE type = 'Absorbed' AND NOT taken AND NOT grows
    AND NOT EXISTS (SELECT 1 FROM sb{n} q WHERE q.aid = r.aid AND q.life = r.life AND q.field = r.field AND q.value = r.value AND q.position < r.position AND q.reset IS NOT DISTINCT FROM r.reset)
), hd{n} AS (
  SELECT aid, life, field, value, min(position) AS position, arg_min(event_id, position) AS event_id, arg_min(ptr, position) AS ptr
  FROM (SELECT t.*, (SELECT max(q.position) FROM st{n} q WHERE q.aid = t.aid AND q.life = t.life AND q.field = t.field AND q.type <> 'SetMemberAdded') AS top FROM st{n} t)
  WHERE type <> 'FieldCleared' AND (top IS NULL OR position >= top) GROUP BY 1, 2, 3, 4
)"""


def _merged_levels() -> str:
    out, source = "", "mine"
    for n in range(1, _LEVELS + 1):
        out += f"""{_settled(n, source)}, up{n} AS (
  SELECT * FROM {source}
  UNION ALL SELECT m.survivor, m.survivor_life, h.field, h.value, 'Absorbed', m.position, h.event_id, (SELECT arg_max(q.ptr, q.position) FILTER (q.ptr IS NOT NULL) FROM hd{n} q WHERE q.aid = h.aid AND q.life = h.life AND q.field = h.field), m.event_id FROM levels m JOIN hd{n} h ON h.aid = m.loser AND h.life = m.loser_life WHERE m.level = {n}
),"""
        source = f"up{n}"
    return out + _settled(_LEVELS + 1, source)


_EVENTS = """
WITH RECURSIVE first AS (
  SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON END AS doc FROM event_log
  WHERE type IN ('EntityCreated', 'FieldSet', 'SetMemberAdded', 'FieldCleared', 'EntitiesRelated', 'EntitiesMerged') AND position IS NOT NULL AND aggregate_id IS NOT NULL AND event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY position) = 1
), ev AS MATERIALIZED (
  SELECT position, event_id, type, aggregate_id, recorded_at,
    CASE WHEN type = 'EntityCreated' AND json_extract_string(doc, '$.name') IS NOT NULL THEN 'name'
         WHEN type IN ('FieldSet', 'SetMemberAdded', 'FieldCleared') THEN json_extract_string(doc, '$.field') END AS field,
    CASE WHEN type = 'EntityCreated' THEN 's:' || json_extract_string(doc, '$.name')
         WHEN type IN ('FieldSet', 'SetMemberAdded') AND json_extract_string(doc, '$.value.precision') IS NOT NULL
           THEN 'd:' || coalesce(json_extract_string(doc, '$.value.timestamp'), '') || '|' || json_extract_string(doc, '$.value.precision')
         WHEN type IN ('FieldSet', 'SetMemberAdded') THEN 's:' || coalesce(json_extract_string(doc, '$.value'), '') END AS value,
    json_extract_string(doc, '$.entityType') AS entity_type, json_extract_string(doc, '$.mergedId') AS merged_id,
    json_extract_string(doc, '$.relation') AS relation, json_extract_string(doc, '$.fromId') AS from_id, json_extract_string(doc, '$.fromType') AS from_type,
    json_extract_string(doc, '$.toId') AS to_id, json_extract_string(doc, '$.toType') AS to_type
  FROM first WHERE doc IS NOT NULL
), mg AS (
  SELECT row_number() OVER (ORDER BY m.position) AS i, m.position, m.event_id, m.aggregate_id AS survivor, m.merged_id AS loser,
    (SELECT max(b.position) FROM ev b WHERE b.type = 'EntityCreated' AND b.field IS NOT NULL AND b.aggregate_id = m.aggregate_id AND b.position < m.position) AS sb,
    (SELECT max(b.position) FROM ev b WHERE b.type = 'EntityCreated' AND b.field IS NOT NULL AND b.aggregate_id = m.merged_id AND b.position < m.position) AS lb
  FROM ev m WHERE m.type = 'EntitiesMerged' AND m.merged_id IS NOT NULL AND m.merged_id <> m.aggregate_id
), walk AS (
  SELECT 0::BIGINT AS i, []::STRUCT(id VARCHAR, p BIGINT)[] AS dead
  UNION ALL
  SELECT g.i, CASE WHEN sb IS NOT NULL AND lb IS NOT NULL AND len(list_filter(dead, lambda d: (d.id = survivor AND d.p > sb) OR (d.id = loser AND d.p > lb))) = 0
    THEN list_append(dead, {'id': loser, 'p': position}) ELSE dead END FROM walk w JOIN mg g ON g.i = w.i + 1
), vm AS MATERIALIZED (
  SELECT g.position, g.event_id, g.survivor, g.loser FROM mg g JOIN (SELECT unnest(dead) AS d FROM walk WHERE i = (SELECT max(i) FROM walk)) t ON g.loser = t.d.id AND g.position = t.d.p
)"""

_FOLD = _EVENTS + """, lived AS (
  SELECT e.*, (SELECT count(*) FROM vm WHERE vm.loser = e.aggregate_id AND vm.position < e.position) AS life FROM ev e
), births AS (
  SELECT aggregate_id AS aid, life, min(position) AS p0, arg_min(entity_type, position) AS entity_type FROM lived WHERE type = 'EntityCreated' AND field IS NOT NULL GROUP BY 1, 2
), born AS (
  SELECT aid AS aggregate_id, life, p0, entity_type FROM births b WHERE life = (SELECT count(*) FROM vm WHERE vm.loser = b.aid)
), live AS MATERIALIZED (
  SELECT e.aggregate_id, e.life, field, value, type, position, event_id, recorded_at FROM lived e JOIN births b ON e.aggregate_id = b.aid AND e.life = b.life
  WHERE field IS NOT NULL AND type IN ('EntityCreated', 'FieldSet', 'SetMemberAdded', 'FieldCleared') AND ((position > p0 AND type <> 'EntityCreated') OR position = p0)
), life_of AS (
  SELECT m.*, (SELECT count(*) FROM vm q WHERE q.loser = m.survivor AND q.position < m.position) AS survivor_life, (SELECT count(*) FROM vm q WHERE q.loser = m.loser AND q.position < m.position) AS loser_life FROM vm m
), depth AS (
  SELECT event_id, survivor, survivor_life, 1 AS d FROM life_of
  UNION ALL SELECT m.event_id, m.survivor, m.survivor_life, d + 1 FROM depth x JOIN life_of m ON m.loser = x.survivor AND m.loser_life = x.survivor_life
), levels AS (
  SELECT m.*, (SELECT max(d) FROM depth WHERE depth.event_id = m.event_id) AS level FROM life_of m
), meets AS (
  SELECT survivor AS aid, survivor_life AS life FROM life_of UNION SELECT loser, loser_life FROM life_of
), mine AS MATERIALIZED (
  SELECT aggregate_id AS aid, l.life, field, value, type, position, event_id, event_id AS ptr, NULL::VARCHAR AS mid FROM live l JOIN meets m ON l.aggregate_id = m.aid AND l.life = m.life
),""" + _merged_levels() + f""", folded AS (
  SELECT aggregate_id AS aid, l.life, field, value, type, position, event_id, event_id AS ptr, NULL::VARCHAR AS mid FROM live l WHERE (aggregate_id, life) NOT IN (SELECT (aid, life) FROM meets)
  UNION ALL SELECT * FROM st{_LEVELS + 1}
), epochs AS (
  SELECT f.aid AS aggregate_id, field, value, type, position, event_id, ptr, mid, max(CASE WHEN type <> 'SetMemberAdded' THEN position END) OVER (PARTITION BY aid, f.life, field ORDER BY position) AS epoch,
    max(CASE WHEN type <> 'SetMemberAdded' THEN position END) OVER (PARTITION BY aid, f.life, field) AS top
  FROM folded f JOIN born b ON f.aid = b.aggregate_id AND f.life = b.life
), held AS (
  SELECT aggregate_id AS entity_id, field, value, min(position) AS position, arg_min(event_id, position) AS event_id, arg_min(struct_pack(p := ptr), position).p AS ptr
  FROM epochs WHERE epoch IS NOT DISTINCT FROM top AND type <> 'FieldCleared' GROUP BY ALL
), hops AS (
  SELECT event_id AS start, position, survivor AS place FROM vm
  UNION ALL SELECT h.start, m.position, m.survivor FROM hops h JOIN LATERAL (SELECT position, survivor FROM vm WHERE vm.loser = h.place AND vm.position > h.position ORDER BY position LIMIT 1) m ON true
), fate AS (
  SELECT m.loser, m.position, (SELECT arg_max(place, h.position) FROM hops h WHERE h.start = m.event_id) AS final_id FROM vm m
), written AS (
  SELECT * FROM ev WHERE type = 'EntitiesRelated' AND relation IS NOT NULL AND from_id IS NOT NULL AND to_id IS NOT NULL
), pointed AS (
  SELECT relation, position, from_type, to_type, coalesce((SELECT arg_min(final_id, f.position) FROM fate f WHERE f.loser = w.from_id AND f.position > w.position), from_id) AS from_id,
    coalesce((SELECT arg_min(final_id, f.position) FROM fate f WHERE f.loser = w.to_id AND f.position > w.position), to_id) AS to_id FROM written w
), rel AS MATERIALIZED (
  SELECT relation, from_id, to_id, arg_max(from_type, position) AS from_type, arg_max(to_type, position) AS to_type FROM pointed GROUP BY 1, 2, 3
)
"""


def _events(spark, sf_dir):
    return fold.read_log(table(spark, sf_dir, "event_log"))


@query(_FOLD + "SELECT entity_id, field, value, position, event_id FROM held")
def fold_fields(spark, sf_dir):
    return fold.fold_fields(_events(spark, sf_dir))


@query(_FOLD + "SELECT entity_id, field, value FROM held WHERE field IN ('aliases', 'notes', 'contact')")
def fold_set_members(spark, sf_dir):
    return fold.fold_fields(_events(spark, sf_dir)).filter(F.col("field").isin(*fold.SET_FIELDS)).select("entity_id", "field", "value")


@query(_FOLD + "SELECT DISTINCT l.aggregate_id AS entity_id, field FROM live l JOIN born b ON l.aggregate_id = b.aggregate_id AND l.life = b.life EXCEPT SELECT entity_id, field FROM held")
def fold_field_clear(spark, sf_dir):
    events = _events(spark, sf_dir)
    line = fold.lineage(events)
    rows = fold.survivors(fold.effective_rows(events, line), line.merges).select(F.col("aggregate_id").alias("entity_id"), "field").distinct()
    return rows.join(fold.fold_fields(events, line).select("entity_id", "field").distinct(), ["entity_id", "field"], "left_anti")


@query(_FOLD + "SELECT entity_id, field, arg_max(ptr, position) FILTER (ptr IS NOT NULL) AS event_id FROM held GROUP BY 1, 2")
def field_provenance(spark, sf_dir):
    return fold.field_provenance(_events(spark, sf_dir))


@query(_FOLD + """, w AS (
  SELECT aggregate_id, count(*) AS n FROM epochs WHERE mid IS NULL AND type <> 'SetMemberAdded' GROUP BY 1
  UNION ALL SELECT aggregate_id, count(*) FROM (SELECT aggregate_id FROM epochs GROUP BY aggregate_id, field, epoch, value HAVING arg_min(type, position) = 'SetMemberAdded' AND arg_min(mid IS NULL, position)) GROUP BY 1
  UNION ALL SELECT survivor, count(*) FROM life_of JOIN born ON survivor = aggregate_id AND survivor_life = life GROUP BY 1)
SELECT aggregate_id AS entity_id, sum(n)::BIGINT AS version FROM w GROUP BY 1""")
def fold_entity_versions(spark, sf_dir):
    return fold.entity_versions(_events(spark, sf_dir))


@query(_FOLD + "SELECT * FROM rel")
def fold_relations(spark, sf_dir):
    return fold.fold_relations(_events(spark, sf_dir))


_VIEW = _FOLD + """, e AS (SELECT DISTINCT id, relation || ':' || from_id || '>' || to_id AS x FROM (SELECT from_id AS id, * FROM rel UNION ALL SELECT to_id, * FROM rel)),
pv AS (SELECT entity_id, field || coalesce('=' || arg_max(ptr, position) FILTER (ptr IS NOT NULL), '') AS x FROM held GROUP BY entity_id, field),
vw AS (SELECT b.aggregate_id AS entity_id, b.entity_type, coalesce((SELECT string_agg(DISTINCT h.field || '=' || h.value, '; ' ORDER BY h.field || '=' || h.value) FROM held h WHERE h.entity_id = b.aggregate_id), '') AS fields,
  coalesce((SELECT string_agg(x, '; ' ORDER BY x) FROM e WHERE e.id = b.aggregate_id), '') AS relations, coalesce((SELECT string_agg(x, '; ' ORDER BY x) FROM pv WHERE pv.entity_id = b.aggregate_id), '') AS provenance FROM born b)
"""


@query(_VIEW + "SELECT * FROM vw")
def entity_view(spark, sf_dir):
    return reads.entity_views(_events(spark, sf_dir))


@query(_VIEW + "SELECT entity_id, sha256(entity_id || '|' || entity_type || '|' || fields || '|' || relations || '|' || provenance) AS digest FROM vw")
def knowledge_digest(spark, sf_dir):
    return reads.serialised(_events(spark, sf_dir))


@query(_FOLD + "SELECT (SELECT count(*) FROM born) AS entities, (SELECT count(*) FROM held) AS fields, (SELECT sum(length(value))::BIGINT FROM held) AS field_letters, (SELECT count(*) FROM rel) AS relations")
def knowledge_fingerprint(spark, sf_dir):
    return reads.fingerprint(_events(spark, sf_dir))


@query(_FOLD + "SELECT entity_id, field FROM held GROUP BY 1, 2 HAVING count(ptr) = 0")
def fields_without_provenance(spark, sf_dir):
    return reads.without_provenance(_events(spark, sf_dir))


@query("SELECT DISTINCT entity_id, name, version FROM projection_entities WHERE entity_type = 'Person'")
def entities_of_type(spark, sf_dir):
    return table(spark, sf_dir, "projection_entities").filter("entity_type = 'Person'").select("entity_id", "name", "version").distinct()


@query(_EVENTS + "SELECT position, event_id, survivor, loser FROM vm")
def merges_valid(spark, sf_dir):
    return fold.valid_merges(_events(spark, sf_dir))


@query(_FOLD + "SELECT loser, position, final_id FROM fate")
def merge_redirects(spark, sf_dir):
    return fold.fates(fold.valid_merges(_events(spark, sf_dir))).select(F.col("id").alias("loser"), F.inline("fates")).select("loser", "position", "final_id")


@query(_FOLD + "SELECT relation, from_id, to_id, arg_min(from_type, position) AS from_type, arg_min(to_type, position) AS to_type FROM pointed GROUP BY 1, 2, 3")
def relation_table(spark, sf_dir):
    return fold.fold_relations(_events(spark, sf_dir), types_of="first")


@query(_FOLD + "SELECT r.* FROM rel r WHERE from_id IN (SELECT final_id FROM fate) OR to_id IN (SELECT final_id FROM fate)")
def merge_repoint_relations(spark, sf_dir):
    events = _events(spark, sf_dir)
    line = fold.lineage(events)
    ends = fold.fates(line.merges).select(F.explode("fates.final_id").alias("id")).distinct()
    relations = fold.fold_relations(events, line)
    return relations.join(ends, (F.col("from_id") == F.col("id")) | (F.col("to_id") == F.col("id")), "left_semi")


@query(_FOLD + "SELECT h.entity_id, h.field, h.value, h.event_id FROM held h WHERE h.entity_id IN (SELECT survivor FROM vm)")
def merge_component_fold(spark, sf_dir):
    events = _events(spark, sf_dir)
    line = fold.lineage(events)
    survivors = line.merges.select(F.col("survivor").alias("entity_id")).distinct()
    return fold.fold_fields(events, line).join(survivors, "entity_id", "left_semi").select("entity_id", "field", "value", "event_id")


@query("""
WITH RECURSIVE one AS (SELECT from_id, max(to_id) AS to_id FROM projection_redirects WHERE to_id IS NOT NULL AND from_id IS NOT NULL AND from_id <> to_id GROUP BY 1),
walk AS (SELECT from_id, to_id FROM one UNION SELECT w.from_id, o.to_id FROM walk w JOIN one o ON w.to_id = o.from_id)
SELECT from_id, to_id AS final_id FROM walk WHERE to_id NOT IN (SELECT from_id FROM one)
""")
def merge_redirects_transitive(spark, sf_dir):
    redirects = table(spark, sf_dir, "projection_redirects")
    ends = fold.resolve_redirects(redirects).select("from_id", "final_id")
    moved_on = redirects.filter("to_id IS NOT NULL AND from_id <> to_id").select(F.col("from_id").alias("final_id")).distinct()
    return ends.join(moved_on, "final_id", "left_anti").select("from_id", "final_id")


# ---- relations and diffs ----------------------------------------------------------------------------------------

# typed by hand, so that the SQL doesn't share the lists of the code it checks
_PAIRS = """('involves', 'Project', 'Person'), ('concerns', 'Task', 'Person'), ('concerns', 'Task', 'Project'), ('concerns', 'Task', 'Idea'), ('concerns', 'Task', 'Event'),
('attended', 'Event', 'Person'), ('relates_to', 'Project', 'Project'), ('relates_to', 'Idea', 'Idea'), ('relates_to', 'Idea', 'Project'), ('became', 'Idea', 'Project'), ('became', 'Idea', 'Task'),
('blocks', 'Task', 'Task'), ('blocks', 'Project', 'Project'), ('blocks', 'Task', 'Project'), ('knows', 'Person', 'Person')"""
_NAMES = "'attended', 'became', 'blocks', 'concerns', 'involves', 'knows', 'relates_to'"
_VIOLATION = f"CASE WHEN relation NOT IN ({_NAMES}) THEN 'unknown_relation' WHEN from_id = to_id THEN 'self_relation' WHEN (relation, from_type, to_type) NOT IN ({_PAIRS}) THEN 'undeclared_pair' END"


@query(_FOLD + f"SELECT relation, from_type, to_type, {_VIOLATION} AS violation, count(*) AS n FROM rel GROUP BY ALL")
def relation_violations(spark, sf_dir):
    return triage.relation_violations(fold.fold_relations(_events(spark, sf_dir))).groupBy("relation", "from_type", "to_type", "violation").agg(F.count(F.lit(1)).alias("n"))


@query(_FOLD + f"SELECT v.relation, (SELECT count(*) FROM rel r WHERE r.relation = v.relation) AS n, (SELECT count(*) FILTER (relation = 'relates_to') / count(*) FROM rel) AS catch_all_share FROM (SELECT unnest([{_NAMES}]) AS relation) v")
def relation_mix(spark, sf_dir):
    return evaluation.relation_mix(fold.fold_relations(_events(spark, sf_dir)), sorted({p[0] for p in triage.RELATION_PAIRS}), "relates_to")


_SCHEMA_ROWS = """('Person', 'name', 'single'), ('Person', 'aliases', 'set'), ('Person', 'summary', 'single'), ('Person', 'notes', 'set'), ('Person', 'salience', 'single'),
('Person', 'employer', 'single'), ('Person', 'role', 'single'), ('Person', 'location', 'single'), ('Person', 'relationship', 'single'), ('Person', 'contact', 'set'), ('Person', 'last_contact_at', 'single'),
('Project', 'name', 'single'), ('Project', 'aliases', 'set'), ('Project', 'summary', 'single'), ('Project', 'notes', 'set'), ('Project', 'salience', 'single'), ('Project', 'status', 'single'),
('Project', 'blocker', 'single'), ('Project', 'next_action', 'single'), ('Project', 'outcome', 'single'), ('Project', 'due', 'single'), ('Project', 'started_at', 'single'),
('Idea', 'name', 'single'), ('Idea', 'aliases', 'set'), ('Idea', 'summary', 'single'), ('Idea', 'notes', 'set'), ('Idea', 'salience', 'single'), ('Idea', 'body', 'single'), ('Idea', 'status', 'single'),
('Event', 'name', 'single'), ('Event', 'aliases', 'set'), ('Event', 'summary', 'single'), ('Event', 'notes', 'set'), ('Event', 'salience', 'single'), ('Event', 'occurred_at', 'single'),
('Event', 'ends_at', 'single'), ('Event', 'location', 'single'), ('Event', 'kind', 'single'), ('Event', 'outcome', 'single'),
('Task', 'name', 'single'), ('Task', 'aliases', 'set'), ('Task', 'summary', 'single'), ('Task', 'notes', 'set'), ('Task', 'salience', 'single'), ('Task', 'status', 'single'), ('Task', 'due', 'single'), ('Task', 'done_at', 'single')"""
_CHANGES = _FOLD + f""", sch AS (SELECT * FROM (VALUES {_SCHEMA_ROWS}) t(entity_type, field, cardinality)),
changes AS (SELECT c.entity_id, c.entity_type, c.field, c.value,
  CASE WHEN s.cardinality IS NULL THEN 'refused_unknown' WHEN c.field IN ('salience', 'last_contact_at') THEN 'refused_derived' WHEN h.value IS NOT NULL THEN 'already_held'
       WHEN s.cardinality = 'set' THEN 'add_to_set' ELSE 'set_field' END AS change
FROM (SELECT DISTINCT l.aggregate_id AS entity_id, b.entity_type, l.field, l.value FROM live l JOIN born b ON l.aggregate_id = b.aggregate_id AND l.life = b.life WHERE type IN ('FieldSet', 'SetMemberAdded')) c
LEFT JOIN sch s ON c.entity_type = s.entity_type AND c.field = s.field LEFT JOIN held h ON c.entity_id = h.entity_id AND c.field = h.field AND c.value = h.value)
"""


def _changes(spark, sf_dir):
    events = _events(spark, sf_dir)
    line = fold.lineage(events)
    types = fold.created(events, line).select("aggregate_id", "entity_type")
    claims = fold.survivors(fold.effective_rows(events, line).filter("type IN ('FieldSet', 'SetMemberAdded')"), line.merges).join(types, "aggregate_id").select(F.col("aggregate_id").alias("entity_id"), "entity_type", "field", "value")
    held = fold.fold_fields(events, line)
    return triage.diff_entities(claims, held, triage.field_schema(spark)), held


@query(_CHANGES + "SELECT * FROM changes")
def diff_entity(spark, sf_dir):
    return _changes(spark, sf_dir)[0]


@query(_CHANGES + """SELECT DISTINCT h.entity_id, 'blocker' AS field, 'clear_field' AS change FROM held h JOIN changes c ON h.entity_id = c.entity_id
WHERE h.field = 'blocker' AND c.entity_type = 'Project' AND c.field = 'status' AND c.change = 'set_field' AND c.value <> 's:blocked'""")
def diff_dependents(spark, sf_dir):
    changes, held = _changes(spark, sf_dir)
    return triage.diff_dependents(changes, held)


@query(_FOLD + f""", c AS (SELECT relation, from_id, from_type, to_id, to_type FROM rel UNION SELECT relation, to_id, to_type, from_id, from_type FROM rel)
SELECT c.relation, c.from_id, c.to_id, c.from_type, c.to_type, {_VIOLATION.replace('relation NOT', 'c.relation NOT').replace('from_id =', 'c.from_id =').replace('= to_id', '= c.to_id').replace('(relation, from_type, to_type)', '(c.relation, c.from_type, c.to_type)')} AS violation,
CASE WHEN violation IS NOT NULL THEN 'refused' WHEN (c.relation, c.from_id, c.to_id) IN (SELECT (relation, from_id, to_id) FROM rel) THEN 'already_held'
WHEN c.relation = 'became' AND c.from_id IN (SELECT from_id FROM rel WHERE relation = 'became') THEN 'replace' ELSE 'relate' END AS change, CASE WHEN c.relation = 'became' THEN 'review' ELSE 'auto' END AS floor FROM c""")
def diff_relations(spark, sf_dir):
    held = fold.fold_relations(_events(spark, sf_dir))
    turned = held.select("relation", F.col("to_id").alias("from_id"), F.col("to_type").alias("from_type"), F.col("from_id").alias("to_id"), F.col("from_type").alias("to_type"))
    return triage.diff_relations(held.unionByName(turned), held)


@query(_FOLD + """, members AS (SELECT * FROM (VALUES ('Person', 'relationship', ['colleague', 'friend', 'family', 'client', 'acquaintance', 'other']), ('Project', 'status', ['active', 'blocked', 'paused', 'done', 'abandoned']),
  ('Idea', 'status', ['open', 'promoted', 'dropped']), ('Event', 'kind', ['meeting', 'call', 'deadline', 'milestone', 'social', 'other']), ('Task', 'status', ['open', 'done', 'dropped'])) t(entity_type, field, known)),
said AS (SELECT l.aggregate_id AS entity_id, b.entity_type, l.field, l.value, position, known, lower(trim(substr(l.value, 3))) AS x FROM live l JOIN births b ON l.aggregate_id = b.aid AND l.life = b.life JOIN members m ON m.entity_type = b.entity_type AND m.field = l.field WHERE type = 'FieldSet')
SELECT entity_id, entity_type, field, value, position, CASE WHEN list_contains(known, x) THEN x ELSE 'other' END AS parsed, CASE WHEN NOT list_contains(known, x) THEN field || ': ' || substr(value, 3) END AS note FROM said""")
def enum_fallback(spark, sf_dir):
    events = _events(spark, sf_dir)
    line = fold.lineage(events)
    rows = fold.effective_rows(events, line).filter("type = 'FieldSet'").join(line.births.select("aggregate_id", "life", "entity_type"), ["aggregate_id", "life"])
    said = rows.select(F.col("aggregate_id").alias("entity_id"), "entity_type", "field", F.col("value").alias("typed"), F.substring("value", 3, 1 << 20).alias("value"), "position")
    parsed = triage.enum_fallback(said).filter("parsed IS NOT NULL")
    return parsed.withColumn("value", F.col("typed")).drop("typed")


@query("""SELECT event_id, position, try_cast(json_extract_string(payload, '$.value.timestamp') AS TIMESTAMP) AS ts,
CASE WHEN json_extract_string(payload, '$.value.timestamp') IS NULL THEN 'relative_unresolved' ELSE json_extract_string(payload, '$.value.precision') END AS precision, json_extract_string(payload, '$.value.phrase') AS phrase
FROM (SELECT event_id, position, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END::JSON AS payload FROM event_log WHERE type = 'FieldSet') WHERE json_extract_string(payload, '$.value.precision') IS NOT NULL AND json_extract_string(payload, '$.value.phrase') IS NOT NULL""")
def resolved_dates(spark, sf_dir):
    doc = F.try_parse_json("payload")
    part = lambda p: F.variant_get(doc, f"$.value.{p}", "string")
    rows = table(spark, sf_dir, "event_log").filter("type = 'FieldSet'").select("event_id", "position", resolve_date(part("timestamp"), part("precision"), part("phrase")).alias("d"))
    return rows.filter("d IS NOT NULL").select("event_id", "position", F.col("d.ts").cast("timestamp_ntz").alias("ts"), "d.precision", "d.phrase")


@query("SELECT DISTINCT proposal_id FROM event_log WHERE type = 'SetMemberAdded' AND proposal_id IS NOT NULL EXCEPT SELECT proposal_id FROM event_log WHERE type = 'FieldSet'")
def emerged_proposals(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    return stores.append_new(log.filter("type = 'FieldSet'"), log.filter("type = 'SetMemberAdded'"), "proposal_id").select("proposal_id")


# ---- triage -----------------------------------------------------------------------------------------------------

_CLAMPED = "CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.5 ELSE least(greatest(confidence, 0.0), 1.0) END"


@query(f"SELECT provider, model_version, CASE WHEN c >= 0.9 THEN 'auto_apply' WHEN c >= 0.5 THEN 'needs_review' ELSE 'discard' END AS band, count(*) AS n FROM (SELECT provider, model_version, {_CLAMPED} AS c FROM event_log) GROUP BY ALL")
def confidence_bands(spark, sf_dir):
    band = C.band_for(C.clamp_unit(F.col("confidence")))
    return table(spark, sf_dir, "event_log").groupBy("provider", "model_version", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT provider, model_version, n AS corrections, n < 50 AS is_bootstrapping, greatest(0, 50 - n) AS remaining FROM (SELECT provider, model_version, count(*) FILTER (type = 'CaptureTranscriptCorrected') AS n FROM event_log GROUP BY 1, 2)")
def bootstrap_status(spark, sf_dir):
    counted = table(spark, sf_dir, "event_log").groupBy("provider", "model_version").agg(F.count_if(F.col("type") == "CaptureTranscriptCorrected").alias("corrections"))
    return counted.withColumn("is_bootstrapping", F.col("corrections") < C.BOOTSTRAP_CORRECTIONS).withColumn("remaining", F.greatest(F.lit(0), C.BOOTSTRAP_CORRECTIONS - F.col("corrections")))


_TRIAGED = f"""
WITH p AS (SELECT DISTINCT ON (proposal_id) proposal_id, provider, model_version, confidence AS extraction, CASE WHEN type = 'FieldSet' THEN round(1 - aggregate_version / 1000.0, 3) END AS resolution,
    CASE type WHEN 'EntitiesRelated' THEN 'add_relation' WHEN 'EntitiesMerged' THEN 'merge' WHEN 'FieldCleared' THEN 'remove' ELSE 'set' END AS change_kind, CASE WHEN type = 'EntityCreated' THEN 'review' ELSE 'auto' END AS floor, recorded_at AS decided_at
  FROM event_log WHERE proposal_id IS NOT NULL AND aggregate_type = 'Entity' ORDER BY proposal_id, position),
k AS (SELECT provider, model_version, count(*) AS corrections FROM event_log WHERE type = 'SetMemberAdded' GROUP BY 1, 2),
a AS (SELECT p.*, coalesce(corrections, 0) AS corrections, coalesce(corrections, 0) < 50 AS boot, {_CLAMPED.replace('confidence', 'extraction')} AS x FROM p LEFT JOIN k USING (provider, model_version)),
b AS (SELECT *, (CASE WHEN boot THEN least(x, 0.9) ELSE x END) * coalesce(resolution, 1) AS confidence FROM a),
c AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 1 WHEN confidence >= 0.5 THEN 2 ELSE 3 END AS band, CASE WHEN change_kind IN ('merge', 'remove') THEN 2 WHEN change_kind = 'add_relation' THEN 1 WHEN floor = 'review' THEN 2 ELSE 1 END AS ceiling FROM b),
d AS (SELECT *, greatest(band, ceiling, CASE WHEN boot AND resolution IS NOT NULL THEN 2 ELSE 1 END) AS bounded, ('0x' || substr(md5(proposal_id), 1, 8))::BIGINT / 4294967296.0 AS drawn,
  CASE WHEN corrections >= 500 THEN 0.05 WHEN corrections >= 50 THEN 0.1 ELSE 0.2 END AS rate FROM c),
t AS (SELECT *, bounded = 1 AND drawn < rate AS is_sampled, ['auto_apply', 'needs_review', 'discard'][CASE WHEN bounded = 1 AND drawn < rate THEN 2 ELSE bounded END] AS disposition FROM d)
"""


def _triaged(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    first = log.filter("proposal_id IS NOT NULL AND aggregate_type = 'Entity'").groupBy("proposal_id").agg(F.min_by(F.struct("provider", "model_version", "confidence", "type", "aggregate_version", "recorded_at"), "position").alias("r")).select("proposal_id", "r.*")
    kind = F.col("type")
    proposals = first.select(
        "proposal_id", "provider", "model_version", F.col("confidence").alias("extraction"), F.when(kind == "FieldSet", F.round(1 - F.col("aggregate_version") / 1000.0, 3)).alias("resolution"),
        F.when(kind == "EntitiesRelated", "add_relation").when(kind == "EntitiesMerged", "merge").when(kind == "FieldCleared", "remove").otherwise("set").alias("change_kind"),
        F.when(kind == "EntityCreated", "review").otherwise("auto").alias("floor"), F.col("recorded_at").alias("decided_at"),
    )
    corrections = log.filter("type = 'SetMemberAdded'").groupBy("provider", "model_version").agg(F.count(F.lit(1)).alias("corrections"))
    return stores.with_expiry(triage.triage(proposals, corrections))


@query(_TRIAGED + "SELECT proposal_id, round(confidence, 9) AS confidence, is_sampled, disposition FROM t")
def triage_dispositions(spark, sf_dir):
    return _triaged(spark, sf_dir).select("proposal_id", F.round("confidence", 9).alias("confidence"), "is_sampled", "disposition")


@query(_TRIAGED + f"SELECT proposal_id FROM t WHERE disposition = 'discard' AND decided_at + INTERVAL 30 DAYS > TIMESTAMPTZ '{NOW}+00'")
def live_discards(spark, sf_dir):
    return stores.live_discards(_triaged(spark, sf_dir), now()).select("proposal_id")


@query(_TRIAGED + f"SELECT count(*) AS kept FROM t WHERE NOT (disposition = 'discard' AND decided_at + INTERVAL 30 DAYS <= TIMESTAMPTZ '{NOW}+00')")
def expired_discards(spark, sf_dir):
    return stores.without_expired(_triaged(spark, sf_dir), now()).agg(F.count(F.lit(1)).alias("kept"))


@query(_TRIAGED + "SELECT proposal_id FROM t WHERE disposition = 'needs_review' AND proposal_id NOT IN (SELECT proposal_id FROM event_log WHERE is_human_confirmed AND proposal_id IS NOT NULL)")
def review_queue(spark, sf_dir):
    entries = _triaged(spark, sf_dir).select("proposal_id", "disposition", F.col("decided_at").alias("queued_at"))
    decided = table(spark, sf_dir, "event_log").filter("is_human_confirmed AND proposal_id IS NOT NULL").select("proposal_id", F.col("recorded_at").alias("adjudicated_at"))
    return stores.review_queue(entries, decided, "needs_review").select("proposal_id")


# ---- resolution -------------------------------------------------------------------------------------------------

# DuckDB's levenshtein counts bytes: letters of two bytes are mapped one to one to capitals, which lower-case text doesn't hold
_LETTERS = "'éóüöïñáøçèàâäãåêëìîíòôõúùûý', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ^'"
_SIM = "CASE WHEN length(x) = 0 OR length(y) = 0 THEN 0.0 WHEN x = y THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END"
_NORM = "trim(regexp_replace(translate(lower(replace({}, chr(160), ' ')), " + _LETTERS + "), '\\s+', ' ', 'g'))"
_RESOLVE = _FOLD + f"""
, ent AS (SELECT DISTINCT entity_id, entity_type, {_NORM.format('name')} AS y FROM projection_entities WHERE name IS NOT NULL),
nam AS (SELECT DISTINCT * FROM (SELECT * FROM ent UNION ALL SELECT a.entity_id, e.entity_type, {_NORM.format('a.alias')} FROM projection_aliases a JOIN ent e ON a.entity_id = e.entity_id WHERE a.alias IS NOT NULL) WHERE y <> ''),
men AS (SELECT DISTINCT entity_type || '|' || mention_text AS mention_id, entity_type, {_NORM.format('mention_text')} AS x FROM adjudication_requests WHERE mention_text IS NOT NULL),
ex AS (SELECT DISTINCT mention_id, entity_id FROM men m JOIN nam n ON m.entity_type = n.entity_type AND m.x = n.y),
fz AS (SELECT mention_id, entity_id, max(s) AS similarity FROM (SELECT mention_id, entity_id, {_SIM} AS s FROM men m JOIN ent n ON m.entity_type = n.entity_type) WHERE s >= 0.7 GROUP BY 1, 2),
vec AS (SELECT entity_id, entity_type, arg_min(embedding::DOUBLE[], embedding) AS v FROM projection_embeddings WHERE model_version = 'hashvec-384-r2' AND len(embedding) = 384 AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0 AND len(list_filter(embedding, lambda q: q <> 0)) > 0 GROUP BY 1, 2),
qv AS (SELECT x.mention_id, v.entity_type, v.v FROM (SELECT mention_id, min(entity_id) AS entity_id FROM ex WHERE entity_id IN (SELECT entity_id FROM vec) GROUP BY 1) x JOIN men m ON x.mention_id = m.mention_id JOIN vec v ON v.entity_id = x.entity_id AND v.entity_type = m.entity_type),
nv AS (SELECT mention_id, entity_id FROM (SELECT q.mention_id, e.entity_id, round(1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 9) AS d FROM qv q JOIN vec e ON q.entity_type = e.entity_type) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY d, entity_id) <= 20),
cand AS (SELECT mention_id, entity_id, count(DISTINCT s) AS sources, min(s) AS source_rank FROM (SELECT *, 0 AS s FROM ex UNION ALL SELECT mention_id, entity_id, 1 FROM fz UNION ALL SELECT mention_id, entity_id, 2 FROM nv) GROUP BY 1, 2),
occ AS (SELECT DISTINCT capture_id, entity_type || '|' || mention_text AS mention_id FROM adjudication_requests WHERE mention_text IS NOT NULL AND capture_id IS NOT NULL),
res AS (SELECT mention_id, min(entity_id) AS entity_id FROM ex GROUP BY 1),
co AS (SELECT DISTINCT a.mention_id, a.capture_id, r.entity_id AS other FROM occ a JOIN occ b ON a.capture_id = b.capture_id AND a.mention_id <> b.mention_id JOIN res r ON r.mention_id = b.mention_id),
edge AS (SELECT from_id AS a, to_id AS b FROM rel UNION SELECT to_id, from_id FROM rel),
tg AS (SELECT mention_id, entity_id, max(part) AS together FROM (SELECT c.mention_id, c.entity_id, co.capture_id, count(*) / (SELECT count(*) FROM co n WHERE n.mention_id = c.mention_id AND n.capture_id = co.capture_id) AS part
  FROM cand c JOIN co ON c.mention_id = co.mention_id JOIN edge e ON e.a = c.entity_id AND e.b = co.other GROUP BY 1, 2, 3) GROUP BY 1, 2),
sc AS (SELECT c.*, coalesce(t.together, 0) AS together, (SELECT max({_SIM}) FROM men m, nam n WHERE m.mention_id = c.mention_id AND n.entity_id = c.entity_id) AS name_similarity FROM cand c LEFT JOIN tg t ON c.mention_id = t.mention_id AND c.entity_id = t.entity_id),
scored AS (SELECT *, round(least(greatest(0.75 * coalesce(name_similarity, 0) + 0.1 * sources / 3 + 0.1 * together, 0.0), 1.0), 9) AS score FROM sc),
ranked AS (SELECT *, row_number() OVER w AS choice, lead(score) OVER w AS runner_up FROM scored WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, source_rank, entity_id))
"""


def _parties(spark, sf_dir):
    entities = table(spark, sf_dir, "projection_entities").filter("name IS NOT NULL").select("entity_id", "entity_type", "name").distinct()
    aliases = table(spark, sf_dir, "projection_aliases").filter("alias IS NOT NULL").select("entity_id", "alias")
    asked = table(spark, sf_dir, "adjudication_requests").filter("mention_text IS NOT NULL").select(F.concat_ws("|", "entity_type", "mention_text").alias("mention_id"), "mention_text", "entity_type").distinct()
    return entities, aliases, asked


def _vectors(spark, sf_dir):
    """Usable vectors of the current model, one for an entity."""
    v = F.col("embedding")
    usable = table(spark, sf_dir, "projection_embeddings").filter("model_version = 'hashvec-384-r2' AND size(embedding) = 384").filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    return usable.groupBy("entity_id", "entity_type").agg(F.min("embedding").alias("embedding"))


def _sources(spark, sf_dir):
    """Candidates of all three sources. A mention's vector is that of an entity of just its name, in place of an embedding port."""
    entities, aliases, asked = _parties(spark, sf_dir)
    names = resolution.all_names(entities, aliases)
    exact = cut(resolution.exact_candidates(asked, names))
    vectors = cut(_vectors(spark, sf_dir))
    own = exact.join(vectors.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"))
    asked_vectors = own.join(asked.select("mention_id", "entity_type"), "mention_id").join(vectors.withColumnRenamed("embedding", "vector"), ["entity_id", "entity_type"]).select("mention_id", "entity_type", "vector")
    found = resolution.candidate_union(exact, resolution.fuzzy_candidates(asked, entities), resolution.nearest_candidates(asked_vectors, vectors))
    return cut(found), exact, names, asked


def _together(spark, sf_dir):
    """Candidates of all sources with what their notes' other mentions say; what of the log is read for that and for contacts, and its lineage."""
    found, exact, names, asked = _sources(spark, sf_dir)
    places = table(spark, sf_dir, "adjudication_requests").filter("mention_text IS NOT NULL").select(F.concat_ws("|", "entity_type", "mention_text").alias("mention_id"), "capture_id")
    resolved = exact.groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"))
    # creations and merges settle the lives of entities; of all other writes only the relations and the contacts count here
    events = cut(_events(spark, sf_dir).filter("type IN ('EntityCreated', 'EntitiesMerged') OR relation IS NOT NULL OR field = 'last_contact_at'"))
    line = fold.lineage(events)
    return found, resolution.co_occurrence(found, places, resolved, fold.fold_relations(events, line)), events, line, exact, names, asked


def _scored(spark, sf_dir):
    found, together, events, line, exact, names, asked = _together(spark, sf_dir)
    # a field is folded by itself
    contact = fold.fold_fields(events.filter("field = 'last_contact_at'"), line).filter("field = 'last_contact_at' AND value LIKE 'd:%'").groupBy("entity_id").agg(F.max(F.try_to_timestamp(F.substring_index(F.substring("value", 3, 1 << 20), "|", 1))).alias("last_contact"))
    days = contact.select("entity_id", (F.datediff(now(), F.col("last_contact"))).cast("double").alias("days_since_contact"))
    featured = found.join(together, ["mention_id", "entity_id"], "left").join(days, "entity_id", "left")
    return cut(resolution.score_candidates(featured, asked, names).withColumn("score", F.round("score", 9))), asked, exact


@query(_RESOLVE + "SELECT mention_id, entity_id, round(together, 9) AS together FROM tg")
def co_occurrence(spark, sf_dir):
    return _together(spark, sf_dir)[1].select("mention_id", "entity_id", F.round("together", 9).alias("together"))


@query(_RESOLVE + """, o AS (SELECT m.mention_id, m.x, coalesce(score, 0) AS s, r.entity_id, coalesce(score >= 0.55 AND round(coalesce(score - runner_up, (score - 0.55) / 0.45), 7) < 0.15, false) AS unsure FROM men m LEFT JOIN ranked r ON m.mention_id = r.mention_id AND choice = 1),
a AS (SELECT o.*, length(mention_id) % 6 AS answer, (SELECT least(count(*), 4) FROM ranked q WHERE q.mention_id = o.mention_id) AS options FROM o)
SELECT mention_id, CASE WHEN s < 0.35 THEN 'unambiguous' WHEN s < 0.55 OR (unsure AND (answer < 1 OR answer > options)) THEN 'rejected_candidates' ELSE 'matched' END AS outcome,
CASE WHEN s >= 0.55 AND NOT unsure THEN entity_id WHEN unsure THEN (SELECT q.entity_id FROM ranked q WHERE q.mention_id = a.mention_id AND q.choice = a.answer AND a.answer BETWEEN 1 AND options) END AS entity_id FROM a""")
def resolution_adjudicated(spark, sf_dir):
    """Ambiguous mentions decided by an answer; here a port that answers by the length of the id, so also none and out of range."""
    scored, asked, _ = _scored(spark, sf_dir)
    out = resolution.resolve(scored, asked).withColumn("is_ambiguous", F.coalesce((F.col("outcome") == "matched") & (F.round("margin", 7) < resolution.CLEAR_MARGIN), F.lit(False)))
    answers = asked.select("mention_id", (F.length("mention_id") % 6).alias("choice")).distinct()
    return resolution.adjudicate(out, resolution.shortlist(scored), answers).select("mention_id", "outcome", "entity_id")


@query(f"SELECT DISTINCT a.entity_id, a.alias, round({_SIM}, 9) AS similarity FROM (SELECT a.entity_id, a.alias, {_NORM.format('a.alias')} AS x, {_NORM.format('e.name')} AS y FROM projection_aliases a JOIN projection_entities e ON a.entity_id = e.entity_id) a WHERE a.alias IS NOT NULL")
def name_similarities(spark, sf_dir):
    named = table(spark, sf_dir, "projection_entities").select("entity_id", "name")
    rows = table(spark, sf_dir, "projection_aliases").filter("alias IS NOT NULL").join(named, "entity_id")
    return rows.select("entity_id", "alias", F.round(name_similarity(F.col("alias"), F.col("name")), 9).alias("similarity")).distinct()


@query(_RESOLVE + "SELECT * FROM ex")
def exact_name_candidates(spark, sf_dir):
    entities, aliases, asked = _parties(spark, sf_dir)
    return resolution.exact_candidates(asked, resolution.all_names(entities, aliases))


@query(_RESOLVE + "SELECT mention_id, entity_id, round(similarity, 9) AS similarity FROM fz")
def fuzzy_name_candidates(spark, sf_dir):
    entities, _, asked = _parties(spark, sf_dir)
    return resolution.fuzzy_candidates(asked, entities).withColumn("similarity", F.round("similarity", 9))


@query(_RESOLVE + "SELECT * FROM cand")
def candidate_union(spark, sf_dir):
    return _sources(spark, sf_dir)[0].select("mention_id", "entity_id", "sources", "source_rank")


@query(_RESOLVE + "SELECT mention_id, entity_id, round(score, 6) AS score FROM scored")
def resolution_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[0].select("mention_id", "entity_id", F.round("score", 6).alias("score"))


@query(_RESOLVE + """SELECT m.mention_id, CASE WHEN coalesce(score, 0) < 0.35 THEN 'unambiguous' WHEN score < 0.55 THEN 'rejected_candidates' ELSE 'matched' END AS outcome,
CASE WHEN score >= 0.55 THEN entity_id END AS entity_id, coalesce(score >= 0.55 AND round(coalesce(round(score, 9) - round(runner_up, 9), (round(score, 9) - 0.55) / 0.45), 7) < 0.15, false) AS is_ambiguous FROM men m LEFT JOIN ranked r ON m.mention_id = r.mention_id AND choice = 1""")
def resolution_outcome(spark, sf_dir):
    scored, asked, _ = _scored(spark, sf_dir)
    out = resolution.resolve(scored, asked)
    return out.select("mention_id", "outcome", "entity_id", F.coalesce((F.col("outcome") == "matched") & (F.round("margin", 7) < resolution.CLEAR_MARGIN), F.lit(False)).alias("is_ambiguous"))


@query(_RESOLVE + "SELECT mention_id, choice, entity_id FROM ranked WHERE choice <= 4")
def adjudication_shortlist(spark, sf_dir):
    return resolution.shortlist(_scored(spark, sf_dir)[0]).select("mention_id", F.col("choice").cast("long").alias("choice"), "entity_id")


@query(_RESOLVE + """, o AS (SELECT m.mention_id, CASE WHEN score >= 0.55 THEN r.entity_id END AS actual_id, e.entity_id AS expected_id FROM men m LEFT JOIN ranked r ON m.mention_id = r.mention_id AND choice = 1
  LEFT JOIN (SELECT mention_id, min(entity_id) AS entity_id FROM ex GROUP BY 1) e ON m.mention_id = e.mention_id),
v AS (SELECT count(*) FILTER (expected_id = actual_id) AS right_match, count(*) FILTER (expected_id <> actual_id) AS wrong_match, count(*) FILTER (expected_id IS NOT NULL AND actual_id IS NULL) AS missed,
  count(*) FILTER (expected_id IS NULL AND actual_id IS NOT NULL) AS false_match, count(*) FILTER (expected_id IS NULL AND actual_id IS NULL) AS right_none FROM o)
SELECT *, round(right_match / (right_match + wrong_match + missed), 9) AS match_accuracy, round(right_none / (right_none + false_match), 9) AS none_accuracy FROM v""")
def resolution_metrics(spark, sf_dir):
    scored, asked, exact = _scored(spark, sf_dir)
    exact = exact.groupBy("mention_id").agg(F.min("entity_id").alias("expected_id"))
    rows = resolution.resolve(scored, asked).select("mention_id", F.col("entity_id").alias("actual_id"), F.col("is_ambiguous").alias("was_adjudicated")).join(exact, "mention_id", "left")
    return evaluation.resolution_metrics(rows).select("right_match", "wrong_match", "missed", "false_match", "right_none", F.round("match_accuracy", 9).alias("match_accuracy"), F.round("none_accuracy", 9).alias("none_accuracy"))


@query(_RESOLVE + f"""SELECT a.entity_id AS survivor_id, b.entity_id AS merged_id, 'dup-' || substr(sha256(a.entity_id || ' ' || b.entity_id), 1, 32) AS duplicate_id, round(max({_SIM}), 9) AS similarity
FROM (SELECT entity_id, entity_type, y AS x FROM nam) a JOIN nam b ON a.entity_type = b.entity_type AND a.entity_id < b.entity_id WHERE {_SIM} >= 0.85 GROUP BY 1, 2""")
def duplicate_pairs(spark, sf_dir):
    entities, aliases, _ = _parties(spark, sf_dir)
    return resolution.duplicate_pairs(entities, aliases).select("survivor_id", "merged_id", "duplicate_id", F.round("similarity", 9).alias("similarity"))


@query("""WITH d AS (SELECT q.vec_id::VARCHAR AS mention_id, e.vec_id::VARCHAR AS entity_id, 1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS x
FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0)
SELECT mention_id, entity_id, greatest(round(x, 9), 0.0::DOUBLE) + 0.0::DOUBLE AS distance FROM d QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY greatest(round(x, 9), 0.0), entity_id) <= 20""")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), F.col("label").alias("entity_type"), "embedding", "vec_id")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("entity_id").alias("mention_id"), "entity_type", F.col("embedding").alias("vector"))
    near = resolution.nearest_candidates(asked, rows)
    return near.withColumn("distance", F.greatest(F.round("distance", 9), F.lit(0.0)))


@query("SELECT DISTINCT name, list_transform(range(8), lambda i: round((('0x' || substr(sha256(name || ' ' || i), 1, 4))::INT / 32768.0 - 1), 9)) AS vector FROM projection_entities WHERE false")
def hash_embedding(spark, sf_dir):
    return table(spark, sf_dir, "projection_entities").select("name").distinct().select("name", hash_vector(F.col("name"), 8).alias("vector"))


del ORACLE["hash_embedding"]


# ---- salience, briefs, search, metrics --------------------------------------------------------------------------

_SALIENT = _FOLD + f""", hist AS (SELECT aggregate_id AS entity_id, arg_max(recorded_at, position) AS last_at, count(*) FILTER (ago <= 7) AS this_week, count(*) FILTER (ago > 7 AND ago <= 14) AS last_week,
   coalesce(bool_or(type = 'FieldSet' AND field = 'status' AND ago <= 7), false) AS status_changed, count(*) AS changes_ever, arg_min(recorded_at, position) AS first_at
 FROM (SELECT *, (epoch_ms(TIMESTAMPTZ '{NOW}+00') - epoch_ms(recorded_at)) / 86400000.0 AS ago FROM ev) GROUP BY 1),
fl AS (SELECT entity_id, arg_max(substr(value, 3), position) FILTER (field = 'status') AS status, arg_max(try_cast(split_part(substr(value, 3), '|', 1) AS TIMESTAMPTZ), position) FILTER (field IN ('due', 'occurred_at')) AS due_at, bool_or(field = 'outcome') AS has_outcome FROM held GROUP BY 1),
base AS (SELECT b.aggregate_id AS entity_id, b.entity_type, coalesce(status, '') AS status, due_at, coalesce(has_outcome, false) AS has_outcome, (epoch_ms(TIMESTAMPTZ '{NOW}+00') - epoch_ms(coalesce(last_at, TIMESTAMPTZ '{NOW}+00'))) / 86400000.0 AS silent,
  (epoch_ms(due_at) - epoch_ms(TIMESTAMPTZ '{NOW}+00')) / 86400000.0 AS until FROM born b LEFT JOIN fl ON b.aggregate_id = fl.entity_id LEFT JOIN hist h ON b.aggregate_id = h.entity_id),
terms AS (SELECT *, CASE WHEN silent <= 0 THEN 40.0 WHEN silent >= 30 THEN 0.0 ELSE 40.0 * (1 - silent / 30) END AS recency, CASE WHEN entity_type = 'Person' THEN 0.0 WHEN (entity_type = 'Project' AND status IN ('active', 'blocked')) OR (entity_type = 'Task' AND status = 'open') THEN 25.0 ELSE 0.0 END AS open_loop,
  CASE WHEN entity_type = 'Person' OR until IS NULL THEN 0.0 WHEN until < 0 THEN CASE WHEN status IN ('done', 'dropped', 'abandoned') THEN 0.0 ELSE 30.0 END WHEN until <= 2 THEN 30.0 WHEN until <= 7 THEN 20.0 WHEN until <= 30 THEN 10.0 ELSE 0.0 END AS imminence,
  CASE WHEN (entity_type = 'Project' AND status = 'blocked' AND silent >= 14) OR (entity_type = 'Task' AND status = 'open' AND silent >= 30) THEN 15.0 ELSE 0.0 END AS attention_debt,
  CASE WHEN entity_type <> 'Person' AND (status IN ('done', 'dropped', 'abandoned') OR (entity_type = 'Event' AND has_outcome AND until < -7)) THEN 20.0 ELSE 0.0 END AS dormancy FROM base),
sal AS (SELECT * REPLACE (recency::DOUBLE AS recency, open_loop::DOUBLE AS open_loop, imminence::DOUBLE AS imminence, attention_debt::DOUBLE AS attention_debt, dormancy::DOUBLE AS dormancy), round(least(greatest(recency::DOUBLE + open_loop + imminence + attention_debt - dormancy, 0.0::DOUBLE), 100.0::DOUBLE), 6) AS salience FROM terms)
"""
_TERMS = ("recency", "open_loop", "imminence", "attention_debt", "dormancy", "salience")


def _salient(spark, sf_dir):
    entities = reads.salient_entities(_events(spark, sf_dir), now())
    return salience.salience_terms(entities, now()).withColumn("salience", F.round("salience", 6))


@query(_SALIENT + "SELECT entity_id, first_at::TIMESTAMP AS first_at, last_at::TIMESTAMP AS last_at, this_week, last_week, status_changed, changes_ever FROM hist")
def history_activity(spark, sf_dir):
    return salience.history(_events(spark, sf_dir), now()).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query(_SALIENT + f"SELECT entity_id, {', '.join(f'round({t}, 6) AS {t}' for t in _TERMS)} FROM sal")
def salience_terms(spark, sf_dir):
    return _salient(spark, sf_dir).select("entity_id", *[F.round(t, 6).alias(t) for t in _TERMS])


@query(_SALIENT + "SELECT entity_id, entity_type, salience FROM sal ORDER BY salience DESC, entity_id LIMIT 100")
def salience_rank(spark, sf_dir):
    return salience.rank(_salient(spark, sf_dir).select("entity_id", "entity_type", "salience"), 100)


@query(_SALIENT + """, e AS (SELECT from_id AS id, to_id AS other, to_type AS t FROM rel UNION SELECT to_id, from_id, from_type FROM rel), a AS (SELECT id, max(coalesce(salience, 0.0)) AS association FROM e LEFT JOIN sal ON other = entity_id WHERE t IN ('Project', 'Task', 'Event') GROUP BY 1)
SELECT entity_id, coalesce(association, 0.0) AS association, round(least(recency + coalesce(association, 0.0), 100.0), 6) AS salience FROM sal LEFT JOIN a ON entity_id = id WHERE entity_type = 'Person'""")
def person_association(spark, sf_dir):
    people = salience.person_association(_salient(spark, sf_dir), fold.fold_relations(_events(spark, sf_dir)))
    return people.select("entity_id", "association", F.round("salience", 6).alias("salience"))


_DAILY = _SALIENT + f""", today AS (SELECT * FROM sal WHERE (entity_type = 'Task' AND status = 'open' AND until < 1) OR (entity_type = 'Event' AND due_at::DATE = DATE '{NOW[:10]}')),
parts AS (SELECT 'Today' AS heading, * FROM today UNION ALL SELECT 'Worth doing', * FROM sal WHERE ((entity_type = 'Task' AND status = 'open') OR (entity_type = 'Project' AND status = 'active')) AND entity_id NOT IN (SELECT entity_id FROM today)
  UNION ALL SELECT 'Looks stuck', * FROM sal WHERE attention_debt > 0 UNION ALL SELECT 'Coming up', * FROM sal WHERE status NOT IN ('done', 'dropped', 'abandoned') AND until BETWEEN 0 AND 7),
rk AS (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY salience DESC, entity_id) AS rank FROM parts)
"""


@query(_DAILY + "SELECT heading, rank, entity_id, entity_type, salience FROM rk WHERE rank <= CASE heading WHEN 'Today' THEN 8 WHEN 'Worth doing' THEN 5 WHEN 'Looks stuck' THEN 3 ELSE 5 END")
def daily_brief(spark, sf_dir):
    return salience.daily_sections(_salient(spark, sf_dir), now()).select("heading", F.col("rank").cast("long").alias("rank"), "entity_id", "entity_type", "salience")


@query(_SALIENT + f""", act AS (SELECT entity_id, this_week, last_week, status_changed, (epoch_ms(TIMESTAMPTZ '{NOW}+00') - epoch_ms(first_at)) / 86400000.0 BETWEEN 0 AND 7 AS is_new FROM hist),
e AS (SELECT from_id AS id, to_id AS other, to_type AS t FROM rel UNION SELECT to_id, from_id, from_type FROM rel), asc_ AS (SELECT id, max(coalesce(salience, 0.0)) AS association FROM e LEFT JOIN sal ON other = entity_id WHERE t IN ('Project', 'Task', 'Event') GROUP BY 1),
ranked AS (SELECT sal.* REPLACE (CASE WHEN entity_type = 'Person' THEN round(least(recency + coalesce(association, 0.0), 100.0), 6) ELSE salience END AS salience) FROM sal LEFT JOIN asc_ ON entity_id = id),
kn AS (SELECT s.*, coalesce(this_week, 0) AS tw, coalesce(last_week, 0) AS lw, coalesce(status_changed, false) AS sc, coalesce(is_new, false) AS is_new FROM ranked s LEFT JOIN act USING (entity_id)),
parts AS (SELECT 'What moved' AS heading, * FROM kn WHERE sc OR tw > lw UNION ALL SELECT 'What didn''t', * FROM kn WHERE open_loop > 0 AND tw = 0 UNION ALL SELECT 'Open loops', * FROM kn WHERE open_loop > 0
  UNION ALL SELECT 'New this week', * FROM kn WHERE is_new UNION ALL SELECT 'People', * FROM kn WHERE entity_type = 'Person' AND tw > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY salience DESC, entity_id) AS rank FROM parts)
SELECT heading, rank, entity_id, entity_type, salience FROM rk WHERE rank <= CASE heading WHEN 'What moved' THEN 8 WHEN 'What didn''t' THEN 5 WHEN 'Open loops' THEN 8 WHEN 'New this week' THEN 10 ELSE 6 END""")
def weekly_brief(spark, sf_dir):
    scored = _salient(spark, sf_dir)
    activity = scored.select("entity_id", "this_week", "last_week", "status_changed", ((F.unix_millis(now()) - F.unix_millis("first_at")) / 86_400_000.0).between(0, 7).alias("is_new"))
    plain = salience.with_association(scored, fold.fold_relations(_events(spark, sf_dir))).withColumn("salience", F.round("salience", 6)).drop("this_week", "last_week", "status_changed", "changes_ever", "first_at", "last_at")
    return salience.weekly_sections(plain, activity).select("heading", F.col("rank").cast("long").alias("rank"), "entity_id", "entity_type", "salience")


@query("SELECT kind || '-' || strftime(d, '%Y-%m-%d') AS brief_id, kind, d AS covers_to FROM (SELECT 'daily' AS kind, unnest([DATE '2026-06-01', DATE '2026-05-31']) AS d UNION ALL SELECT 'weekly', DATE '2026-06-01') WHERE kind || '-' || strftime(d, '%Y-%m-%d') <> 'daily-2026-05-31'")
def due_brief_windows(spark, sf_dir):
    existing = spark.createDataFrame([("daily-2026-05-31",)], "brief_id string")
    today = date(2026, 6, 1)
    return stores.due_windows(existing, "daily", today).unionByName(stores.due_windows(existing, "weekly", today))


@query("""WITH s AS (SELECT DISTINCT aggregate_id AS entity_id FROM event_log WHERE type = 'EntitiesRelated'), o AS (SELECT aggregate_id AS entity_id, confidence AS salience FROM event_log WHERE type = 'FieldCleared')
SELECT (SELECT count(*) FROM s) AS surfaced, (SELECT count(DISTINCT entity_id) FROM o WHERE entity_id IN (FROM s)) AS surfaced_and_opened, (SELECT count(*) FROM o WHERE entity_id NOT IN (FROM s)) AS opened_unsurfaced,
(SELECT round(coalesce(avg(salience), 0.0), 9) FROM o WHERE entity_id NOT IN (FROM s)) AS mean_unsurfaced_salience""")
def attention_signal(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    opens = log.filter("type = 'FieldCleared'").select(F.col("aggregate_id").alias("entity_id"), F.col("confidence").alias("salience"))
    signal = evaluation.attention_signal(log.filter("type = 'EntitiesRelated'").select(F.col("aggregate_id").alias("entity_id")), opens)
    return signal.withColumn("mean_unsurfaced_salience", F.round("mean_unsurfaced_salience", 9))


_TOKENS = "list_filter(string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: t <> '')"


def _bm25(source: str, phrase: list[str]) -> str:
    wanted = "[" + ", ".join(f"'{p}'" for p in phrase) + "]"
    return f"""WITH d AS (SELECT doc_key, {_TOKENS.format("coalesce(text, '')")} AS t FROM ({source})), c AS (SELECT doc_key, len(t) AS n, len(list_filter(range(greatest(len(t) - {len(phrase)}, 0) + 1), lambda i: t[i + 1:i + {len(phrase)}] = {wanted})) AS f FROM d),
g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f > 0) AS hits FROM c) SELECT doc_key, round(-greatest(ln((docs - hits + 0.5) / (hits + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, g WHERE f > 0"""


_CAPTURE_TEXTS = "SELECT capture_id AS doc_key, min(coalesce(corrected_text, raw_text)) AS text FROM captures GROUP BY 1"


def _capture_texts(spark, sf_dir):
    return captures.effective_text(table(spark, sf_dir, "captures")).withColumnRenamed("capture_id", "doc_key")


@query(_bm25(_CAPTURE_TEXTS, ["price", "table"]))
def capture_search(spark, sf_dir):
    return search.search(_capture_texts(spark, sf_dir), "price-table", limit=None).withColumn("score", F.round("score", 6))


@query(_bm25(_CAPTURE_TEXTS, ["zsofia"]))
def capture_search_accents(spark, sf_dir):
    return search.search(_capture_texts(spark, sf_dir), "ZSÓFIA", limit=None).withColumn("score", F.round("score", 6))


@query(_bm25(_CAPTURE_TEXTS, ["price", "table"]))
def capture_search_postings(spark, sf_dir):
    postings, lengths = search.build_index(_capture_texts(spark, sf_dir))
    return search.search_index(postings, lengths, "price-table", limit=None).withColumn("score", F.round("score", 6))


@query(_FOLD + ", st AS (SELECT entity_id AS doc_key, string_agg(substr(value, 3), ' ' ORDER BY position, substr(value, 3)) AS text FROM held WHERE value LIKE 's:%' GROUP BY 1) " + _bm25("FROM st", ["museum"]).replace("WITH d AS", ", d AS", 1).lstrip())
def entity_search_bm25(spark, sf_dir):
    return search.search(reads.entity_texts(_events(spark, sf_dir)), "Museum", limit=None).withColumn("score", F.round("score", 6))


@query("""SELECT round(sum(correct) / sum(expected), 9) AS recall, round(sum(correct) / sum(found), 9) AS precision, round(avg(c), 9) AS mean_confidence
FROM (SELECT count(*) AS expected, count(*) FILTER (NOT is_human_confirmed) AS found, count(*) FILTER (NOT is_human_confirmed AND confidence >= 0.7) AS correct, avg(confidence) AS c FROM event_log GROUP BY capture_id)""")
def extraction_metrics(spark, sf_dir):
    auto = ~F.col("is_human_confirmed")
    cases = table(spark, sf_dir, "event_log").groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(auto).alias("found"), F.count_if(auto & (F.col("confidence") >= 0.7)).alias("correct"), F.count_if(auto).alias("fields"), F.count_if(auto).alias("fields_right"),
        F.count(F.lit(1)).alias("emitted"), F.lit(0).alias("violations"), F.avg("confidence").alias("confidence"),
    )
    return evaluation.extraction_metrics(cases).select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"), F.round("mean_confidence", 9).alias("mean_confidence"))


@query("SELECT provider, s[(floor(len(s) * 0.5) + 1)::INT] AS p50, s[(floor(len(s) * 0.95) + 1)::INT] AS p95 FROM (SELECT provider, list_sort(list(confidence) FILTER (confidence IS NOT NULL)) AS s FROM event_log GROUP BY 1) WHERE len(s) > 0")
def percentile_floor(spark, sf_dir):
    return evaluation.percentile_by_rank(table(spark, sf_dir, "event_log"), "provider", "confidence", {"p50": 0.5, "p95": 0.95})


@query()
def greedy_mention_match(spark, sf_dir):
    rows = table(spark, sf_dir, "adjudication_requests").dropDuplicates(["request_id"])
    expected = rows.select(F.col("capture_id").alias("case_id"), F.unix_micros("requested_at").alias("at"), "entity_type", F.col("mention_text").alias("text"))
    actual = rows.select(F.col("capture_id").alias("case_id"), F.col("entity_type"), F.posexplode("candidates").alias("at", "c")).select("case_id", F.col("at").cast("long").alias("at"), "entity_type", F.col("c.name").alias("text"))
    return evaluation.greedy_matches(expected, actual)


@query(_FOLD + "SELECT entity_id, field, field || ': ' || coalesce(substr(value, 3), 'null') AS note FROM held")
def held_notes(spark, sf_dir):
    return fold.fold_fields(_events(spark, sf_dir)).select("entity_id", "field", note_of(F.col("field"), F.substring("value", 3, 1 << 20)).alias("note"))


@query("SELECT DISTINCT event_id, 'evt-' || substr(sha256(capture_id || ' ' || coalesce(proposal_id, '') || ' ' || type || ' ' || aggregate_id || ' ' || aggregate_version || ' ' || provider || ' ' || model_version), 1, 32) AS derived_id FROM event_log")
def event_identity(spark, sf_dir):
    derived = ids.event_id(*[F.col(c) for c in ("capture_id", "proposal_id", "type", "aggregate_id", "aggregate_version", "provider", "model_version")])
    return table(spark, sf_dir, "event_log").select("event_id", derived.alias("derived_id")).distinct()
