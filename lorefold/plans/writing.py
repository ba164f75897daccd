"""Queries of the write side, the stored projection and the briefs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.operators import briefs, captures, evaluation, extraction, fold, salience, writing
from lorefold.plans.reference import _FOLD, _SALIENT, _TRIAGED, NOW, _events, _salient, _triaged, now, query
from lorefold.sources.tables import table


def _run(commands: str, log: str) -> str:
    """CTEs after ``cmd`` (command_key, arrival, type, aggregate_id, expected, capture_id, proposal_id, provider, model_version): ``done`` with outcome, at and event_id, one command of an aggregate after the other."""
    return f"""cmd AS ({commands}),
vers AS (SELECT aggregate_id, max(aggregate_version) + 1 AS n FROM event_log WHERE {log} GROUP BY 1),
seq AS (SELECT c.*, row_number() OVER (PARTITION BY c.aggregate_id ORDER BY arrival, command_key) AS i, coalesce(n, 0) AS stored FROM cmd c LEFT JOIN vers v ON c.aggregate_id = v.aggregate_id
  WHERE type IN ('CreateEntity', 'SetField', 'AddToSet', 'ClearField', 'RelateEntities', 'MergeEntities', 'IngestCapture', 'CorrectTranscript')),
run AS (SELECT aggregate_id, 0::BIGINT AS i, min(stored) AS ver, NULL::VARCHAR AS command_key, NULL::BIGINT AS at_version FROM seq GROUP BY 1
  UNION ALL SELECT s.aggregate_id, s.i, CASE WHEN s.expected IS NULL OR s.expected = r.ver THEN r.ver + 1 ELSE r.ver END, s.command_key, CASE WHEN s.expected IS NULL OR s.expected = r.ver THEN r.ver END FROM run r JOIN seq s ON s.aggregate_id = r.aggregate_id AND s.i = r.i + 1),
done AS (SELECT c.*, CASE WHEN r.command_key IS NULL THEN 'unknown_command' WHEN at_version IS NULL THEN 'stale' ELSE 'applied' END AS outcome, at_version,
  CASE WHEN at_version IS NOT NULL THEN 'evt-' || substr(sha256(coalesce(capture_id, '') || ' ' || coalesce(proposal_id, '') || ' ' || type || ' ' || c.aggregate_id || ' ' || at_version || ' ' || provider || ' ' || model_version), 1, 32) END AS event_id
  FROM cmd c LEFT JOIN run r ON c.command_key = r.command_key)
"""


_CLEARS = """SELECT DISTINCT ON (event_id) event_id AS command_key, position AS arrival, CASE WHEN aggregate_version % 10 = 0 THEN 'DropField' ELSE 'ClearField' END AS type, aggregate_id, aggregate_version AS expected, capture_id, proposal_id, provider, model_version
FROM event_log WHERE type = 'FieldCleared' ORDER BY event_id, position, aggregate_version"""


@query("WITH RECURSIVE " + _run(_CLEARS, "type <> 'FieldCleared'") + "SELECT command_key, outcome, at_version AS aggregate_version, event_id FROM done")
def executed_commands(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    columns = ("aggregate_type", "aggregate_id", "aggregate_version", "payload", "capture_id", "proposal_id", "provider", "model_version", "confidence", "is_human_confirmed")
    cleared = log.filter("type = 'FieldCleared'").groupBy("event_id").agg(F.min(F.struct("position", "aggregate_version", *[c for c in columns if c != "aggregate_version"])).alias("r")).select("event_id", "r.*")
    commands = cleared.select(
        F.col("event_id").alias("command_key"), F.col("position").alias("arrival"), F.when(F.col("aggregate_version") % 10 == 0, "DropField").otherwise("ClearField").alias("type"), "aggregate_type", "aggregate_id",
        F.col("aggregate_version").alias("expected_version"), "payload", "proposal_id", "capture_id", "provider", "model_version", "confidence", "is_human_confirmed",
    )
    return writing.execute(commands, log.filter("type <> 'FieldCleared'"), now()).select("command_key", "outcome", "aggregate_version", "event_id")


# the command that each proposal of the log would be, by its event
_COMMAND = "CASE type WHEN 'EntityCreated' THEN 'CreateEntity' WHEN 'FieldSet' THEN 'SetField' WHEN 'SetMemberAdded' THEN 'AddToSet' WHEN 'FieldCleared' THEN 'ClearField' WHEN 'EntitiesRelated' THEN 'RelateEntities' WHEN 'EntitiesMerged' THEN 'MergeEntities' END"
_PROPOSED = f"SELECT DISTINCT ON (proposal_id) proposal_id, capture_id, {_COMMAND} AS command_type, aggregate_type, aggregate_id, aggregate_version, payload, position AS arrival FROM event_log WHERE proposal_id IS NOT NULL AND aggregate_type = 'Entity' ORDER BY proposal_id, position"
_QUEUED = _TRIAGED.replace("\nWITH p AS", "\nWITH RECURSIVE p AS", 1) + f", pc AS ({_PROPOSED}), "


def _proposed(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    first = log.filter("proposal_id IS NOT NULL AND aggregate_type = 'Entity'").groupBy("proposal_id").agg(
        F.min_by(F.struct("capture_id", "type", "aggregate_type", "aggregate_id", "aggregate_version", "payload", F.col("position").alias("arrival")), "position").alias("r")
    ).select("proposal_id", "r.*")
    kinds = {event: command for command, event in writing.EVENT_FOR_COMMAND}
    command = F.coalesce(*[F.when(F.col("type") == event, name) for event, name in kinds.items()])
    return first.withColumn("command_type", command).withColumnRenamed("aggregate_version", "expected_version").drop("type")


def _queue(spark, sf_dir):
    decided = _triaged(spark, sf_dir).select("proposal_id", "disposition", "confidence", "is_sampled", "provider", "model_version")
    return _proposed(spark, sf_dir).join(decided, "proposal_id").filter("disposition <> 'discard'").withColumn("queued_at", now()).withColumn("adjudicated_at", F.lit(None).cast("timestamp"))


_UNPROPOSED = "proposal_id IS NULL"


@query(_QUEUED + _run("SELECT proposal_id AS command_key, arrival, command_type AS type, aggregate_id, aggregate_version AS expected, pc.capture_id, proposal_id, provider, model_version FROM pc JOIN t USING (proposal_id) WHERE disposition = 'auto_apply'", _UNPROPOSED) + """SELECT t.proposal_id, t.disposition, round(t.confidence, 9) AS confidence, t.disposition <> 'discard' AS is_queued, d.outcome, d.event_id FROM t LEFT JOIN done d ON t.proposal_id = d.command_key""")
def triage_applied(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    base = log.filter("proposal_id IS NOT NULL AND aggregate_type = 'Entity'").groupBy("proposal_id").agg(F.min_by(F.struct("provider", "model_version", "confidence", "type", "aggregate_version"), "position").alias("r")).select("proposal_id", "r.*")
    kind = F.col("type")
    own = base.select(
        "proposal_id", "provider", "model_version", F.col("confidence").alias("extraction"), F.when(kind == "FieldSet", F.round(1 - F.col("aggregate_version") / 1000.0, 3)).alias("resolution"),
        F.when(kind == "EntitiesRelated", "add_relation").when(kind == "EntitiesMerged", "merge").when(kind == "FieldCleared", "remove").otherwise("set").alias("change_kind"), F.when(kind == "EntityCreated", "review").otherwise("auto").alias("floor"),
    )
    corrections = log.filter("type = 'SetMemberAdded'").groupBy("provider", "model_version").agg(F.count(F.lit(1)).alias("corrections"))
    triaged = writing.triage_all(own.join(_proposed(spark, sf_dir), "proposal_id"), corrections, log.filter(_UNPROPOSED), now())
    queued = triaged.queue.select("proposal_id", F.lit(True).alias("is_queued"))
    out = triaged.dispositions.join(queued, "proposal_id", "left").join(triaged.executed.select("proposal_id", "outcome", "event_id"), "proposal_id", "left")
    return out.select("proposal_id", "disposition", F.round("confidence", 9).alias("confidence"), F.coalesce("is_queued", F.lit(False)).alias("is_queued"), "outcome", "event_id")


_FIRST_FATE = "SELECT loser AS id, arg_min(final_id, f.position) AS final_id FROM fate f GROUP BY 1"
_ADJUDICATED = _FOLD + ", " + _TRIAGED.strip().removeprefix("WITH ") + f", pc AS ({_PROPOSED}), ff AS ({_FIRST_FATE}), "


def _redirects(spark, sf_dir):
    ends = fold.fates(fold.valid_merges(_events(spark, sf_dir)))
    return ends.select("id", F.col("fates")[0]["final_id"].alias("final_id"))


@query(_ADJUDICATED + _run("""SELECT proposal_id AS command_key, c.arrival, command_type AS type, coalesce(ff.final_id, pc.aggregate_id) AS aggregate_id,
CASE WHEN ff.final_id IS NULL AND command_type <> 'MergeEntities' THEN aggregate_version END AS expected, pc.capture_id, proposal_id, 'human' AS provider, 'human' AS model_version
FROM pc JOIN t USING (proposal_id) JOIN (SELECT proposal_id, arrival FROM pc WHERE arrival % 2 = 0) c USING (proposal_id) LEFT JOIN ff ON ff.id = pc.aggregate_id WHERE disposition <> 'discard'""", "true") + "SELECT proposal_id, aggregate_id, outcome, event_id, outcome = 'applied' AS is_stamped FROM done")
def confirmed_proposals(spark, sf_dir):
    """Every second queued proposal confirmed; those whose entity was merged away act on the survivor."""
    log = table(spark, sf_dir, "event_log")
    queued = _queue(spark, sf_dir)
    confirmed = queued.filter("arrival % 2 = 0").select("proposal_id", "arrival")
    executed, queue = writing.confirm(queued.drop("arrival", "provider", "model_version"), confirmed, log, _redirects(spark, sf_dir), now())
    return executed.join(queue.select("proposal_id", F.col("adjudicated_at").isNotNull().alias("is_stamped")), "proposal_id").select("proposal_id", "aggregate_id", "outcome", "event_id", "is_stamped")


@query(_ADJUDICATED + """ch AS (SELECT proposal_id, arrival, aggregate_id, payload, pc.capture_id, 'corr-' || substr(sha256(proposal_id || ' SetField ' || aggregate_id || ' ' || payload), 1, 32) AS correction_id FROM pc JOIN t USING (proposal_id) WHERE command_type = 'SetField' AND disposition = 'needs_review' AND payload IS NOT NULL),
""" + _run("SELECT correction_id AS command_key, arrival, 'SetField' AS type, coalesce(ff.final_id, aggregate_id) AS aggregate_id, NULL::BIGINT AS expected, capture_id, proposal_id, 'human' AS provider, 'human' AS model_version FROM ch LEFT JOIN ff ON ff.id = ch.aggregate_id WHERE arrival % 3 <> 0", "true") + "SELECT command_key AS correction_id, proposal_id, capture_id, at_version AS aggregate_version, event_id FROM done")
def corrected_proposals(spark, sf_dir):
    """Corrections of queued fields; a third, recorded before, isn't made again."""
    log = table(spark, sf_dir, "event_log")
    queue = _queue(spark, sf_dir).filter("disposition = 'needs_review' AND command_type = 'SetField' AND payload IS NOT NULL")
    chosen = queue.select("proposal_id", "arrival", F.lit("SetField").alias("type"), "aggregate_type", "aggregate_id", "payload")
    recorded = chosen.filter("arrival % 3 = 0").select(writing.ids.correction_id(F.col("proposal_id"), F.col("type"), F.col("aggregate_id"), F.col("payload")).alias("correction_id"))
    executed, made = writing.correct(queue, chosen, recorded, log, _redirects(spark, sf_dir), now())
    return made.select("correction_id", "proposal_id", "capture_id").join(executed.select(F.col("command_key").alias("correction_id"), "aggregate_version", "event_id"), "correction_id")


_VERSIONS = """w AS (
  SELECT aggregate_id, count(*) AS n FROM epochs WHERE mid IS NULL AND type <> 'SetMemberAdded' GROUP BY 1
  UNION ALL SELECT aggregate_id, count(*) FROM (SELECT aggregate_id FROM epochs GROUP BY aggregate_id, field, epoch, value HAVING arg_min(type, position) = 'SetMemberAdded' AND arg_min(mid IS NULL, position)) GROUP BY 1
  UNION ALL SELECT survivor, count(*) FROM life_of JOIN born ON survivor = aggregate_id AND survivor_life = life GROUP BY 1),
ver AS (SELECT aggregate_id AS entity_id, sum(n)::BIGINT AS version FROM w GROUP BY 1)"""
_DECLARED = """dcl AS (SELECT * FROM (VALUES ('name', '', 'single'), ('aliases', '', 'set'), ('summary', '', 'single'), ('notes', '', 'set'), ('employer', 'Person', 'single'), ('role', 'Person', 'single'), ('location', 'Person', 'single'),
  ('relationship', 'Person', 'single'), ('contact', 'Person', 'set'), ('status', 'Project', 'single'), ('blocker', 'Project', 'single'), ('next_action', 'Project', 'single'), ('outcome', 'Project', 'single'), ('due', 'Project', 'single'),
  ('started_at', 'Project', 'single'), ('body', 'Idea', 'single'), ('status', 'Idea', 'single'), ('occurred_at', 'Event', 'single'), ('ends_at', 'Event', 'single'), ('location', 'Event', 'single'), ('kind', 'Event', 'single'),
  ('outcome', 'Event', 'single'), ('status', 'Task', 'single'), ('due', 'Task', 'single'), ('done_at', 'Task', 'single')) d(field, entity_type, cardinality))"""


@query(_FOLD + f""", {_VERSIONS}, {_DECLARED},
pr AS (SELECT DISTINCT l.proposal_id, l.aggregate_id AS entity_id, e.field, e.value FROM event_log l JOIN ev e ON l.event_id = e.event_id WHERE l.type = 'FieldSet' AND e.type = 'FieldSet' AND l.proposal_id IS NOT NULL AND e.field IS NOT NULL),
ck AS (SELECT pr.*, v.version, b.entity_type, EXISTS (SELECT 1 FROM held h WHERE h.entity_id = pr.entity_id AND h.field = pr.field AND h.value = pr.value) AS is_held, (SELECT max(cardinality) FROM dcl WHERE dcl.field = pr.field AND dcl.entity_type IN ('', b.entity_type)) AS cardinality
  FROM pr LEFT JOIN ver v ON v.entity_id = pr.entity_id LEFT JOIN born b ON b.aggregate_id = pr.entity_id),
ok AS (SELECT *, version IS NOT NULL AND cardinality IS NOT NULL AND NOT is_held AS changes FROM ck)
SELECT DISTINCT proposal_id, CASE WHEN version IS NULL THEN 'target_gone' WHEN changes THEN 'changed' ELSE 'no_change' END AS outcome, CASE WHEN changes THEN field END AS field, CASE WHEN changes THEN value END AS value,
CASE WHEN changes THEN CASE WHEN cardinality = 'set' THEN 'add_to_set' ELSE 'set_field' END END AS change, CASE WHEN changes THEN version END AS expected_version, CASE WHEN changes THEN 'needs_review' END AS disposition
FROM ok WHERE changes OR NOT EXISTS (SELECT 1 FROM ok o WHERE o.proposal_id = ok.proposal_id AND o.entity_id = ok.entity_id AND o.changes)""")
def reproposed(spark, sf_dir):
    events = _events(spark, sf_dir)
    line = fold.lineage(events)
    proposed = table(spark, sf_dir, "event_log").filter("type = 'FieldSet' AND proposal_id IS NOT NULL").select("event_id", "proposal_id").distinct()
    said = events.filter("type = 'FieldSet' AND field IS NOT NULL").join(proposed, "event_id").select("proposal_id", F.col("aggregate_id").alias("entity_id"), "field", "value").distinct()
    types = fold.created(events, line).select(F.col("aggregate_id").alias("entity_id"), "entity_type")
    return writing.repropose(said.select("proposal_id", "entity_id").distinct(), said.join(types, "entity_id"), fold.fold_fields(events, line), fold.entity_versions(events, line))


# ---- extraction and evaluation ----------------------------------------------------------------------------------

_SAID = "SELECT DISTINCT request_id AS capture_id, CASE WHEN entity_type = 'Idea' THEN 'Thing' ELSE entity_type END AS entity_type, mention_text FROM adjudication_requests WHERE mention_text IS NOT NULL"


def _answers(spark, sf_dir):
    """Answers as an extractor gives them, with a type, a field and a derived field that aren't to be had."""
    rows = table(spark, sf_dir, "adjudication_requests").filter("mention_text IS NOT NULL").select("request_id", "entity_type", "mention_text").distinct()
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in (("summary", "s"), ("salience", "1"), ("colour", "blue"), ("due", "2026-01-01"))])
    mention = F.struct(F.col("mention_text").alias("text"), F.when(F.col("entity_type") == "Idea", "Thing").otherwise(F.col("entity_type")).alias("entity_type"), F.lit(1.5).alias("confidence"), fields.alias("fields"))
    return rows.select(F.col("request_id").alias("capture_id"), F.to_json(F.struct(F.array(mention).alias("mentions"))).alias("answer"))


@query(f"SELECT capture_id, 0 AS at, entity_type, trim(mention_text) AS text, 1.0::DOUBLE AS confidence FROM ({_SAID}) WHERE entity_type <> 'Thing' AND trim(mention_text) <> ''")
def extraction_mentions(spark, sf_dir):
    return extraction.parse_extraction(_answers(spark, sf_dir))[0]


@query(f"""WITH s AS ({_SAID}) SELECT capture_id, 'unknown_entity_type' AS violation, entity_type AS detail FROM s WHERE entity_type = 'Thing'
UNION ALL SELECT capture_id, v, d FROM s, (VALUES ('derived_field', 'salience'), ('unknown_field', 'colour'), ('unknown_field', 'due')) f(v, d) WHERE entity_type <> 'Thing' AND trim(mention_text) <> '' AND NOT (d = 'due' AND entity_type IN ('Project', 'Task'))""")
def extraction_violations(spark, sf_dir):
    return extraction.parse_extraction(_answers(spark, sf_dir))[2].select("capture_id", "violation", "detail")


@query("SELECT DISTINCT capture_id FROM captures WHERE capture_id NOT IN (SELECT capture_id FROM event_log WHERE proposal_id IS NOT NULL AND capture_id IS NOT NULL)")
def captures_to_extract(spark, sf_dir):
    recorded = table(spark, sf_dir, "event_log").filter("proposal_id IS NOT NULL AND capture_id IS NOT NULL")
    return extraction.to_extract(table(spark, sf_dir, "captures").select("capture_id").distinct(), recorded)


@query(r"""SELECT count(*) AS expected, count(*) FILTER (heard) AS heard, count(*) FILTER (heard) / count(*) AS recall FROM (SELECT regexp_matches(note_text, '(?i)\b' || regexp_escape(mention_text) || '\b') AS heard
FROM adjudication_requests WHERE note_text IS NOT NULL AND mention_text IS NOT NULL)""")
def transcription_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "adjudication_requests").filter("note_text IS NOT NULL AND mention_text IS NOT NULL")
    return evaluation.noun_recall(rows.select(F.col("note_text").alias("text"), F.col("mention_text").alias("noun")))


@query("SELECT DISTINCT provider, model_version, provider || '/' || model_version AS model, CASE WHEN provider = 'human' THEN 0.95 ELSE 0.9 END::DOUBLE AS auto_from, CASE WHEN provider = 'human' THEN 0.6 ELSE 0.5 END::DOUBLE AS review_from FROM event_log")
def model_thresholds(spark, sf_dir):
    models = table(spark, sf_dir, "event_log").select("provider", "model_version").distinct()
    measured = models.filter("provider = 'human'").select(F.concat_ws("/", "provider", "model_version").alias("model"), F.lit(0.95).alias("auto_from"), F.lit(0.6).alias("review_from"))
    return evaluation.thresholds_for(models, measured, 0.9, 0.5)


# ---- briefs -----------------------------------------------------------------------------------------------------

_NAMED = f""", nm AS (SELECT entity_id, arg_max(substr(value, 3), position) AS name FROM held WHERE field = 'name' GROUP BY 1),
today AS (SELECT * FROM sal WHERE (entity_type = 'Task' AND status = 'open' AND until < 1) OR (entity_type = 'Event' AND due_at::DATE = DATE '{NOW[:10]}')),
parts AS (SELECT 0 AS section, 'Today' AS heading, * FROM today UNION ALL SELECT 1, 'Worth doing', * FROM sal WHERE ((entity_type = 'Task' AND status = 'open') OR (entity_type = 'Project' AND status = 'active')) AND entity_id NOT IN (SELECT entity_id FROM today)
  UNION ALL SELECT 2, 'Looks stuck', * FROM sal WHERE attention_debt > 0 UNION ALL SELECT 3, 'Coming up', * FROM sal WHERE status NOT IN ('done', 'dropped', 'abandoned') AND until BETWEEN 0 AND 7),
sel AS (SELECT p.section, p.heading, p.entity_id, coalesce(nm.name, p.entity_id) AS name, p.salience, row_number() OVER (PARTITION BY heading ORDER BY salience DESC, p.entity_id) AS rank FROM parts p LEFT JOIN nm ON nm.entity_id = p.entity_id
  QUALIFY rank <= CASE heading WHEN 'Today' THEN 8 WHEN 'Worth doing' THEN 5 WHEN 'Looks stuck' THEN 3 ELSE 5 END)
"""


def _selection(spark, sf_dir, brief_id):
    rows = salience.daily_sections(_salient(spark, sf_dir), now())
    order = F.coalesce(*[F.when(F.col("heading") == h, F.lit(i)) for i, h in enumerate(salience.DAILY_CAPS)])
    return rows.select(F.lit(brief_id).alias("brief_id"), "heading", order.alias("section"), "rank", "entity_id", F.coalesce("name", "entity_id").alias("name"), "salience")


@query(_SALIENT + _NAMED + """, sx AS (SELECT section, '## ' || heading || chr(10) || string_agg('- ' || name, chr(10) ORDER BY rank, name) AS part FROM sel GROUP BY section, heading)
SELECT 'plain' AS brief_id, string_agg(part, chr(10) || chr(10) ORDER BY section) AS prose, 'none' AS provider, 0 AS mentions FROM sx
UNION ALL SELECT 'invented', string_agg(part, chr(10) || chr(10) ORDER BY section), 'local', 1 FROM sx
UNION ALL SELECT 'kept', 'Nothing but this today.', 'local', 0
UNION ALL SELECT 'quiet', 'Nothing needs your attention.', 'none', 0""")
def composed_briefs(spark, sf_dir):
    selection = _selection(spark, sf_dir, "plain")
    both = selection
    for other in ("invented", "kept"):
        both = both.unionByName(selection.withColumn("brief_id", F.lit(other)))
    wanted = spark.createDataFrame([("plain",), ("invented",), ("kept",), ("quiet",)], "brief_id string")
    said = spark.createDataFrame([("invented", "Remember that Xanthippe Quoxley waits.", "local", "m"), ("kept", "Nothing but this today.", "local", "m"), ("quiet", "Much about Nobody.", "local", "m")], "brief_id string, prose string, provider string, model_version string")
    return briefs.compose(wanted, both, said).select("brief_id", "prose", "provider", F.size("mentions").cast("int").alias("mentions"))


_BRIEFS = "SELECT DISTINCT ON (capture_id) capture_id AS brief_id, source AS kind, source_timestamp AS covers_to, CASE WHEN corrected_text IS NOT NULL THEN ingested_at END AS read_at FROM captures WHERE capture_id IS NOT NULL ORDER BY capture_id, source, source_timestamp, (corrected_text IS NULL), ingested_at"


def _briefs(spark, sf_dir):
    """Notes in place of briefs: a table of briefs isn't among the data."""
    read = F.when(F.col("corrected_text").isNotNull(), F.col("ingested_at"))
    rows = table(spark, sf_dir, "captures").filter("capture_id IS NOT NULL").groupBy("capture_id").agg(F.min(F.struct("source", "source_timestamp", F.col("corrected_text").isNull().alias("n"), "ingested_at", read.alias("read_at"))).alias("r"))
    return rows.select(F.col("capture_id").alias("brief_id"), F.col("r.source").alias("kind"), F.col("r.source_timestamp").alias("covers_to"), F.col("r.read_at").alias("read_at"))


@query(f"SELECT brief_id FROM ({_BRIEFS}) WHERE kind = 'voice' ORDER BY covers_to DESC, brief_id DESC LIMIT 30")
def recent_briefs(spark, sf_dir):
    return briefs.recent(_briefs(spark, sf_dir), "voice").select("brief_id")


@query(f"SELECT count(*) AS unread FROM ({_BRIEFS}) WHERE read_at IS NULL")
def unread_briefs(spark, sf_dir):
    return briefs.unread_count(_briefs(spark, sf_dir))


@query(f"""WITH b AS ({_BRIEFS}), r AS (SELECT capture_id AS brief_id, min(ingested_at) AS first FROM captures GROUP BY 1) SELECT b.brief_id, coalesce(read_at, first)::TIMESTAMP AS read_at FROM b LEFT JOIN r ON r.brief_id = b.brief_id AND kind = 'voice'""")
def briefs_marked_read(spark, sf_dir):
    reads_ = table(spark, sf_dir, "captures").filter("source = 'voice'").select(F.col("capture_id").alias("brief_id"), F.col("ingested_at").alias("read_at"))
    return briefs.mark_read(_briefs(spark, sf_dir), reads_).select("brief_id", F.col("read_at").cast("timestamp_ntz").alias("read_at"))


@query("""WITH be AS (SELECT DISTINCT capture_id AS brief_id, aggregate_id AS entity_id FROM event_log WHERE type = 'EntityCreated'), o AS (SELECT aggregate_id AS entity_id, recorded_at AS opened_at, capture_id AS brief_id, confidence AS salience FROM event_log WHERE type = 'FieldSet' AND recorded_at IS NOT NULL),
c AS (SELECT o.entity_id, opened_at, salience, CASE WHEN (o.brief_id, o.entity_id) IN (SELECT (brief_id, entity_id) FROM be) THEN o.brief_id END AS brief_id FROM o),
f AS (SELECT DISTINCT ON (entity_id, opened_at) * FROM c ORDER BY entity_id, opened_at, brief_id IS NULL, brief_id, salience NULLS FIRST)
SELECT entity_id, opened_at::TIMESTAMP AS opened_at, brief_id, salience FROM f WHERE (entity_id, opened_at) NOT IN (SELECT (aggregate_id, recorded_at) FROM event_log WHERE type = 'FieldCleared' AND recorded_at IS NOT NULL)""")
def recorded_opens(spark, sf_dir):
    log = table(spark, sf_dir, "event_log")
    selected = log.filter("type = 'EntityCreated'").select(F.col("capture_id").alias("brief_id"), F.col("aggregate_id").alias("entity_id"))
    opens = log.filter("type = 'FieldSet' AND recorded_at IS NOT NULL").select(F.col("aggregate_id").alias("entity_id"), F.col("recorded_at").alias("opened_at"), F.col("capture_id").alias("brief_id"), F.col("confidence").alias("salience"))
    stored = log.filter("type = 'FieldCleared'").select(F.col("aggregate_id").alias("entity_id"), F.col("recorded_at").alias("opened_at"))
    return briefs.record_opens(stored, opens, selected).select("entity_id", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"), "brief_id", "salience")


@query("""WITH sel AS (SELECT DISTINCT capture_id AS brief_id, aggregate_id AS entity_id, type AS heading, first(confidence) AS salience FROM event_log WHERE capture_id IS NOT NULL AND type = 'EntityCreated' GROUP BY 1, 2, 3)
SELECT (SELECT count(DISTINCT capture_id) FROM captures WHERE capture_id NOT IN (SELECT capture_id FROM captures WHERE source = 'voice')) AS briefs,
  (SELECT count(*) FROM sel WHERE brief_id IN (SELECT capture_id FROM captures) AND brief_id NOT IN (SELECT capture_id FROM captures WHERE source = 'voice')) AS entities""")
def stored_briefs(spark, sf_dir):
    rows = _briefs(spark, sf_dir)
    selection = table(spark, sf_dir, "event_log").filter("capture_id IS NOT NULL AND type = 'EntityCreated'").select(F.col("capture_id").alias("brief_id"), F.col("aggregate_id").alias("entity_id"), F.col("type").alias("heading"), F.col("confidence").alias("salience"))
    fresh, entities, _ = briefs.put(table(spark, sf_dir, "captures").filter("source = 'voice'").select(F.col("capture_id").alias("brief_id")), selection.limit(0), rows, selection)
    return fresh.agg(F.count(F.lit(1)).alias("briefs")).crossJoin(entities.agg(F.count(F.lit(1)).alias("entities")))  # one row each


@query(_FOLD + """, said AS (SELECT entity_id, field, position, CASE WHEN value LIKE 'd:%' THEN split_part(substr(value, 3), '|', 1) ELSE substr(value, 3) END AS x FROM held WHERE field NOT IN ('name', 'salience')),
l AS (SELECT entity_id, field || ': ' || string_agg(x, '; ' ORDER BY position, x) AS fact FROM said WHERE x <> '' GROUP BY entity_id, field) SELECT entity_id, string_agg(fact, ' | ' ORDER BY fact) AS facts FROM l GROUP BY 1""")
def entity_facts(spark, sf_dir):
    known = briefs.facts(fold.fold_fields(_events(spark, sf_dir)))
    lines = F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return known.select("entity_id", F.array_join(F.array_sort(lines), " | ").alias("facts"))


# ---- the stored projection --------------------------------------------------------------------------------------

_HELD = _FOLD + "SELECT entity_id, field, value, position, event_id FROM held"


def _split_log(spark, sf_dir, parts):
    """The log in a shared folder as files by order of arrival, so that a stream has something to catch up with."""
    from lorefold.streaming.catch_up import shared_folder

    log = table(spark, sf_dir, "event_log")
    bounds = log.filter("position IS NOT NULL").agg(F.percentile_approx("position", [i / parts for i in range(1, parts)], 1000).alias("q")).first()[0] or []  # a few numbers
    folder = shared_folder(spark, "log")
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("position"))), F.lit(0)) if bounds else F.lit(0)
    marked = log.withColumn("arrived", part)
    for i in range(parts):
        marked.filter(F.col("arrived") == i).drop("arrived").coalesce(1).write.mode("append").parquet(folder)
    return folder


@query(_HELD)
def stream_catch_up(spark, sf_dir):
    """Caught up in two batches, each folding only what it touches."""
    from lorefold.streaming.catch_up import catch_up, shared_folder

    base = shared_folder(spark, "catch-up")
    return catch_up(spark, _split_log(spark, sf_dir, 2), f"{base}/state", f"{base}/checkpoint", files_per_batch=1)


@query(_HELD)
def projection_rebuild(spark, sf_dir):
    from lorefold.streaming.catch_up import rebuild, shared_folder

    table(spark, sf_dir, "event_log")
    base = shared_folder(spark, "rebuild")
    return rebuild(spark, f"{sf_dir}/event_log.parquet", f"{base}/state", f"{base}/checkpoint")


@query("SELECT max(position) AS position, false AS is_rebuilding FROM event_log")
def projection_freshness(spark, sf_dir):
    from lorefold.streaming.catch_up import freshness, rebuild, shared_folder

    table(spark, sf_dir, "event_log")
    base = shared_folder(spark, "freshness")
    rebuild(spark, f"{sf_dir}/event_log.parquet", f"{base}/state", f"{base}/checkpoint")
    return freshness(spark, f"{base}/state")


@query(_HELD)
def snapshot_rebuild(spark, sf_dir):
    """Folded from a snapshot at the middle of the log and what came after it."""
    from lorefold.streaming.catch_up import rebuild_from_snapshot, save_snapshot, shared_folder

    log = table(spark, sf_dir, "event_log")
    middle = log.agg(F.percentile_approx("position", 0.5)).first()[0] or 0
    folder = shared_folder(spark, "snapshots")
    early = fold.fold_fields(fold.read_log(log.filter(F.col("position") <= middle)))
    save_snapshot(early, middle, folder)
    return rebuild_from_snapshot(log, folder)




# ---- guards -----------------------------------------------------------------------------------------------------

@query("""SELECT DISTINCT capture_id, CASE WHEN source = 'voice' AND raw_text LIKE 'm%' THEN 'removed' ELSE 'changed' END AS violation FROM captures
WHERE (source = 'voice' AND raw_text LIKE 'm%') OR capture_id IN (SELECT capture_id FROM captures WHERE raw_text LIKE 'a%') AND raw_text LIKE 'a%'""")
def append_only_guard(spark, sf_dir):
    """Captures after some were corrected, which is allowed, some removed and some rewritten, which isn't."""
    stored = table(spark, sf_dir, "captures").select("capture_id", "source", "raw_text", "corrected_text", "content_hash")
    before = stored.withColumn("corrected_text", F.lit(None).cast("string"))
    after = stored.filter(~F.coalesce((F.col("source") == "voice") & F.col("raw_text").startswith("m"), F.lit(False))).withColumn("raw_text", F.when(F.col("raw_text").startswith("a"), F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text")))
    return captures.append_only_violations(before, after, "capture_id", "corrected_text")


@query("""SELECT DISTINCT capture_id, CASE WHEN source = 'voice' THEN '' ELSE 'source' END || CASE WHEN trim(raw_text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) = '' THEN (CASE WHEN source = 'voice' THEN '' ELSE ',' END) || 'text' ELSE '' END AS violations FROM captures WHERE raw_text IS NOT NULL""")
def request_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "captures").filter("raw_text IS NOT NULL").select("capture_id", F.when(F.col("source") == "voice", "voice").otherwise("spoken").alias("source"), F.col("raw_text").alias("text"), F.date_format("source_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_timestamp"))
    return rows.select("capture_id", F.concat_ws(",", captures.request_violations()).alias("violations")).distinct()


@query("""SELECT DISTINCT proposal_id, CASE WHEN capture_id IS NULL OR trim(capture_id) = '' THEN 'capture_id,' ELSE '' END || 'chosen_target_id' AS violations FROM event_log WHERE proposal_id IS NOT NULL""")
def correction_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "event_log").filter("proposal_id IS NOT NULL").select("proposal_id", "capture_id", F.lit("corr-1").alias("correction_id"), F.col("type").alias("chosen_type"), F.lit(" ").alias("chosen_target_id"))
    return rows.select("proposal_id", F.concat_ws(",", writing.correction_violations()).alias("violations")).distinct()
