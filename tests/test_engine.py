from datetime import datetime

from lorefold.engine import Engine
from tests.parity import DATA


def test_engine_reads(spark):
    engine = Engine(spark, f"{DATA}/sf0.001")
    now = datetime(2026, 6, 1, 12)
    top = engine.rank(now, 3).collect()
    assert len(top) == 3
    assert top[0].salience >= top[-1].salience
    assert engine.entity_view(top[0].entity_id).count() >= 1
    assert engine.entities_of_type("Person").count() > 0
    assert {r.heading for r in engine.daily_brief(now).collect()} <= {"Today", "Worth doing", "Looks stuck", "Coming up"}
    assert engine.search_captures("price table").columns == ["doc_key", "score"]
    assert engine.search_entities("opinion").count() >= 0
    asked = spark.createDataFrame([("m", "Nobody At All", "Person")], "mention_id string, mention_text string, entity_type string")
    assert engine.resolve(asked).first().outcome == "unambiguous"
    assert engine.recover().columns == engine._table("captures").columns
    assert engine.duplicates().columns == ["duplicate_id", "survivor_id", "merged_id", "similarity"]
