"""Notes of events: props are parsed once, whatever reads the notes."""

from __future__ import annotations

from lineweave.sources.events import notes_of

SF = "/root/testdata/sf0.001"


def test_props_are_not_parsed_again(spark):
    notes = notes_of(spark.read.parquet(f"{SF}/events.parquet"))
    assert "get_json_object" not in notes._jdf.queryExecution().optimizedPlan().toString()
    assert notes.count() > 0
