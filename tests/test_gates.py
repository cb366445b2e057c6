"""Gates find the violations that are planted for them."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import pit, state
from tidemark.plans import market_queries, product_queries


def test_append_invariance_sees_a_look_ahead(spark, sf, monkeypatch):
    clean = {r.what: r for r in market_queries.append_invariance(spark, sf).collect()}
    assert clean["states"].compared > 0 and clean["states"].differing == 0 and clean["labels"].differing == 0
    honest = state.with_changes

    def leaking(rows, key, idx):
        return honest(rows, key, idx).withColumn("slope", F.lead("slope", 3).over(Window.partitionBy(key).orderBy(idx)))

    monkeypatch.setattr(state, "with_changes", leaking)
    assert {r.what: r.differing > 0 for r in market_queries.append_invariance(spark, sf).collect()}["states"]


def test_causality_gates_see_a_choice_that_was_not_known(spark, sf, monkeypatch):
    assert all(r.passed for r in product_queries.causality_gates(spark, sf).collect() if r.gate.endswith("twice"))

    def careless(observations, sessions, formal_only=True):
        rows = observations.where("vintage_kind <> 'PROVIDER_BACKTESTED'").join(sessions.select("session_date"), "session_date")
        return pit.latest_row(rows, ["series_id", "session_date"], ["ingested_at", "revision_id"], ["revision_id"])

    monkeypatch.setattr(pit, "known_at_decision", careless)
    found = {r.gate: r for r in product_queries.causality_gates(spark, sf).collect()}
    assert found["revisions chosen twice"].violations > 0 and not found["revisions chosen twice"].passed
