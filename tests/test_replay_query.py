"""The replay query goes through the engine."""

from cloakwork.operators.engine import Engine
from cloakwork.plans.queries import QUERIES


def test_replays_on_rows_that_were_away(spark, monkeypatch):
    seen, replayed = [], Engine._replayed
    monkeypatch.setattr(Engine, "_replayed", lambda self, own, *a: (seen.append(own.count()), replayed(self, own, *a))[1])
    QUERIES["u4_replay_values"](spark, "/root/testdata/sf0.001")
    assert seen and seen[0] > 0
