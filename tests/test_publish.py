"""The publication log against the stated rules, one command after another."""

import random

import pytest

from riskgrid.operators import publish
from riskgrid.operators.shared import folder

SCHEMA = "log string, seq bigint, kind string, run_id string, scenario_id string, generation int, config_digest string, model_digest string, planner_digest string, request_id string, revision bigint, plan_id string"


def outcomes(rows):
    """Each log from its whole past, looked up anew for every command."""
    out = []
    for k, row in enumerate(rows):
        past = [r for r in out if r[0] == row[0]]

        def active():
            """Token that the last activation with effect set, and what came after it."""
            effects = [i for i, r in enumerate(past) if r[2] == "activate" and r[-3] == "ok"]
            return (past[effects[-1]][3:11], past) if effects else (None, past)

        token, seen = active()
        fresh = max((i for i, r in enumerate(seen) if r[2] == "activate" and r[-3] == "ok" and all(s[3:11] != r[3:11] for s in [next((x for x in reversed(seen[:i]) if x[2] == "activate" and x[-3] == "ok"), (None,) * 14)])), default=0)
        cancelled = any(r[2] == "cancel" and r[-3] == "ok" for r in seen[fresh:])
        mine = row[3:11]
        current, previous = (past[-1][-2], past[-1][-1]) if past else (None, None)
        if row[2] == "activate":
            same_run = token is not None and token[0] == mine[0]
            if mine == token:
                said = "rejected: cancelled" if cancelled else "ok"
            elif same_run and mine[2] < token[2]:
                said = "rejected: older generation"
            elif same_run and mine[2] == token[2] and mine[7] < token[7]:
                said = "rejected: older revision"
            else:
                said = "ok"
                if token is not None and token[:6] != mine[:6]:
                    current = previous = None
        elif row[2] == "cancel":
            said = "ok" if token == mine else "not active"
        else:
            said = "rejected: nothing active" if token is None else "rejected: stale" if token != mine else "rejected: cancelled" if cancelled else "ok"
            if said == "ok" and current != row[11]:
                current, previous = row[11], current if current is not None else previous
        out.append((*row, said, current, previous))
    return [(r[0], r[1], r[2], *r[-3:]) for r in out]


@pytest.mark.parametrize("seed", range(3))
def test_replay_follows_the_rules(seed, spark):
    r = random.Random(seed)
    rows = []
    for log in range(30):
        tokens = [(r.choice("ab"), r.choice("st"), r.randrange(3), "c", r.choice("mn"), "p", f"q{r.randrange(3)}", r.randrange(3)) for _ in range(4)]
        for seq in range(r.randrange(25)):
            kind = r.choice(["activate", "activate", "cancel", "publish", "publish", "publish"])
            rows.append((f"log{log}", seq, kind, *r.choice(tokens[: 1 + seq // 4]), f"plan{r.randrange(4)}"))
    got = publish.replay(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(outcomes(rows))
    assert {x[3] for x in got} >= {"ok", "not active", "rejected: stale", "rejected: cancelled", "rejected: older generation", "rejected: older revision"}
    assert publish.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_published_tables_replace_each_other(spark):
    root = folder(spark, "test-published")
    with pytest.raises(LookupError):
        publish.published_table(spark, root)
    for k in range(3):
        publish.publish_table(spark.range(k), root)
        assert publish.published_table(spark, root).count() == k
