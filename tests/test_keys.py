"""Key events against a replay one by one."""

import random
from datetime import datetime, timedelta

from veilframe.operators import keys as K

KEYS = "key_id long, org_id long, name string, key_suffix string, key_hash string, created_at timestamp_ntz, revoked_at timestamp_ntz, grace_expires_at timestamp_ntz, rotated_from_id long, rate_limit_per_hour int"
EVENTS = "event_id long, kind string, key_id long, org_id long, ts timestamp_ntz, new_key_id long, new_hash string, new_suffix string"


def test_key_table_equals_a_replay(spark):
    rnd = random.Random(4)
    t0 = datetime(2024, 1, 1)
    keys = [(k, k % 3, f"key{k}", f"s{k}", f"h{k}", t0, t0 if k % 7 == 0 else None, t0 if k % 5 == 0 else None, None, k) for k in range(12)]
    events = []
    for i in range(400):
        kind = rnd.choice(["rotate", "revoke", "revoke"])
        # half the events name keys that only a rotation before (or after) them issues
        target = rnd.choice([rnd.randrange(14), 1000 + rnd.randrange(max(1, i)), 3])
        events.append((i, kind, target, rnd.choice([target % 3, 0, 1]), t0 + timedelta(hours=rnd.randrange(200)), 1000 + i, f"nh{i}", f"ns{i}"))
    h = timedelta(minutes=10)  # a chain of three, with events before a link is issued
    events += [(900, "rotate", 1, 1, t0 + h, 5000, "a", "a"), (901, "rotate", 5000, 1, t0 + 2 * h, 5001, "b", "b"), (902, "rotate", 5001, 1, t0 + 3 * h, 5002, "c", "c"),
               (903, "revoke", 5001, 1, t0 + 3 * h, 0, "", ""), (904, "revoke", 5002, 1, t0 + 2 * h, 0, "", ""), (905, "rotate", 5001, 1, t0 + 4 * h, 5003, "d", "d"),
               (906, "revoke", 5002, 2, t0 + 9 * h, 0, "", ""), (899, "rotate", 5000, 1, t0 + h, 5004, "e", "e")]
    table = {k[0]: list(k) for k in keys}
    status = {}
    for e in sorted(events, key=lambda e: (e[4], e[0])):
        i, kind, key, org, ts, new, digest, s = e
        row = table.get(key)
        if row is None or row[1] != org:
            status[i] = 404
        elif kind == "revoke":
            row[6], status[i] = ts, 204
        elif row[7] is not None:
            status[i] = 409
        else:
            row[7], status[i] = ts + timedelta(hours=24), 201
            table[new] = [new, org, row[2] + " (rotated)", s, digest, ts, None, None, key, row[9]]
    got, outcomes = K.apply_key_events(spark.createDataFrame(keys, KEYS), spark.createDataFrame(events, EVENTS))
    assert {r["event_id"]: r["status"] for r in outcomes.collect()} == status
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.values()))
    assert any("(rotated) (rotated)" in r[2] for r in table.values())


def test_no_events_change_nothing(spark):
    keys = spark.createDataFrame([(1, 1, "k", "s", "h", datetime(2024, 1, 1), None, None, None, 5)], KEYS)
    table, outcomes = K.apply_key_events(keys, spark.createDataFrame([], EVENTS))
    assert table.collect() == keys.collect() and outcomes.count() == 0
