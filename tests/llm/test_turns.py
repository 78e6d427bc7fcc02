"""Turn reassembly against brute force, and against the query's own SQL."""

import hashlib
import random

import duckdb
import pytest

from kgraph.llm.queries import op11_conversation_turns
from kgraph.llm.turns import SQL, reassembled, replayed, smallest

DDL = "conv_id long, turn long, role string, text string"


def brute(rows, batches, idle):
    """Batch by batch, as the contract says it. rows: (batch, conv_id, turn, role, payload)."""
    first, out, kept, quiet, closed, released = {}, [], {}, {}, set(), {}
    for _, c, t, *_ in rows:
        first[c] = min(first.get(c, t), t)
    for b in range(batches + 1):
        now = {}
        for x in sorted(r for r in rows if r[0] == b):
            now.setdefault(x[1], []).append(x)
        for c, arrived in now.items():
            for _, _, t, role, payload in arrived:
                if c in closed:
                    out.append(("reject", c, t, b, payload, None, None, None))
                else:
                    kept.setdefault(c, {}).setdefault(t, (role, payload))
            quiet[c] = 0
            while c not in closed and (t := released.get(c, first[c])) in kept[c]:
                out.append(("release", c, t, b, kept[c][t][1], None, None, None))
                released[c] = t + 1
        for c in sorted(set(kept) - closed):
            quiet[c] += c not in now
            if quiet[c] == idle or b == batches:
                k = kept[c]
                left = [t for t in sorted(k) if t >= released.get(c, first[c])]
                out.append(("close", c, -1, b, None, left, max(k) - first[c] + 1 - len(k), sum(t - 1 in k and k[t - 1][0] == k[t][0] for t in k)))
                closed.add(c)
    return sorted(map(str, out))


def arrivals(rng, batches=9):
    rows = {}
    for c in range(30):
        low, n = rng.choice([0, 0, 5, -3]), rng.choice([1, 2, 4, 9, 40])
        for t in range(low, low + n):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                b = rng.randrange(batches) if rng.random() < 0.3 else min(batches - 1, max(0, rng.randrange(3) + c % 6))
                role = rng.choice(["user", "assistant", ""])
                rows[b, c, t] = (b, c, t, role, f"{role}|{rng.choice(['', 'x', 'é'])}{t}")
    return list(rows.values())


@pytest.mark.parametrize(("seed", "block", "idle"), [(1, 512, 3), (2, 4, 3), (3, 1, 2)])
def test_equals_brute_force(spark, seed, block, idle):
    rows = arrivals(random.Random(seed))
    df = spark.createDataFrame(rows, "batch long, conv_id long, turn long, role string, payload string").repartition(3)
    assert sorted(str(tuple(r)) for r in reassembled(df, 9, idle, block).collect()) == brute(rows, 9, idle)


def test_replay_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "A"), (1, 2, None, None), (None, 0, "user", "a"), (2, None, "user", "a"), (3, 7, "a|b", "c"), (3, 7, "a", "b|c"), (4, -5, "user", "x" * 3_000_000)]
    got = {(r.batch, r.conv_id, r.turn): (r.role, r.payload) for r in replayed(spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS batch", "2 AS payload")).collect()}
    want = {}
    for c, t, role, text in rows:
        if c is None or t is None:
            continue
        h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
        for b, r in [(h % 12, role or "")] + [((h + 3) % 12, "user")] * (h % 7 < 2):
            want[b, c, t] = min(want.get((b, c, t), ("\U0010ffff",) * 2), (f"{r}|{text or ''}", r))
    assert got == {k: (r, p) for k, (p, r) in want.items()}
    assert smallest(spark.createDataFrame([], "batch long, conv_id long, turn long, role string, payload string")).collect() == []


def test_empty_and_query_equal_sql(spark, tmp_path):
    long = [(77, t, "user" if t % 3 else "assistant", f"turn {t}") for t in range(1300) if t != 1100]
    for rows in ([], long):
        spark.createDataFrame(rows, DDL).write.mode("overwrite").parquet(f"{tmp_path}/{len(rows)}/conversations.parquet")
    for folder, files in ((f"{tmp_path}/0", "/*.parquet"), (f"{tmp_path}/1299", "/*.parquet"), ("/root/testdata/sf0.001", "")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{files}'")
        want, got = con.sql(SQL), op11_conversation_turns(spark, folder)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
