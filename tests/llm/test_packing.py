import random

import numpy as np

from burstframe.llm import packing


def brute_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        if i == len(room):
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return out


def test_tournament_is_first_fit():
    rng = random.Random(8)
    for _ in range(60):
        sizes = sorted((rng.randint(0, 50) for _ in range(rng.randint(1, 80))), reverse=True)
        assert packing.pack(np.array(sizes), 50).tolist() == brute_first_fit(sizes, 50)


def test_containers(spark):
    rng = random.Random(9)
    sizes = [rng.choice([0, 3, 17, 40, 64, 100, 250]) for _ in range(300)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens int, slot string")
    rows = packing.containers(df, "doc_id", 300, capacity=100, group_size=100).collect()
    used, parts = {}, {}
    for r in rows:
        used[(r.pack_group, r.slot)] = used.get((r.pack_group, r.slot), 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part, r.first_token, r.n_tokens))
    assert max(used.values()) <= 100
    for i, n in enumerate(sizes):
        own = sorted(parts[i])
        assert sum(p[2] for p in own) == n and len(own) == max(1, -(-n // 100)) and [p[1] for p in own] == [100 * k for k in range(len(own))]
    assert sum(used.values()) / (100 * len(used)) > 0.9
    assert packing.containers(df.limit(0), "doc_id", 0).count() == 0
    assert packing.fill_report(packing.containers(df, "doc_id", 300, capacity=100)).first().n_tokens == sum(sizes)
