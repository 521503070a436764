"""Small comparing units share a call, large ones have their own."""

import random

from skyframe.llm.near_dedup import CHUNK, _compared, _packed


def test_small_units_share_packs(spark):
    rows = [(u, 10 * u + k, k, 50) for u in range(3000) for k in range(2)] + [(9999, 10**6 + k, k, 50) for k in range(200)]
    packed = _packed(spark.createDataFrame(rows, "unit long, id long, c long, n long")).select("unit", "pack").distinct().collect()
    packs = {r.unit: r.pack for r in packed}
    assert len(packed) == len(packs) == 3001 and packs[9999] == 9999
    assert 1 < len(set(packs.values())) <= 6000 // CHUNK + 1  # once a call for each unit


def test_packs_link_only_within_units(spark):
    rng = random.Random(3)
    texts, open_ = [], []
    for u in range(40):
        body = [f"w{u}x{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(3):
            words = body[:]
            words[30 * (k > 0)] = f"other{u}{k}" if k < 2 else "end"
            texts.append((3 * u + k, " ".join(words if k < 2 else words[::-1])))
            open_.append((u, 3 * u + k, 3, 3 * u + k, 56))
    from skyframe.llm.near_dedup import sketch

    texts = spark.createDataFrame(texts, "id long, text string")
    nodes = sketch(texts, 5).select("id", "n", "f1", "registers")
    open_ = spark.createDataFrame(open_, "key long, id long, size long, c long, n long")
    found = {tuple(sorted((r.a, r.b))) for r in _compared(open_, nodes, texts, 5, 80, False).collect()}
    assert found == {(3 * u, 3 * u + 1) for u in range(40)}
