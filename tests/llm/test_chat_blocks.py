"""Conversations whose turn numbers are repeated or null are cut into bounded blocks and repaired as one."""

import random

from skyframe.llm import chat_repair
from skyframe.llm.chat_repair import START, format_chats, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def test_repeated_and_null_turns(spark, monkeypatch):
    rng = random.Random(5)
    turn = lambda: rng.choice([None, *range(11)])
    rows = [(conv, turn(), rng.choice(["user", "assistant", "system", None]), f"t{rng.randrange(9)}") for conv in (None, 1) for _ in range(4000)]
    rows += [(2, None, "user", "same")] * 3000 + [(3, 0, "user", "a")]
    sizes, written = [], chat_repair.materialize

    def spy(df, tag):
        out = written(df, tag)
        sizes.extend(r[0] for r in out.selectExpr("size(turns)").collect())
        return out

    monkeypatch.setattr(chat_repair, "materialize", spy)
    got = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and sum(sizes) == len(rows) and max(sizes) <= chat_repair.BLOCK
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:2]) + tuple((x is not None, x or "") for x in r[2:])
    for conv in (None, 1, 2, 3):
        want = sorted((r for r in rows if r[0] == conv), key=key)
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0, r.place))
        assert [r.place for r in mine] == list(range(len(want))) and [r.turn for r in mine] == [r[1] for r in want]
        assert all(w[3] in r.rendered for r, w in zip(mine, want))
        ways = [(sum(c for *_, c in repair([r[2] for r in want], START, leave)) + int(chat_repair.END[leave])) for leave in (1, 2, 3) if not (leave == 1 and len(want) > 1)]
        assert sum(r.cost for r in mine) == min(ways)
