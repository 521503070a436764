"""Role repair against a search over every legal rendering."""

import heapq
import itertools

from skyframe.llm.chat_repair import ASSISTANT, INSERT, MERGE, RELABEL, ROLES, SYSTEM, USER, format_chats

NEXT = {None: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
CODES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT, "bot": None}


def cheapest(roles):
    """By Dijkstra: write turns one at a time, each the next input turn under some role, its merger into the last, or an empty one."""
    heap, seen = [(0, 0, None, 0)], set()
    tie = itertools.count(1)
    while heap:
        cost, _, last, at = heapq.heappop(heap)
        if (last, at) in seen:
            continue
        seen.add((last, at))
        if at == len(roles) and last in (None, ASSISTANT):
            return cost
        for role in NEXT[last]:
            if role != SYSTEM:  # an empty system turn is never of use
                heapq.heappush(heap, (cost + INSERT, next(tie), role, at))
            if at < len(roles):
                heapq.heappush(heap, (cost + RELABEL * (CODES[roles[at]] != role), next(tie), role, at + 1))
        if at < len(roles) and last is not None:
            heapq.heappush(heap, (cost + MERGE + RELABEL * (CODES[roles[at]] != last), next(tie), last, at + 1))
    raise AssertionError


def test_all_short_conversations(spark):
    every = [roles for n in range(1, 7) for roles in itertools.product(("system", "user", "assistant"), repeat=n)]
    every += [roles for roles in itertools.product(CODES, repeat=4) if "bot" in roles]
    rows = [(c, k, role, f"text{k}") for c, roles in enumerate(every) for k, role in enumerate(roles)]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    assert len(by) == len(every)
    for c, roles in enumerate(every):
        assert sum(r.cost for r in by[c]) == cheapest(roles), roles
        text = "".join(r.rendered for r in by[c])
        # the template read back: legal roles in turn, and every text once, in order
        read = [t.split("|>\n", 1)[0].removeprefix("<|") for t in text.split("<|end|>\n") if t]
        names = read[1:] if read[0] == "system" else read
        assert names == [ROLES[1 + k % 2] for k in range(len(names))] and len(names) % 2 == 0 and names
        assert [w for w in text.replace("<", " <").split() if w.startswith("text")] == [f"text{k}" for k in range(len(roles))]


def test_repeated_and_null_turn_numbers(spark):
    rows = [(1, None, "user", f"u{k}") for k in range(1500)] + [(1, 5, "assistant", "a")] * 700 + [(None, None, None, None)] * 3
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    mine = [r for r in got if r.conv_id == 1]
    assert sorted(r.place for r in mine) == list(range(2200))
    assert sum(r.cost for r in mine) == (1499 + 699) * MERGE
