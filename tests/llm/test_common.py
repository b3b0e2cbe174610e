from __future__ import annotations

import random

import pytest

from sluicework.llm.common import WordMemory, numbered


@pytest.mark.parametrize("group", [["g"], []])
def test_numbers_are_gapless_in_order(spark, group):
    draw = random.Random(2)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.choice([None, 1, 2, 2, 2, draw.randrange(1000)]), i) for i in range(2000)]
    got = numbered(spark.createDataFrame(rows, "g string, k long, slot2 long").repartition(7), ["k"], group, "slot").collect()
    assert len(got) == len(rows) and sorted(r.slot2 for r in got) == sorted(r[2] for r in rows)
    groups = {}
    for r in got:
        groups.setdefault(r.g if group else 0, []).append((r.slot, r.k))
    for held in groups.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held)))
        keys = [(k is not None, k or 0) for _, k in held]
        assert keys == sorted(keys)


def test_numbers_of_an_empty_table(spark):
    assert numbered(spark.createDataFrame([], "g string, k long"), ["k"], ["g"]).count() == 0


def test_word_memory_is_bounded_and_keeps_order():
    made = []

    def make(words):
        made.extend(words)
        return [w.upper() for w in words]

    memory = WordMemory(make, limit=3, longest=4)
    assert memory.over(["a", "b", "a", "abcdef"]) == ["A", "B", "A", "ABCDEF"]
    assert memory.over(["c", "d", "b"]) == ["C", "D", "B"] and made.count("b") == 1
    assert memory.over(["a", "abcdef"]) == ["A", "ABCDEF"] and made.count("a") == 1 and made.count("abcdef") == 2
    for k in range(50):
        memory.over([f"w{k}"])
    assert len(memory.known) + len(memory.older) <= 8
    assert memory.over(["a"]) == ["A"] and made.count("a") == 2 and memory.over([]) == []
