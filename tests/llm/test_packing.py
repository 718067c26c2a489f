from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanlode.llm.packing import pack


def boxes(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "item long, size long, container string, k int")
    return pack(df, capacity).collect()


def check(got, sizes, capacity):
    room, parts = {}, {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.size
        parts.setdefault(r.item, []).append((r.part, r.first, r.size))
        assert r.split == ((sizes[r.item] or 0) > capacity)
    assert all(x <= capacity for x in room.values())
    for i, s in enumerate(sizes):
        held = sorted(parts[i])
        assert sum(x[2] for x in held) == max(s or 0, 0) and [x[0] for x in held] == list(range(len(held)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(held, held[1:]))
        assert len(held) == 1 or (s or 0) > capacity
    return room


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 350)), min_size=1, max_size=120))
def test_every_token_has_one_place(spark, sizes):
    check(boxes(spark, sizes, 100), sizes, 100)


def test_fill_and_edges(spark):
    sizes = [(37 * i) % 97 + 1 for i in range(3000)]
    room = check(boxes(spark, sizes, 100), sizes, 100)
    assert sum(room.values()) / (100 * len(room)) > 0.75
    assert boxes(spark, [], 100) == []
    check(boxes(spark, [100, 100, 101, 10_000, 0, -3], 100), [100, 100, 101, 10_000, 0, -3], 100)


def test_small_items_fill_their_containers(spark):
    room = check(boxes(spark, [10] * 2000, 4096), [10] * 2000, 4096)
    assert len(room) == 5
    room = check(boxes(spark, [0] * 3000 + [1] * 5000, 4096), [0] * 3000 + [1] * 5000, 4096)
    assert len(room) == 3
    sizes = [i % 40 + 21 for i in range(20_000)]
    room = check(boxes(spark, sizes, 4096), sizes, 4096)
    assert sum(room.values()) / (4096 * len(room)) > 0.8
