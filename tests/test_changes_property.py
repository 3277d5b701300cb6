"""Random change feeds: views kept from changes equal views of the final table."""

from __future__ import annotations

import random

import pytest

from retally.operators import changelog
from retally.plans import views
from retally.schemas import CHANGE, EVENT
from retally.streaming.store import ViewStore

# The ranges the events are drawn from.
ACTORS = ["USA", "CHN", "FRA", "CHNGOV"]
CODES = ["010", "043", "0841"]
DATES = [19790101, 19800101, 20010101, 20240101, 20240102]


def random_event(rng, key):
    score = None if rng.random() < 0.3 else round(rng.uniform(-10, 10), 2)
    return (
        key,
        rng.choice(DATES),
        rng.choice(ACTORS),
        rng.choice(ACTORS),
        rng.choice(CODES),
        rng.randint(1, 3),
        rng.randint(1, 10),
        rng.randint(1, 4),
        score,
    ) + (None,) * 9


def changed_event(rng, old):
    """The event with new values: sometimes the score only, sometimes other groups."""
    new = list(random_event(rng, old[0]))
    if rng.random() < 0.5:
        new[1:5], new[7] = old[1:5], old[7]
    return tuple(new)


def random_feed(seed, batches, size, start=15):
    """A snapshot batch, then batches of changes; and the table at the end."""
    rng, table, seq = random.Random(seed), {}, 0
    feed = [[]]
    for key in range(start):
        table[key] = random_event(rng, key)
        feed[0].append((seq := seq + 1, "snapshot", None, table[key]))
    next_key = start
    for _ in range(batches):
        batch = []
        for _ in range(rng.randint(0, size)):
            kind = rng.choice(["insert", "update", "delete", "delete"])
            if kind == "insert" or not table:
                table[next_key] = random_event(rng, next_key)
                batch.append((seq := seq + 1, "insert", None, table[next_key]))
                next_key += 1
            elif kind == "update":
                key = rng.choice(sorted(table))
                old, table[key] = table[key], changed_event(rng, table[key])
                batch.append((seq := seq + 1, "update", old, table[key]))
            else:
                key = rng.choice(sorted(table))
                batch.append((seq := seq + 1, "delete", table.pop(key), None))
        feed.append(batch)
    return feed, list(table.values())


@pytest.mark.parametrize("seed", range(4))
def test_views_from_changes_equal_views_of_the_final_table(spark, values, seed):
    feed, final = random_feed(seed, batches=3, size=20)
    table = spark.createDataFrame(final, EVENT)
    frames = [spark.createDataFrame(batch, CHANGE) for batch in feed]
    deltas = None
    for frame in frames:
        one = views.delta(views.signed(frame))
        deltas = one if deltas is None else deltas.unionByName(one)
    everything = spark.createDataFrame([r for batch in feed[1:] for r in batch], CHANGE)
    start = spark.createDataFrame([r[3] for r in feed[0]], EVENT)
    assert values(changelog.apply_changes(start, everything)) == values(table)
    for spec in views.VIEWS.values():
        expected = values(views.full(table, spec))
        assert values(views.from_deltas(deltas, spec)) == expected
        signed = views.entering(start).unionByName(views.signed(everything))
        assert values(views.from_signed(signed, spec)) == expected


def test_store_with_replays_compactions_and_empty_batches(spark, values, folder):
    feed, final = random_feed(11, batches=4, size=12)
    feed.insert(2, [])
    store = ViewStore(spark, folder)

    def apply(number):
        return store.apply(spark.createDataFrame(feed[number], CHANGE), number, "f")

    def all_views():
        return {n: values(v.drop("last_updated")) for n, v in store.views().items()}

    assert apply(0) and apply(1)
    assert not apply(1)
    before = all_views()
    assert store.compact() == 1
    assert store.compact() == 1
    assert all_views() == before
    assert apply(2) and apply(3)
    assert all_views()
    assert store.compact() == 3
    assert not apply(3)
    for number in range(4, len(feed)):
        assert apply(number)
        assert not apply(number)
    table = spark.createDataFrame(final, EVENT)
    for name, spec in views.VIEWS.items():
        assert values(store.view(name).drop("last_updated")) == values(views.full(table, spec))
