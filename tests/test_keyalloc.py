"""The distributed allocation equals the sequential rule on random input."""

import random

from glossweave.operators.keyalloc import allocate


def sequential(requests, existing):
    taken, out = set(existing), {}
    for text, base, _ in sorted(requests, key=lambda r: r[2]):
        key, n = base, 2
        while key in taken:
            key, n = f"{base}{n}", n + 1
        taken.add(key)
        out[text] = key
    return out


def check(spark, requests, existing):
    r = spark.createDataFrame(requests, "text string, base string, ord long")
    e = spark.createDataFrame([(k,) for k in existing], "key string")
    got = {x.text: x.key for x in allocate(r, e).collect()}
    assert got == sequential(requests, existing)


def test_random_collisions(spark):
    rng = random.Random(7)
    for _ in range(2):
        names = ["Item", "Item2", "Item22", "Item3", "Save", "Save10", "A0", "A"]
        n = rng.randint(5, 25)
        ords = rng.sample(range(1000), n)
        requests = [(f"t{i}", rng.choice(names), ords[i]) for i in range(n)]
        existing = rng.sample(["Item", "Item2", "Item4", "Item23", "Save", "Save2", "Save3", "Save102", "A02", "A5", "Other"], rng.randint(0, 8))
        check(spark, requests, existing)


def test_hot_base(spark):
    requests = [(f"t{i}", "Hot" if i % 3 else f"Hot{i}", i) for i in range(90)]
    check(spark, requests, ["Hot5", "Hot10", "Hot"])


def test_no_collisions(spark):
    check(spark, [("a", "X", 2), ("b", "Y", 1)], [])


def test_interleaved_order_is_random(spark):
    rng = random.Random(3)
    names = ["Hot"] * 40 + [f"Hot{i}" for i in range(2, 30)] + ["Hot1", "Hot12", "Hot12"]
    ords = rng.sample(range(1000), len(names))
    check(spark, [(f"t{i}", n, ords[i]) for i, n in enumerate(names)], ["Hot7", "Hot122"])
