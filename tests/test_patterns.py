"""Groups over shared keys and near-duplicate templates next to plain versions."""

import random
from itertools import combinations

from eventloom.operators import patterns
from eventloom.plans.groups import linked_groups


def closure(nodes, linked):
    root = {v: v for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(nodes, 2):
            if linked(a, b) and root[a] != root[b]:
                low = min(root[a], root[b])
                for v in (a, b):
                    root[v] = low
                changed = True
    return root


def test_linked_groups_of_long_chains_and_stars(spark):
    chain = [(f"c{i:03d}", f"k{i}") for i in range(200)] + [(f"c{i + 1:03d}", f"k{i}") for i in range(200)]
    star = [(f"s{i:03d}", "hub") for i in range(300)]
    rows = [*chain, *star, *star[:9], ("alone", "own"), ("z", "z1"), ("z", "z2")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "node string, key string").repartition(5)
    got = {r["node"]: r["root"] for r in linked_groups(df, "node", "key").collect()}
    want = {n: "c000" for n, _ in chain} | {n: "s000" for n, _ in star} | {"alone": "alone", "z": "z"}
    assert got == want
    assert linked_groups(df.limit(0), "node", "key").collect() == []


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["user", "login", "failed", "from", "<ip>"]) for _ in range(rng.randrange(9))) for _ in range(150)]
    texts += ["", "<num>", "User,login failed", "user login failed", "a b c d", "a b c x", "a b c d e", "a b x d e", "b c d e"]

    def reduced(text):
        w = patterns.WORD.findall(text.lower())
        return {tuple(w)} | ({tuple(w[:i] + w[i + 1 :]) for i in range(len(w))} if len(w) >= 5 else set())

    nodes = sorted(set(texts))
    sets = {t: reduced(t) for t in nodes}
    want = closure(nodes, lambda a, b: bool(sets[a] & sets[b]))
    df = spark.createDataFrame([(t,) for t in [*texts, None, *texts[:20]]], "template string").repartition(4)
    got = patterns.near_groups(df).collect()
    assert {r["template"]: r["pattern_group"] for r in got} == want and len(got) == len(nodes)
    assert want["a b c d e"] == want["a b x d e"] == want["a b c d"] and want["a b c x"] == "a b c x"


def test_variants_of_a_very_long_template():
    words = [f"w{i}" for i in range(20_000)]
    own = set(patterns.variants(words))
    assert len(own) == 20_001
    assert own & set(patterns.variants(words[:7000] + ["other"] + words[7001:]))
    assert not own & set(patterns.variants(words[:7000] + ["other", "more"] + words[7002:]))
