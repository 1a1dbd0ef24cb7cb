import random

from ledgerline.llm.components import connected_components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_of_paths_hubs_and_odd_links(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    rng.shuffle(chain)
    hub = [(1000, k) for k in range(1001, 1200)] + [(5, 1100)]
    others = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    edges = chain + hub + others + others[:5] + [(7, 7), (None, 3), (4, None), (-9, 9), (9, -8)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = [(r["id"], r["component"]) for r in connected_components(df).collect()]
    assert dict(got) == brute(edges) and len(got) == len(dict(got))
    assert connected_components(df.limit(0)).count() == 0
