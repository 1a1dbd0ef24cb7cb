import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import ngram_join as N

DOCS = "doc_id long, text string, key long, component_id string"


def brute_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(b" ".join(words[s : s + k]) for s in range(len(words) - k + 1))


def brute_components(rows):
    """Least doc_id reachable for each row, by all pairs."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), (i if not sets[k] else least.get(root(k)))) for k, (i, _) in enumerate(rows)]


def corpus(seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n\t", "one", "one", "Two words", "two WORDS", "a b c d e", "a b c d e f", "x " * 20_000]
    bases = [[word() for _ in range(rng.choice([7, 20, 60, 150]))] for _ in range(14)] + [passage]
    for base in bases:
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    # A passage that many documents share, with more or less around it.
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 25))]) for _ in range(40)]
    texts += texts[20:40]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    ids[3] = ids[5] = None
    ids[7] = ids[8]
    return list(zip(ids, texts))


@pytest.mark.parametrize("block", [N.BLOCK, 6])
def test_components_equal_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "own") for i, t in rows], DOCS).repartition(4)
    got = [tuple(r) for r in N.jaccard_components(docs, block=block).collect()]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(brute_components(rows), key=order)


def test_one_of_each_group_stays(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(i, t, 1, "own") for i, t in rows], DOCS)
    kept = N.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    groups, wanted = defaultdict(int), defaultdict(int)
    component = {}
    for (i, t), (_, n, c) in zip(rows, brute_components(rows)):
        component[i, t] = (c, n)
        if n == 0:
            wanted["empty", i, t] += 1
        else:
            wanted[c] = 1
    for row in kept.collect():
        c, n = component[row["doc_id"], row["text"]]
        groups[("empty", row["doc_id"], row["text"]) if n == 0 else c] += 1
    assert dict(groups) == dict(wanted)


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    assert N.jaccard_components(docs).count() == 0
    assert N.keep_one_per_group(docs).count() == 0


def test_products_in_small_column_blocks():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    for width in (1, 7, 4096):
        links = N.links_of_blocks(sets[:30], sets[20:], column_block=width)
        for a, x in enumerate(sets[:30]):
            for b, y in enumerate(sets[20:]):
                both = len(np.intersect1d(x, y))
                assert links[a, b] == (100 * both >= 80 * (len(x) + len(y) - both))
