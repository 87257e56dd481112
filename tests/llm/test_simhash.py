import random

import numpy as np
import pandas as pd
import xxhash

from colloquy.llm import common, simhash


def brute(rows):
    """Fingerprints one by one, all pairs, union-find."""
    prints = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, f"{p:016x}", least.get(find(i), -1)) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_components_equal_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, " one\n"), (None, "a b c"), (6, "a b c"), (6, "a b c"), (7, "É b")]
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        rows.append((100 + 4 * i, " ".join(text)))
        for k in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((101 + 4 * i + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _fp", "'x' as component_id")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in simhash.components(docs).collect())
    assert got == brute(rows)



def test_long_chain_and_blocks(spark):
    chain = [(1 << k) - 1 for k in range(0, 63, 2)]
    far = [0x5555555555555555, 0x5555555555555555 ^ 3]
    prints = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in chain + far], "_fp long")
    edges = simhash.links(prints, block=3)
    roots = {r.node: r.root for r in simhash.contracted(edges).collect()}
    assert len(set(roots.get(x, x) for x in chain)) == 1
    assert len(set(roots.get(x, x) for x in far)) == 1
    assert roots.get(chain[5], chain[5]) != roots.get(far[0], far[0])


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_fingerprint_of_many_rows(spark):
    rows = [(k, "one two three four") for k in range(1100)] + [(2000, "another text is here"), (2001, "one two three four")]
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[2001] == got[1099] == 0 and got[2000] == 2000


def test_one_component_and_one_star_hold_most_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(common, "HEAVY", 10)
    monkeypatch.setattr(common, "LIGHT", 100)
    star = [(0, i) for i in range(1, 3000)]  # a centre of most links
    chain = [(i, i + 1) for i in range(5000, 5040)]
    edges = spark.createDataFrame([*star, *chain, (9, 9), (2999, 1)], "a long, b long").repartition(5)
    got = {(r.node, r.root) for r in simhash.contracted(edges).collect()}
    assert got == {(i, 0) for i in range(1, 3000)} | {(i, 5000) for i in range(5001, 5041)}
    prints = spark.range(4000).selectExpr("id as doc_id", "if(id < 3000, (id % 60) * 0, id * 1000003) as _fp")
    same = {r.component_id for r in simhash.with_components(simhash.cut(prints)).filter("_fp = 0").collect()}
    assert same == {0}
