"""Near misses of one template: hardly any links, and shared rare shingles everywhere."""

import random

import numpy as np

from corpusloom.llm import setsketch
from corpusloom.llm.common import WordHashes


def pages(count):
    rnd = random.Random(11)
    rows = []
    for i in range(count):
        words = [f"t{k}" for k in range(300)]
        for field in range(14):
            words[20 * field + 9] = f"f{field}v{rnd.randrange(20)}"
        rows.append((i, words))
    for i in range(0, count, 10):  # eight fields changed: linked at 0.85, barely
        words = list(rows[i][1])
        for field in rnd.sample(range(14), 8):
            words[20 * field + 9] = f"x{field}y{i}"
        rows.append((count + i, words))
    return [(i, " ".join(w)) for i, w in rows]


def links(rows, size, percent):
    sets = {i: {tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_candidates_of_a_template(spark):
    """Every link of rows that are given twice is a candidate, and few others are."""
    rows = pages(200)
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(4)
    ids = spark.createDataFrame([(i, i) for i, _ in rows], "id long, component long")
    sets = setsketch._sets(docs, ids.select("id"), 3)
    found = {tuple(r) for r in setsketch._unsettled_pairs(sets, ids, 85).collect()}
    exact = links(rows, 3, 85)
    assert len(exact) >= 20 and exact <= found and len(found) < 2 * len(exact)


def test_near_duplicates_of_a_template(spark):
    rows = pages(100)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    group = {i: i for i, _ in rows}
    for a, b in links(rows, 3, 85):
        low, high = sorted((group[a], group[b]))
        group = {i: low if g == high else g for i, g in group.items()}
    assert got == group


def test_bitmaps_bound_what_sets_differ_in():
    hashes, rnd = WordHashes(), random.Random(3)
    for n in (0, 1, 5, 300, 5000):
        a = setsketch.shingle_hashes(" ".join(str(rnd.randrange(400)) for _ in range(n)), 3, hashes)
        b = np.setxor1d(a, setsketch.shingle_hashes(" ".join(str(rnd.randrange(400)) for _ in range(60)), 3, hashes))
        x, y = (setsketch.parities(s).view(np.uint64) for s in (a, b))
        bits = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0
