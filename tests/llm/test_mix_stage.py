"""The mixing stage on a skewed corpus: every source gets its words, long documents as well as short ones."""

import random
from collections import Counter

import corpus_pipeline
from corpusloom.llm import mixing


def targets(rows):
    """Shares of all words by weights 1, 2, 3, 1, ...; a source that reaches its limit leaves the rest to the others."""
    sizes = Counter()
    for _, source, _, size in rows:
        sizes[source] += size
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    found, left = {}, sum(sizes.values())
    while True:
        level = left / sum(weights.values())
        full = [s for s in weights if level * weights[s] >= mixing.MAX_REPEATS * sizes[s]]
        if not full:
            return found | {s: level * w for s, w in weights.items()}
        for s in full:
            found[s] = mixing.MAX_REPEATS * sizes[s]
            left -= found[s]
            del weights[s]


def test_sources_keep_their_targets(spark):
    draw = random.Random(5)
    rows = []
    for i in range(2400):
        source = "a-hot" if i % 3 == 0 else f"s{i % 19:02d}"
        size = draw.choice([20, 60, 300, 1200])
        rows.append((i if i % 50 else None if i % 100 else 7, source, " ".join(f"w{i}x{k}" for k in range(size)), size))
    rows += [(-1, None, "of no source " * 90, 270), (-2, "s01", None, 0), (-3, "s02", " ", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").repartition(5)
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    times = Counter((r.source, r.text) for r in out)
    assert set(map(tuple, out)) <= set(rows) and max(times.values()) <= mixing.MAX_REPEATS
    words, longest, kept, there = Counter(), Counter(), Counter(), Counter()
    for _, source, text, size in rows:
        words[source] += times[source, text] * size
        longest[source] = max(longest[source], size)
        there[source, size] += size
        kept[source, size] += times[source, text] * size
    for source, target in targets(rows).items():
        # the longest document, a seat that the quotas round and a short last block
        assert abs(words[source] - target) <= longest[source] + (2 + mixing.MAX_REPEATS) * mixing.BLOCK_WORDS, source
    # the hot source is cut to a small part, of which its long documents get their share
    ratio = words["a-hot"] / sum(there["a-hot", s] for s in (20, 60, 300, 1200))
    assert ratio < 0.3
    for size in (300, 1200):
        assert 0.5 * ratio < kept["a-hot", size] / there["a-hot", size] < 1.5 * ratio
    ids = Counter(r.doc_id for r in out)
    assert ids[None] > 0 and ids[7] > 0


def test_same_rows_in_any_layout(spark):
    docs = spark.createDataFrame([(i % 300 or None, f"s{i % 4}", f"word{i} " * (i % 400)) for i in range(900)], "doc_id long, source string, text string")
    first, second = (Counter(map(tuple, corpus_pipeline.mix_sources(spark, docs.repartition(n), "").collect())) for n in (1, 7))
    assert first == second and sum(first.values()) > 100
