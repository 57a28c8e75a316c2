"""Ranked search, decontamination and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm import maxscore, variants, winnow

LETTERS = "abcdefghij"


def rare_and_frequent(rng, n):
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return [words[min(int(rng.expovariate(0.02)), 299)] for _ in range(n)]


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in term.findall((text or "").translate(lower)) if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words,item_terms", [(4_000_000, 100_000), (3000, 20)])
def test_ranked_search(spark, shard_words, item_terms, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(maxscore, "WINDOW", 4096)
    docs = [(i, " ".join(rare_and_frequent(rng, rng.randint(1, 60)))) for i in range(6000)]
    docs += [(7000 + i, docs[3][1].upper()) for i in range(30)] + [(8000, None), (8001, ""), (8002, "..., !"), (None, docs[5][1]), (8003, "Été ÉTÉ été-a_b3"), (8004, " ".join(["aa"] * 70_000)), docs[4]]
    items = [(i, " ".join(rare_and_frequent(rng, rng.randint(1, 40)))) for i in range(25)] + [(25, docs[3][1]), (26, None), (27, "?"), (28, "ÉTÉ b3"), (29, "zzzz"), (None, "aa b3"), (3, "a a a b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as term", "1 as shard").repartition(3)
    index = maxscore.build(frame, shard_words)
    got = maxscore.search(index, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as number"), 10, item_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)


def test_ranked_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert maxscore.search(maxscore.build(empty), items).count() == 0
    assert maxscore.search(maxscore.build(items.withColumnRenamed("item_id", "doc_id")), items.limit(0)).count() == 0


def test_candidates_are_rejected_before_unpacking(spark):
    """A frequent term's blocks stay packed where rare terms decide."""
    texts = [(i, "common " * (1 + i % 3) + ("rare " * 40 if i < 12 else "") + f"x{i}") for i in range(4000)]
    made, unpacked = maxscore._List.block, []
    known, ids = maxscore._Ids(), []
    import numpy as np
    import pandas as pd

    for _, t in texts:
        ids.append(np.array([known[x] for x in maxscore.terms_of(t.encode())], np.int32))
    rows = pd.concat([b.to_pandas() for b in maxscore._packed("0", known, ids, [i for i, _ in texts])])
    total = sum(map(len, ids))
    m = 25 + 75 * np.array([len(x) for x in ids]) * 4000 // total
    lists = {r.term: maxscore._List(r, lambda n: 25 + 75 * n * 4000 // total) for r in rows[rows.term.isin([b"common", b"rare"])].itertuples()}
    maxscore._List.block = lambda self, i, m: unpacked.append((self, i)) or made(self, i, m)
    old, maxscore.WINDOW = maxscore.WINDOW, 512
    try:
        found = maxscore._search(maxscore._Query(0, [b"common", b"rare"], np.array([1, 5000])), lists, m, np.arange(4000), 10)
    finally:
        maxscore._List.block, maxscore.WINDOW = made, old
    assert len(found) == 10 and all(d < 12 for _, d in found)
    assert len({i for own, i in unpacked if own is lists[b"common"]}) < 8 < len(lists[b"common"].last)


def brute_contamination(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    passages = {}
    for item, text in items:
        w = split(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if w else 0):
            passages.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in {len(p) for p in passages}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in passages:
                    hit |= set(range(i, i + m))
                    found |= passages[p]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, short):
    rng = random.Random(3)
    word = lambda: rng.choice(["one", "two", "Three", "été", "4", "five"]) + rng.choice(["", "", "x", "y"])
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 40)))) for i in range(30)]
    items += [(30, items[2][1].upper()), (None, "lone null item of exactly ten words so it has one"), (31, None), (32, "?!"), (2, items[3][1])]
    if short:
        items += [(40, "five words are not ten"), (41, "Solo"), (42, "nine words here make one window of an item")]
    docs = []
    for i in range(200):
        text = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 12)
            text[5:5] = w[a : a + rng.randint(8, 14)] * rng.randint(1, 2)
        docs.append((i, "; ".join(text)))
    docs += [(500 + i, items[1][1]) for i in range(40)] + [(600, None), (601, ""), (None, items[5][1] + ", SOLO five words are not ten"), (None, "nothing"), docs[0], (602, "lone null item of exactly ten words so it has one nine words here make one window of an item solo")]
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "'x' as prints"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as m"))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(docs, items, 10)


def test_contamination_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in winnow.contamination(docs, none).collect()] == [(1, 2, 0, 0)]
    assert winnow.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and distance_one(x, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_variants(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("aeinrté") for _ in range(rng.randint(6, 13))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "b" * 30]
    texts = []
    for s in stems:
        forms = {s: 300}
        for _ in range(25):
            i = rng.randrange(len(s))
            forms[rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("aeix") + s[i:], s[:i] + rng.choice("aeix") + s[i + 1 :]])] = rng.choice([5, 6, 40])
        texts += [w for w, n in forms.items() for _ in range(n)]
    # words that all share both a first half and most of the rest
    texts += [f"crowds{a}{b}tails" for a in "abcdefghijklm" for b in "abcdefghijèÿ" for _ in range(5)] + [f"crowds{a}tails" for a in "abcdefghijklm" for _ in range(30)]
    rng.shuffle(texts)
    docs = [(i, " 1-".join(t if rng.random() < 0.8 else t.upper().replace("É", "é") for t in texts[i * 50 : i * 50 + 50])) for i in range(len(texts) // 50)]
    docs += [(None, "Lonely words, lonely中lonely"), (9000, None), (9001, ""), (9002, "short")] + [docs[1]] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as span")
    want = brute_variants(docs)
    for crowd in (2, 24):
        got = variants.group_variants(frame, crowd=crowd)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] and r[2] != r[1] for r in want)
    assert variants.group_variants(frame.limit(0)).count() == 0


def test_crowded_chunks_make_few_pairs(spark):
    """A first half that all words share isn't paired out."""
    words = [(f"shared{a}{b}{c}{d}", 5) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx" for d in "abcd"]
    vocab = spark.createDataFrame(words, "word string, n long")
    near = variants.near_pairs(vocab).count()
    assert near == len(words) * (7 + 7 + 7 + 3) // 2
