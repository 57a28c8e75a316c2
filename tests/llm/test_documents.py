"""The document operators against brute force on a small table with the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, pu_quality, rules, setsketch, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(3000)]

    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    shared, base = text(70), text(200)
    rows = []
    for i in range(60):
        body = text(rnd.randint(20, 200))
        if i % 6 == 0:
            body = f"{body} {shared}\n{text(30)}"
        if i % 7 == 0:  # near copies with one to nine edits
            w = base.split()
            for _ in range(i // 7 + 1):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            body = " ".join(w)
        rows.append((i, body, rnd.choice(["en", "de", None]), f"s{i % 4}" if i % 9 else None, len(body)))
    rows += [(100, rows[3][1], "en", "s1", 1), (101, rows[3][1].upper(), "en", "s1", 1), (102, None, None, None, None), (103, "", "en", "s0", 0), (104, " \n\t ", "en", "s0", 4)]
    rows += [(105, "one two", "en", "s0", 7), (106, "One  TWO", "en", "s0", 8), (107, "x " * 5000, "en", "s2", 10000), (108, "x " * 5000, "de", "s2", 10000), (109, "\x1c\x85 \xa0", "en", "s0", 4)]
    rows += [rows[8], rows[8], (None, rows[6][1], "en", "s0", 3), (110, shared, "en", "s3", 1)]
    return rows


def frame(spark, rows):
    clash = ["id", "hash", "score", "size", "shard", "word", "component", "band", "end"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in clash})


def words(text):
    return WORDS.findall(text or "")


def test_substring(spark):
    rows = corpus()
    got = sorted(map(tuple, substring.dedup_digest(frame(spark, rows), 50).collect()), key=str)
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            w = words(text)
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, doc_id), doc_id)
    want = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = set()
        if doc_id is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < doc_id:
                    gone |= set(range(k, k + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert substring.dedup_digest(frame(spark, rows).limit(0), 50).count() == 0


def test_substring_texts_keep_columns(spark):
    docs = frame(spark, corpus())
    out = substring.dedup_texts(docs, 50)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert 108 not in kept and kept[102] is None and kept[3] == dict((r[0], r[1]) for r in corpus())[3]


def test_automaton_spans():
    a = substring.SuffixAutomaton()
    a.add(b"a b c d e f".split(), 1)
    a.add(b"x b c y d e f".split(), 2)
    assert a.spans(b"q a b c d q d e f".split(), 3, 9) == [(1, 5), (6, 9)]
    assert a.spans(b"b c y d".split(), 3, 2) == []
    assert a.spans(b"b c y d".split(), 3, 3) == [(0, 4)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = corpus()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(frame(spark, rows), size, percent).collect()}

    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [(r[0], shingles(r[1])) for r in rows]
    group = {d: d for d, _ in sets if d is not None}

    def root(x):
        return x if group[x] == x else root(group[x])

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    want = {(d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets}
    assert got == want
    assert len({c for _, _, c, _ in got}) < len(group)
    assert setsketch.near_duplicates(frame(spark, rows).limit(0), size, percent).count() == 0


def test_unsettled_buckets_are_compared_exactly(spark):
    """A star of one text that links all copies, with copies that don't reach each other."""
    rnd = random.Random(1)
    base = [str(i) for i in range(300)]
    rows = [(50, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for k in rnd.sample(range(300), 7 if i % 2 else 13):
            w[k] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(298)} for d, t in rows}
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert got == group


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    both = np.union1d(a, b)
    assert (setsketch.sketch(both) == np.maximum(setsketch.sketch(a), setsketch.sketch(b))).all()
    found = setsketch.estimate(setsketch.sketch(both)[None], setsketch.sketch(a)[None], np.array([1200.0]), np.array([900.0]))
    assert abs(found[0] - 0.75) < 0.1


def test_rules(spark):
    rows = corpus()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept and r.base_failed) for r in rules.weak_quality(frame(spark, rows)).collect())
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = words(text)
        seen, lines, repeated = {}, set(), set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                repeated |= {k + j for k in places for j in range(3)}
        dup = 0
        for line in text.split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        want.append((str(doc_id), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w), False))
    assert got == sorted(want)
    assert rules.weak_quality(frame(spark, rows).limit(0)).count() == 0


def test_label_model_finds_accurate_rules():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < p, np.where(good, 1, -1), np.where(good, -1, 1)) for p in (0.95, 0.9, 0.85, 0.6)], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy, prior = rules.label_model(patterns, counts.astype(float))
    assert ((posterior[back.ravel()] >= 0.5) == good).mean() > 0.9 and accuracy[0] > accuracy[3] and abs(prior - 0.7) < 0.1


def test_posterior_equals_em_over_documents(spark):
    """The same EM written out over documents one by one, and the verdict that follows from it."""
    rows = corpus() * 2
    names = list(rules.votes())
    counted = rules.text_features(frame(spark, rows), ["doc_id"]).select("*", *[c.alias(n) for n, c in rules.votes().items()]).collect()
    docs = [[r[n] for n in names] for r in counted]
    prior, n = 0.7, len(docs)
    spoken = [sum(d[k] != 0 for d in docs) / n for k in range(len(names))]
    start = [[{-1: b * s, 0: 1 - s, 1: (1 - b) * s} for s in spoken] for b in (0.4, 0.02)]
    start = [[{v: max(x, 1e-6) / sum(max(y, 1e-6) for y in r.values()) for v, x in r.items()} for r in side] for side in start]
    rate = start
    for _ in range(500):
        good = []
        for d in docs:
            odds = prior / (1 - prior)
            for k, v in enumerate(d):
                odds *= rate[1][k][v] / rate[0][k][v]
            good.append(odds / (1 + odds))
        rate = []
        for side in (0, 1):
            weight = [g if side else 1 - g for g in good]
            mass = [{v: sum(w for w, d in zip(weight, docs, strict=True) if d[k] == v) + start[side][k][v] for v in (-1, 0, 1)} for k in range(len(names))]
            rate.append([{v: x / sum(m.values()) for v, x in m.items()} for m in mass])
        prior = min(max(sum(good) / n, 0.001), 0.999)
    want = {}
    for r, g in zip(counted, good, strict=True):
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        want.setdefault((r.doc_id, r.n_words, r.word_chars), (g, not failed and g >= 0.5))
    got = rules.weak_quality(frame(spark, rows)).collect()
    assert len(got) == len(rows) and any(r.kept for r in got) and not all(r.kept for r in got)
    for r in got:
        g, kept = want[r.doc_id, r.n_words, r.word_chars]
        assert abs(r.quality - g) < 1e-4 and r.kept == kept


def test_mixing(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = mixing.mix(docs, block_words=16, shard_words=500).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), len(words(r[1]))) for r in rows)
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + len(words(r[1]))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order)
    while True:
        left = sum(by.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * by[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * by[s] for s in full}
        open_ -= full
    sizes = {(round(target[s], 6), by[s]) for s in order}
    assert {(round(r.target, 6), r.source_size) for r in got} == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for t, n in sizes:
        taken = sum(r.taken for r in got if (round(r.target, 6), r.source_size) == (t, n))
        assert abs(taken - t) <= max(0.03 * t, 200)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block_words=16, shard_words=500).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sainte_lague_equals_highest_quotients(spark):
    rnd = random.Random(2)
    for seats in (1, 7, 100, 1003):
        claims = [(g, i, round(rnd.random() ** 3 * 100, 3)) for g in ("a", "b") for i in range(9)]
        df = spark.createDataFrame(claims, "g string, i int, claim double").withColumn("seats", F.lit(seats).cast("long"))
        got = {(r.g, r.i): r.quota for r in mixing.sainte_lague(df, "claim", "seats", ["g"], ["i"]).collect()}
        for g in ("a", "b"):
            mine = {i: c for h, i, c in claims if h == g}
            won = dict.fromkeys(mine, 0)
            for _ in range(seats):
                won[max(mine, key=lambda i: (mine[i] / (2 * won[i] + 1), -i))] += 1
            assert {i: got[g, i] for i in mine} == won


def test_lattice_equals_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "bab", "▁ab"]
    table = np.random.default_rng(0).random((7, 2))
    lattice = langid.Lattice(pieces, table)

    def total(word, k, at=0):
        text = "▁" + word
        if at == len(text):
            return 1.0
        s = sum(table[i, k] * total(word, k, at + len(p)) for i, p in enumerate(pieces) if text.startswith(p, at))
        return s + (langid._OTHER * total(word, k, at + 1) if text[at] not in pieces else 0)

    for word in ("ab", "abab", "axb", "", "bbbbb"):
        assert np.allclose(lattice.log_probabilities([word, "a"])[0], [np.log(total(word, k)) for k in (0, 1)])
    for long in ("ab" * 500, "axbab" * 60 + "b"):
        want = lattice.log_probabilities([long])[0]
        assert np.isfinite(want).all()
        for step in (7, 33, 100, 4096):
            assert np.allclose(lattice.log_probability(long, step), want)


def test_language_equals_brute_force(spark):
    """Training, score and verdict written out by recursion, over words, marks and a long run without white space."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [("the cat, the dog", "en"), ("der hund und die katze", "de"), ("theansweris" * 40, "en"), ("½ ² 12", "en"), ("ﬁn é", "fr"), ("¡qué!", None), (None, "en")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts * 3)], "doc_id long, text string, lang string")
    pieces = langid.vocabulary(path)
    languages, table, prior = langid.train(docs, pieces)
    known = [(t, lang) for i, (t, lang) in enumerate(texts * 3) if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    assert languages == sorted({lang for _, lang in known})
    assert np.allclose(np.exp(prior), [sum(k == lang for _, lang in known) / len(known) for k in languages])
    at = {p: i for i, p in enumerate(pieces)}
    counts = {}
    for t, lang in known:
        for w in set(langid.normal_words(t)):
            for j in range(0, len(w), 30):
                counts[w[j : j + 30], lang] = counts.get((w[j : j + 30], lang), 0) + 1
    want = np.full((len(pieces), len(languages)), 1 / len(pieces))

    def arcs(text):
        return [(i, j, at[text[i:j]]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in at] + [(i, i + 1, None) for i in range(len(text)) if text[i] not in at]

    def forward(text, p):
        total = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            total[j] = sum(total[i] * p(k) for i, e, k in arcs(text) if e == j)
        return total

    for _ in range(langid.ROUNDS):
        seen = np.zeros_like(want)
        for (w, lang), n in counts.items():
            text, column = "▁" + w, languages.index(lang)

            def p(k, column=column):
                return langid._OTHER if k is None else want[k, column]

            ahead = forward(text, p)
            back = [0.0] * len(text) + [1.0]
            for i in range(len(text) - 1, -1, -1):
                back[i] = sum(p(k) * back[e] for s, e, k in arcs(text) if s == i)
            for s, e, k in arcs(text):
                if k is not None:
                    seen[k, column] += n * ahead[s] * p(k) * back[e] / ahead[-1]
        want = (seen + 0.01) / (seen.sum(0) + 0.01 * len(pieces))
    assert np.allclose(table, want)

    rows = {r.doc_id: r for r in langid.identify(docs, path).collect()}
    lattice = langid.Lattice(pieces, want)
    for i, (t, _) in enumerate(texts * 3):
        if t is None or not any(c.isalpha() for c in t):
            assert rows[i].lang_pred == "und" and rows[i].score == 0
            continue
        total = prior + sum(lattice.log_probabilities([w])[0] for w in langid.normal_words(t))
        assert "".join(langid.normal_words(t)) == "".join(t.lower().split())  # every character counts
        assert rows[i].lang_pred == languages[int(total.argmax())]
        assert abs(rows[i].score - 1 / np.exp(total - total.max()).sum()) < 1e-9


def test_language(spark):
    import public_tokenizers

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "12 34 --"), (5003, "the " * 3000), (None, "und das ist die")], "doc_id long, text string")
    docs = d.select("doc_id", "text", "lang").unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    got = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 1005 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (5000, 5001, 5002))
    truth = {r.doc_id: r.lang for r in d.collect()}
    held = [i for i in truth if rows[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == rows[i].held_out for i in truth)
    assert np.mean([truth[i] == rows[i].lang_pred for i in held]) > 0.98
    assert langid.identify(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("module,label,threshold", [(toxicity, "toxic", 0.5), (pu_quality, "quality", 0.3)])
def test_classifiers(spark, module, label, threshold):
    path = "/root/testdata/sf0.1/"
    known = spark.read.parquet(path + "labels.parquet")
    docs = spark.read.parquet(path + "documents.parquet").join(known, "doc_id").select("doc_id", "text").limit(3000)
    odd = spark.createDataFrame([(90000, None), (90001, ""), (None, "x")], "doc_id long, text string")
    run = {toxicity: toxicity.toxicity, pu_quality: pu_quality.quality}[module]
    rows = {r.doc_id: r for r in run(docs.unionByName(odd), known).collect()}
    truth = {r.doc_id: r[label] for r in known.collect() if r.doc_id in rows}
    held = [i for i in truth if rows[i].held_out]
    y, s = np.array([truth[i] for i in held]), np.array([rows[i].score for i in held])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows.values())
    assert run(docs.limit(0), known).count() == 0
    none = run(docs.limit(5), known.limit(0)).collect()
    assert len(none) == 5


def test_one_class_of_labels(spark):
    """Without toxic and other training texts the score is the share of toxic ones."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for toxic in (0, 1):
        labels = docs.select("doc_id", F.lit(toxic).alias("toxic"))
        assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {float(toxic)}


def test_toxic_features_and_weights():
    """Hashed n-grams of a text one by one, and a logistic regression whose gradient vanishes."""
    text = "Du Idiot, geh weg"
    body = f" {text} ".lower()
    want = set()
    for n in toxicity.LENGTHS:
        for i in range(len(body) - n + 1):
            h = ord(body[i])
            for c in body[i + 1 : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            want.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    assert {int(x) for h in toxicity.ngram_hashes(text) for x in h} == want
    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.4) * np.array([2.0, -1.5, 0.5, 1.0, 0.1])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1, 1, 0, 0, 0])))).astype(float)
    weight = np.where(y == 1, 0.5, 2.0)
    w, b = toxicity.logistic(x, y, weight, rounds=5000)
    error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / weight.sum()
    assert np.abs(x.T @ error + 2e-3 * w).max() < 1e-6 and abs(error.sum()) < 1e-6


def test_prior_of_positives():
    """Mixtures of known shares, and one where the unlabelled rows are all positive."""
    rng = np.random.default_rng(6)
    for share in (0.2, 0.6, 0.9, 1.0):
        good = rng.random(4000) < share
        whole = rng.standard_normal((4000, 6)) + np.where(good, 2.0, -2.0)[:, None] * [1, 1, 0, 0, 0, 0]
        trusted = rng.standard_normal((2000, 6)) + [2.0, 2.0, 0, 0, 0, 0]
        assert abs(pu_quality.class_prior(trusted, whole) - share) < 0.06


def test_non_negative_risk():
    """The fitted risk beats that of other scorers, and the fit recovers the classes that only positives were labelled of."""
    rng = np.random.default_rng(7)
    good = rng.random(3000) < 0.4
    whole = rng.standard_normal((3000, 4)) + np.where(good, 1.5, -1.5)[:, None] * [1, 1, 0, 0]
    trusted = rng.standard_normal((1000, 4)) + [1.5, 1.5, 0, 0]

    def risk(w, b):
        def loss(x, side):
            return sum(float(np.log1p(np.exp(-side * (r @ w + b)))) for r in x) / len(x)

        return 0.4 * loss(trusted, 1) + max(0.0, loss(whole, -1) - 0.4 * loss(trusted, -1))

    w, b = pu_quality.fit(trusted, whole, 0.4)
    found = risk(w, b)
    assert all(found <= risk(w + d, b + e) + 2e-3 for d, e in [(np.eye(4)[0] * 0.3, 0), (-np.eye(4)[1] * 0.3, 0), (np.eye(4)[2] * 0.3, 0), (0 * w, 0.3), (0 * w, -0.3)])
    assert ((whole @ w + b > 0) == good).mean() > 0.95


def test_quality_features_and_scores(spark):
    """Counts of a text one by one, whole long words among them, and a score that is the sigmoid of their weighted sum."""
    text = "Ab12 cd! " + "Q" * 70 + "z" * 5 + "\nAb12 cd! x\nAb12 cd! x"
    got = pu_quality.features(text, pu_quality.Shapes(), pu_quality.WordHashes())
    ws = text.split()

    def shape(w):
        out = ""
        for c in w:
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            out += k if not out.endswith(k) else ""
        return zlib.crc32(out.encode()) % pu_quality.ONES

    ones = np.zeros(pu_quality.ONES)
    for w in ws:
        ones[shape(w)] += 1 / len(ws)
    assert np.allclose(got[: pu_quality.ONES] ** 2, ones, atol=1e-6)
    three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    lines = text.split("\n")
    letters = sum(map(len, ws))
    want = [np.log1p(len(ws)) / 8, 1, 1, 1 - len(set(three)) / len(three), 1 - len(set(lines)) / len(lines), letters / len(ws) / 10, 0, 0, np.log1p(len(ws) / 3) / 5, len(set(ws)) / len(ws)]
    assert np.allclose(got[-10:], want, atol=1e-6)
    model = (np.linspace(-1, 1, len(got)), 0.2)
    rows = spark.createDataFrame([(1, text, "clash"), (2, None, None)], "doc_id long, text string, score string").select("doc_id", "text")
    scores = {r.doc_id: r.score for r in pu_quality.score(rows, model, ["doc_id"]).collect()}
    assert abs(scores[1] - 1 / (1 + np.exp(-(got @ model[0] + 0.2)))) < 1e-6 and abs(scores[2] - 1 / (1 + np.exp(-(model[0][-9] + model[0][-8] + 0.2)))) < 1e-6  # no words: fewer than 50 and than 15
