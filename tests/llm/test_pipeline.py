"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import mixing

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-duplicates", "substrings", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns

    def step(name, docs):
        path = str(tmp_path / name)
        stages[name](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path).cache()

    clean = step("toxicity", docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in docs.collect()} - kept
    assert clean.columns == columns and np.mean([i in kept for i, t in labels.items() if not t]) > 0.95
    assert clean.intersect(docs).count() == len(kept) and len(gone) < 0.3 * docs.count()

    unique = step("near-duplicates", clean)
    rows = sorted(clean.select("doc_id", "text").collect())
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[a] != group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == {d for d in group if group[d] == d}

    cut = step("substrings", unique)
    rows = {r.doc_id: r for r in unique.collect()}
    seen, want = set(), {}
    for d in sorted(rows):
        w, gone = words(rows[d].text), set()
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, window in enumerate(own):
            if window in seen:
                gone |= set(range(k, k + 50))
        seen |= set(own)
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone:
            want[d] = (rows[d].text, rows[d].n_chars)
        elif left:
            want[d] = (left, len(left))
    assert cut.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == want

    mixed = step("mixing", cut)
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(cut).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    # whole copies that the mix fills, and at most one more for the rest
    assert mixed.columns == columns and all(times.get(d, 0) - (t // n if n else 0) in ((0, 1) if n and t % n else (0,)) for d, (t, n) in taken.items())
    assert abs(sum(times.get(d, 0) * n for d, (t, n) in taken.items()) - sum(t for t, _ in taken.values())) < 0.05 * sum(t for t, _ in taken.values())

    packed = step("packing", mixed).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.select("text").collect())
    assert sum(p.length for p in packed) == total


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert out.agg(F.max("length")).first()[0] <= 1024


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like the stages' own."""
    clash = ["score", "_toxicity", "_gone", "_id", "_key", "_text", "_times", "_copy", "_row", "_content", "size", "shard", "key", "part", "component_id", "kept"]
    body = " ".join(f"w{i}" for i in range(90))
    rows = [(1, body, "en", "a", 9), (1, body, "en", "a", 9), (1, "another text of the same id", "en", "a", 9), (2, body + " more", "de", None, None), (3, None, None, None, None), (4, "", "en", "b", 0)]
    rows += [(None, "no id " * 30, "en", "b", 180), (None, "no id " * 30, "en", "b", 180), (None, None, None, "b", None), (5, "x " * 60000, "en", "c", 120000), (6, "y" * 60000, "en", "c", 60000), (7, " \n\t ", "en", "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in clash})
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        empty = stage(spark, at.limit(0), SF)
        assert empty.count() == 0 and empty.columns == out.columns
        if name == "packing":
            break
        path = str(tmp_path / name)
        out.write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns and at.filter("score != 'clash' or _row != 'clash'").count() == 0
        held = [(r.doc_id, r.text) for r in at.collect()]
        if name == "toxicity":
            assert sorted(map(str, held)) == sorted(str((r[0], r[1])) for r in rows)  # nothing here is toxic
        if name == "near-duplicates":
            assert {d for d, _ in held} == {1, 3, 4, 5, 6, 7, None} and len(held) == len(rows) - 1
        if name == "substrings":
            assert len([t for d, t in held if d is None]) == 3 and (3, None) in held and (4, "") in held
        if name == "mixing":
            assert any(d is None for d, _ in held) and all(words(t) for _, t in held) and {d for d, _ in held} <= {1, 5, 6, None}
    assert out.agg(F.sum("length")).first()[0] == out.dropDuplicates(["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]).agg(F.sum("length")).first()[0]
