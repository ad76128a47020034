"""The pipeline's stages against brute force at the smallest scale."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, language, simhash_dedup

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def classes(texts):
    """For each text the place of the first text that links of five-word similarity 0.8 or more reach."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, "x", 0), (10_002, "123 !!", "en", "x", 0), (10_003, "", "en", "x", 0)], docs.schema)
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def step(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = step("language", docs)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    before = {r.doc_id: r.text for r in kept.collect()}
    kept = step("exact_dedup", kept)
    last = {t: i for i, t in sorted(before.items())}
    assert {r.doc_id for r in kept.collect()} == set(last.values())
    before = {r.doc_id: r.text for r in kept.collect()}
    kept = step("near_dedup", kept)
    ids = sorted(before)
    least = classes([before[i] for i in ids])
    assert {r.doc_id for r in kept.collect()} == {i for k, i in enumerate(ids) if least[k] == k} and len(set(least)) < len(ids)
    before = {r.doc_id: r.text for r in kept.collect()}
    kept = step("decontamination", kept)
    bench = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in kept.collect()} == {i for i, t in before.items() if not bench.search([t])[0]}
    assert kept.columns == corpus_pipeline.COLUMNS
    packed = step("packing", kept)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_language_is_learned_from_all_documents(spark, monkeypatch):
    """Profiles and the least score are those of every document of known language that is not held out, not of 3,000 of them."""
    r = random.Random(8)
    vocab = {"en": "abcdefghijklm", "de": "klmnopqrstuvw"}
    text = lambda strange, letters, n: " ".join("".join(chr(r.randint(0x4E00, 0x9000)) if r.random() < strange else r.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, text(r.choice((0, 0, 0, 0.3, 0.6)), vocab[k], r.randint(3, 8)), k) for i in range(9000) for k in [("en", "de")[i % 2]]]
    rows += [(10_000 + i, text(i / 600, vocab["en"], 12), None) for i in range(600)] + [(20_000, None, "en"), (20_001, "1 2", "en"), (None, "abc klm", "en")]
    docs = spark.createDataFrame([(i, t, k, "x", 0) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(t, k) for i, t, k in rows if k and t and not held(i)]
    models = {}
    for lang in vocab:
        codes, counts = np.unique(np.concatenate([language.grams(t) for t, k in learned if k == lang]), return_counts=True)
        models[lang] = codes[np.lexsort((codes.view(np.int64), -counts))][: language.PROFILE]
    ranker = language.Ranker(models)
    scores = sorted(s for found, s in (ranker.predict(t) for t, _ in learned) if found != "und")
    least = scores[(len(scores) - 1) // 1000] / 2
    own = [(i, ranker.predict(t)[1]) for i, t, _ in rows]
    want = sorted(str(i) for i, s in own if s > 0 and s >= least)
    assert 20 < len(rows) - len(want) < 580
    monkeypatch.setattr(language, "AT_ONCE", 1000)
    monkeypatch.setattr(language, "BINS", 64)
    got = language.learn(docs, sample=None)
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in models.items()}
    assert language.least_score(docs, got) == least
    assert sorted(str(x.doc_id) for x in dict(corpus_pipeline.STAGES)["language"](spark, docs, SF).collect()) == want


def test_quantile_is_exact(spark):
    """Against sorting: skewed, repeated, equal, very close, single and missing values."""
    r = random.Random(4)
    for values in ([r.random() ** 9 for _ in range(5000)], [r.choice((0.0, 0.1, 1e-300)) for _ in range(2000)], [0.5] * 1500, [0.3, np.nextafter(0.3, 1)] * 1000, [0.0, 5e-324] * 999, [0.7], [0.2, None, None]):
        there = sorted(float(v) for v in values if v is not None)
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
        assert language.least_reached(df, "x") == there[(len(there) - 1) // 1000]
    assert language.least_reached(df.limit(0), "x") is None


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def prose(r, n):
    return " ".join(str(r.randint(0, 10**6)) for _ in range(n))


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Every pair of five-word similarity 0.8 or more is linked, and nothing else."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = [None, "", "  \n", "one two", "one two", "one two three", "Ü b c d e", "ü b c d e"]
    line = " ".join(word() for _ in range(12))
    for n in (5, 9, 14, 30, 60, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(5):
                copy = list(base)
                for _ in range(r.choice((1, 1, 2, 3, 4, n // 30))):
                    copy[r.randrange(len(copy))] = word()
                texts.append(" ".join(copy[: len(copy) - r.choice((0, 0, 1, n // 8))]))
    texts += [line + " " + " ".join(word() for _ in range(r.choice((1, 2, 3, 20)))) for _ in range(60)]
    for k in range(3):  # large groups, whose sets take several tiles
        base = [word() for _ in range(80)]
        for _ in range(60):
            texts.append(" ".join(word() if r.random() < 0.02 + 0.02 * k else w for w in base))
    monkeypatch.setattr(simhash_dedup, "TILE_SETS", 16)
    monkeypatch.setattr(simhash_dedup, "TILE_SHINGLES", 3000)
    monkeypatch.setattr(simhash_dedup, "PART", 7)
    long = prose(r, 30_000)
    texts += [long, long + " end", "x" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, "one two"), (3, "one two")]
    root = classes([t for _, t in rows])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    far = sum((simhash_dedup.fingerprint(rows[k][1]) ^ simhash_dedup.fingerprint(rows[x][1])).bit_count() > 2 for k, x in enumerate(root) if k != x)
    assert far > 50
    docs = frame(spark, rows).withColumn("_row", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = sorted((str(x.doc_id), x.component_id) for x in simhash_dedup.similar_texts(docs).collect())
    assert got == sorted((str(i), least.get(root[k])) for k, (i, _) in enumerate(rows))
    kept = sorted((str(x.doc_id) for x in simhash_dedup.one_of_each(docs).collect()))
    assert kept == sorted({str(i) for k, (i, _) in enumerate(rows) if i is not None and least[root[k]] == i})
    assert simhash_dedup.similar_texts(docs.limit(0)).count() == 0


def test_rows_with_repeated_ids(spark):
    """No unique text is lost, of equal rows one stays, and null ids do not keep copies."""
    rows = [(1, "aaa bbb"), (1, "unique text here"), (2, "aaa bbb"), (5, "same row"), (5, "same row"), (None, "aaa bbb"), (None, "nobody's text"), (None, "nobody's text"), (7, None), (8, "")]
    docs = frame(spark, rows).withColumn("clash", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    got = sorted((str(x.doc_id), x.text or "") for x in stages["exact_dedup"](spark, docs, SF).collect())
    assert got == sorted([("1", "unique text here"), ("2", "aaa bbb"), ("5", "same row"), ("None", "nobody's text"), ("8", "")])
    base = [f"w{k}" for k in range(60)]
    near = [" ".join([*base[:k], "other", *base[k:]]) for k in range(0, 60, 20)]
    rows = [(1, near[0]), (1, "completely other words in this one"), (2, near[1]), (None, near[2]), (3, near[2]), (4, "alone"), (4, "alone"), (None, "no id no copy"), (9, None), (9, "")]
    got = sorted((str(x.doc_id), x.text or "") for x in stages["near_dedup"](spark, frame(spark, rows), SF).collect())
    assert got == sorted([("1", near[0]), ("1", "completely other words in this one"), ("4", "alone"), ("None", "no id no copy"), ("9", "")])
