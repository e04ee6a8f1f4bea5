"""The corpus pipeline stage by stage."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import shares

from spanveil.llm import decontaminate, mixing, nearcopies, simhash, toxicity, workers

SF = "/root/testdata/sf0.001"


def least_of_groups(rows):
    """The least id of each group that links of 5-gram Jaccard 0.8 or of three fingerprint bits join, all pairs compared."""
    made = [((r.text or "").encode(), r.doc_id) for r in rows]
    sets, prints = [set(nearcopies.shingles(t)[1].tolist()) for t, _ in made], [simhash.fingerprint_text(t) for t, _ in made]
    name = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 3 or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = name[i], name[j]
                name = [min(a, b) if x in (a, b) else x for x in name]
    return sorted(min(d for (_, d), x in zip(made, name) if x == n) for n in set(name))


def test_every_stage_begins_when_executors_have_given_back(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory
    collections = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collections()
    workers.rested(spark)
    assert collections() > before

    class Stop(Exception):
        pass

    def stop(_):
        raise Stop

    monkeypatch.setattr(workers, "rested", stop)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Stop):
            stage(spark, None, SF)


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names
        seen[name] = (before, docs)
    before, after = seen["toxicity"]
    model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.scored(before, model, evidence=False)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.filter("score < 0.5").collect()}
    before, after = seen["neardup"]
    assert sorted(r.doc_id for r in after.collect()) == least_of_groups(before.collect())
    before, after = seen["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find_contamination(before, bench).filter("size(spans) > 0").count() > 0
    assert decontaminate.find_contamination(after, bench).filter("size(spans) > 0").count() == 0
    clean = decontaminate.find_contamination(before, bench).filter("size(spans) = 0").select("doc_id", "text")
    assert clean.exceptAll(after.select("doc_id", "text")).count() == 0
    before, after = seen["mixing"]
    plan = mixing.mixed(before)
    assert sorted((r.doc_id, r["count"]) for r in after.groupBy("doc_id").count().collect()) == sorted((r.doc_id, r.copies) for r in plan.filter("copies > 0").collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in before.collect():
        sizes[r.source] += size(r.text)
    for r in after.collect():
        taken[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s))
    for s, goal in zip(order, shares([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])):
        reach, passes = 1, min(int(goal // sizes[s]), 3)
        for r in before.collect():
            if r.source == s:
                reach |= reach << size(r.text)
        best = max(x for x in range(int(goal) - passes * sizes[s] + 1) if reach >> x & 1)
        assert abs(taken[s] - goal) <= abs(best + passes * sizes[s] - goal) + 1e-6, s
    out = corpus_pipeline.STAGES[-1][1](spark, after, SF)
    assert out.count() == after.count()
    assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(F.sum("n_tokens")).first()[0]


def test_repeated_and_odd_rows_pass(spark):
    """Repeated rows, shared and null ids, null, empty and very long texts, clashing columns, empty tables."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "quite another text with nothing shared"), (2, None), (3, ""), (None, "z y x"), (None, "no id and not alike either"), (4, long), (5, long + " w1")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i != 4 else None, len(t or ""), 0.9, "q") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, copies string").repartition(4)
    kept = corpus_pipeline.neardup_stage(spark, docs, SF)
    want = sorted(str(r) for r in ((1, "a b c d"), rows[2], (2, None), rows[5], rows[6], rows[7]))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want
    assert sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.neardup_stage(spark, docs.repartition(3), SF).collect()) == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name in ("toxicity", "decontamination"):
            assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
        if name == "mixing":
            counts = {(r.doc_id, r.text): r["count"] for r in out.groupBy("doc_id", "text").count().collect()}
            assert all(n <= 3 * rows.count(k) for k, n in counts.items()) and set(counts) <= set(rows)
    assert corpus_pipeline.token_stage(spark, docs, SF).count() == len(rows)


def test_near_copies_go_at_four_fifths_of_their_shingles(spark):
    words = [f"w{i}" for i in range(100)]
    changed = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    texts = [changed(), changed(50), changed(30, 60), changed(20, 40, 80), " ".join(f"y{i}" for i in range(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.neardup_stage(spark, docs, SF).collect()) == [0, 3, 4]


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(nearcopies.shingles((r.text or "").encode())[1].tolist()) for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got.keys() == sets.keys()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                assert 9 * n < 4 * (len(sets[a]) + len(sets[b])) or got[a] == got[b], (a, b)


def test_texts_that_only_share_passages_are_not_compared(spark, monkeypatch):
    """Of texts that share a third of their words with two others or a common opening with all, no pairs are made; near copies that sit in a cluster at the bound are joined all the same."""
    made, verified = [], nearcopies._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    own = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    texts = [" ".join([*own(f"all{i % 2}", 12), *own(i, 60), *own(f"p{i // 3}", 30)]) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.near_copies(docs).collect()} == set(range(150))
    assert made == [0, 0]
    r, base = random.Random(3), own("base", 90)
    texts += [" ".join(f"y{i}x{k}" if k in at else w for k, w in enumerate(base[: r.randint(70, 90)])) for i in range(80) for at in [r.sample(range(90), r.randint(0, 4))]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted({r.component_id for r in nearcopies.near_copies(docs).collect()}) == least_of_groups(docs.collect())
