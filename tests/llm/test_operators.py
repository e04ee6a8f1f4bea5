"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanveil.llm import bytescan, chat, components, decontaminate, extract, licenses, mixing, neighbours, queries, simhash, substrings, tokenfiles, toxicity
from spanveil.llm.labelled_pages import labelled_pages

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß—x", "Ünder", "the"]
    shared = " ".join(r.choices(vocabulary, k=60))
    rows = []
    for i in range(60):
        text = " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 34, 35, 36, 90, 300])))
        if i % 4 == 0:
            text += "\n" + shared + "\t" + r.choice(vocabulary)
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "   \n"), (63, rows[8][1]), (63, rows[8][1]), (64, "a " * 200), (65, " ".join(r.choices(vocabulary, k=20_000))), (66, rows[12][1].replace("w1 ", "w2 ")), (67, "Under the MIT License.")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 5, "x") for i, t in corpus()], "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_word_scan_is_exact_over_chunks():
    texts = ["", None, " a b", "c", "d e \x0b f", "x" * 50]
    for limit in (1, 7, 1 << 20):
        got, seen = [], {}
        for c in bytescan.chunks(pa.array(texts), limit):
            w = bytescan.scan(c, bytescan.NON_SPACE)
            got += w.counts.tolist()
            for s, e, h in zip(w.starts, w.ends, bytescan.word_hashes(c, w).tolist()):
                word = c.data[s:e].tobytes()
                assert seen.setdefault(word, h) == h == bytescan.hash_of(word)
        assert got == [len(WORD.findall(t or "")) for t in texts]


def test_op1_matches_sql_and_reads_back(spark, tmp_path):
    rows = [(1, 0, "system", "be \\1; ### User: kind"), (1, 1, "user", None), (1, 2, "assistant", "</turn> ]: \\"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 5, "tool", "### Other [q]: z"), (3, None, None, "n"), (None, 1, "user", "?")]
    pq.write_table(pa.table({k: list(v) for k, v in zip(("conv_id", "turn", "role", "text"), zip(*rows))}), tmp_path / "conversations.parquet")
    got = chat.op1_chat_format(spark, str(tmp_path)).drop("valid").toPandas().sort_values("conv_id", na_position="first").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_chat_format"]).df().drop(columns="valid").sort_values("conv_id", na_position="first").reset_index(drop=True)
    for column in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256"):
        assert got[column].tolist() == want[column].tolist(), column
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1].valid and not out[2].valid and out[2].first_illegal == 0
    assert [s.text for s in out[1].segments if s.loss] == ["\\6; \\5; \\0;"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_op2_against_brute_force(docs, empty):
    words = [(i, WORD.findall(t or "")) for i, t in corpus()]
    count = Counter(tuple(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    out = substrings.without_repeats(docs)
    n = F.aggregate("spans", F.lit(0), lambda a, s: a + s["n_words"])
    assert rows_of(out.withColumn("gone", n), "doc_id", "n_words", "gone", "kept") == sorted(want)
    assert substrings.without_repeats(empty).count() == 0


def test_op2_rows_that_share_or_lack_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (None, a), (None, "z " + b[:50])], "doc_id long, text string")
    out = substrings.without_repeats(df).select("doc_id", F.length("kept").alias("n")).collect()
    assert Counter((r.doc_id, r.n) for r in out) == Counter({(1, 0): 1, (1, len(b)): 1, (None, 0): 1, (None, len(("z " + b[:50]).strip())): 1})


def test_op3_recall_ties_and_invalid_vectors(spark):
    g = np.random.default_rng(1)
    v = g.standard_normal((700, 16))
    v[300:360] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)] + [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [float("inf")] + [1.0] * 15), (804, []), (900, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0 OR vec_id = 7"), shard=200, block=3).toPandas()
    hits = total = 0
    for q in [0, 7, 100, 200, 300, 400, 500, 600]:
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id], rtol=0, atol=0)
        hits, total = hits + len(set(best) & set(mine.vec_id)), total + 10
    assert hits / total >= 0.9
    assert got[got.query_id == 7].sort_values("rank").vec_id.tolist() == list(range(300, 310))
    assert not len(got[got.query_id.isin([800, 900])])
    assert neighbours.nearest(df.filter("false"), df.filter("false")).count() == 0
    few = df.filter("vec_id < 4")
    assert neighbours.nearest(few, few.filter("vec_id = 0")).count() == 3


def test_op3_repeated_and_shared_ids(spark):
    """Against brute force: a query's row twice, its vector under its own id often and once under another, ids with several vectors, clashing columns."""
    g = np.random.default_rng(2)
    v = g.standard_normal((60, 8))
    rows = [(i, v[i]) for i in range(60)] + [(0, v[0]), (0, v[30])] + [(100, v[5])] * 12 + [(77, v[5]), (9, v[40]), (9, v[40])]
    df = spark.createDataFrame([(i, [float(y) for y in x], "a", 1.0) for i, x in rows], "vec_id long, embedding array<double>, rank string, score double")
    for parts in (1, 5):
        got = neighbours.nearest(df.repartition(parts), df.filter("vec_id % 100 = 0").repartition(parts), shard=16).collect()
        answers = Counter()
        for q, x in rows:
            if q % 100 == 0:
                d = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in {(i, tuple(y)): (i, y) for i, y in rows}.values() if i != q)[:10]
                answers.update((q, r, i, round(s, 9)) for r, (s, i) in enumerate(d, 1))
        assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == answers


def test_op4_base_places_and_bounded_errors(spark):
    texts = ["Under the MIT License under, the\nmit-license", "undér the mit license", None, "", "x apache license version 2. CC BY-NC cc by ncx", "released undr the mit licence today", "all rights reserved all rights reserved", "word " * 5000 + "under the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "")], "doc_id long, text string").withColumn("spans", F.lit(1))
    out = {r.doc_id: r for r in licenses.find_notices(df).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall(low(t))
        places = [(j, n.label) for n in licenses.NOTICES if n.base for p in [n.phrase.split()] for j in range(len(w)) if w[j : j + len(p)] == p]
        assert (out[i].n_words, out[i].n_base) == (len(w), len(places))
        assert out[i].first_word == min((j for j, _ in places), default=None) and out[i].last_word == max((j for j, _ in places), default=None)
        assert out[i].base_labels == sorted({x for _, x in places})
    assert [(s.label, s.edits, s.text) for s in out[5].spans] == [("mit", 2, "undr the mit licence")]
    assert out[1].n_base == 0 and [s.label for s in out[1].spans] == ["mit"]
    assert licenses.find_notices(df.filter("false")).count() == 0


def test_op5_round_trip(docs, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    extra = docs.sparkSession.createDataFrame([(100, "It's <|endoftext|> 12½ don't x́y ÀÉ"), (None, "null id"), (101, "İstanbul ΣΑΣ ﬁ")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    t = Tokenizer.from_file(path)
    want, start = [], 0
    rows = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for cuts in (tokenfiles.CUTS, 2):
        monkeypatch.setattr(tokenfiles, "CUTS", cuts)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_table(table.withColumn("part", F.lit("clash")), path, parts=6).orderBy("start").collect()]
        assert got == want
    assert tokenfiles.token_table(empty, path).count() == 0


def test_op5_one_id_on_most_rows_fills_several_parts(spark):
    import public_tokenizers

    df = spark.createDataFrame([(7 if i % 3 else i, f"text {i}") for i in range(90)], "doc_id long, text string")
    files = tokenfiles.write_tokens(df, public_tokenizers.path("word_bpe_49k.json"), parts=6)
    assert max(n for _, _, n, _ in files.parts) < 40 and sum(n for _, _, n, _ in files.parts) == 90
    ids = [r.doc_id for r in files.documents(spark).orderBy("start").collect()]
    assert ids == sorted(ids)


def test_op6_learns_and_scores_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn(docs, labels)
    out = toxicity.scored(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).select((F.col("score") >= 0.5).cast("int").alias("p"), "toxic").collect()
    assert np.mean([r.p == r.toxic for r in out]) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (3, "x " * 50_000), (None, "idiot scum moron")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id is None).score > 0.5
    none = toxicity.learn(docs, labels.filter("false"))
    assert {r.score for r in toxicity.scored(odd, none).collect()} == {0.0}
    assert {r.score for r in got if r.doc_id in (1, 2)} == {model.share}
    assert {r.doc_id: r.neighbours for r in got}[1] == [] and all(len(r.neighbours) == 15 for r in toxicity.scored(docs.limit(50), model).filter("length(text) > 500").collect())
    assert toxicity.scored(odd.filter("false"), model).count() == 0


def test_op6_index_is_exact():
    g = np.random.default_rng(0)
    dense = np.zeros((300, 40))
    for i in range(300):
        dense[i, g.choice(40, g.integers(1, 6), replace=False)] = g.random() + 0.1
    dense[250:] = dense[:50]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    rows, terms = np.nonzero(dense)
    ids = g.permutation(300)
    index = toxicity.BlockMaxIndex(ids, np.zeros(300, int), rows, terms, dense[rows, terms], 40)
    for i in range(60):
        f = np.flatnonzero(dense[i])
        cos = dense @ dense[i]
        want = [r for r in np.lexsort((ids, -np.round(cos, 12))) if cos[r] > 1e-15]
        assert index.nearest(f, dense[i, f], 15)[0].tolist() == want[:15]
        assert index.nearest(f, dense[i, f], 15, without=i)[0].tolist() == [r for r in want if r != i][:15]
        assert index.nearest(f, dense[i, f], 1000)[0].tolist() == want


def test_op6_neighbours_are_the_nearest_by_dense_cosine(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    examples, _ = toxicity.examples_of(docs, labels)
    texts = {r.doc_id: re.findall(ALNUM, (r.text or "").lower()) for r in docs.collect()}
    words = sorted({w for i in examples.ids.tolist() for w in texts[i]})
    df = {w: sum(w in t for t in map(set, texts.values())) for w in words}
    labelled = dict(zip(examples.ids.tolist(), examples.toxic.tolist()))
    n1, n = sum(labelled.values()), len(labelled)

    def factor(w):
        k1, k = sum(w in texts[i] for i in labelled if labelled[i]), sum(w in texts[i] for i in labelled)
        part = lambda s, e: s * np.log(s / e) if s else 0.0
        llr = 2 * (part(k1, n1 * k / n) + part(k - k1, (n - n1) * k / n) + part(n1 - k1, n1 * (n - k) / n) + part(n - n1 - k + k1, (n - n1) * (n - k) / n))
        return np.log((1 + len(texts)) / (1 + df[w])) * (1 + (llr / toxicity.LLR_SCALE if k1 * (n - n1) > (k - k1) * n1 else 0))

    at, weight = {w: j for j, w in enumerate(words)}, np.array([factor(w) for w in words])

    def vector(t):
        x = np.zeros(len(words))
        for w, c in Counter(t).items():
            if w in at:
                x[at[w]] = weight[at[w]] * (1 + np.log(c))
        return x / (np.linalg.norm(x) or 1)

    ids = examples.ids
    dense = np.stack([vector(texts[i]) for i in ids.tolist()])
    for i, t in texts.items():
        cos = dense @ vector(t)
        best = np.sort(cos[cos > 1e-12])[::-1][: toxicity.NEIGHBOURS]
        mine = got[i].neighbours
        assert np.allclose([x.similarity for x in mine], best, atol=1e-9), i
        assert all(abs(cos[ids.tolist().index(x.doc_id)] - x.similarity) < 1e-9 for x in mine)
        assert bool(mine) or not set(t) & set(words)


def test_op7_held_out_pages_and_broken_html(spark):
    chain = extract.model()
    right = total = 0
    for page in labelled_pages(80, 1234):
        blocks, gold = extract.labelled_blocks(page)
        right, total = right + sum(a == b for a, b in zip(chain.decode(blocks), gold)), total + len(gold)
    assert right / total > 0.98
    page = '<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One&nbsp; <b>two</b>three.<br>four<p>Five &eacute; six seven, eight.</article><footer>&copy; me</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "</div></p>"), (1, "u", page), (None, "u", "<!-- x"), (6, "u", "<article>" + "<p>Long text, here it is.</p>" * 3000 + "</article>")]
    out = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).collect()
    assert [r.text for r in out if r.page_id == 1] == ["A & B One twothree. four Five é six seven, eight."] * 2
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == len(rows)
    assert {r.page_id: r.text for r in out}[2] == "" and len({r.page_id: r.text for r in out}[6]) > 60_000


def shares(sizes, weights, cap=3):
    """Shares by rounds: whoever is above its cap stops, the rest is shared anew."""
    out, left, active = [0.0] * len(sizes), sum(sizes), [i for i, s in enumerate(sizes) if s]
    while active:
        total = sum(weights[i] for i in active)
        above = [i for i in active if left * weights[i] > cap * sizes[i] * total]
        for i in active:
            out[i] = float(cap * sizes[i]) if i in above else left * weights[i] / total
        left -= sum(cap * sizes[i] for i in above)
        active = [i for i in active if i not in above] if above else []
    return out


def test_op8_targets_against_rounds(spark):
    r = random.Random(4)
    for sizes in ([100, 100, 100], [10, 1000], [0, 5], [1, 1, 10**6], [r.choice([0, r.randint(1, 10 ** r.randint(1, 6))]) for _ in range(40)]):
        names = [f"1s{i:03d}" for i in range(len(sizes) - 1)] + ["0"]
        got = {x._source: x.target for x in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "_source string, source_size long")).collect()}
        assert np.allclose([got[n] for n in names], shares(sizes, [i % 3 + 1 for i in range(len(sizes))]), rtol=1e-12), sizes


def test_op8_fit():
    r = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.unique(r.integers(1, 300, 40))
        counts = r.integers(1, 50, len(lengths))
        budget = float(r.random() * (lengths * counts).sum())
        take = mixing.fit(lengths, counts, budget)
        got = (take * lengths).sum()
        assert (take <= counts).all() and (take >= 0).all() and got <= budget and budget - got < 1 + (lengths.min() > budget) * lengths.min()
    assert mixing.fit(np.array([0, 7]), np.array([3, 1]), 5.0).tolist()[1] == 0
    # Few, long documents: the best of all subsets.
    for step in (1, 1000):
        lengths = np.unique(r.integers(17_000 // step, 30_000 // step, 14)) * step
        budget = int(0.6 * lengths.sum())
        sums = {0}
        for x in lengths.tolist():
            sums |= {s + x for s in sums}
        take = mixing.fit(lengths, np.ones(len(lengths), int), budget)
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_op8_rows(docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    hot = docs.select("doc_id", "text", "source").unionByName(docs.sparkSession.range(1000, 1200).selectExpr("id AS doc_id", "'three hot words' AS text", "'s1' AS source"))
    # Rows of one id or none, which only their text tells apart, and rows that nothing tells apart.
    hot = hot.unionByName(docs.sparkSession.range(90).selectExpr("if(id < 50, null, 77L) AS doc_id", "concat('null ids tie ', id) AS text", "'s2' AS source")).unionByName(docs.sparkSession.range(60).selectExpr("5L AS doc_id", "'all rows are equal here' AS text", "'s2' AS source"))
    out = mixing.mixed(hot).toPandas()
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    again = mixing.mixed(hot.repartition(7)).toPandas()
    key = ["doc_id", "text", "size", "taken"]
    rows = lambda d: sorted(map(str, d[key].values.tolist()))
    assert rows(out) == rows(again)
    assert len(out) == hot.count() and (out.taken <= 3 * out["size"]).all() and (out["size"] == out.text.map(lambda t: len(WORD.findall(t or "")))).all()
    for _, g in out.groupby(out.source.fillna("")):
        assert abs(g.taken.sum() - g.target.iat[0]) <= max(1, g["size"].max() / 2)
    assert mixing.mixed(empty).count() == 0
    clash = mixing.mixed(docs.withColumn("size", F.lit("x")).withColumn("taken", F.lit("y")))
    assert dict(clash.dtypes)["taken"] == "bigint" and clash.columns.count("size") == 1 and clash.count() == docs.count()


def test_op9_against_brute_force(docs, empty):
    rows = corpus()
    fp = [simhash.fingerprint_text((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(i, least.get(x, i))
    want = sorted((i, f"{f:016x}", least[x]) for (i, _), f, x in zip(rows, fp, label))
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_op9_large_groups_keep_their_components(spark):
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(300)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), block=32)
    named = {x.node: x.component for x in components.connected_components(edges).collect()}
    a = np.array([p for (p,) in signed]).view(np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist():
            if i != j:
                assert named[signed[i][0]] == named[signed[j][0]]
    assert edges.count() < 20 * len(signed)


def test_position_sets_cover_every_choice():
    from itertools import combinations

    for width in (2, 3, 4, 5):
        sets = simhash.position_sets(width)
        assert all(any(set(s) <= set(x) for s in sets) for x in combinations(range(8), 5))


def brute_hits(rows, items):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[key]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_op10_against_brute_force(spark, docs, block_bytes):
    rows = corpus()
    items = [(1, " ".join((rows[4][1] or "").split()[-30:])), (2, "w1 W2 w3"), (3, None), (4, ""), (5, "the"), (1, "w5 w6"), (6, rows[65 - 0][1][:400]), (7, "not there at all " * 4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes)
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    got = sorted((r[0], r[1], r[2], list(r[3])) for r in out.select("doc_id", "n_words", n, "items").collect())
    assert got == brute_hits(rows, items)


def test_op10_shards_collisions_and_clashing_columns(spark, docs, monkeypatch):
    rows = corpus()
    items = [(1, " ".join((rows[4][1] or "").split()[-30:])), (2, "the"), (None, "w5 w6"), (None, "w7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    column = pa.array([t for _, t in rows])
    want = [(n, h, f) for _, n, h, f in sorted(brute_hits(list(enumerate(t for _, t in rows)), [(i or "", t) for i, t in items]))]
    # With a hash of few values, words of the benchmark share one, and words of documents meet wrong symbols.
    real = bytescan.word_hashes
    for bits, limit in ((64, 1), (12, 500), (6, 500)):
        monkeypatch.setattr(bytescan, "word_hashes", lambda c, w, way=0, bits=bits: real(c, w, way) & np.uint64((1 << bits) - 1) if way == 0 else real(c, w, way))
        phrases = decontaminate.Phrases([(i and str(i), t) for i, t in items], 10)
        assert phrases.way == (bits == 6)
        n, spans, found = decontaminate.search_batch(column, phrases, limit)
        assert [(int(n[r]), sum(k for _, k in spans.get(r, ())), found.get(r, [])) for r in range(len(rows))] == want
    monkeypatch.undo()
    cut = decontaminate.remove_contamination(docs, bench)
    assert cut.columns == docs.columns and {r.spans for r in cut.collect()} == {"x"}


def test_op10_index_finds_all_places():
    r = np.random.default_rng(2)
    text = np.concatenate([np.append(r.integers(1, 4, r.integers(1, 60)), 0) for _ in range(40)])
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 5):
        phrases = r.integers(1, 4, (50, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_op10_removal_and_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Keep this. Alpha, beta; gamma DELTA! And this."), (2, "alpha beta gamma delta"), (3, None), (4, "clean")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove_contamination(df, bench).collect()}
    assert out == {1: "Keep this. ! And this.", 3: None, 4: "clean"}
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(df, bench.filter("false")).filter("size(spans) > 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    digest = lambda d: sorted(hashlib.md5(repr(tuple(map(str, r))).encode()).hexdigest() for r in d[columns].itertuples(index=False))
    assert digest(got) == digest(want)
