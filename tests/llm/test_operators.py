"""Each operator on real and awkward tables, against brute force or SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import brown, embeddings, exact, html, langid, minhash, mixing, pieces, pii, queries, scratch, toxicity
from barloom.llm.components import connected_components
from tests.llm.test_kernels import language_by_force

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, u long, v long, n int, kept boolean, component string, rank string, copies string, toxic string, held_out string, lang_pred string, bands int, best int, label int, size string"
EXTRA = (1, 2, 3, True, "c", "r", "k", "t", "h", "l", 7, 8, 9, "s")
LONG = " ".join(f"w{k % 900}x" for k in range(60_000))


def awkward(spark, texts=None):
    """Nulls in every column, empty and very long texts, copies, repeated rows, names that clash."""
    rows = [
        (1, "one two three four five six", "en", "s1"), (2, "one  two three\nfour five six", "en", "s1"), (3, "one two three four five six seven", "de", "s2"),
        (4, None, "en", "s2"), (5, "", None, "s1"), (6, " \t\n", "fr", None), (7, LONG, "en", "s3"), (8, LONG + " end", "en", "s3"), (9, "x", "de", ""), (9, "x", "de", ""),
        (10, "12345 !!", "en", "s1"), (None, "no id at all here", "de", None), (None, None, None, None), (11, "Ähnlich öfter über", "de", "s2"), (12, "mail a.b@c.de or 1.2.3.4", "en", "s1"), (13, "one two three four five six", None, "s3"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


def words(t):
    return WORD.findall((t or "").encode().lower())


def near_by_force(ids, texts, width, num, den):
    sets = {}
    for k, t in zip(ids, texts, strict=True):
        w = words(t)
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and den * min(len(sets[a]), len(sets[b])) >= num * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("name", ["op1_mix", "op6_exact"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()
    order = ["doc_id", *sorted(c for c in want.columns if c != "doc_id")]
    pd.testing.assert_frame_equal(got[order].sort_values("doc_id").reset_index(drop=True), want[order].sort_values("doc_id").reset_index(drop=True), check_dtype=False)


def test_every_operator_has_its_query():
    names = {re.match(r"op(\d+)_", n)[1] for n in queries.queries()}
    assert names == {str(k) for k in range(1, 14)}


# ---- 1


def test_mix_awkward(spark):
    got = mixing.mix(awkward(spark)).toPandas()
    assert len(got) == 16 and (got["taken"] <= 3 * got["size"]).all()
    totals = got.groupby("source", dropna=False)["size"].sum()
    per = got.drop_duplicates("source").set_index("source")["source_size"]
    assert sorted(totals) == sorted(per)
    assert got.drop_duplicates("source")["target"].sum() == pytest.approx(totals.sum())
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    again = mixing.mix(awkward(spark).repartition(5)).toPandas()
    tidy = lambda x: x[["doc_id", "size", "taken"]].sort_values(["doc_id", "size", "taken"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(again))


@pytest.mark.parametrize("sizes", [[100, 1, 1, 0], [5, 5, 5], [0, 0], [1, 1000, 10, 10, 10, 500]])
def test_targets_fill_up(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weight = [(1, 2, 3)[k % 3] for k in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 3 * sizes[k]]
        if not over:
            for k in free:
                target[k] = level * weight[k]
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
            free.remove(k)
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(target)


def test_mix_is_near_its_targets(spark):
    got = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 2 * g["size"].max()


# ---- 2


@pytest.mark.parametrize(("width", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates(spark, docs, width, num, den):
    extra = [w.rsplit(" ", k)[0] + " new words" for k, w in enumerate(docs["text"][:40], 1)]
    table = pd.concat([docs[["doc_id", "text"]], pd.DataFrame({"doc_id": range(1000, 1040), "text": extra})])
    want = near_by_force(table["doc_id"], table["text"], width, num, den)
    got = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), width, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_one_original(spark):
    """A chain and a crowd: copies that are linked with some of the others only."""
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(160):
        w = list(base)
        for at in r.choice(150, r.integers(0, 14), replace=False):
            w[at] = f"x{r.integers(1 << 40)}"
        texts.append(" ".join(w))
    table = pd.DataFrame({"doc_id": r.permutation(160), "text": texts})
    want = near_by_force(table["doc_id"], table["text"], 3, 85, 100)
    got = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 3, 85, 100).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert 1 < len({c for _, c in want.values()}) < 160


def test_near_duplicates_of_a_hot_pivot(spark, docs, monkeypatch):
    """One original with hundreds of near copies; its pairs are dealt to many tasks and come to the same."""
    monkeypatch.setattr(minhash, "LARGE", 7)
    base = docs["text"][0].split()[:120]
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(120)] + [f"{' '.join(base)} end{k}" for k in range(200)]
    table = pd.concat([pd.DataFrame({"doc_id": range(320), "text": texts}), docs[["doc_id", "text"]].head(30).assign(doc_id=range(1000, 1030))])
    want = near_by_force(table["doc_id"], table["text"], 3, 85, 100)
    got = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    pairs = spark.createDataFrame([(0, k) for k in range(1, 101)] + [(k, 200) for k in range(1, 20)], "a long, b long")
    sets = spark.range(201).select(F.col("id").alias("doc_id"), (F.col("id") * 3).alias("sig"))
    hot = minhash._hot(pairs)
    assert {r.id: r.parts for r in hot.collect()} == {0: 15, 200: 3}
    both = minhash._beside(minhash._beside(pairs, sets, "a", "sig", hot), sets, "b", "sig", hot)
    assert sorted((r.a, r.b, r.sig_a, r.sig_b) for r in both.collect()) == sorted((r.a, r.b, 3 * r.a, 3 * r.b) for r in pairs.collect())


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(awkward(spark)).toPandas()
    assert len(got) == 16
    ids = dict(zip(got["doc_id"], got["component_id"], strict=True))
    assert (ids[1], ids[2], ids[13], ids[3], ids[8], ids[9], ids[4], ids[5]) == (1, 1, 1, 3, 7, 9, 4, 5)
    assert got[got["doc_id"].isna()]["kept"].all()
    assert minhash.near_duplicates(awkward(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f g"), (5, "h i j k l m n"), (2, "h i j k l m n"), (9, "a b c d e f g")], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(twice).collect()} == {2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 3


def test_pieces(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = queries.op3_pieces(spark, DATA).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = sp.encode(t)
        row = got.loc[d]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    odd = pieces.encode(awkward(spark), queries.piece_model()).toPandas()
    assert all(list(i) == sp.encode(t or "") and d == sp.decode(sp.encode(t or "")) for i, d, t in zip(odd["piece_ids"], odd["decoded"], odd["text"], strict=True))
    assert pieces.encode(awkward(spark).limit(0), queries.piece_model()).count() == 0


# ---- 4


def test_language(spark, docs):
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").toPandas()
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]]
    both = got.merge(truth)
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    assert (both[both["held_out"]]["lang"] == both[both["held_out"]]["lang_pred"]).mean() > 0.97
    odd = langid.identify(awkward(spark)).toPandas()
    none = odd["text"].isna() | ~odd["text"].fillna("").str.contains("[A-Za-zÄäöü]")
    assert (odd[none]["lang_pred"] == "und").all() and (odd[none]["lang_score"] == 0).all()
    assert (odd[~none]["lang_pred"] != "und").all() and odd["lang_score"].between(0, 1).all()
    assert langid.identify(awkward(spark).limit(0)).count() == 0
    blank = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}


def test_language_by_force(spark, docs):
    """The query's results are those of naive Bayes counted one n-gram at a time."""
    got = {r.doc_id: r for r in queries.op4_langid(spark, DATA).collect()}
    train = [(r.text, r.lang) for r in docs.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    some = docs[docs["text"].str.len() < 4000]
    want = language_by_force([(t, x if isinstance(x, str) else None) for t, x in train], some["text"].tolist())
    for d, (lang, score) in zip(some["doc_id"], want, strict=True):
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=1e-4)


def test_sums_in_a_tree(spark, docs, monkeypatch):
    """Partial sums of many tasks are added two at a time, and come to the same."""
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    key = lambda d: sorted(map(str, d.collect()))
    want = [key(langid.identify(table)), key(brown.score_texts(table)), key(minhash.near_duplicates(table))]
    monkeypatch.setattr(scratch, "FAN", 2)
    cut = table.repartition(9)
    assert key(langid.identify(cut)) == want[0]
    tidy = lambda rows: [re.sub(r"score=(-?[\d.]+)", lambda m: f"{float(m[1]):.6g}", r) for r in rows]
    assert tidy(key(brown.score_texts(cut))) == tidy(want[1])
    assert key(minhash.near_duplicates(cut)) == want[2]


def test_language_ignores_its_inputs_order(spark):
    a = langid.identify(awkward(spark)).select("text", "lang_pred", "lang_score")
    b = langid.identify(awkward(spark).repartition(7).withColumn("source", F.lit("z"))).select("text", "lang_pred", "lang_score")
    key = lambda x: sorted((r.text or "", r.lang_pred, round(r.lang_score, 9)) for r in x.collect())
    assert key(a) == key(b)


# ---- 5


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(0)
    base = r.normal(0, 1, (12, 16))
    rows = []
    for k in range(150):
        v = (base[k % 12] + r.normal(0, 0.25, 16)).astype(np.float32)
        rows.append((k, v.tolist(), int(k % 3) if k % 17 else None))
    rows += [(200 + k, rows[5][1], 2) for k in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, [math.inf] + [1.0] * 15, 1), (305, [], 1), (306, rows[0][1][:8], 0), (None, rows[1][1], 1), (307, [x * 1000 for x in rows[1][1]], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(table, 0.93).collect()}
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for i, v, a in good:
        for j, w, b in good:
            if i < j and a == b and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].n_links == len(links[i]), i
        if i is not None:
            assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    assert len(got) == len(rows) and sum(map(len, links.values())) > 900
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    key = lambda d: sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in d.collect())
    clash = table.withColumns({c: F.lit("x") for c in ("v", "rep", "good", "n", "tile", "Links", "component_id", "kept")})
    assert key(embeddings.near_vectors(clash, 0.93)) == key(spark.createDataFrame(list(got.values())))


# ---- 6


def test_exact_awkward(spark):
    got = exact.dedup_exact(awkward(spark)).toPandas()
    strip = lambda t: re.sub("[\x20\x09-\x0d]+", "", t or "")
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[strip(t)].append((-len(t or ""), d is not None, d or 0, d))
    want = sorted((str(d), str(min(groups[strip(t)])[3]), len(groups[strip(t)]), hashlib.sha256(strip(t).encode()).hexdigest()) for d, t in rows)
    num = lambda x: "None" if pd.isna(x) else str(int(x))
    assert sorted((num(r.doc_id), num(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()) == want
    assert exact.dedup_exact(awkward(spark).limit(0)).count() == 0


@pytest.mark.parametrize("shard_blocks", [1, 1 << 13])
def test_exact_filter_passes_single_rows(spark, shard_blocks):
    """Whole or in shards, the filter has every repeated digest and few others; a shard sees its own rows only."""
    rows = exact.digests(spark.read.parquet(f"{DATA}/documents.parquet"))
    positions, words = exact.repeated(rows, 24), 1 << 12
    tagged = exact.tag(rows, 24, exact.filter_blocks(positions, words), words, shard_blocks)
    assert len(tagged) == (4 if shard_blocks == 1 else 1)
    n = {r.text_sha256: r.n for r in rows.groupBy("text_sha256").agg(F.count("*").alias("n")).collect()}
    got = [r for t in tagged for r in t.collect()]
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows.collect())
    assert all(r.maybe or n[r.text_sha256] == 1 for r in got)
    assert sum(r.maybe for r in got) < sum(v for v in n.values() if v > 1) + 10


def test_exact_is_the_same_in_shards_and_shuffles_only_what_may_repeat(spark, monkeypatch):
    texts = [f"text number {k} {'x' * (k % 7)}" for k in range(3000)] + ["a copy of all"] * 1500 + [f"text number {k}{' ' * (k % 5)} {'x' * (k % 7)}" for k in range(0, 3000, 10)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    key = lambda d: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in d.collect())
    want = key(exact.dedup_exact(table))
    monkeypatch.setattr(exact, "SHARD_BLOCKS", 1)
    monkeypatch.setattr(exact, "BITS", 1 << 10)
    monkeypatch.setattr(exact, "BROADCAST_GROUPS", 4)
    found = exact.dedup_exact(table)
    assert key(found) == want
    by_text = defaultdict(list)
    for k, t in enumerate(texts):
        by_text[t.replace(" ", "")].append((-len(t), k))
    assert want == sorted((k, min(g)[1], len(g), k == min(g)[1]) for g in by_text.values() for _, k in g)
    # the result's plan: what missed the filter is read and passed on; the rest meets its groups in one shuffled join
    alone, rest = found._jdf.queryExecution().optimizedPlan().children().apply(0).toString(), found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in alone and "Aggregate" not in alone and rest.count("Join Inner") <= 2


# ---- 7


def test_toxicity(spark):
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    both = got.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"))
    own = both[both["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a in own[own["toxic"] == 1]["score"] for b in own[own["toxic"] == 0]["score"]]
    assert np.mean(pairs) > 0.85  # with some forty toxic documents to learn from
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (None, 1), (9, None), (11, 1), (12, 0)], "doc_id long, toxic int")
    odd = toxicity.rate(awkward(spark), labels).toPandas()
    assert len(odd) == 16 and odd["toxicity"].between(0, 1).all()
    assert toxicity.rate(awkward(spark).limit(0), labels).count() == 0
    assert toxicity.rate(awkward(spark), labels.limit(0)).count() == 16


def test_toxicity_labels_that_repeat(spark):
    """The worst of a document's labels counts; null ids and labels teach nothing; repeated ids are one document."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (None, "e"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 0), (3, 0), (None, 1), (4, 0), (9, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.sample(docs, labels).collect()), key=str) == [("a", 1), ("d", 0), (None, 0)]


# ---- 8


def test_pages(spark):
    got = queries.op8_html(spark, DATA).toPandas()
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    from html import unescape

    for r in got.itertuples():
        page = pages[pages["page_id"] == r.page_id]["html"].iloc[0]
        inner = page.split("<article>", 1)[1].split("</article>")[0]
        inner = inner if "</article>" in page else re.sub("<[^>]*$", "", inner)
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "", "", "x"), (1, "u", "<p>" + LONG, "x")], "page_id long, url string, html string, main_text string")
    assert [len(x.main_text) for x in html.extract(odd, html.train()).collect()] == [0, 0, len(LONG)]
    assert html.extract(odd.limit(0), html.train()).count() == 0


# ---- 9


@pytest.mark.parametrize("which", ["real", "awkward"])
def test_scores(spark, docs, which):
    table = spark.read.parquet(f"{DATA}/documents.parquet") if which == "real" else awkward(spark)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    tokens = [[*words(t), None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total = sum(count.values())
    base = lambda t: sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in t)
    want = sorted((-1 if d is None else d, h, len(t), sum(count[w] > 0 for w in t), total, round(base(t), 6)) for (d, _), t, h in zip(rows, tokens, held, strict=True))
    got = brown.score_texts(table).toPandas()
    assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert np.isfinite(got["score"]).all() and (got["score"] < 0).all()
    if which == "real":
        own = got[got["held_out"]]
        assert own["score"].sum() > own["base_score"].sum()


def brown_by_force(rows):
    """Scores counted in dictionaries, one token at a time; only the exchange itself is the library's."""
    docs = [brown.token_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist() for _, t in rows]
    taught = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0 for d, _ in rows]
    count = Counter(w for own, t in zip(docs, taught, strict=True) if t for w in own)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    top = sorted(sorted(count, key=lambda w: (-count[w], signed(w)))[: brown.ITEMS])
    item = {w: k for k, w in enumerate(top)}
    item_of = lambda w: item.get(w, brown.ITEMS + w % brown.GROUPS)
    pairs = lambda own: zip([own[-1], *own[:-1]], own, strict=True)
    bigrams = np.zeros((brown.ALL, brown.ALL))
    for own, t in zip(docs, taught, strict=True):
        for a, b in pairs(own) if t else ():
            bigrams[item_of(a), item_of(b)] += 1
    k = brown.n_classes(len(count))
    seed = brown.exchange(bigrams, k)
    member = np.eye(k)[seed]
    likes = brown._affinity(member.T @ bigrams @ member)
    seen = defaultdict(lambda: np.zeros(2 * k))
    for own, t in zip(docs, taught, strict=True):
        for a, b in pairs(own) if t else ():
            seen[b][seed[item_of(a)]] += 1
            seen[a][k + seed[item_of(b)]] += 1
    cls = {w: int((seen[w] @ likes).argmax()) if w in seen and w not in item else int(seed[item_of(w)]) for own in docs for w in own}
    table, n, v = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for own, t in zip(docs, taught, strict=True):
        for a, b in pairs(own) if t else ():
            table[cls[a], cls[b]] += 1
    for w, c in count.items():
        n[cls[w]] += c
        v[cls[w]] += 1
    transit, _ = brown._transit(table)
    return [sum(math.log10(transit[cls[a], cls[b]]) + math.log10((count[b] + brown.EMIT) / (n[cls[b]] + brown.EMIT * (v[cls[b]] + 1))) for a, b in pairs(own)) for own in docs]


@pytest.mark.parametrize("which", ["real", "awkward"])
def test_scores_by_force(spark, docs, which):
    table = awkward(spark) if which == "awkward" else spark.createDataFrame(docs[["doc_id", "text"]].head(60), "doc_id long, text string").repartition(4)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = sorted((str(d), x) for (d, _), x in zip(rows, brown_by_force(rows), strict=True))
    got = sorted((str(r.doc_id), r.score) for r in brown.score_texts(table).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9)


def test_scores_without_rows_or_training(spark):
    assert brown.score_texts(awkward(spark).limit(0)).count() == 0
    alone = spark.createDataFrame([(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    got = brown.score_texts(alone).toPandas()
    assert (got["n_known"] == 0).all() and (got["base_score"] == 0).all()


def test_pipeline_keeps_documents_of_unknown_and_of_many_languages(spark):
    import corpus_pipeline

    texts = [(k, f"word number {k} of many", None) for k in range(8)] + [(8, "", None), (9, "12 !", None), (10, None, None)]
    none = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, none, DATA).collect()} == set(range(8))
    letters = "abcdefghijklmnopqrst"
    many = spark.createDataFrame([(100 * i + k, "na", x) for i, x in enumerate(letters) for k in range(8)] + [(100 * i + 50 + k, f"na{x}", x) for i, x in enumerate(letters) for k in range(8)], "doc_id long, text string, lang string")
    assert corpus_pipeline.identify_language(spark, many, DATA).where("length(text) = 3").count() == 8 * len(letters)


def test_rare_words_have_classes_of_their_own(spark):
    """Words beyond the most frequent, alike in ending and length and seen equally often, after different words."""
    r = np.random.default_rng(5)
    pairs = [(("left", "right")[k % 2], f"f{k}w") for k in range(1200) for _ in range(6)]
    rare = {"left": [f"a{k:03d}xy" for k in range(200)], "right": [f"b{k:03d}xy" for k in range(200)]}
    pairs += [(side, w) for side, ws in rare.items() for w in ws for _ in range(3)]
    order = r.permutation(len(pairs))
    ids = {h: iter([k for k in range(40_000) if (zlib.crc32(str(k).encode()) % 10 == 0) == h]) for h in (True, False)}
    rows = [(next(ids[False]), " ".join(" ".join(pairs[i]) for i in order[k : k + 8])) for k in range(0, len(order), 8)]
    right = [(next(ids[True]), f"{side} {w}") for side, ws in rare.items() for w in ws]
    wrong = [(next(ids[True]), f"{other} {w}") for side, other in (("left", "right"), ("right", "left")) for w in rare[side]]
    got = brown.score_texts(spark.createDataFrame(rows + right + wrong, "doc_id long, text string")).toPandas().set_index("doc_id")["score"]
    assert got[[d for d, _ in right]].mean() > got[[d for d, _ in wrong]].mean() + 0.5
    assert brown.n_classes(0) == brown.CLASSES < brown.n_classes(10**6) < brown.n_classes(10**8)


# ---- 10


def test_pii(spark, docs):
    from tests.llm.test_kernels import plain_rules

    got = queries.op10_pii(spark, DATA).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        base = sorted(plain_rules(t), key=lambda s: (s[1], s[0]))
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        row = got.loc[d]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert set(listed) <= set(row["spans"].split(","))
    odd = pii.digest(pii.find(awkward(spark), pii.train())).toPandas().set_index("doc_id")
    assert odd.loc[12]["spans"] == "email:5:13,ip:17:24" and odd.loc[4]["spans"] == ""
    assert pii.find(awkward(spark).limit(0), pii.train()).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, docs):
    """Each stage against brute force on what the one before kept."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    kept = [table]
    for _, step in corpus_pipeline.STAGES:
        kept.append(step(spark, kept[-1], DATA).persist())
    frames = [k.toPandas() for k in kept]
    for f in frames[1:-1]:
        assert list(f.columns) == table.columns
    assert set(frames[1]["doc_id"]) == set(docs["doc_id"])
    groups = defaultdict(list)
    for r in frames[1].itertuples():
        groups[re.sub("[\x20\x09-\x0d]+", "", r.text)].append((-len(r.text), r.doc_id))
    assert sorted(frames[2]["doc_id"]) == sorted(min(g)[1] for g in groups.values())
    near = near_by_force(frames[2]["doc_id"], frames[2]["text"], 5, 4, 5)
    assert sorted(frames[3]["doc_id"]) == sorted({c for _, c in near.values()})
    taken = mixing.mix(kept[3]).toPandas()
    assert Counter(frames[4]["doc_id"]) == Counter({r.doc_id: r.copies for r in taken.itertuples() if r.copies})
    assert sorted(frames[5]["doc_id"]) == sorted(frames[4]["doc_id"])
    assert (frames[5]["n_tokens"] == frames[5]["token_ids"].map(len)).all()
    assert sorted(corpus_pipeline.run(spark, DATA).toPandas()["ids_sha256"]) == sorted(frames[5]["ids_sha256"])


def test_pipeline_leaves_columns_of_any_name(spark):
    """Columns with the names of working columns come back as they were."""
    names = ["row", "row_", "Copies", "held_out", "LANG_PRED", "lang_score", "own_held_out", "__row__"]
    table = spark.createDataFrame([(k, f"some words of text number {k} that differ", "en", "s", *[f"{n}{k}" for n in names]) for k in range(40)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for _, step in corpus_pipeline.STAGES[:-1]:
        table = step(spark, table, DATA)
        assert table.columns[4:] == names
    rows = table.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_pipeline_awkward(spark):
    table = awkward(spark)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, table.limit(0), DATA).count() == 0
        out = step(spark, table, DATA)
        assert out.columns == table.columns
    told = corpus_pipeline.identify_language(spark, table, DATA)
    assert {r.lang_pred for r in told.collect()} == {"l"}
    exact_left = corpus_pipeline.drop_copies(spark, table, DATA)
    assert sorted(r.doc_id for r in exact_left.collect() if r.doc_id) == [2, 3, 6, 7, 8, 9, 10, 11, 12]
    assert corpus_pipeline.encode_pieces(spark, table, DATA).count() == 16
