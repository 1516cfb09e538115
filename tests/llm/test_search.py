"""Ranked search, decontamination and conversation repair, against SQL and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontam, lexical, postings, queries, turns
from tests.llm.test_operators import DATA, LONG, awkward

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, rank string, score string, terms string"
NONE = ("d", "r", "s", "t")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("name", ["op11_search", "op12_decontam", "op13_turns"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want) > 0
    tidy = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


# ---- 11


def ranked(docs, items, k):
    """docs: (id, text); items: (id, text). Each item's k best documents."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    total, n_docs = sum(sum(b.values()) for _, b in bags), sum(bool(b) for _, b in bags)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, wanted in asked.items():
        rows = []
        weight = {w: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * sum(w in b for _, b in bags) + 1)))) for w in wanted}
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // max(total, 1)
            score = sum(weight[w] * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * m)) for w in wanted if b[w])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


@pytest.mark.parametrize("how", ["plain", "small"])
def test_search_by_force(spark, monkeypatch, how):
    if how == "small":  # many shards, several blocks of queries and of accumulators, merges in several levels
        monkeypatch.setattr(postings, "SHARD", 60)
        monkeypatch.setattr(postings, "MOST_DOCS", 2)
        monkeypatch.setattr(lexical, "MOST_PAIRS", 6)
        monkeypatch.setattr(lexical, "MOST_VALUES", 4)
    items = [(1, "one TWO three"), (2, "x"), (3, None), (4, ""), (None, "without an id at all"), (5, "nowhere"), (1, "seven"), (6, "über Ähnlich"), (7, "one one one w1x w2x")]
    docs = awkward(spark).unionByName(awkward(spark).where("doc_id in (1, 9)")).repartition(5)
    table = spark.createDataFrame([(*i, *NONE) for i in items], ITEMS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (1, 3, 50):
        assert found(lexical.search(docs, table, k, fan=2)) == ranked(rows, items, k)


def test_search_of_nothing(spark):
    docs, table = awkward(spark), spark.createDataFrame([(1, "one", *NONE)], ITEMS)
    assert lexical.search(docs.limit(0), table).count() == 0
    assert lexical.search(docs, table.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), table).count() == 0


def test_the_best_with_ties():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 40))
        scores, known = r.integers(1, 5, n), r.random(n) < 0.8
        ids = np.where(known, r.integers(0, 9, n), 0)  # rows without an id are alike
        k = int(r.integers(1, 12))
        key = lambda i: (-scores[i], not known[i], ids[i])  # noqa: B023, E731
        got = lexical.best(scores, ids, known, k)
        assert sorted(map(key, got)) == sorted(map(key, range(n)))[:k] and len(set(got.tolist())) == len(got)


# ---- 12


def hit(docs, items, width):
    cut = {}
    for i, t in items:
        w = terms(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            cut.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = terms(t)
        places, own = set(), set()
        for n in {len(x) for x in cut}:
            for k in range(len(w) - n + 1):
                who = cut.get(tuple(w[k : k + n]))
                if who:
                    places |= set(range(k, k + n))
                    own |= who
        out.append((d, len(w), len(places), tuple(sorted(own, key=str)), bool(places)))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["plain", "small"])
def test_decontamination_by_force(spark, monkeypatch, how):
    if how == "small":
        monkeypatch.setattr(postings, "SHARD", 100)
        monkeypatch.setattr(decontam, "MOST_WINDOWS", 5)
        monkeypatch.setattr(decontam, "MOST_CANDIDATES", 3)
    r = random.Random(5)
    items = [(1, "one two three"), (2, "four"), (3, None), (4, "\n"), (None, "no id at"), (1, "six seven"), (5, "w10x w11x w12x w13x"), (5, "w10x w11x w12x w13x"), (6, "a a b"), (7, "b a")]
    more = [(100 + k, " ".join(r.choice("aab") for _ in range(r.randint(0, 30)))) for k in range(40)]
    docs = awkward(spark).select("doc_id", "text", "rank", "kept").unionByName(spark.createDataFrame([(*m, "r", True) for m in more], "doc_id long, text string, rank string, kept boolean")).repartition(4)
    table = spark.createDataFrame([(*i, *NONE) for i in items], ITEMS)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    for width in (1, 3, 10):
        got = sorted([(x.doc_id, x.n_words, x.n_hit, tuple(sorted(x.item_ids, key=str)), x.contaminated) for x in decontam.contamination(docs, table, width).collect()], key=str)
        assert got == hit(rows, items, width)
    one = decontam.digest(decontam.contamination(docs, table, 1)).where("doc_id = 1").first()
    assert one.n_items == 2 and one.items_sha256 == hashlib.sha256(b"1,2").hexdigest()


def test_decontamination_of_nothing(spark):
    docs, table = awkward(spark), spark.createDataFrame([(1, "one", *NONE)], ITEMS)
    assert decontam.contamination(docs.limit(0), table).count() == 0
    for none in (table.limit(0), table.withColumn("text", F.lit(None).cast("string"))):
        got = decontam.contamination(docs, none)
        assert got.count() == 16 and got.where("contaminated or n_hit <> 0 or size(item_ids) <> 0").count() == 0


def test_phrases_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["x one", "two y", "one two", "two one", "one"] * 3)], "doc_id long, text string").coalesce(1)
    got = decontam.phrases(decontam.index(docs), spark.createDataFrame([(1, "one two")], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [2, 7, 12] and {(s.a, s.b) for r in got for s in r.spans} == {(0, 2)}


def test_proximity_by_force(spark):
    r = random.Random(8)
    docs = [(k, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 25)))) for k in range(60)]
    items = [(1, "a b c"), (2, "d d e"), (3, "f"), (4, "a b z")]
    want = set()
    within = 4
    for d, t in docs:
        w = terms(t)
        for i, q in items:
            need = set(terms(q))
            for a in range(len(w)):
                if w[a] in need:
                    ends = [next((p for p in range(a, min(len(w), a + within)) if w[p] == x), None) for x in need]
                    if None not in ends:
                        want.add((d, i, a, max(ends) + 1))
    shards = decontam.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2))
    got = decontam.proximity(shards, spark.createDataFrame(items, "item_id long, text string"), width=3, within=within).collect()
    assert sorted((x.doc_id, x.item_id, x.start, x.stop) for x in got) == sorted(want)


# ---- 13


def repair_by_force(rows):
    """rows: (role, text) in order. (blank, duplicate, truncated, illegal, cost, audit, repaired): every state, no fold."""
    spaces = " \t\n\x0b\f\r"
    seen, marks = set(), []
    for role, text in rows:
        last = text.rstrip(spaces)[-1:]
        marks.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    initials = [r[:1] for r, _ in rows]
    states = {"e": (0, "", ())}

    def put(new, state, cost, audit, out):
        if state not in new or (cost, audit) < new[state][:2]:
            new[state] = (cost, audit, out)

    def insert(states):
        now = dict(states)
        for _ in range(3):
            for state, (cost, audit, out) in list(now.items()):
                to = "a" if state == "u" else "u"
                put(now, to, cost + 5, audit + "I", (*out, ({"u": "user", "a": "assistant"}[to], "")))
        return now

    for (role, text), mark in zip(rows, marks, strict=True):
        new = {}
        for state, (cost, audit, out) in insert(states).items():
            put(new, state, cost + 2, audit + "D", out)
            if mark in ("blank", "duplicate"):
                continue
            more = 5 if mark == "truncated" else 0
            for to, name in (("s", None), ("u", "user"), ("a", "assistant")):
                if not (to == "s" and state == "e" or to == "u" and state in "esa" or to == "a" and state == "u"):
                    continue
                if role[:1] == to:
                    put(new, to, cost + more, audit + "K", (*out, (role, text)))
                if name:
                    put(new, to, cost + more + 1, audit + "R", (*out, (name, text)))
        states = new
    ended = insert(states)
    cost, audit, out = min(ended[k] for k in "ea" if k in ended)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (*(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_by_force(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    r = random.Random(block)
    talks = {k: [(r.choice(["user", "assistant", "system", "tool", ""]) if r.random() < 0.3 else ["user", "assistant"][i % 2], r.choice(["Yes.", "No", "\t\n", "", "Why?", "a. b", f"Well {i}! \n"])) for i in range(r.randint(1, 12))] for k in range(60)}
    talks[60] = [("user", f"turn {i}.") for i in range(40)]
    talks[None] = [("system", "S."), ("user", "u."), ("assistant", "a!"), ("user", "v?")]
    rows = [(k, i, role, text, 0) for k, talk in talks.items() for i, (role, text) in enumerate(talk)]
    table = turns.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int").repartition(3))
    audits = turns._audits(table)
    got = {x.conv_id: (x.illegal, x.cost, x.audit) for x in audits.collect()}
    lines = {x.conv_id: x.repaired for x in turns._texts(turns.repaired(table, audits)).collect()}
    marks = Counter((x.conv_id, x.fault) for x in table.collect())
    for k, talk in talks.items():
        want = repair_by_force(talk)
        assert (*(marks[k, f] for f in ("blank", "duplicate", "truncated")), *got[k], lines.get(k, "")) == want, (k, talk)


def test_repair_awkward(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, None, None, None), (2, None, "user", "x"), (None, 1, "user", "a."), (None, 1, "assistant", "b."), (None, 1, "user", "a."), (3, 1 << 62, "user", "."), (3, -(1 << 62), "assistant", "."), (4, 5, "user", LONG), (4, 6, "assistant", "ok.")]
    schema = "conv_id long, turn long, role string, text string, pos string, rank string, fault string, block string, cost string, copy string, audit string"
    table = spark.createDataFrame([(*x, *"prfbcxy") for x in rows], schema)
    got = {x.conv_id: x for x in turns.repair(table).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for k, x in got.items():
        own = []
        for _, t, role, text in sorted((y for y in rows if y[0] == k), key=lambda y: (y[1] is not None, y[1] or 0, y[2] or " ", hashlib.md5((y[3] or " ").encode()).hexdigest())):
            kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
            role, text = role or " ", " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                own += [("user" if kind == 4 else role, text, t)] * (2 if kind == 3 else 1)
        want = repair_by_force([y[:2] for y in own])
        assert (x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired) == want
        known = [y[2] for y in own if y[2] is not None]
        assert x.gaps == (min((1 << 63) - 1, max(known) - min(known) + 1 - len(set(known))) if known else 0)
    assert turns.repair(table.limit(0)).count() == 0


def test_repair_stays_native(spark):
    plan = turns.repair(spark.read.parquet(f"{DATA}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
