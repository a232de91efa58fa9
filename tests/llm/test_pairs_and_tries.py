"""Collocations, conversation tries and the Jaccard join against brute force, and their edge cases."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import collocations, conversation_trie, count_tree, jaccard_join, near, queries, shared

RNG = random.Random(11)


# --- 11 -----------------------------------------------------------------------


def brute_collocations(rows, max_words=3, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ",;:!?\n\x0b\x0c\r":
            text = text.replace(c, ".")
        for piece in text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, left, right = min(((1000000 * a * a) // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrases(n, rng):
    words = ["New", "York", "city", "hall", "of", "the", "été", "Ünder", "a'b", "x y"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(n))


@pytest.mark.parametrize("max_words,least,top,block", [(3, 10, 2000, 8 << 20), (4, 3, 7, 200), (2, 5, 5, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, max_words, least, top, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rng = random.Random(block)
    rows = [(rng.choice(["en", "en", None, "und", "fr"]), phrases(rng.randint(0, 60), rng)) for _ in range(60)] + [("en", None), (None, ""), ("en", "of the " * 3000), ("de", " .. ,")] + [("fr", "the été city hall")] * 30
    docs = spark.createDataFrame([(i, *r, "w", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word string, block int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, max_words=max_words, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_collocations(rows, max_words, least, top)


def test_collocation_score_is_exact(spark):
    for a, left, right in ((10**15, 10**15 + 7, 3 * 10**15 + 1), (7, 11, 13), (10**15 - 1, 10**15 - 1, 10**15 - 1), (9, 9, 9)):
        row = spark.range(1).select(collocations.score(*(F.lit(x).cast("long") for x in (a, left, right)))).first()[0]
        assert row == 1000000 * a * a // (left * right)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).isEmpty()
    assert collocations.collocations(spark.createDataFrame([("en", "a b c")], docs.schema)).isEmpty()


# --- 12 -----------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    paths = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        own, base = ([t[3:] for t in sorted(convs.get(k, []))] for k in (c, c - c % 5))
        paths[c] = tuple(base[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])

    def subtree(node):
        leaves, saved = int(not kids[node]), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for k in kids[node]:
            a, b = subtree(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, own in members.items():
        leaves, saved = subtree(node)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, d int")


@pytest.mark.parametrize("chunk,arity", [(4096, 8), (2, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, chunk, arity):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    monkeypatch.setattr(conversation_trie, "ARITY", arity)
    rng = random.Random(chunk)
    rows = []
    for c in [*range(40), 101, 103, 7000]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["hi", "hé", "", None, "yes"])) for t in range(rng.randint(1, 12))]
    rows += [(60 + k, 0, "user", "same") for k in range(9)] + [(60, 1, "bot", "x")] * 3 + [(None, 1, "user", "lost")]
    rows += [(200, t, "user", str(t % 3)) for t in range(150)] + [(203, 0, "user", "alone")]
    got = conversation_trie.conversation_trie(conversations(spark, rows).repartition(4))
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == brute_trie(rows)
    places = sorted((r.place, r.last, r.depth) for r in got.collect())
    assert [p for p, _, _ in places] == list(range(1, len(places) + 1)) and places[0][1] == len(places)
    for p, last, depth in places:  # the subtree is what follows until a node that is no deeper
        assert all(d > depth for q, _, d in places if p < q <= last) and all(d <= depth for q, _, d in places if q == last + 1)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert conversation_trie.conversation_trie(conversations(spark, [])).isEmpty()
    few = [(3, 0, "user", "a"), (8, 0, "user", "b")]  # their families' first conversations are absent
    got = sorted((tuple(r) for r in conversation_trie.conversation_trie(conversations(spark, few)).select(*COLUMNS).collect()), key=str)
    assert got == brute_trie(few)


# --- 13 -----------------------------------------------------------------------


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 5))) for _ in range(n))


def edited(text, k, rng=RNG):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = prose(1, rng)
    return " ".join(words)


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if text else []
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= round(100 * similarity) * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, "w") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, n int, d int, h string")


def joined(spark, rows, parts=4, **options):
    got = jaccard_join.similar_components(documents(spark, rows).repartition(parts), **options)
    return sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_join_equals_brute_force(spark):
    base = [prose(RNG.randint(5, 200)) for _ in range(40)]
    texts = base + [edited(t, k) for t in base for k in (1, 2, 4, 8)] + base[:9] * 2 + [None, "", " \n ", "One", "one", "two words", "two  Words", "a b c d", "ÀÉ ß x", prose(9000)]
    texts += [t + " " + prose(n) for t in base[:10] for n in (3, 20)] + [" ".join(t.split()[k:]) for t in base[:10] for k in (5, 25)]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    assert joined(spark, rows) == brute_components(rows)


def test_join_of_repeated_and_null_ids(spark):
    t = prose(100)
    rows = [(5, t), (5, prose(50)), (5, t), (None, edited(t, 1)), (None, prose(9)), (8, None), (8, edited(t, 1)), (9, "x"), (7, "X")]
    assert joined(spark, rows) == brute_components(rows)
    assert joined(spark, []) == []


@pytest.mark.parametrize("leaves,leaf", [(1024, 16), (8, 2)])
def test_join_of_a_large_group_of_near_copies(spark, monkeypatch, leaves, leaf):
    monkeypatch.setattr(count_tree, "LEAVES", leaves)
    monkeypatch.setattr(count_tree, "LEAF", leaf)
    rng = random.Random(leaf)
    t = prose(120, rng)
    rows = [(i, edited(t, rng.randint(0, 5), rng)) for i in range(120)] + [(500 + i, prose(60, rng)) for i in range(40)]
    assert joined(spark, rows, 7) == brute_components(rows)


def test_work_on_sets_that_share_rare_passages_is_bounded(spark, monkeypatch):
    """Documents of one of a few long passages and one of some short ones: all share a rare shingle with many, none is similar."""
    made = []
    real = count_tree._candidates
    monkeypatch.setattr(count_tree, "_candidates", lambda *a: made.append(shared.stored(spark, real(*a), "seen")) or made[-1])
    counts = []
    for n in (150, 300):
        rng = random.Random(n)
        long, short = [prose(85, rng) for _ in range(n // 50)], [prose(22, rng) for _ in range(70)]
        rows = [(i, f"{long[i % len(long)]} {short[i % 70]} {prose(12, rng)}") for i in range(n)]
        made.clear()
        assert joined(spark, rows) == brute_components(rows)
        counts.append(sum(m.count() for m in made) / n)
    assert max(counts) <= 2  # pairs tried for each document


def test_tree_allows_every_similar_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        a = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        sets.append(np.unique(a))
        b = a.copy()
        b[: max(1, len(b) // 12)] = rng.integers(0, 2**63, max(1, len(b) // 12), dtype=np.uint64)
        sets.append(np.unique(b))
    points = [count_tree.unpacked(count_tree.packed(count_tree.point(s))) for s in sets]
    sizes, roots = np.array([len(s) for s in sets]), np.arange(len(sets))
    roots[60:90] = 60
    found = {(min(a, b), max(a, b)) for x, y, _ in count_tree.close_pairs(roots, sizes, points, None, 0.8) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if k >= 0.8 * (sizes[i] + sizes[j] - k) and roots[i] != roots[j]:
                assert (j, i) in found
            if roots[i] == roots[j]:
                assert (j, i) not in found
    assert len(found) < 200  # of 7,140 pairs
    assert count_tree.unpacked(count_tree.packed(np.array([3, 70_000]))).tolist() == [3, 70_000]


# --- queries ------------------------------------------------------------------

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
