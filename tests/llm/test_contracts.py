"""The registered queries over small tables: columns, types, folds, empty tables, extra columns, very long texts; ablations of op4 and op9."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import html_text, license_join, queries, quality, shared, toxicity

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: Columns and types that the contracts fix.
CONTRACTS = {
    "op1": "doc_id bigint, fingerprint string, component_id bigint",
    "op2": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9": "page_id bigint, url string, text string, n_chars bigint",
    "op10": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13": "doc_id bigint, n_shingles bigint, component_id bigint",
}
BY_NUMBER = {name.split("_")[0]: f for name, f in queries.QUERIES.items()}
ONE_ROW_A_DOCUMENT = ("op1", "op2", "op4", "op5", "op7", "op8", "op10", "op13")


def write_tables(spark, path, docs, labels, pages=(), conversations=()):
    extra = ", score double, label string, held_out int, n int, h string, root string, lang_pred int"
    spark.createDataFrame([(*r, 1.0, "x", 2, 3, "y", "z", 4) for r in docs], "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(*r, 1) for r in pages], "page_id long, url string, html string, n_chars int").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(*r, 1) for r in conversations], "conv_id long, turn long, role string, text string, d int").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, prose(30)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = [prose(rng.randint(5, 60), rng) + (" grumblefoot snarkwit" if i % 4 == 0 else "") for i in range(160)]
    texts += [None, "", " ", "123 456", texts[3], texts[3], "Ünïcödé " * 5, prose(900_000, rng)]  # the last has some five megabytes
    docs = [(i, t, ["en", "de", None][i % 3], "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (3, texts[4], "en", "s", 1)]
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(160)] + [(4, 0, 1)]
    pages = [(1, "u", f"<article><p>{prose(50)}</p></article>"), (2, None, None), (3, "v", ""), (3, "v", "<p>" + prose(9) + "</p><br>" * 20_000)]
    return write_tables(spark, str(tmp_path_factory.mktemp("small")), docs, labels, pages, [(c, t, "user", prose(3)) for c in range(7) for t in range(4)]), docs


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("none")), [], [])


@pytest.mark.parametrize("number", sorted(CONTRACTS, key=lambda n: int(n[2:])))
def test_contract(spark, tables, number):
    path, docs = tables
    out = BY_NUMBER[number](spark, path)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split() for x in CONTRACTS[number].split(", "))} == dict(x.split() for x in CONTRACTS[number].split(", "))
    rows = out.collect()
    if number in ONE_ROW_A_DOCUMENT:
        assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    if number in ("op4", "op5", "op8"):
        modulus, held = {"op4": (3, 1), "op5": (4, 2), "op8": (4, 2)}[number]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if number in ("op4", "op5"):
        assert all(r.predicted == (r.score >= 0.7) for r in rows)
        texts = {}
        for r, text in ((r, d[1] or "") for d in docs for r in rows if r.doc_id == d[0] and d[0] != 3):
            assert texts.setdefault(text, r.score) == r.score  # equal texts, equal scores
    if number == "op8":
        by = {r.doc_id: r.lang_pred for r in rows}
        assert [by[i] for i in (160, 161, 162, 163)] == ["und"] * 4 and set(by.values()) <= {"en", "de", "und"}
    if number == "op9":
        assert [r.page_id for r in sorted(rows, key=lambda r: (r.page_id, r.n_chars))] == [1, 2, 3, 3]
        assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("number", sorted(CONTRACTS, key=lambda n: int(n[2:])))
def test_empty_tables(spark, empty_tables, number):
    out = BY_NUMBER[number](spark, empty_tables)
    assert out.isEmpty() and {x.split()[0] for x in CONTRACTS[number].split(", ")} <= set(out.columns)


def test_contaminated_query_with_repeated_rows(spark, tmp_path):
    item = prose(30)
    docs = [(1, f"{prose(50)} {item} {prose(50)}", "en", "s", 1)] * 2 + [(1, prose(90), "en", "s", 1), (None, item, "en", "s", 1), (4, None, "en", "s", 1), (5, prose(300_000) + " " + item, "en", "s", 1)]
    path = write_tables(spark, f"{tmp_path}/t", docs, [])
    spark.createDataFrame([(7, item, 1.0), (7, item, 1.0), (8, None, 1.0), (9, "", 1.0)], "item_id long, text string, containment double").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    out = BY_NUMBER["op3"](spark, path)
    assert sorted(((r.doc_id, r.item_id, r.containment) for r in out.collect()), key=str) == [(1, 7, 1.0), (1, 7, 1.0), (5, 7, 1.0), (None, 7, 1.0)]


def test_secret_scan_of_long_candidates_is_linear(spark):
    from strandloom.llm import secret_scan

    took = []
    for n in (20_000, 80_000):
        rng = random.Random(n)
        long = "".join(rng.choice("abcdefABCDEF0123456789+/") for _ in range(n))
        rows = spark.createDataFrame([(1, f"token = {long}"), (2, "secret: abcdef12 " * (n // 17))], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: r.n_assign for r in secret_scan.digest(secret_scan.secret_scan(rows)).collect()}
        took.append(time.time() - began)
        assert got == {1: 1, 2: n // 17}
    assert took[1] < 10 * took[0] + 5


def test_pipeline_of_odd_and_empty_tables(spark, tables, empty_tables):
    import corpus_pipeline

    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id <> 167 or doc_id is null")
    odd = docs.union(spark.createDataFrame([(None, rows[5][1], "en", "s", 1, 1.0, "x", 2, 3, "y", "z", 4), (None, None, None, None, None, None, None, None, None, None, None, None)], docs.schema))
    now = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = shared.stored(spark, stage(spark, now, path), f"odd-{k}")
        assert k == 4 or (out.columns == odd.columns and out.exceptAll(now).isEmpty())
        if k == 1:  # one row of each text; the null id's copy goes, as an id has its text
            normal = lambda df: {" ".join((r.text or "").split(" ")) for r in df.collect()} - {"", " "}
            assert normal(out) == normal(now)
            assert out.where("doc_id is null and text is not null").isEmpty()
        now = out
    assert now.count() > 0
    assert corpus_pipeline.run(spark, empty_tables).isEmpty()


# --- op2 ----------------------------------------------------------------------


def test_each_template_names_itself_alone_in_its_family(spark):
    family = [n for n in license_join.TEMPLATES if n.startswith("cc-by")]
    assert len(family) > 2
    rows = spark.createDataFrame([(i, license_join.TEMPLATES[n]) for i, n in enumerate(family)], "doc_id long, text string")
    for r in license_join.license_scan(rows).collect():
        name = family[r.doc_id]
        assert [x for x in r.labels.split(",") if x.startswith("cc-")] == [license_join.ALIASES.get(name, name)]


# --- op4 ----------------------------------------------------------------------


def brute_logit(model, text):
    words = set(toxicity.WORD.findall(text.lower()))
    found = set()
    for w in words:
        found.add(w)
        if w not in model["terms"]:
            found |= {"^" + w[:n] for n in range(4, min(7, len(w)) + 1)}
    return model["slope"] * (model["intercept"] + sum(v for f, v in model["weights"].items() if f in found)) + model["shift"]


def test_counterfactuals_lower_neutral_mentions(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        y, words = int(i % 3 == 0), prose(rng.randint(20, 80), rng).split()
        if y and rng.random() < 0.8:
            words[rng.randrange(len(words))] = rng.choice(["grumblefoot", "snarkwit", "muddlehead"])
        if rng.random() < (0.7 if y else 0.05):
            words[rng.randrange(len(words))] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, y))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    with_term, without = (toxicity.train(spark, d, lab, strength=s) for s in (1.0, 0.0))
    assert with_term["changes"] > 0
    neutral = spark.createDataFrame([(i, f"{prose(20, rng)} muslim {prose(20, rng)}") for i in range(60)], "doc_id long, text string")
    mean = [np.mean([r[0] for r in neutral.select(toxicity.score_column(spark, m)).collect()]) for m in (with_term, without)]
    assert mean[0] < mean[1] - 0.05  # fewer false positives on neutral mentions
    false = [sum(r[0] >= 0.7 for r in neutral.select(toxicity.score_column(spark, m)).collect()) for m in (with_term, without)]
    assert false[0] <= false[1]
    insults = spark.createDataFrame([(i, f"{prose(30, rng)} snarkwit {prose(5, rng)}") for i in range(30)], "doc_id long, text string")
    hit = [np.mean([r[0] for r in insults.select(toxicity.score_column(spark, m)).collect()]) for m in (with_term, without)]
    assert hit[0] > mean[0] and hit[0] > 0.9 * hit[1]
    scores = [r[0] for r in d.orderBy("doc_id").select(toxicity.score_column(spark, with_term)).collect()]
    want = [1 / (1 + np.exp(-np.clip(brute_logit(with_term, t), -30, 30))) for _, t in rows]
    assert np.abs(np.array(scores) - want).max() < 1e-9


# --- op9 ----------------------------------------------------------------------


def brute_smooth(values, sigma=1.0):
    out = []
    for i in range(len(values)):
        w = [np.exp(-((i - j) ** 2) / (2 * sigma**2)) if abs(i - j) <= np.ceil(2 * sigma) else 0.0 for j in range(len(values))]
        out.append(float(np.dot(w, values) / np.sum(w)))
    return out


def parsed(page):
    parser = html_text.Lines()
    parser.feed(page)
    parser.close()
    parser.end_line()
    return parser.lines, parser.regions


LINKS = "".join(f"<p><a href=x>{w}</a> <b>{w}</b></p>" for w in ("Home", "About", "News", "Team", "Jobs", "Press", "Help", "Blog", "Shop", "Work"))


def test_ratios_and_threshold_choose_lines():
    p = [prose(60) for _ in range(5)]
    body = "".join(f"<p>{x}</p>" for x in p[:2]) + "<p>Short.</p>" + "".join(f"<p>{x}</p>" for x in p[2:])
    page = f"<body><div class=start>{LINKS}</div><div class=text>{body}</div><div class=end>{LINKS}</div></body>"
    lines, regions = parsed(page)
    assert html_text.main_text(page).split("\n\n") == [*p[:2], "Short.", *p[2:]]
    ratios, threshold = html_text.line_ratios(lines)
    raw = [len(t) / max(1, tags) for t, tags, _, _ in lines]
    assert np.allclose(ratios, brute_smooth(raw)) and abs(threshold - np.std(brute_smooth(raw))) < 1e-9
    flat = f"<body>{LINKS}{body}{LINKS}</body>"  # one region: the ratios cut its lines
    assert html_text.main_text(flat).split("\n\n")[1:-1] == [*p[:2], "Short.", *p[2:]] or html_text.main_text(flat).split("\n\n") == [*p[:2], "Short.", *p[2:]]
    assert "Team" not in html_text.main_text(flat)


def test_threshold_and_smoothing_matter(monkeypatch):
    p = [prose(60) for _ in range(6)]
    stray = f"<div>{LINKS}<p>{prose(7)}</p>{LINKS}</div>"
    page = f"<body>{stray}<div>" + "".join(f"<p>{x}</p>" for x in p) + "</div></body>"
    want = html_text.main_text(page)
    assert want.split("\n\n") == p
    real = html_text.line_ratios
    monkeypatch.setattr(html_text, "line_ratios", lambda lines, sigma=1.0: (real(lines, sigma)[0], 0.0))  # every line is content
    assert html_text.main_text(page) != want
    monkeypatch.setattr(html_text, "line_ratios", real)
    mixed = f"<body><div>{LINKS}<p>{prose(24)}</p>{LINKS}</div><div>" + "".join(f"<p>{x}</p>" for x in p) + "</div></body>"
    assert html_text.main_text(mixed, sigma=1.5).split("\n\n") == p
    assert html_text.main_text(mixed, sigma=0) != html_text.main_text(mixed, sigma=1.5)  # without smoothing one long line selects its links


def test_structure_vetoes_by_whole_names():
    p = [prose(50) for _ in range(3)]
    page = f"<body><article><p>{p[0]}</p><div class='social-history'><p>{p[1]}</p></div><div class='cookie-notice x'><p>{p[2]}</p></div><div id='comments-list-2'><p>{p[2]}</p></div></article></body>"
    assert html_text.main_text(page).split("\n\n") == p[:2]


def test_comments_and_long_pages_are_linear():
    assert html_text.main_text("<p>a</p><!-- x <p>b</p>") == "a" and html_text.main_text("<p>a<!-- b --> c<!--> d</p>") == "a c d"
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        html_text.main_text("<p>some words here" * n)
        html_text.main_text("<p>x</p>" + "<!-- " * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


# --- op5 ----------------------------------------------------------------------


def test_quality_score_equals_sizes_by_zstandard(spark, tables):
    path, docs = tables
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    model = quality.train(spark, read("documents"), read("labels"))
    some = read("documents").where("doc_id < 40 and doc_id <> 3")
    scores = {r.doc_id: r.s for r in some.select("doc_id", quality.score_column(spark, model).alias("s")).collect()}
    again = {r.doc_id: r.s for r in some.repartition(7).select("doc_id", quality.score_column(spark, model).alias("s")).collect()}
    assert scores == again and len(scores) == 39
    assert shared.remainder("doc_id", 4) is not None and some.where(F.col("doc_id") == 3).isEmpty()
