"""Operators on small tables: defined results for odd rows, brute force, round trips."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actlens.llm import (chat, components, language, mixing, neardup_vectors, ngram_join, pages, pieces, quality,
                         shingles, stages, urls, vector_search)
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = "word " * 30_000


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, a clashing column."""
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "a", 0, 1.0), (3, "!!! 12", None, "a", 6, None),
            (4, LONG, "en", "a", len(LONG), 1.0), (5, "one two three", "en", None, 13, 1.0),
            (5, "one two three", "en", None, 13, 1.0), (None, "one two three", "de", "b", 13, 1.0),
            (7, "One TWO three", "de", "b", 13, 1.0)]
    return spark.createDataFrame(rows, DOC)


# -- shingles and the n-gram join

@given(st.lists(st.one_of(st.none(), st.text("aB \t\n\x0b\x85é▁", max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_match_plain_python(texts):
    got = [len(s) for _, s in shingles.shingle_sets(pa.array(texts, pa.string()), chunk_bytes=16)]
    assert got == [len(shingle_set(t)) for t in texts]


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    sets = [shingle_set(t) for _, t in rows]
    for i, j in product(range(len(rows)), repeat=2):
        if i < j and sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_copies(seed, n):
    rng, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(60)]
    for d in range(n):
        base = random.Random(seed * 100 + d % 7)
        w = [f"w{base.randrange(3000)}" for _ in range(80)]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        if d % 3 == 0:
            w[40:40] = common
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_match_brute_force(spark, seed):
    rows = near_copies(seed, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=repr)
    assert got == brute_components(rows)


@pytest.mark.parametrize("ids_broadcast", [0, 500_000])
def test_ngram_small_ranges_and_blocks(spark, monkeypatch, ids_broadcast):
    """Postings over many ranges, and every group of runs dealt over blocks of both sides."""
    monkeypatch.setattr(ngram_join, "POSTINGS_PER_RANGE", 100)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", ids_broadcast)
    monkeypatch.setattr(ngram_join, "MAIN_ROUNDS", 0)       # leave the open pairs more to do
    rows = near_copies(3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=repr) == brute_components(rows)


def test_open_pairs_are_the_same_for_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:30], rng.choice(base[30:], 5), rng.integers(1, 1 << 62, 2).astype(np.uint64)]))
            for _ in range(40)]
    nodes = spark.createDataFrame([(i, len(s), bytearray(ngram_join.parity_bits(s))) for i, s in enumerate(sets)],
                                  "node long, n long, bits binary")
    shared = spark.createDataFrame([(r, i, len(sets[i]), 0) for r in range(6) for i in range(40) if (i + r) % 3 < 2],
                                   "run long, node long, n long, pos long")
    labels = spark.createDataFrame([(i, 0 if i < 24 else 30) for i in range(40) if not 24 <= i < 30],
                                   "node long, component_id long")
    part = [0 if i < 24 else i if i < 30 else 30 for i in range(40)]
    run = {(r.run, r.node) for r in shared.collect()}
    want = set()
    for i in range(40):
        for j in range(i):
            a, b = sorted(((len(sets[i]), i), (len(sets[j]), j)))
            if part[i] != part[j] and any((r, i) in run and (r, j) in run for r in range(6)) and ngram_join.may_link(
                    a[0], b[0], ngram_join.parity_bits(sets[a[1]]), ngram_join.parity_bits(sets[b[1]])):
                want.add((a[1], a[0], b[1], b[0]))
    assert want
    for block_rows in (3, 20, 8_000):
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
        got = [tuple(p) for p in ngram_join.open_candidates(shared, labels, nodes).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_ngram_odd_rows(spark, odd):
    got = sorted(map(tuple, ngram_join.ngram_components(odd).collect()), key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.ngram_components(odd.limit(0)).count() == 0


def test_near_duplicate_stage_keeps_rows_that_share_an_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "seven eight nine ten eleven twelve")
    docs = "doc_id long, text string, lang string, source string"

    def kept(rows):
        df = spark.createDataFrame([(*r, "en", "s") for r in rows], docs)
        return sorted((r["doc_id"], r["text"]) for r in stages.near_duplicate_stage(spark, df, "").collect())
    assert kept([(5, a), (5, b)]) == [(5, a), (5, b)]
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(3, a), (5, a), (3, c), (1, c)]) == [(1, c), (3, a)]
    assert kept([(5, a), (5, a.upper()), (5, a)]) == [(5, a.upper())]
    many = [(i % 9, t) for i, t in near_copies(3, 60)]
    groups, best = brute_components([(i, t) for i, (_, t) in enumerate(many)]), {}
    for i, _, g in groups:
        best[g] = min(best.get(g, many[i]), many[i])
    assert kept(many) == sorted(best.values())


def test_stages_take_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.coalesce("doc_id", F.lit(6)))
    rows = sorted(map(tuple, docs.collect()), key=repr)
    mixed = sorted(map(tuple, stages.mixing_stage(spark, docs, "").collect()), key=repr)
    assert {r for r in mixed} <= {r for r in rows if words(r[1])}
    sizes, taken, took = {}, {}, {}
    for r in mixing.mix_sources(docs.select("doc_id", "source", "text")).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["size"]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    for r in rows:
        share = taken[r[0]] / sizes[r[0]] if sizes[r[0]] else 0
        took[r[0]] = took.get(r[0], 0) + int(share + 0.5)
    assert {d: sum(r[0] == d for r in mixed) for d in took} == took
    kept = sorted(map(tuple, stages.near_duplicate_stage(spark, docs, "").collect()), key=repr)
    best = {}
    for (i, _, g), r in zip(sorted(brute_components([(i, r[1]) for i, r in enumerate(rows)])), rows):
        best[g] = min(best.get(g, r), r, key=lambda v: (v[0], v[1] or ""))
    assert kept == sorted(best.values(), key=repr)
    assert stages.piece_stage(spark, docs, "").filter("lossless").count() == len(rows)
    assert stages.mixing_stage(spark, docs.limit(0), "").count() == 0


def test_bitmap_bound_never_rejects_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(1, 1 << 60, rng.integers(5, 300)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(1, 1 << 60, 5).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        links = 7 * both >= 3 * (len(a) + len(b))
        assert ngram_join.walk_trie(a, [b]) == [links]
        assert not links or ngram_join.may_link(len(a), len(b), ngram_join.parity_bits(a), ngram_join.parity_bits(b))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 60)], "a long, b long")
    got = {r["node"]: r["component_id"] for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in range(51)}


# -- mixing

def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 5}" if i % 5 else None) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=16)
    got = got.collect()
    assert sum(r["size"] for r in got) == sum(i % 37 for i in range(400))
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6


def test_mix_odd_rows(spark, odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mix_without_ids_fills_no_slice(spark, monkeypatch):
    """Rows with a null or repeated id are spread over slices, and the mix stays the one of its SQL order."""
    import hashlib
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", 50)
    rows = [(None if i % 3 else (7 if i % 2 else i), "w " * (i % 11), "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select("doc_id", F.lit(1).alias("sid"), mixing.count_words(F.col("text")).alias("size")) \
                .withColumn("row", F.monotonically_increasing_id())
    seen = []
    cut = mixing.slice_rows
    monkeypatch.setattr(mixing, "slice_rows", lambda *a: seen.append(cut(*a)) or seen[-1])
    placed = mixing.place_documents(mixing.materialize(sized, "test"), 600, "mix-1:").collect()
    counts = [r["count"] for r in seen[0].groupBy("slice").count().collect()]
    assert len(counts) > 6 and max(counts) < 200
    want, at = [], 0
    for d, size in sorted(((d, len(t.split())) for d, t, _ in rows),
                          key=lambda x: (hashlib.md5(f"mix-1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])):
        want.append((d, size, at))
        at += size
    assert sorted(((r["doc_id"], r["size"], r["begin"]) for r in placed), key=str) == sorted(want, key=str)


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 9000)], "source string, size long")
    plan = mixing.source_plan(sizes, 10)
    slots = plan.agg(F.sum("n_slots")).first()[0]
    rows = mixing.schedule(plan, slots, 64).collect()
    need = {r["sid"]: r["n_slots"] for r in plan.collect()}
    assert {s: sorted(r["rank"] for r in rows if r["sid"] == s) for s in need} == {s: list(range(n)) for s, n in need.items()}
    for s, n in need.items():      # every prefix is close to its share
        at = sorted(r["slot"] for r in rows if r["sid"] == s)
        assert all(abs((i + 1) - (t + 1) * n / slots) < 8 for i, t in enumerate(at))


# -- chat

PARTS = st.text("</s>[INST]|\\ <>SY\nab", max_size=24)


@given(PARTS)
@settings(max_examples=200, deadline=None)
def test_unescape_inverts_escape(text):
    escaped = re.sub(chat.CONTROL, lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)
    assert chat.unescape(escaped) == text and "<|" not in escaped and "[INST]" not in escaped


def test_chat_parts_and_odd_rows(spark):
    rows = [(1, 0, "user", [("text", "see <|end|> ", None, None), ("image", None, "i.png", 2.0), ("weird", None, "d", None)]),
            (1, 1, "assistant", [("text", "</s>[INST] \\ok", None, None)]), (1, 1, "assistant", []),
            (None, None, None, [(None, None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    done = chat.format_turns(df)
    first = done.filter("turn = 0").first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "i.png", 1152), ("document", "d", 512)]
    assert first["expanded_tokens"] == 1664 and "<|image:i.png|>" in first["formatted"]
    back = {r["conv_id"]: r for r in chat.read_back(done).collect()}
    assert back[1]["n_turns"] == 3 and back[1]["loss_chars"] == len("</s>[INST] \\ok")
    assert back[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] \\ok").hexdigest()
    assert back[None]["n_turns"] == 1 and back[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.read_back(done.limit(0)).count() == 0


# -- language, quality

def test_language_odd_rows(spark, odd):
    learn = spark.createDataFrame([(i, f"the cat and the dog {i}" if i % 2 else f"die katze und der hund {i}",
                                    "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    model = language.fit_languages(learn, F.lit(True))
    got = language.predict_languages(odd, model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and all(0 <= r["lang_score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in language.predict_languages(learn, model).orderBy("doc_id").collect()] == ["de", "en"] * 30
    none = language.fit_languages(odd.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict_languages(odd, none).collect()} == {"und"}
    assert language.predict_languages(odd.limit(0), model).count() == 0


def test_quality_rules(spark, odd):
    rows = [(i, "### $$$ ### $$$ " * (3 + i % 5) if i % 3 == 0 else f"A plain line of words number {i}, quite long. " * 3)
            for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)] + [(999, None), (None, 1)],
                                   "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, F.lit(True))
    scored = quality.score_quality(docs, model).collect()
    assert model.rules and all((r["quality_score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in scored)
    # the compiled column equals the rules applied directly
    x = quality.text_stats(pa.array([t for _, t in rows]))
    held = quality.rule_matrix(x, model.rules)
    want = 1 / (1 + np.exp(-(held @ np.array(model.weights) + model.bias)))
    assert np.allclose([r["quality_score"] for r in sorted(scored, key=lambda r: r["doc_id"])], want)
    got = quality.score_quality(odd, model)
    assert got.count() == odd.count() and got.filter("quality_score is null").count() == 0
    assert quality.fit_quality(docs, labels.limit(0), F.lit(True)).rules == []


# -- pages, urls

def test_main_text():
    page = ("<html><body class='has-sidebar'><nav>menu</nav><div class=ad>buy</div><article><h1>T&amp;t</h1><p>a <b>b</b>\n c"
            "<br>d<p>e<script>x='</p>'</script><div class='comments'>no</div><ul><li>1<li>2</ul></article><footer>f</footer>")
    assert pages.main_text(page, set()) == "T&t\na b c d\ne\n1\n2"
    assert pages.main_text(None, set()) == pages.main_text("", set()) == ""
    assert pages.main_text("plain &lt;text", set()) == "plain <text"
    assert pages.main_text("<div>" * 5000 + "deep", set()) == "deep"


@pytest.mark.parametrize("page,want", [
    ("<article class='post has-sidebar'><p>a</p></article>", "a"),
    ("<div id='page' class='site header-fixed'><article><p>a</p></article></div>", "a"),
    ("<div class='layout no-footer'><p>a</p></div>", "a"),
    ("<article><h1 class='entry-header'>t</h1><section id='related-work'><p>r</p></section><p class='share-price'>9</p></article>",
     "t\nr\n9"),
    ("<article class='promo'><h2 class='header'>t</h2><p>a</p><p class='ad'>x</p><div class='x Sidebar'>y</div></article>", "t\na"),
    ("<div class='overlay'><main><p>a</p></main></div>", "a"),
    ("<main><h1>t</h1><div class='modal'><article><p>a</p></article></div></main>", "a"),
    ("<div class='widget'><article><p>a</p></article></div>", "a"),
    ("<article><p>a</p></article><div class='related'><article>r</article></div>", "a"),
    ("<main><p>a</p><div class='comments'><article>c</article></div></main>", "a")])
def test_names_drop_only_as_whole_tokens(page, want):
    assert pages.main_text(f"<body>{page}</body>", set()) == want


def test_site_templates(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Top of site</div><div><p>Text {i} here</p></div>") for i in range(8)]
    rows += [(90, None, None), (91, "x", ""), (91, "x", "")]
    got = {r["page_id"]: r["text"] for r in
           pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {i} here" for i in range(8)) and got[90] == got[91] == ""


def test_copies_are_no_template_and_layouts_are(spark):
    copy = "<body><div>Top</div>{}<article><div class='body'><section><p>Same text</p></section></div></article></body>"
    bare = "<body><div>Top</div><div><p>Same text</p></div></body>"
    rows = [(i, "http://copies/x", copy.format(f"<div class='ad'>ad {i}</div>")) for i in range(8)]
    rows += [(8 + i, None, bare) for i in range(8)]
    rows += [(100 + i, "http://layouts/x", f"<body><div>Layout {i % 3}</div><div><p>Text {i}</p></div></body>") for i in range(30)]
    rows += [(200 + i, "http://small/x", f"<body><div>Top</div><div><p>Text {i}</p></div></body>") for i in range(3)]
    rows += [(300 + i, "http://mixed/x", bare if i < 6 else f"<body><div>Top</div><div><p>Text {i}</p></div></body>") for i in range(11)]
    got = {r["page_id"]: r["text"] for r in
           pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Same text" for i in range(8)) and all(got[8 + i] == "Top\nSame text" for i in range(8))
    assert all(got[100 + i] == f"Text {i}" for i in range(30)) and all(got[200 + i] == f"Text {i}" for i in range(3))
    assert all(got[300 + i] == ("Same text" if i < 6 else f"Text {i}") for i in range(11))


def test_url_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/x"), (2, "http://a.example.com/en/"), (3, "http://b.com/q?x"), (4, "http://b.com"),
            (5, "http://spam-farm.org/a"), (6, None), (7, "no scheme"), (8, "http://x.net/es/1"), (9, "http://notcom/"), (8, "http://x.net/es/1")]
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in
           urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert sorted(got) == [(1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "com/", "allow"),
                           (4, None, "allow"), (5, None, "block"), (6, None, "allow"), (7, None, "allow"),
                           (8, "net/es/", "block"), (8, "net/es/", "block"), (9, None, "allow")]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_as_a_table(spark):
    """10,000 sites and some words as tables against a plain reading of the rules."""
    import random
    import re
    rng = random.Random(5)
    names = [f"site{i}" for i in range(9_990)]
    sites = [(f"{n}.{'com' if i % 2 else 'org'}", "/" if i % 3 else "/a-b/", "block" if i % 4 else "allow")
             for i, n in enumerate(names)]
    sites += [("com", "/", "allow"), ("site3.com", "/a.b+c/", "block"), ("x_y.com", "/", "block"), ("site5.com", "/", "allow"),
              (None, "/", "block")]
    words = [("free-bets", "block"), ("c++", "block"), ("++", "block"), (None, "block")]
    urls_ = [f"https://{rng.choice(['', 'www.', 'not'])}{rng.choice(names)}.{rng.choice(['com', 'org', 'net'])}"
             f"{rng.choice(['/', '/a-b/x', '/a-b', '/a.b+c/', '/axb+c/', '', '/free-bets', '/c++/q'])}" for _ in range(600)]
    urls_ += ["http://x_y.com/", "http://a.x_y.com/", "http://site5.com/", "http://e.net/freebets", "http://e.net/a++b"]
    table = urls.site_rules(spark.createDataFrame(sites, "host string, path string, action string")).unionByName(
        urls.word_rules(spark.createDataFrame(words, "word string, action string")))
    pages_ = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages_, table).collect()}
    for i, u in enumerate(urls_):
        host, path = re.match("https?://([^/]*)(.*)", u).groups()
        fit = max(((len(h + p), h + p, a) for h, p, a in sites if h and path.startswith(p)
                   and (host == h or host.endswith("." + h))), default=None)
        bad = any(re.search("(?:^|[^A-Za-z0-9])" + re.escape(w) + "(?:[^A-Za-z0-9]|$)", host + path) for w, _ in words if w)
        assert got[i] == ((fit[1], fit[2]) if fit else (None, "block" if bad else "allow")), u


def test_url_rules_odd_tables(spark):
    pages_ = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    schema = "rule string, regex string, tokens array<string>, action string, kind string"
    # no tokens, null tokens, one name for two expressions, repeats, no expression
    rules = [("r", "a.com", None, "block", None), ("r", "zzz", ["zzz", None], "block", "pattern"), ("n", None, ["a"], "block", None),
             (None, "a", [], "block", None), ("r", "a.com", None, "block", None)]
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in urls.judge_urls(pages_, spark.createDataFrame(rules, schema)).collect()}
    assert got == {1: ("block", "r"), 2: ("allow", None)}
    none = urls.judge_urls(pages_, spark.createDataFrame([], schema)).collect()
    assert [r["verdict"] for r in none] == ["allow", "allow"]


# -- pieces

@pytest.fixture(scope="module")
def table():
    return pieces.load_pieces()


@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(" \n▁aé", max_size=12)), max_size=5))
@settings(max_examples=60, deadline=None)
def test_pieces_round_trip(table, texts):
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    for a, b, ids, n in pieces.encode_texts(table, pa.array(texts, pa.string()), np.arange(len(texts)), chunk_bytes=32):
        data, ends = pieces.decode_ids(table, ids, n)
        assert [data[ends[i]:ends[i + 1]].tobytes().decode() for i in range(b - a)] == [t or "" for t in texts[a:b]]


def test_sampled_shares_match_enumeration(table):
    """Sampled segmentations of a word occur as often as their weights say."""
    weight, start = table.log_weight, table.out_start
    by_text = {table.out_bytes[start[i]:start[i + 1]].tobytes().decode(): i for i in range(table.size) if np.isfinite(weight[i])}

    def spellings(s):
        if not s:
            return [()]
        return [(by_text[s[:k]], *rest) for k in range(1, len(s) + 1) if s[:k] in by_text for rest in spellings(s[k:])]
    every = spellings(" hello")
    p = np.exp([sum(weight[list(x)]) for x in every])
    want = dict(zip(every, p / p.sum()))
    n = 20_000
    seen = {}
    for _, _, ids, count in pieces.encode_texts(table, pa.array(["hello"] * n), np.arange(n)):
        at = 0
        for c in count:
            key = tuple(ids[at:at + c].tolist())
            seen[key] = seen.get(key, 0) + 1
            at += c
    assert set(seen) <= set(want)
    assert all(abs(seen.get(x, 0) / n - q) < 0.02 for x, q in want.items())


def test_pieces_of_odd_rows(spark, odd, table):
    a, b = (sorted(map(tuple, pieces.encode_documents(odd, table).collect()), key=repr) for _ in range(2))
    assert a == b and all(r[3] for r in a) and len(a) == odd.count()
    assert [r[1] for r in a if r[0] == 1] == [None] and [r[1] for r in a if r[0] == 2] == [0]


# -- vectors

def vector_rows(seed=1, n=300, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    x = np.repeat(base, 6, axis=0)[:n] + rng.normal(size=(n, dim)) * 0.12
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [None] * dim), (n + 5, [1.0, 2.0])]
    return rows, x


def test_near_duplicate_tiles_need_each_block_once(spark):
    """All pairs of 64 blocks in 8 ranges: a block goes once to each pair of tiles, not to each pair of blocks."""
    seqs = range(64)
    pairs = spark.createDataFrame([(4, a, b) for a in seqs for b in seqs if a <= b], "dim int, a long, b long")
    blocks = spark.createDataFrame([(4, s, b"", b"") for s in seqs], "dim int, seq long, uids binary, x binary")
    rows = neardup_vectors.tile_rows(pairs, blocks, 3, 2).collect()          # four tiles of two ranges
    assert len(rows) == 64 * 4
    assert sorted((r["seq"], m) for r in rows for m in r["mates"]) == [(a, b) for a in seqs for b in seqs if a <= b]
    x = np.array([[0.1, 2.0], [3.0, 4.0]])
    for v in (x, x.astype(np.float32).astype(float), x * 1e300):
        assert (neardup_vectors._unpacked(neardup_vectors._packed(v), 2, 2) == v).all()
    assert len(neardup_vectors._packed(x.astype(np.float32).astype(float))) == x.nbytes // 2


def test_near_duplicate_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neardup_vectors, "SUB_ROWS", 8)
    rows, x = vector_rows()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicate_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (links[i].sum(), label[i])
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(x), len(rows)))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neardup_vectors.near_duplicate_vectors(empty).count() == 0


def test_repeated_vectors_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicate_vectors(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (4, 0, 4)]


def test_search_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ROWS_PER_LEAF", 64)
    monkeypatch.setattr(vector_search, "CHUNK_ROWS", 50)
    rows, x = vector_rows(n=900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search_vectors(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hit = 0
    for q in range(0, 900, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r["score"] for r in mine], [x[q] @ x[r["vec_id"]] for r in mine], atol=1e-9)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10]) & {r["vec_id"] for r in mine})
    assert hit >= 0.9 * 10 * 45
    few = vector_search.search_vectors(df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4
    assert vector_search.search_vectors(df.limit(0), F.lit(True)).count() == 0


def test_search_of_small_leaves_finds_k(spark, monkeypatch):
    """Hot groups of one leaf each fill the calibration; rare queries sit in a leaf of few rows."""
    monkeypatch.setattr(vector_search, "ROWS_PER_LEAF", 32)
    monkeypatch.setattr(vector_search, "CALIBRATION_QUERIES", 4)
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(12) * 10, 30, axis=0)[:330]
    x[300:] = np.eye(12)[11] * 10
    x = np.vstack([x, np.eye(12)[10] * 10 + np.zeros((6, 1))])
    x += rng.normal(size=x.shape) * 0.001
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.search_vectors(df, F.lit(True), k=20).collect()
    counts = {}
    for r in got:
        counts[r["query_id"]] = counts.get(r["query_id"], 0) + 1
    assert set(counts) == set(range(336)) and set(counts.values()) == {20}



def test_visits_go_on_until_leaves_hold_k(spark):
    tree = vector_search.fit_tree(np.array([[1.0, 0], [0, 1.0], [-1.0, 0], [0, -1.0]] * 20), 1.0, 8)
    n = max(tree.leaf) + 1
    queries = spark.createDataFrame([(1, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, own long")
    assert n > 2
    for own_rows, want in ((1, 1), (2, 2), (6, 2), (7, 3)):
        asked = queries.withColumn("own", F.lit(own_rows).cast("long"))
        assert vector_search._visits(asked, tree, 1, {leaf: 5 for leaf in range(n)}, 4).count() == want


# -- mended cases

def test_vector_search_of_odd_queries(spark):
    schema = "vec_id long, embedding array<double>"
    x = np.random.default_rng(3).normal(size=(90, 4))
    plain = [(i + 1, x[i].tolist()) for i in range(90)]
    asked = F.col("vec_id") % 20 == 0

    def found(rows, k=5):
        got = vector_search.search_vectors(spark.createDataFrame(rows, schema), asked, k=k).collect()
        return sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got)
    assert found([r for r in plain if r[0] % 20]) == []
    other = [(100, []), (120, None), (140, [0.0] * 4), (160, [1.0, 2.0]), (161, [2.0, 1.0]), (180, [float("inf")] * 4),
             (20, [9.0, 9.0]), (200, [1.0, 2.0, 3.0])]
    got = found(plain + other + [(40, x[0].tolist()), (40, x[0].tolist())])
    assert got == found(plain[::-1] + [(40, x[0].tolist())] + other + [(40, x[0].tolist())])
    n = {q: sum(r[0] == q for r in got) for q in {r[0] for r in got}}
    assert n == {20: 2, 40: 5, 60: 5, 80: 5, 160: 2}
    assert [r[2] for r in got if r[0] == 160] == [20, 161] and all(r[0] != r[2] for r in got)
    assert found([(20, None), (40, []), (41, [0.0])]) == []


def test_vector_search_recall_on_clusters(spark):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(300, 16))
    x = centres[np.minimum(rng.geometric(0.02, 20_000) - 1, 299)] + rng.normal(size=(20_000, 16)) * 0.35
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.search_vectors(rows, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(
        F.collect_list("vec_id").alias("ids")).collect()
    recall = []
    for r in got:
        s = x @ x[r["query_id"]]
        s[r["query_id"]] = -np.inf
        recall.append(len(set(np.argpartition(-s, 20)[:20]) & set(r["ids"])) / 20)
    assert len(recall) == 1000 and np.mean(recall) >= 0.95 and np.mean(np.array(recall) >= 0.9) >= 0.9


@pytest.mark.parametrize("scale", [1e200, 1e-200])
def test_near_duplicates_of_extreme_lengths(spark, scale):
    rows = [(i, [scale * (1 + 1e-9 * i), 2 * scale, -scale]) for i in range(4)] + [(9, [scale, -scale, scale])]
    got = neardup_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, 3, 0) for i in range(4)] + [(9, 0, 9)]


def test_every_language_is_learned(spark):
    names = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, f"{n} {n}{n} zz{n}", n) for i, n in enumerate(names * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, F.lit(True))
    assert sorted(v for lang in model.languages.values() for v in lang) == sorted(names)
    assert max(map(len, model.languages.values())) <= language.MOST_IN_FAMILY
    got = language.predict_languages(docs, model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9


def test_an_id_on_a_third_of_the_rows_is_learned_from(spark):
    rows = [(7, f"the cat and the dog {i}", "en") for i in range(500)] + [(7, "the cat", "en")] * 500
    rows += [(8 + i, f"die katze und der hund {i}", "de") for i in range(500)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.fit_languages(docs, F.lit(True), per_language=50)
    got = language.predict_languages(docs, model, score_column="score")
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert got.filter("lang_pred <> lang").count() == 0
    labels = spark.createDataFrame([(7, 1)] + [(8 + i, 0) for i in range(500)], "doc_id long, quality int")
    clash = docs.withColumn("_stat_bytes", F.lit("x"))
    rules = quality.fit_quality(clash, labels, F.lit(True), rows=100)
    scored = quality.score_quality(clash, rules)
    assert scored.columns == [*clash.columns, "quality_score"] and scored.count() == len(rows)


@pytest.mark.parametrize("page,want", [
    ("<form id=aspnetForm><div class=nav>m</div><article><p>a</p></article></form>", "a"),
    ("<form><div><h1>t</h1><p>Long text of the page</p><input></div></form><div>end</div>", "t\nLong text of the page\nend"),
    ("<div class='content share'><p>a</p></div>", "a"),
    ("<article><p>a</p><form><p>your name</p></form></article>", "a"),
    ("<p>Text of the page that is longer</p><form><p>your name</p></form>", "Text of the page that is longer")])
def test_wrapping_forms_stay(page, want):
    assert pages.main_text(f"<body>{page}</body>", set()) == want


def test_lists_that_some_articles_share_stay(spark):
    shared = "<ul><li>same</li><li>list</li></ul><figure><img><figcaption>same</figcaption></figure>"
    rows = [(i, "http://h/x", f"<body><article><p>Text {i}</p>{shared if i < 10 else ''}<div>Share this</div></article></body>")
            for i in range(60)]
    got = {r["page_id"]: r["text"] for r in
           pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"Text {i}\nsame\nlist\nsame" if i < 10 else f"Text {i}") for i in range(60))
