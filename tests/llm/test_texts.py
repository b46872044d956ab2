"""Token counts, licence scans, HTML extraction and quality scores."""

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geostrata.llm import html_extract as H
from geostrata.llm import license_scan as L
from geostrata.llm import quality as Q
from geostrata.llm import token_counts as T
from geostrata.llm.entry import QUERIES


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_library(text):
    e = T.encoder(T.default_path())
    ids = e.library.encode(text, add_special_tokens=False).ids
    assert e.count(text) == len(ids) and e.encode(text).tolist() == ids


def test_long_words_specials_and_every_character():
    e = T.encoder(T.default_path())
    for text in ["a" * 5000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "<|endof", " " * 99 + "z", " " * 300_000 + "x", "\n" * 5000, "b " + "\t" * 9000 + " c", "".join(map(chr, range(0x3000))), "".join(map(chr, range(0x1F000, 0x1FA00)))]:
        assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids and e.count(text) == len(e.encode(text))
    assert e.merge("lower" * 40) == e.merged("lower" * 40) and e.merge(" indivisible") == e.merged(" indivisible")


def test_whole_tokens_are_proved():
    e = T.encoder(T.default_path())
    assert len(e.whole) > 49_000 and all(e.library.model.tokenize("".join(e.letters[b] for b in w.encode()))[0].id == i for w, i in list(e.whole.items())[::97])


def test_token_query(spark, sf, odd, empty):
    e = T.encoder(T.default_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_token_counts"](spark, sf).collect():
        n = len(e.library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
    rows = T.count_tokens(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert T.count_tokens(empty).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    at = [(i, label) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({label for _, label in at}))


@given(st.lists(st.sampled_from("cc by general public license all rights reserved licence x All Rights 4 é".split()), max_size=40).map(" ".join))
@settings(max_examples=100, deadline=None)
def test_base_places(text):
    sam = L.automaton(tuple(L.TEMPLATES.items()), tuple(L.BASE.items()))
    n, places, _ = sam.scan(text.encode())
    want = brute_base(text)
    assert (n, len(places), ",".join(sorted({sam.base[p][1] for _, p in places}))) == (want[0], want[1], want[4])


def test_matching_statistics_against_all_substrings():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5)]
    templates = {f"t{i}": " ".join(rng.choice(words, 12)) for i in range(4)}
    sam = L.Automaton(templates, {"w0 w1": "a", "w1": "b", "w4 w4 w0": "c"})
    subs = {tuple(t.split()[a:b]) for t in [*templates.values(), "w0 w1", "w1", "w4 w4 w0"] for a in range(12) for b in range(a + 1, 13)}
    for _ in range(50):
        text = list(rng.choice([*words, "z"], 30))
        _, _, matches = sam.scan(" ".join(text).encode())
        longest = [max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in subs), default=0) for i in range(30)]
        want = [(i, n) for i, n in enumerate(longest) if n >= L.LEAST and (i == 29 or longest[i + 1] <= n)]
        assert [(e, n) for e, n, _ in matches] == want


def test_licence_query(spark, sf, odd, empty):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_license_scan"](spark, sf).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(docs[r.doc_id])
        assert ("Apache License, Version 2.0" in docs[r.doc_id]) == ("apache-notice" in r.labels) and 0 <= r.score <= 1
    assert L.scan_licences(odd).count() == odd.count() and L.scan_licences(empty).count() == 0


def test_a_changed_licence_is_still_covered():
    sam = L.automaton(tuple(L.TEMPLATES.items()), tuple(L.BASE.items()))
    text = L.TEMPLATES["mit"].replace("free of charge", "at no cost").encode()
    got = {sam.names[t]: covered / sam.sizes[t] for t, covered, _, _ in sam.chains(sam.scan(text)[2])}
    assert 0.6 < got["mit"] < 1 and got.get("isc", 0) < 0.6


def test_html_against_the_markup(spark, sf):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op7_html_extraction"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_without_marks_keeps_the_loud_middle():
    menu = "".join(f"<li><a href='/{i}'>item</a></li>" for i in range(9))
    body = "".join(f"<p>Sentence {i} of a long paragraph that goes on for a while.</p>" for i in range(6))
    page = f"<html><body><ul>{menu}</ul><div>{body}</div><form>Name <input></form><div class='site-footer'>Imprint and a long row of words that nobody reads at all</div></body></html>"
    assert H.main_text(page) == "\n".join(f"Sentence {i} of a long paragraph that goes on for a while." for i in range(6))


def test_html_without_marks_goes_on_after_asides_and_starts_at_the_title():
    long = [f"Paragraph {i} " + "of words and more words " * 9 for i in range(4)]
    asides = "<nav>one</nav><nav>two</nav><ul class='related'><li>three</li><li>four</li></ul>"
    menu = "<ul><li>Home</li><li>About</li></ul>"
    page = f"<body>{menu}<h1>Title</h1><p>By me</p><div class='share'>share this</div>" + f"<p>{long[0]}</p><p>{long[1]}</p>{asides}<p>Short.</p><p>{long[2]}</p>{asides}<p>{long[3]}</p>" + f"{asides}</body>"
    assert H.main_text(page) == "\n".join(x.strip() for x in ["Title", "By me", *long[:2], "Short.", *long[2:]])


def test_html_quiet_articles_stay_beside_loud_ones():
    loud = "A sentence that is long enough to be heard over all the noise of a page."
    assert H.main_text(f"<article><p>{loud}</p></article><nav>a</nav><nav>b</nav><nav>c</nav><article><p>Brief.</p></article>") == f"{loud}\nBrief."


def test_html_hints_take_no_text_of_an_article():
    kept = ["<section id='discussion'>A</section>", "<h2 id='related-work'>B</h2>", "<div id='search-algorithms'><p>C</p></div>", "<h2 id='comments'>D</h2>", "<div data-id='ad' data-class=comments>E</div>", "<p title='x class=ad'>F</p>", "<section id='comments-on-method'>G</section>", "<p class='notice'>H</p>", "<section aria-label='Related work'>I</section>"]
    gone = ["<div class='ad'>1</div>", "<div class='x ad-slot'>2</div>", "<section id='comments'>3</section>", "<div id='cookie-notice'>4</div>", "<div class='sidebar-left'>5</div>", "<div role='navigation'>6</div>"]
    both = "".join(a + b for a, b in zip(kept, [*gone, *[""] * 3]))
    assert H.main_text(f"<article>{both}</article>") == "A\nB\nC\nD\nE\nF\nG\nH\nI"
    assert H.main_text("<body><h2 id='related-work'>A</h2><section id='discussion'>B</section><div class='site-search'>c</div></body>") == "A\nB"


def test_html_rules():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    page = "<main><h1>T &amp; U</h1><aside>side</aside><p>a\n b<b>c</b><br>d</p><div class='comments'><p>first!</p></div><script>x<p>y</script><p>&lt;p&gt; 1 < 2<!-- no --></p><nav>menu</nav></main><p>outside and quite long text that is no part of the article at all</p>"
    assert H.main_text(page) == "T & U\na bc d\n<p> 1 < 2"
    assert H.main_text("<article><p>only") == "only"


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>" + "x" * 200_000), (None, "v", "<article>a</article>")], "page_id long, url string, html string")
    got = {(r.page_id, r.n_chars): r.text for r in H.extract(df).collect()}
    assert got[1, 0] == "" and got[2, 0] == "" and len(got[2, 200_000]) == 200_000 and got[None, 1] == "a"
    assert H.extract(df.where("1 = 0")).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_classifier"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.5) == q for s, q in held]) >= 0.95


def test_quality_learns_from_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad !!! junk") for i in range(60)], "doc_id long, text string")
    label = lambda i: i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2
    model = Q.train(docs, spark.createDataFrame([(i, label(i)) for i in range(60)], "doc_id long, quality int"))
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in Q.score(docs, model).collect())


def test_quality_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(odd, Q.train(odd, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (999, 1)], "doc_id long, quality int")
    model = Q.train(odd, labels)
    scores = [r.score for r in Q.score(odd, model).collect()]
    wide = odd.withColumn("quality_score", F.lit("x")).withColumn("score", F.lit(3))
    kept = Q.passing(wide, model, np.median(scores))
    assert len(scores) == odd.count() and kept.columns == wide.columns and kept.count() == sum(s >= np.median(scores) for s in scores)
    assert Q.score(empty, Q.train(empty, labels)).count() == 0


def test_html_articles_by_another_name(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        assert H.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == H.main_text(r.html)


def test_html_loud_text_beside_a_tiny_article():
    loud = [f"Paragraph {i} " + "of words and more words " * 15 for i in range(20)]
    text = H.main_text("<article>x y</article>" + "".join(f"<p>{x}</p>" for x in loud))
    assert all(x.strip() in text for x in loud)
    assert H.main_text("".join(f"<div>{x}</div>" for x in ["one equal line of some forty characters!"] * 9)).count("\n") == 8  # ties


def test_html_a_quiet_notice_is_no_part_of_a_loud_article():
    article = "".join(f"<p>{'word ' * 60}</p>" for _ in range(5))
    notice = "<div>This site was made with care by people who like it a lot.</div>"
    text = H.main_text(f"{notice}<article><h1>T</h1>{article}<p>End.</p></article>{notice}")
    assert text.startswith("T\n") and text.endswith("\nEnd.") and "care" not in text


def test_html_time_is_linear():
    import time

    for piece in ("<a href=\"x ' ", "<a '\"", "</b>", "<b>", "<b><p>", "<a \"x\" ", "<!--", "<", "<script>", "<div id="):
        page = piece * (1_000_000 // len(piece)) + ">"
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 8, piece


def test_html_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "a" * 90 + "</p>", 5, "t")] * 2, "page_id long, url string, html string, n_chars long, text string")
    assert [(r.page_id, r.n_chars, r.text) for r in H.extract(df).collect()] == [(1, 90, "a" * 90)] * 2


def brute_chain(matches, places, gap):
    """Most words that a chain of (end, length, state) covers, over all choices of matches and places, by template."""
    best = {}

    def go(i, t, end, place, covered):
        best[t] = max(best.get(t, 0), covered)
        for j in range(i, len(matches)):
            e, n, state = matches[j]
            for u, p in places[state]:
                if u == t and p > place and e - n - end <= gap:
                    go(j + 1, t, e, p, covered + min(n, p - place, e - end))

    for i, (e, n, state) in enumerate(matches):
        for t, p in places[state]:
            go(i + 1, t, e, p, n)
    return best


def test_chains_against_all_choices():
    rng = np.random.default_rng(16)
    words = [f"w{i}" for i in range(6)]
    for _ in range(60):
        sam = L.Automaton({f"t{i}": " ".join(rng.choice(words, 14)) for i in range(3)}, {})
        _, _, matches = sam.scan(" ".join(rng.choice([*words, "z"], 40)).encode())
        assert {t: c for t, c, _, _ in sam.chains(matches)} == brute_chain(matches[:12], sam.places, L.GAP) or len(matches) > 12


def test_stray_matches_break_no_chain_and_one_word_is_a_phrase(spark):
    text = L.TEMPLATES["mit"].split()
    text[60:60] = text[:4]
    sam = L.automaton(tuple(L.TEMPLATES.items()), tuple(L.BASE.items()))
    got = {sam.names[t]: c / sam.sizes[t] for t, c, _, _ in sam.chains(sam.scan(" ".join(text).encode())[2])}
    assert got["mit"] == 1.0
    df = spark.createDataFrame([(1, "the GPL, and the gpl"), (2, None)], "doc_id long, text string")
    assert [(r.n_base, r.first_word, r.labels) for r in L.scan_licences(df, base={"gpl": "g"}).orderBy("doc_id").collect()] == [(2, 1, "g"), (0, None, "")]


def plain_ftrl(rows, epochs):
    """Follow the regularised leader by the book, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if i == "bias":
            return -z.get(i, 0.0) / ((Q.BETA + n.get(i, 0.0) ** 0.5) / Q.ALPHA)
        if abs(z.get(i, 0.0)) <= Q.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * Q.L1) / ((Q.BETA + n[i] ** 0.5) / Q.ALPHA + Q.L2)

    for _ in range(epochs):
        for places, label in rows:
            x = {"bias": 1.0}
            for i in places.tolist():
                x[i] = x.get(i, 0.0) + 1 / len(places) ** 0.5
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / Q.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_against_plain_updates():
    rng = np.random.default_rng(17)
    rows = [(rng.integers(0, 60, rng.integers(1, 30)), int(rng.random() < 0.5)) for _ in range(80)]
    weights, bias = Q.fit(rows)
    want = plain_ftrl(rows, Q.EPOCHS)
    assert abs(bias - want.pop("bias")) < 1e-5 and all(abs(weights[i] - w) < 1e-5 for i, w in want.items())
    assert np.count_nonzero(weights) == sum(w != 0 for w in want.values())
