"""Quality, fingerprints, pages, personal data and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelfill.llm import exact, fingerprint, jaccard, pages, pii, quality

SF = "/root/testdata/sf0.001"


def test_machine_is_the_sum_over_pairs():
    r = np.random.default_rng(1)
    m = quality.Machine(0.3, r.normal(size=quality.SIZE).astype(np.float32), r.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    bounds, column, value = quality.features(pa.array(["a b c. A\nb", ""], pa.large_string()))
    for k, got in enumerate(m.raw(bounds, column, value)):
        c, x = column[bounds[k] : bounds[k + 1]], value[bounds[k] : bounds[k + 1]]
        pairs = sum(m.factors[c[i]] @ m.factors[c[j]] * x[i] * x[j] for i in range(len(c)) for j in range(i))
        assert np.isclose(got, 0.3 + (m.weights[c] * x).sum() + pairs, rtol=1e-3)


def test_quality_on_held_out_labels(spark):
    got = entry.queries()["op1_quality"](spark, "/root/testdata/sf0.01")
    found = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(r.predicted == r.quality for r in found) / len(found) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.collect())


def test_quality_of_nulls_nothing_and_no_labels(spark, table):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table([(1, None), (None, ""), (3, "a b")])
    assert sorted(map(tuple, quality.score(docs, quality.train(docs, labels)).collect()), key=repr) == [(1, False, 0.5, 1), (3, False, 0.5, 1), (None, True, 0.5, 1)]
    assert quality.score(table([]), quality.train(docs, labels)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_fingerprints(spark, table):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice("aeiou") + str(r.randrange(40)) for _ in range(n))
    long = text(2000)
    rows = [(1, None), (2, ""), (3, "é🙂b"), (4, long), (5, long), (9, text(300)), (9, text(300)), (None, "null id"), (50, "the the the the the the")]
    got = fingerprint.fingerprints(table(rows)).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    edited = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited[i, len(t)] = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert {(x.doc_id, x.n_chars): x.edited_sha256 for x in got} == edited
    by = {x.doc_id: x for x in got}
    assert by[4].fingerprint == by[5].fingerprint and by[4].near_next == 1.0 and by[1].fingerprint == by[2].fingerprint
    assert by[5].near_edited > 0.1 > by[5].near_next and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    assert fingerprint.fingerprints(table([])).count() == 0


def test_quality_of_repeated_ids_and_long_texts(spark, monkeypatch):
    """A labelled id that many rows repeat is one row of the fit; every row is scored, equal ones alike."""
    rows = [(i, "good text with many words of it. " * 4 if i % 2 else "spam !!! $$$ " * 9) for i in range(40)]
    rows += [(1, rows[1][1])] * 300 + [(3, "another text of the same id")] * 50 + [(7, "long words " * 60_000), (None, "x")]
    inner = ["quality", "score", "held_out", "columns", "values"]
    docs = spark.createDataFrame([(i, t, *([1] * 5)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in inner))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    seen, real = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda bounds, *rest: seen.append(len(bounds) - 1) or real(bounds, *rest))
    got = quality.score(docs, quality.train(docs, labels, 20)).collect()
    assert seen[0] <= 20 and len(got) == len(rows)
    assert len({x.score for x in got if x.doc_id == 1}) == 1


def test_next_documents_whatever_cut_points_a_run_finds(spark, table, monkeypatch):
    """Two calls may find different points, as merging sketches in another order does; one document's next must not depend on it."""
    rows = [(3 * i, f"text of {i} here") for i in range(200)]
    real, calls = fingerprint.cut_points, []

    def other(docs):
        calls.append(1)
        return real(docs) if len(calls) % 2 else [p + 1 + 7 * (p % 3) for p in real(docs)]

    monkeypatch.setattr(fingerprint, "cut_points", other)
    for _ in range(2):
        got = {x.doc_id: x for x in fingerprint.fingerprints(table(rows)).collect()}
        for k, (i, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert len(calls) == 2


def _plain_print(words, gram=3, cells=32):
    """Order sketches without Spark, on names for hashes: which runs each cell selects, in text order."""
    runs = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)] if len(words) >= gram else [tuple(words)]
    seen, numbered = Counter(), []
    for place, run in enumerate(runs):
        numbered.append((run, seen[run], place))
        seen[run] += 1
    return numbered


def test_fingerprint_depends_on_numbered_runs_and_their_order_only(spark, table):
    """Equal selections give equal sketches: texts whose numbered runs agree agree in all, and one lost run costs its cell only."""
    words = [f"w{i % 90}" for i in range(400)]
    same = "  ".join(words) + "\n"
    rows = [(1, " ".join(words)), (2, same), (3, " ".join(words + ["extra"])), (4, " ".join(words[::-1])), (5, " ".join(words * 2))]
    got = {x.doc_id: x for x in fingerprint.fingerprints(table(rows)).collect()}
    assert _plain_print(words) == _plain_print(same.split()) and got[1].fingerprint == got[2].fingerprint
    new = set(_plain_print(words + ["extra"])) - set(_plain_print(words))
    changed = set(got[2].fingerprint.split()) ^ set(got[3].fingerprint.split())
    assert len(new) == 1 and len(changed) <= 2 and got[2].near_next >= 31 / 33
    assert got[3].near_next < 0.2  # the same words backwards
    assert got[4].near_next < 0.2
    assert len(got[1].fingerprint.split()) == 32


def test_fingerprint_of_texts_without_white_space(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(3000))
    rows = [(1, long, 1, 2), (2, long[:1500] + "X" + long[1500:], 1, 2), (3, "x" * 200_000, 1, 2), (4, "y z " * 100_000, 1, 2)]
    got = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, range int, sent int")).collect()}
    assert got[1].near_next > 0.5 and got[2].near_next == 0.0 and got[3].n_chars == 200_000


def test_order_counts_in_a_fingerprint(spark, table):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[200:] + words[:200])), (3, " ".join(reversed(words)))]
    got = {x.doc_id: x for x in fingerprint.fingerprints(table(rows)).collect()}
    assert 0.2 < got[1].near_next < 1 and got[2].near_next < 0.1


PAGE = """<html><body class="home"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><aside>side</aside>
<article class="post-12"><header class="entry-header"><h1>Title &amp; more</h1><div class="meta">by X</div></header><p>First <b>bold</b> a&nbsp;b<p>Second <a href="x">link</a> text.
<ul><li>one<li>two</ul><div class="share-buttons">Share</div><span class="ad">buy <span>now</span> please</span><form><p>email</p></form><script>var x="</p>";</script></article>
<section class="comments"><article class="comment"><p>I disagree strongly with all of this and so on and so on.</p></article></section><footer>foot</footer></body></html>"""


def test_pages(spark):
    bare = '<div class="body-1"><p>Own words of this page, many of them.</p></div><div class="other"><p>A much longer piece that the host never uses for its articles, %s.</p></div>'
    usual = '<div class="body-2"><p>The usual place, with a long enough text %s.</p></div><div class="other"><p>x</p></div>'
    rows = [(1, "http://a.com/1", PAGE), (2, None, None), (3, "u", ""), (4, None, "<p>no host"), (1, "http://a.com/1", PAGE)]
    rows += [(10 + i, f"https://b.org:80/{i}", usual % ("and more " * 5)) for i in range(5)] + [(20, "https://b.org/x", bare % "indeed")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == "Title & more\nFirst bold a b\nSecond link text.\none\ntwo"
    assert by[2].text == by[3].text == "" and by[4].text == "no host" and by[20].text == "Own words of this page, many of them."
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _site(r, host, n):
    """Pages of one invented host with the article text of each, known since they are made from it."""
    words = [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice(['', 'a', 'en', 'ing'])}" for _ in range(300)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k)).capitalize() + "."
    tag, name = r.choice([("article", "post"), ("div", "story-text"), ("section", "body-copy"), ("div", "col main-copy")])
    odd = r.choice(["notice-board-history", "art-form", "banner-year", "search-for-meaning", "social-contract-theory"])
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words[:6])
    notice, form = prose(12), '<form class="newsletter-box"><p>' + prose(15) + '</p><input name="x"></form>'
    pages_ = []
    for i in range(n):
        blocks_ = [("h1", prose(4))] + [("p", prose(r.randrange(15, 40))) for _ in range(r.randrange(2, 6))]
        inner = [f"<{t}>{x}</{t}>" for t, x in blocks_]
        extra = prose(25)
        inner.insert(r.randrange(1, len(inner) + 1), None)
        at = inner.index(None)
        inner[at] = f'<div class="{odd}"><p>{extra}</p></div>'
        truth = [x for _, x in blocks_]
        truth.insert(at, extra)
        noise = r.choice(['<div class="ad-slot-3">' + prose(20) + "</div>", '<span class="ad">' + prose(5) + "</span>", f'<div class="share-this-tool"><a href="#">{prose(3)}</a></div>', ""])
        inner.insert(r.randrange(1, len(inner) + 1), noise)
        comments = '<div class="comments">' + "".join(f'<div class="comment-{k}"><p>{prose(30)}</p></div>' for k in range(r.randrange(4))) + "</div>"
        html = f"""<html><head><title>{words[0]}</title></head><body><div class="site-header"><ul class="menu">{menu}</ul></div><nav>{menu}</nav>
        <div id="cookie-notice">{notice}</div><div class="related-reading-tips"><p>{notice} {notice}</p></div><{tag} class="{name}" id="p{i}">{chr(10).join(inner)}</{tag}>
        {form}{comments}<aside><p>{prose(30)}</p></aside><footer><p>{notice}</p></footer></body></html>"""
        pages_.append((f"https://{host}/{i}", html, "\n".join(truth)))
    return pages_


def test_pages_of_known_articles(spark):
    """Articles keep their blocks with odd class names; what repeats on a host, links, adverts and comments stay out."""
    r = random.Random(12)
    made = [p for k in range(8) for p in _site(r, f"h{k}.example", r.choice([1, 5, 20]))]
    rows = [(i, url, html, 5, "p") for i, (url, html, _) in enumerate(made)]
    got = {x.page_id: x.text for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, kind int, path string")).collect()}
    wrong = [(got[i], text) for i, (_, _, text) in enumerate(made) if got[i] != text]
    assert not wrong, wrong[0]


def test_a_name_with_other_words_is_judged_by_its_text(spark):
    long = "Many words of this very article about the history of the town stand in this place, %s."
    page = '<article><p>Opening words of an article, long enough to count, %s.</p><div class="%s"><p>%s</p></div><p>Closing words of it.</p></article>'
    rows = [(i, f"http://a.org/{i}", page % (i, "notice-board-history", long % i)) for i in range(4)]
    rows += [(10 + i, f"http://b.org/{i}", page % (i, "notice-board-history", long % "always the same")) for i in range(4)]
    rows += [(20 + i, f"http://c.org/{i}", page % (i, "art-form", f'<a href="x">{long % i}</a>')) for i in range(4)]
    rows += [(30 + i, f"http://d.org/{i}", page % (i, "art-form comments", long % i)) for i in range(4)]
    got = {x.page_id: x.text.split("\n") for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == [f"Opening words of an article, long enough to count, {i}.", long % i, "Closing words of it."]
        assert all(len(got[k + i]) == 2 for k in (10, 20, 30))


def test_votes_have_no_cap(spark):
    """One page with a very long article outweighs three short ones in another place."""
    big = '<div class="long-read"><p>' + "word " * 60_000 + "</p></div>"
    small = '<div class="short-read"><p>' + "brief " * 100 + '</p></div><div class="long-read"><p>tiny</p></div>'
    rows = [(0, "http://a.org/0", big)] + [(i, f"http://a.org/{i}", small) for i in (1, 2, 3)]
    paths = pages.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [x.label for x in paths] == ["div.long-read"]


def test_broken_markup_does_not_stop_a_page():
    for text in ("<", "<<<>", "<a", "<!-- x", "<div " * 50, "</p></div>", "<p" + "<b>" * 2000, "<script>x", "&#xD800;&#0;&bogus;"):
        elements, found = pages.blocks(text)
        pages.container(elements)


# the patterns as the contract writes them
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    luhn = sum((int(c) * 2 - 9 if c > "4" else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 16 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]


def test_base_spans(spark, table):
    r = random.Random(2)
    parts = ["a", "b", "@", ".", "-", "+", "1", "2", "25", "0", " ", "(", ")", "x.y", "é", "🙂", "a@b.c", "10.0.0.1", "4111 1111 1111 1111", "+49 (30) 123-4567", "\n", "_", "300"]
    rows = [(0, None), (1, ""), (2, "1" * 500 + "."), (3, "a" * 3000 + "@"), (4, "a@b" + ".c" * 2000)]
    rows += [(i, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for i in range(5, 500)]
    got = {x.doc_id: x for x in pii.personal_data(table(rows)).collect()}
    for i, t in rows:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if _good(k, m.group())] for k, p in BASE.items()]
        joined = ",".join(sum(spans, []))
        x = got[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == list(map(len, spans)), t
        assert x.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and x.spans.startswith(joined)
    assert pii.personal_data(table([])).count() == 0


def test_terms_that_disclose_a_value_are_found_and_hidden(spark, table):
    r = random.Random(4)
    fill = lambda: " ".join(r.choice("bcdfg") + r.choice("aeiou") + r.choice("klmn") + str(r.randrange(50)) for _ in range(30))
    rows = [(i, f"{fill()} contact Zorblax Quint at z@q.org for {fill()}") for i in range(8)] + [(100 + i, fill() + " contact for") for i in range(100)]
    docs = table(rows)
    text = {i: t for i, t in rows}
    for x in pii.personal_data(docs).collect():
        terms = [text[x.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"]
        assert ("Zorblax" in terms and "contact" not in terms) if x.doc_id < 100 else terms == []
    clean = {x.doc_id: x for x in pii.sanitise(docs).collect()}
    assert len(clean) == len(rows) and pii.sanitise(docs).columns == docs.columns
    assert all("[EMAIL]" in clean[i].text and "Zorblax" not in clean[i].text and "contact" in clean[i].text for i in range(8))
    assert all(clean[i].text == t for i, t in rows if i >= 100)


def test_terms_count_in_whole_documents_and_once_for_each(spark, table):
    pad = "the plain words of any text stand here " * 12
    rows = [(i, f"Quint, {pad} (Quint) mail q@z.org {pad} Quint") for i in range(8)]
    rows += [(20, f"Wexler rang {pad} {pad} 10.20.30.40"), (21, f"{pad} no pattern but Quint")]
    rows += [(100 + i, pad + "mail") for i in range(300)]
    text = dict(rows)
    spans = {x.doc_id: [text[x.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"] for x in pii.personal_data(table(rows)).collect()}
    assert all(spans[i] == ["Quint,", "(Quint)", "Quint"] for i in range(8))  # far from the mention, in every form
    assert spans[20] == ["Wexler", "rang"]  # a value of one document
    assert spans[21] == ["Quint"] and not any(spans[100 + i] for i in range(300))


def test_disclosure_like_a_plain_count(spark, table):
    r = random.Random(11)
    word = lambda: f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.choice('klmn')}{int(r.expovariate(0.02))}"
    rows = []
    for i in range(250):
        words = [word() for _ in range(r.randrange(20, 120))]
        if i % 6 == 0:
            who = r.randrange(12)
            words += [f"Name{who}", f"mail{who}@x.org"] + [f"Town{who}"] * (r.random() < 0.8)
        if r.random() < 0.01:
            words.append(f"Name{r.randrange(12)}")
        rows.append((i, " ".join(words)))
    terms = {i: {w for w in (re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w) for w in t.lower().split()) if len(w) >= 3} for i, t in rows}
    n_term = Counter(t for ts in terms.values() for t in ts)
    spectrum, incidences = Counter(n_term.values()), sum(n_term.values())
    docs_of = defaultdict(set)
    for i, t in rows:
        for m in re.findall(BASE["email"].replace("(", "(?:"), t):
            docs_of[m].add(i)
    want: dict = {}
    for docs in set(map(frozenset, docs_of.values())):
        both = Counter(t for i in docs for t in terms[i])
        held = sum(both.values())
        kinds = Counter((j, n_term[t]) for t, j in both.items())
        for t, j in both.items():
            k = n_term[t]
            rate = k * held / incidences
            expected = spectrum[k] * math.exp(-rate) * rate**j / math.factorial(j)
            p = (1 - min(1, (expected + 2 * math.sqrt(expected)) / kinds[j, k])) * min(1, 8 / kinds[j, k]) * j / k
            if p > 0:
                want[t] = max(want.get(t, 0), 1 + math.log2(p) / min(7, math.log2(len(rows) / len(docs))))
    want = {t: x for t, x in want.items() if x >= pii.GENERALISE}
    docs = table(rows)
    found = pii.base_spans(docs).select("text", F.xxhash64("doc_id", "text").alias("key"), F.concat(*map(pii._mentions, pii.KINDS)).alias("mentions")).filter(F.size("mentions") > 0)
    got = {x.term: x.disclosure for x in pii.disclosing(docs, found).collect()}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert sum(t.startswith("name") for t in want) > 6 and sum(not t.startswith(("name", "town", "mail")) for t in want) < 3
    spans = {x.doc_id: x.spans for x in pii.personal_data(docs).collect()}
    for i, t in rows:
        hidden = [m.span() for m in re.finditer(r"\S+", t) if m.group().lower() in want and "@" not in m.group()]
        assert [s for s in spans[i].split(",") if s.startswith("term")] == [f"term:{a}:{b}" for a, b in hidden]


def test_copies_do_not_give_their_words_away(spark, table):
    """A long text with a value and its near copy: their rare words are no identifiers, and stay in other texts too; a name stays one."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(4))
    rare = [word() for _ in range(200)]
    rows = [(0, " ".join(rare) + " mail q@z.org"), (1, " ".join(rare[:190]) + " mail q@z.org")]
    rows += [(10 + i, f"{r.choice(rare)} {word()} wrote the usual mail from the day") for i in range(300)]
    rows += [(400 + i, f"{word()} Quint wrote the usual mail from x@y.org to {word()}") for i in range(6)]
    spans = {x.doc_id: x.spans for x in pii.personal_data(table(rows)).collect()}
    assert all("term" not in spans[i] for i, _ in rows if i < 400)
    assert all(spans[400 + i].count("term") == 1 for i in range(6))


def test_personal_data_with_clashing_names_nulls_and_repeats(spark):
    inner = ["_marks", "_mark_key", "key", "row", "maybe", "marks", "_word", "_bits", "email", "terms"]
    rows = [(1, "to a@b.org"), (1, "to a@b.org"), (None, "from 10.0.0.1 on"), (None, None), (2, ""), (3, "x" * 200_000 + " a@b.org")]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in inner]) for i, t in rows], ["doc_id", "text", *inner])
    clean = pii.sanitise(docs)
    text = {"to a@b.org": "to [EMAIL]", "from 10.0.0.1 on": "from [IP] on", rows[-1][1]: "x" * 200_000 + " [EMAIL]"}
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted(((i, text.get(t, t), *[f"{c}{i}" for c in inner]) for i, t in rows), key=repr)
    assert sorted((x.doc_id or 0, x.n_email, x.n_ip) for x in pii.personal_data(docs).collect()) == [(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0)]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_overlapping_spans_leave_together(spark, table):
    got = pii.sanitise(table([(1, "call +49 30 1234567bob@x.org now"), (2, "a@b.org and 10.0.0.1")])).collect()
    assert {x.doc_id: x.text for x in got} == {1: "call [PHONE] now", 2: "[EMAIL] and [IP]"}


def test_pipeline_stages_keep_documents_and_clean_text(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.toArrow())
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids and 0 < len(ids) < before.count()


def test_pipeline_stages_with_clashing_names_nulls_and_nothing(spark):
    """Each stage that returns documents, on columns named as inner ones are, nulls, repeated rows and an empty table."""
    inner = ["score", "held_out", "predicted", "quality", "norm", "salt", "place", "row", "text_sha256", "_node", "_gone", "_marks", "_mark_key", "maybe", "key"]
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a  b c d e f g"), (None, None), (None, "to x@y.org"), (3, ""), (4, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in inner]) for i, t in rows], ["doc_id", "text", *inner])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for stage in (lambda d: quality.keep_good(d, labels), exact.drop_copies, lambda d: jaccard.drop_near_copies(d, 5, 80), pii.sanitise):
        got = stage(docs)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert all(x[c] == f"{c}{x.doc_id}" for x in got.collect() for c in inner)
        assert stage(docs.limit(0)).count() == 0


def test_registered():
    numbered = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in numbered] == list(range(1, 14)) and "pipeline" in entry.queries()


def test_scoring_holds_little_beside_its_batch():
    """A worker's arrays are bounded by a slice of the text, not by the four megabytes that other operators take at once."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from panelfill.llm import quality

    machine = quality.fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), [])
    texts = ["some words of a page, " * 100 + str(i) for i in range(3000)]
    batch = pa.record_batch({"doc_id": pa.array(range(3000), pa.int64()), "text": texts, "held_out": [False] * 3000})
    run = quality._scored(SimpleNamespace(value=machine))
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 100e6
