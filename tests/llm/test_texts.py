"""Personal data, main text, classifiers and the pipeline."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import html_text, pii, quality, toxicity

# -- personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        double = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_equal_brute_force(make, sample, odd):
    r = random.Random(3)
    parts = ["a", "b@", "@", "c.d", "1", "22", ".", "255", "256", "+", "-", " ", "(", "é", "🙂", "4539 1488 0343 6467", "+49 30 1234567", "x@y.z", "1.2.3.4", "_", "%", "0"]
    rows = sample + [(10_000 + k, "".join(r.choice(parts) for _ in range(r.randint(0, 50)))) for k in range(1500)]
    rows += [(20_000, "9" * 4_000), (20_001, "a@" + ".b" * 20_000), (20_002, "1." * 4_000), (20_003, "x" * 4_000)]
    got = {r["doc_id"]: r for r in pii.find_digests(make(rows, clash=True)).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), text[:200]
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x == k for x, _, _ in want) for k in KINDS]
        assert set(joined(want).split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert pii.find_digests(make(odd)).count() == len(odd) and pii.find_digests(make([])).count() == 0


def test_added_spans_need_checks_and_context(make):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432."),
        (2, "not one: DE88 3704 0044 0532 0130 00"),
        (3, "Telefon: 030-555-1234"),
        (4, "serial 030-555-1234"),
        (5, "call +1 (017) 555-7713 now"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.find_digests(make(rows)).collect()}
    assert got == {1: "iban:5:32,iban:37:59", 2: "", 3: "phone:9:21", 4: "", 5: "phone:5:22"}
    scores = {r["doc_id"]: [s["score"] for s in r["spans"]] for r in pii.find(make(rows)).collect()}
    assert scores[1][0] > 0.9 and scores[3][0] == pytest.approx(0.65) and scores[5][0] > 0.9


def test_checksums(spark):
    cards = {"4539148803436467": True, "4539148803436468": False, "0000000000000": True, "79927398713": True}
    df = spark.createDataFrame([(c,) for c in cards], "d string")
    assert {r[0]: r[1] for r in df.select("d", pii.luhn(F.col("d"))).collect()} == cards
    accounts = {"DE89370400440532013000": True, "GB82WEST12345698765432": True, "FR1420041010050500013M02606": True, "DE89370400440532013001": False}
    df = spark.createDataFrame([(c,) for c in accounts], "d string")
    assert {r[0]: r[1] for r in df.select("d", pii.mod97(F.col("d"))).collect()} == accounts


def test_redaction(make):
    rows = [(1, "mail a.b@c.de or +49 30 1234567 x"), (2, None), (3, ""), (4, "1.2.3.4@x.y"), (5, "clean text 🙂"), (6, "🙂 a@b.c, a@b.c")]
    df = make(rows, clash=True).withColumn("n_chars", F.lit(-1).cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert got[1] == ("mail [EMAIL] or [PHONE] x", 25) and got[2] == (None, None) and got[3] == ("", 0)
    assert got[4] == ("[EMAIL]", 7) and got[5] == ("clean text 🙂", 12) and got[6][0] == "🙂 [EMAIL], [EMAIL]"


def test_no_python_in_the_plan(make):
    text = pii.find_digests(make([(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text.split("== Optimized")[1].replace("PythonRDD", ""))


# -- main text


def test_pages_give_their_articles(spark):
    pages = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    for _, page in pages:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert html_text.main_text(page) == "\n\n".join(x for x in parts if x)


PAGE = """<!DOCTYPE html><html><body><header class="site-header"><h2>Site</h2><ul class=menu><li><a href=/>Home</a><li><a href=/x>About us</a></ul></header>
<div id="cookie-notice">We use cookies, please, accept, all.</div><div class="wrapper"><div class="post-content"><h1>Title &amp; more</h1>
<p>First paragraph, with commas,\n and  text<br>second line here.<p>Unclosed para <b>bold <i>x</b> tail <a href=#>a link</a>.
<div class="ad">Buy now, cheap, good, things, lots, of, commas, in, here</div><ul><li>item one<li>item two</ul>
<table><tr><td>cell a<td>cell b</table><script>if (a<b) "</p>"</script><style>p{}</style><blockquote>Quote, yes.</blockquote><form><p>Name, <input></form></div>
<aside><p>Sidebar, with, many, commas, and, a, lot, of, text that is long enough to count for something when scoring.</p></aside>
<section id="comments"><p>User: great, article, really, loved, it, wow, this is a long comment that could win, if not left out.</p></section></div>
<footer>&copy; 2024</footer>"""


def test_boilerplate_is_left_out():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "Title & more",
        "First paragraph, with commas, and text second line here.",
        "Unclosed para bold x tail a link.",
        "item one",
        "item two",
        "cell a",
        "cell b",
        "Quote, yes.",
    ]


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<!-- x") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain < b &lt;text&gt;") == "plain < b <text>"
    assert html_text.main_text("</p></div>a<p>b</span>c") == "a\n\nbc"
    assert html_text.main_text("<div>" * 5000 + "x" + "<p>a, b" * 5000).startswith("x\n\na, b")
    html_text.main_text("<a b='" * 5000 + "<" * 5000)


PARAGRAPHS = "<p>First sentence, with commas, of the article text.</p><p>Second one is here, too.</p>"
TEXT = "First sentence, with commas, of the article text.\n\nSecond one is here, too."
MARKED = {
    "a form around the page": (f"<html><body><form id=aspnetForm><div>{PARAGRAPHS}</div></form></body></html>", TEXT),
    "a layout's name": (f'<body><div class="content has-sidebar">{PARAGRAPHS}</div></body>', TEXT),
    "a layout's name around the article": (f'<body><div class="layout with-sidebar"><article>{PARAGRAPHS}</article><aside>x, y</aside></div></body>', TEXT),
    "a widget around the article": (f'<body><nav>a</nav><div class="elementor-widget"><article>{PARAGRAPHS}</article></div></body>', TEXT),
    "marked by name around the article": (f'<div class="widget"><main>{PARAGRAPHS}</main></div>', TEXT),
    "a wrapper of content and sidebar": (f'<div class="content-sidebar-wrap"><div class="content"><h1>T</h1>{PARAGRAPHS}</div><div class="sidebar">menu</div></div>', "T\n\n" + TEXT),
    "named paragraphs and link lists in an article": (f'<article>{PARAGRAPHS}<p class="social-history">He smoked.</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>', TEXT + "\n\nHe smoked.\n\none\n\ntwo"),
    "an apostrophe in a value": (f"<article><p title=don't>first text here isn't lost</p>{PARAGRAPHS}</article>", "first text here isn't lost\n\n" + TEXT),
    "a stray quote": (f'<article><p class="x"">stray</p>{PARAGRAPHS}</article>', "stray\n\n" + TEXT),
    "a quote that isn't closed": (f"<article><p class='a>b</p>{PARAGRAPHS}</article>", "b\n\n" + TEXT),
    "a teaser in a sidebar": (f"<aside class=related><article>Teaser</article></aside><div class=post>{PARAGRAPHS}</div>", TEXT),
    "an open head": (f"<head><title>x</title><article>{PARAGRAPHS}</article>", TEXT),
    "comments": (f"<body><article>{PARAGRAPHS}</article><div class='comments-area'><p>a, long, long, comment, with, commas</p></div></body>", TEXT),
    "a notice longer than the article": ("<div class='cookie-notice'><p>we, use, cookies, a, lot, and, more</p></div><div class=post><p>Short.</p></div>", "Short."),
    "an advert in an article": (f"<article>{PARAGRAPHS}<p class=ad>Buy.</p><div class='wp-ad-block'>Buy, buy.</div></article>", TEXT),
    "an open drawing": (f"<article><svg>{PARAGRAPHS}</article>", TEXT),
    "a footer alone": ("<div id=footer><p>copy</p></div>", ""),
    "an article far down": ("<div>" * 40 + f"<div class=x>{PARAGRAPHS}</div>" + "</div>" * 40, TEXT),
    "a label inside a paragraph": (f"<article>{PARAGRAPHS}<p>one <button>x</button> two</p></article>", TEXT + "\n\none two"),
}


@pytest.mark.parametrize("name", MARKED)
def test_marks_and_broken_attributes(name):
    page, text = MARKED[name]
    assert html_text.main_text(page) == text


def test_long_broken_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<svg>" * 30_000, "<a b='" * 30_001, "<div class=ad>" * 30_000 + "x", "<p title=\"" * 20_000, "<article><div class=sidebar>" * 10_000 + "x", "<" * 200_000, "<!--" * 50_000):
        html_text.main_text(page)
    assert time.perf_counter() - began < 30


def test_extract_frames(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>"), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == Counter((i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in rows)
    assert html_text.extract(df.limit(0)).count() == 0


# -- classifiers

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_results(scores, label):
    """(score, label) of rows that no model has learnt from."""
    labels = duckdb.sql(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'").fetchall()
    return np.array([(scores[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0])


def test_quality_on_held_out_documents(documents):
    docs, labels = documents
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    got = held_out_results(scores, "quality")
    kept = got[:, 0] >= 0.3
    assert all(0 <= s <= 1 for s in scores.values())
    assert (kept == got[:, 1]).mean() > 0.97
    assert kept[got[:, 1] == 1].mean() > 0.985 and kept[got[:, 1] == 0].mean() < 0.12
    again = quality.fit(docs.repartition(7), labels.repartition(5))
    assert again == model  # neither order nor partitioning matters


def logistic(z):
    return 1 / (1 + np.exp(-z))


def test_quality_equals_brute_force(spark, documents):
    import zstandard

    from skein.llm.common import id_and_text, labelled_sample

    docs, labels = documents
    model = quality.fit(docs, labels)
    sample, _ = labelled_sample(id_and_text(docs), labels, "quality", quality.SAMPLE_DOCS)
    rows = [(r["text"].encode(), r["label"]) for r in sample.filter("half = 0").collect()]
    for label, content in ((0, model.bad), (1, model.good)):
        every = [t[k : k + 1024] for t, y in rows if y == label for k in range(0, len(t), 1024)]
        hashed = [r["block"] for r in spark.createDataFrame([(bytearray(x),) for x in every], "block binary").orderBy(F.xxhash64("block"), "block").limit(20_000).collect()]
        assert content == zstandard.train_dictionary(112 << 10, [bytes(x) for x in hashed]).as_bytes()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    pack = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (model.bad, model.good)]
    for i, text in docs.select("doc_id", "text").limit(400).collect():
        raw = (text or "").encode()
        bad, good = (sum(len(c.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024)) for c in pack)
        size = np.log((bad + good + 40) / (2 * len(raw) + 40))
        d = 10 * (bad - good) / (bad + good) if raw else 0.0
        assert got[i] == pytest.approx(logistic(np.dot(model.weights, [1, d, size, size * size, np.tanh(d), np.tanh(4 * d)])), abs=1e-9)


def test_quality_edges(make, documents, odd):
    docs, labels = documents
    model = quality.fit(docs, labels)
    assert quality.score(make(odd, clash=True), model).count() == len(odd)
    assert quality.score(make([]), model).count() == 0
    df = make(odd, clash=True)
    assert quality.keep_good(df, model).columns == df.columns
    constant = quality.fit(make(odd), labels.limit(0))
    assert {r["score"] for r in quality.score(make(odd), constant).collect()} == {0.5}
    few = labels.sparkSession.createDataFrame([(2, 0), (4, 1), (4, 1), (6, 1), (6, 0), (7, 1), (None, 1), (8, None), (3, 5)], "doc_id long, quality int")
    assert quality.score(make(odd), quality.fit(make(odd), few)).count() == len(odd)


def test_toxicity_on_held_out_documents(documents):
    docs, labels = documents
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    got = held_out_results(scores, "toxic")
    said = got[:, 0] >= 0.5
    assert all(0 <= s <= 1 for s in scores.values())
    assert (said == got[:, 1]).mean() > 0.96 and said[got[:, 1] == 0].mean() < 0.02 and said[got[:, 1] == 1].mean() > 0.8
    assert toxicity.fit(docs.repartition(7), labels.repartition(5)).weights == model.weights


def test_toxicity_equals_brute_force(documents):
    from skein.llm.common import id_and_text, labelled_sample

    docs, labels = documents
    model = toxicity.fit(docs, labels)
    sample, _ = labelled_sample(id_and_text(docs), labels, "toxic", toxicity.SAMPLE_DOCS)
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in sample.collect())
    assert max(len(t) for _, t, _ in rows) > 20_000  # long texts count as others do
    here = toxicity.train([[words for _, _, words in toxicity.sentences(t)] for _, t, _ in rows], np.array([y for _, _, y in rows], dtype=float))
    assert set(here) == set(model.weights) and all(here[f] == pytest.approx(x, abs=1e-6) for f, x in model.weights.items())
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in docs.select("doc_id", "text").limit(400).collect():
        clean = 1.0
        for sentence in re.split(r"[.!?\n|]", text or ""):
            words = {w for w in re.findall(r"[^\W\d_]+", sentence.lower())}
            evidence = sum(model.weights.get(w, 0) + sum(model.weights.get("^" + w[:k], 0) for k in (4, 5, 6, 7) if len(w) > k) for w in words)
            clean *= 1 - max(0.0, logistic(-6 + evidence) - logistic(-6)) if words else 1
        assert got[i] == pytest.approx(1 - clean, abs=1e-6)


def test_offending_sentences_are_located(make, odd):
    r = random.Random(1)
    plain = ["the sun is out", "we went home", "it rained a lot", "rivers run deep", "bread is warm"]
    bags, y = [], []
    for k in range(300):
        text = [r.choice(plain) + " " + r.choice("abcdefgh") for _ in range(r.randint(1, 30))]
        if k % 3 == 0:
            text[r.randrange(len(text))] += " you rotten fool"
        bags.append([set(s.split()) for s in text])
        y.append(float(k % 3 == 0))
    model = toxicity.ToxicityModel(toxicity.train(bags, np.array(y)))
    text = "The sun is out. You Rotten fool! We went home."
    row = toxicity.score(make([(1, text), *odd]), model).filter("doc_id = 1 and score > 0.5").head()
    assert [text[s["start"] : s["end"]].strip() for s in row["offending"]] == ["You Rotten fool"]
    clean = toxicity.score(make([(1, ". ".join(plain) * 2000), *odd]), model).collect()
    assert all(r["score"] < 0.5 and r["offending"] == [] for r in clean) and len(clean) == 1 + len(odd)
    assert toxicity.score(make([]), model).count() == 0


def test_toxicity_without_labels(make, odd, documents):
    model = toxicity.fit(make(odd), documents[1].limit(0))
    assert {r["score"] for r in toxicity.score(make(odd, clash=True), model).collect()} == {0.0}
    assert toxicity.train([[{"a"}]], np.array([1.0])) == {}


def test_context_reaches_over_other_numbers(make):
    texts = ["Telefon: 030-555-1234, 030-555-9876, 030-555-4321", "see 030-555-1234 (mobile) or later", "order 030-555-1234, 030-555-9876", "🙂 é call 030-555-1234 / 030-555-9876"]
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in pii.find(make(list(enumerate(texts)))).collect()}
    assert got == {0: ["030-555-1234", "030-555-9876", "030-555-4321"], 1: ["030-555-1234"], 2: [], 3: ["030-555-1234", "030-555-9876"]}
    assert [r["text"] for r in pii.redact(make([(0, texts[0])])).collect()] == ["Telefon: [PHONE], [PHONE], [PHONE]"]


def test_many_matches_take_linear_time(make):
    n = 100_000
    rows = [(1, "mail a@b.cd now " * n), (2, "Telefon 030-555-1234, a@b.cd +49 30 1234567 " * (n // 4))]
    df = make(rows).withColumn("n_chars", F.lit(0).cast("long"))
    pii.redact(make(rows[:1]).limit(0)).collect()
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.find_digests(df).collect()}
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert time.perf_counter() - began < 60
    assert got[1]["n_email"] == n and got[2]["n_phone"] == n // 4 and got[1]["spans"].endswith(f"email:{16 * n - 11}:{16 * n - 5}")
    assert text == {1: "mail [EMAIL] now " * n, 2: "Telefon [PHONE], [EMAIL] [PHONE] " * (n // 4)}


def test_redaction_equals_brute_force(make):
    r = random.Random(8)
    parts = ["x@y.zz", "1.2.3.4", "4539 1488 0343 6467", "+49 30 1234567", "DE89 3704 0044 0532 0130 00", "tel 030-555-1234", "🙂é", " ", ", ", "words and more ", "0", "\n", "a" * 700]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.choice([3, 30, 300])))) for k in range(200)]
    spans = {x["doc_id"]: x["spans"] for x in pii.find(make(rows)).collect()}
    got = {x["doc_id"]: x["text"] for x in pii.redact(make(rows)).collect()}
    for i, text in rows:
        out, at = "", 0
        for s in sorted(spans[i], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert got[i] == out + text[at:]
        base = [s for s in spans[i] if s["base"]]
        assert [(s["kind"], s["start"], s["end"]) for s in base] == base_spans(text)
        added = {(m.start(), m.end()) for m in re.finditer(pii.NATIONAL, text)} | {(m.start(), m.end()) for m in re.finditer(pii.IBAN, text)}
        assert {(s["start"], s["end"]) for s in spans[i] if not s["base"]} <= {(a, b) for a, b in added if not any(s["start"] < b and a < s["end"] for s in base)}
        context = [(m.start(), m.end()) for m in re.finditer(pii.NATIONAL, text) if re.search(pii.CONTEXT["phone"], text[max(0, m.start() - 40) : m.start()]) or re.search(pii.CONTEXT["phone"], text[m.end() : m.end() + 20])]
        assert {(a, b) for a, b in context if not any(s["start"] < b and a < s["end"] for s in base)} <= {(s["start"], s["end"]) for s in spans[i] if s["kind"] == "phone"}


# -- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as c
    from test_duplicates import exact_brute, similar_brute
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, frames = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()], []
    for name, stage in c.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        frames.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    rows = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, df in frames if name != "packing"}
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(rows["quality"]) == sorted((i, t) for i, t in before if model.score(t) >= 0.3)
    assert sorted(i for i, _ in rows["exact_dedup"]) == sorted(i for (i, _, _, kept, _), n in exact_brute(rows["quality"]).items() if kept for _ in range(n))
    similar, near = set(similar_brute(rows["exact_dedup"])), {i for i, _ in rows["near_dedup"]}
    assert similar <= near and len(near - similar) <= 0.03 * (len(rows["exact_dedup"]) - len(similar)) and len(near) == len(rows["near_dedup"])
    texts = dict(rows["near_dedup"])
    assert {i for i, _ in rows["pii"]} == set(texts)
    assert all(base_spans(t) == [] for _, t in rows["pii"])
    assert all(t == texts[i] for i, t in rows["pii"] if not base_spans(texts[i]) and "[" not in t)
    lib = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    packed = frames[-1][1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: len(lib.encode(t, add_special_tokens=False)) + 1 for i, t in rows["pii"]}
    assert c.run(spark, sf).count() == frames[-1][1].count()
    assert [n for n, _ in c.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    rows = [(i, t, None, None, None) for i, t in odd]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in c.STAGES:
            got = stage(spark, docs, sf)
            assert name == "packing" or got.columns == docs.columns
            assert (got.count() > 0) == bool(data)
