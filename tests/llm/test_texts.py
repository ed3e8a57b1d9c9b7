"""Tokens, fingerprints, page texts and classifiers against references, brute force and held-out labels."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from geoquarry.llm import fingerprints, quality, toxicity
from geoquarry.llm.boosting import grow, isotonic
from geoquarry.llm.byte_bpe import Vocabulary, bpe_digests, decoded, encode
from geoquarry.llm.html_extraction import extracted, is_aside, wrappers
from geoquarry.llm.html_pages import blocks
from geoquarry.llm.labelled import remainder, training_rows
from geoquarry.llm.queries import QUERIES
from geoquarry.llm.text_arrays import shingle_hashes, text_blocks
from geoquarry.llm.url_filter import url_host
from geoquarry.llm.wrappers import Sequence, aligned, expression, numbered, of_page, regions

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [" ", "\n", "\t", "'", "s", "r", "t", "ve", "m", "ll", "d", "  ", "a", "é", "ß", "中", "文", "1", "２", "!", "?*", "\xa0", "🙂", "—", "\x85", "ª", " ", "the", " of", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(count=3000):
    pick = random.Random(2)
    made = ["".join(pick.choices(ODD, k=pick.randint(0, 40))) for _ in range(count)]
    return [*made, "", None, "a" * 3000, " " * 500, "x'" * 300, "z!" * 40 + "\n\n ", "long text of words " * 20_000]


def test_ids_equal_the_reference(tokenizer):
    with open(RANKS, "rb") as file:
        words = Vocabulary(file.read())
    texts = odd_texts()
    seen = 0
    for block in text_blocks(pa.array(texts)):
        ids, bounds = words.encode(block)
        for at in range(block.count):
            want = tokenizer.encode_ordinary(texts[block.first + at] or "")
            assert ids[bounds[at] : bounds[at + 1]].tolist() == want
            seen += 1
    assert seen == len(texts)


def test_digests_and_round_trip(spark, tokenizer):
    texts = odd_texts(300)
    rows = [(number if number % 7 else None, text, "x") for number, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids string")
    got = bpe_digests(docs).collect()
    want = []
    for id_, text, _ in rows:
        ids = tokenizer.encode_ordinary(text or "")
        want.append((id_, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((tuple(row) for row in got), key=str) == sorted(want, key=str)
    back = encode(docs, RANKS, keep=("text",)).select("text", decoded(F.col("token_ids"), RANKS).cast("string").alias("back"))
    assert all((row["text"] or "") == row["back"] for row in back.collect())
    assert bpe_digests(docs.limit(0)).collect() == []


def test_fingerprints_follow_the_order_of_ids(spark):
    pick = random.Random(8)
    words = ["".join(pick.choices("abcdé🙂", k=4)) for _ in range(200)]
    rows = [(number, " ".join(pick.choices(words, k=pick.randint(0, 80)))) for number in range(0, 3000, 5)]
    rows += [(3001, None), (3002, ""), (3003, "x"), (3004, "t " * 60_000), (3005, rows[9][1])]
    pick.shuffle(rows)
    old, fingerprints.BUCKET_ROWS = fingerprints.BUCKET_ROWS, 50
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fingerprint", F.lit(1))
        got = {row["doc_id"]: row for row in fingerprints.with_next(docs).collect()}
    finally:
        fingerprints.BUCKET_ROWS = old
    texts = {id_: text or "" for id_, text in rows}
    order = sorted(texts, reverse=True)
    assert len(got) == len(rows)
    by_text = {}
    for id_, after in zip(order, order[1:] + order[:1], strict=True):
        text, other, row = texts[id_], texts[after], got[id_]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        for name, one, two in (("near_edited", text, edited), ("near_next", text, other)):
            sets = [shingles(value) for value in (one, two)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
            assert abs(row[name] - true) < 0.25, (one[:50], two[:50])
    assert fingerprints.with_next(docs.limit(0)).collect() == []


def test_bands_find_near_copies(spark):
    pick = random.Random(12)
    words = ["".join(pick.choices("abcdefg", k=5)) for _ in range(500)]
    rows, want = [], {}
    for group in range(25):
        base = pick.choices(words, k=200)
        for copy in range(pick.randint(1, 5)):
            own = list(base)
            if copy:
                own[pick.randrange(200)] = "changed"
            want[len(rows)] = min(want.get(len(rows), len(rows)), len(rows) - copy)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, ""), (901, None), (902, rows[0][1]), (None, rows[0][1]), (902, rows[0][1])]
    want |= {900: 900, 901: 901, 902: 0, None: 0}
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    assert {row["doc_id"]: row["component_id"] for row in got} == want
    assert fingerprints.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_near_copies_on_one_template_meet(spark):
    # Documents at about 0.75 to each other, so buckets are led by others; each has one near copy.
    pick = random.Random(21)
    words = ["".join(pick.choices("abcdefghij", k=6)) for _ in range(5000)]
    frame, rows = pick.choices(words, k=170), []
    for number in range(60):
        own = [*frame, *pick.choices(words, k=28)]
        rows += [(2 * number, " ".join(own)), (2 * number + 1, " ".join([*own[:-9], *pick.choices(words, k=9)]))]
    pick.shuffle(rows)
    sets = {id_: shingles(text) for id_, text in rows}
    near = {id_: id_ for id_ in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and near[a] != near[b]:
                low, high = sorted((near[a], near[b]))
                near = {id_: low if value == high else value for id_, value in near.items()}
    assert len(set(near.values())) == 60
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {row["doc_id"]: row["component_id"] for row in got} == near


def test_sketches_rule_out_pairs_of_a_template_before_texts_move(spark, monkeypatch):
    # All share buckets with all, at about 0.6 to each other; each has one near copy.
    pick = random.Random(22)
    words = ["".join(pick.choices("abcdefghij", k=6)) for _ in range(5000)]
    frame, rows = pick.choices(words, k=150), []
    for number in range(80):
        own = [*frame, *pick.choices(words, k=50)]
        rows += [(2 * number, " ".join(own)), (2 * number + 1, " ".join([*own[:-8], *pick.choices(words, k=8)]))]
    moved, verified = [], fingerprints._verified
    monkeypatch.setattr(fingerprints, "_verified", lambda pairs, *rest: moved.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 30, raising=False)
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {row["doc_id"]: row["component_id"] for row in got} == {id_: id_ - id_ % 2 for id_, _ in rows}
    assert sum(moved) < 1000, moved


def test_sketches_keep_every_link(spark):
    pick = random.Random(23)
    rows = []
    for number in range(400):
        one = [f"w{pick.randrange(900)}" for _ in range(pick.choice([0, 1, 5, 40, 200, 3000]))]
        other = [word if pick.random() > 0.02 else "x" for word in one] if number % 2 else one[: int(len(one) * 0.83)]
        rows.append((number, " ".join(one), " ".join(other)))
    two = (fingerprints._sketched(F.col(name)).alias(name) for name in ("one", "other"))
    frame = spark.createDataFrame(rows, "id int, one string, other string")
    near = frame.select("id", fingerprints.jaccard(F.col("one"), F.col("other")).alias("near"))
    may = frame.select("id", *two).select("id", "one.n", "one.parity", F.col("other.n").alias("m"), F.col("other.parity").alias("other"))
    found = may.select("id", *(fingerprints._may_link(share).alias(f"at{share * 10:.0f}") for share in (0.5, 0.8, 1.0))).join(near, "id").collect()
    for row in found:
        assert all(row[f"at{share * 10:.0f}"] or row["near"] < share for share in (0.5, 0.8, 1.0)), row
    assert sum(not row["at8"] for row in found) > 50


def shingles(text):
    words = text.split()
    return {tuple(words[at : at + 5]) for at in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_shingles_of_short_texts():
    texts = pa.array(["a b c d e f", None, "", "q", "q r", "b c d e f", "a b c d e"])
    for block in text_blocks(texts):
        block.find_words()
        hashes, bounds = shingle_hashes(block.hashes(), block.bounds, 5)
        assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 1, 1]
        assert hashes[0] == hashes[-1] and hashes[1] == hashes[-2]


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- note <p>no</p> -->
<article id="a12"><header><h1>Title &amp; more {n}</h1></header><p>First <b>bo</b>ld
   part {n}.<br>Next line &#233;<p>Second &lt;part&gt; <a href="/x">with link</a> {n}</p>
<div class="ad">Buy {n} now</div><form><input name="q">Search</form>
<ul><li>point one {n}<li>point two {n}</ul><p>Share this page</p></article>
<aside>Side {n}</aside><div class="comments"><p>Reader says {n}</p></div><footer>&copy; {n}</footer></body></html>"""


def page(number):
    return PAGE.replace("{n}", f"n{number}")


def test_main_text_of_pages(spark):
    rows = [(number, f"http://a.test/{number}?x", page(number)) for number in range(6)]
    rows += [(7, None, None), (8, "http://b.test/", ""), (9, "http://c.test/", "plain words only here, nothing else at all"), (10, "x", "<div>" * 5000 + "deep text in there, long enough"), (10, "x", "<div>" * 5000 + "deep text in there, long enough")]
    rows += [(11, "http://d.test/", "<p>unclosed <b>tags & 'quotes <i a=\"b>c</p><p>stay readable as text")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("main", F.lit("x"))
    got = extracted(pages).collect()
    assert len(got) == len(rows)
    texts = {row["page_id"]: row["text"] for row in got}
    for number in range(6):
        assert texts[number] == f"Title & more n{number} First bold part n{number}. Next line é Second <part> with link n{number} point one n{number} point two n{number}"
    assert texts[7] == "" and texts[8] == ""
    assert texts[9].startswith("plain words") and texts[10].startswith("deep text")
    assert all(row["n_chars"] == len(row["text"]) for row in got)
    assert extracted(pages.limit(0)).collect() == []
    hosts = pages.select(F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), "html")
    found = {row["host"]: row for row in wrappers(hosts).collect()}
    assert "<li>(#)+" in found["a.test"]["expression"]


def test_alignment_resolves_mismatches():
    def tree(text):
        return of_page(blocks(text)[0])

    wrapper = aligned(tree("<div>x</div><p>a<p>b<p>c"), tree("<h1>t</h1><div>y</div><p>a"))
    assert expression(wrapper) == "<h1>(#)? <div>(#) <p>(#)+"
    assert aligned(wrapper, tree("<div>z</div>")) != wrapper
    assert expression(tree("<p>a<h2>b</h2><p>c<h2>d</h2>")) == "<p>(#)+ <h2>(#)+"


def frame_of(number, inner, attributes=""):
    return (
        f'<html><head><title>t</title></head><body{attributes}><nav><a href="/">Home</a></nav>{inner}'
        f"<footer>&copy; own{number}</footer></body></html>"
    )


def texts_of(spark, pages):
    rows = [(number, "http://own.test/", html) for number, html in enumerate(pages)]
    got = extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return [row["text"] for row in sorted(got, key=lambda row: row["page_id"])]


def sentence(number, part=0):
    pick = random.Random(f"{number} {part}")
    return " ".join("".join(pick.choices("abcdefghij", k=6)) for _ in range(25)) + "."


def test_places_of_the_wrapper_decide(spark):
    # All paragraphs share one path; only their places in the wrapper tell the constant ones apart.
    pages = [
        frame_of(number, f"<div class=x><p>Subscribe to our letter</p><h2>{sentence(number)}</h2><p>{sentence(number, 1)}</p>"
                 f"<p>{sentence(number, 2)}</p><ul><li>{sentence(number, 3)}</ul><p>Shared under a licence</p></div>")
        for number in range(3)
    ]
    want = [" ".join(sentence(number, part) if part else sentence(number) for part in range(4)) for number in range(3)]
    assert texts_of(spark, pages) == want


@pytest.mark.parametrize("around", ["article", "div class=post-body", "main", "td"])
def test_short_and_linked_blocks_of_the_article_stay(spark, around):
    def article(number):
        return (
            f"<h1>{sentence(number)}</h1><p>{sentence(number, 1)}</p><h2>Results</h2><p>Yes.</p><table><tr><td>{number}<td>b</table>"
            f"<p>{sentence(number, 2)}</p><ul class=refs><li><a href=/1>Paper {number}</a><li><a href=/2>Book {number}</a></ul>"
        )

    outer = ("<table><tr>", "</table>") if around == "td" else ("", "")
    menu = "<ul class=top><li><a href=/a>Start</a><li><a href=/b>Contact</a></ul>"
    pages = [frame_of(number, f"{menu}{outer[0]}<{around}>{article(number)}</{around.split()[0]}>{outer[1]}<div class=end>All rights reserved by us</div>") for number in range(5)]
    want = [
        f"{sentence(number)} {sentence(number, 1)} Results Yes. {number} b {sentence(number, 2)} Paper {number} Book {number}" for number in range(5)
    ]
    assert texts_of(spark, pages) == want


@pytest.mark.parametrize("count", [1, 2, 4, 5, 12])
def test_copies_of_one_article_stay(spark, count):
    article = f"<article><h1>Title</h1><p>Short text.</p><p>{sentence(0)}</p><ul><li>One<li>Two</ul><p>End.</p></article>"
    want = f"Title Short text. {sentence(0)} One Two End."
    assert texts_of(spark, [frame_of(number % 7, article) for number in range(count)]) == [want] * count
    # One paragraph and the date differ.
    pages = [frame_of(number, article.replace("One<", f"One {number}<").replace("Short", f"Day {number}")) for number in range(count)]
    assert texts_of(spark, pages) == [want.replace("One", f"One {number}").replace("Short", f"Day {number}") for number in range(count)]


def test_fixed_texts_between_others_stay(spark):
    pages = [
        frame_of(number, f"<article><h1>{sentence(number)}</h1><div class=byline>By Jane</div><p>{sentence(number, 1)}</p><h2>Results</h2>"
                 f"<p>{sentence(number, 2)}</p><div>Share this page</div></article>") for number in range(6)
    ]
    assert texts_of(spark, pages) == [f"{sentence(number)} By Jane {sentence(number, 1)} Results {sentence(number, 2)}" for number in range(6)]


@pytest.mark.parametrize(("before", "after"), [
    ('<html><head><title>t</title></head><body class="has-sidebar search"><div class="content no-sidebar">', "</div>"),
    ('<html><head><title>t</title></head><body><article class="post comments-open ad-free">', "</article>"),
    ('<html><head><title>t</title></head><body><article class="post related">', "</article>"),
    ('<html><head><title>t</title></head><body><main class="search">', "</main>"),
    ('<html><head><title>t</title></head><body><form id="aspnetForm"><div>', "</div></form>"),
    ('<html><head><title>t</title></head><body><div class="widget"><div class="post">', "</div></div>"),
    ("<html><head><title>t</title><meta charset=utf-8><body><article>", "</article>"),
    ("<title>t</title><div>", "</div>"),
    ("<html><head><title>t</title><body><select><option>No</select><button>Menu<div></div></button><div><button>Open</div><div>", "</div>"),
])
def test_names_of_the_whole_page_are_no_asides(spark, before, after):
    pages = [f"{before}<p>{sentence(number)}</p><p>{sentence(number, 1)}</p>{after}" for number in range(4)]
    assert texts_of(spark, pages) == [f"{sentence(number)} {sentence(number, 1)}" for number in range(4)]


def test_whole_words_name_an_aside():
    assert is_aside(">html>body>div.sidebar") and is_aside(">html>body>div>form") and is_aside(">html>head")
    assert not is_aside(">html>body.sidebar>div.no-sidebar>article.comment>header")
    assert not is_aside(">body>form>div.widget", frozenset([2, 3])) and is_aside(">body>div.comments", frozenset([2]))


def test_pages_match_their_wrapper():
    pick = random.Random(4)

    def tree(depth=0):
        return "".join(
            f"<{tag}>{tree(depth + 1) if depth < 3 else ''}{pick.choice(['', 'words'])}</{tag}>" for tag in pick.choices(["div", "ul", "section"], k=pick.randint(0, 4))
        )

    for _ in range(60):
        roots = [blocks(tree()) for _ in range(6)]
        nodes = of_page(roots[0][0])
        for root, _ in roots[1:]:
            nodes = aligned(nodes, of_page(root))
        wrapper = Sequence(nodes)
        places = {number: path for number, path, _, _ in regions(wrapper)}
        assert sorted(places) == list(range(wrapper.end + 1))
        for root, found in roots:
            numbers = numbered(root, wrapper)
            assert all(at in numbers and numbers[at] in places for at, _, _ in found)


def test_pages_of_the_table(spark, sf_dir):
    import html as entities
    import re

    pages = {row["page_id"]: row["html"] for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in QUERIES["op2_html_extraction"](spark, sf_dir).collect():
        inner = pages[row["page_id"]].split("<article>")[1].split("</article>")[0]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert row["text"] == " ".join(entities.unescape(plain).split())


def ranked(scores, truth):
    order = np.argsort(np.argsort(scores))
    good = truth == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize(("name", "label", "modulus", "left"), [("op5_quality", "quality", 4, 2), ("op10_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, modulus, left):
    folder = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(remainder(modulus) == left)
    rows = got.join(labels, "doc_id").collect()
    assert all(row["held_out"] for row in rows)
    scores = np.array([row["score"] for row in rows])
    truth = np.array([row[label] for row in rows])
    assert len(rows) > 300 and scores.min() >= 0 and scores.max() <= 1
    assert ranked(scores, truth) > 0.93
    assert np.mean([row["predicted"] == row[label] for row in rows]) > 0.93


@pytest.mark.parametrize(("fit", "score", "column", "label"), [
    (toxicity.fit_toxicity, toxicity.toxicity, "toxicity", "toxic"), (quality.fit_quality, quality.quality, "quality_score", "quality"),
])
def test_odd_documents_have_scores(spark, fit, score, column, label):
    texts = ["", None, "a", "!!! *** 123", "you idiot " * 3, "word " * 80_000, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn(column, F.lit("old"))
    known = spark.createDataFrame([(0, 1), (2, 0), (2, 1), (None, 1), (4, None), (99, 0)], f"doc_id bigint, {label} int")
    for labels in (known, known.limit(0), known.filter("doc_id = 0")):
        rows = score(docs, fit(docs, labels)).orderBy("doc_id").collect()
        values = [row[column] for row in rows]
        assert all(0 <= value <= 1 for value in values) and values[6] == values[7] and values[0] == values[1]
    assert score(docs.limit(0), fit(docs.limit(0), known)).collect() == []


@pytest.mark.parametrize("count", [300, 3_000])
def test_toxicity_of_rows_that_were_not_learned(spark, count):
    pick = np.random.default_rng(4)
    words = np.array([f"word{number}" for number in range(300)])
    rows = []
    for number in range(2 * count):
        text = list(pick.choice(words, 30))
        if number % 3 == 0:
            text[::6] = pick.choice(["grubbel", "fnarz", "zwolk"], 5)
        rows.append((number, " ".join(text), int(number % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(docs, docs.filter(F.col("doc_id") < count).select("doc_id", "toxic"))
    out = toxicity.toxicity(docs.filter(F.col("doc_id") >= count), model).select("toxic", "toxicity").collect()
    truth, scores = np.array([row[0] for row in out]), np.array([row[1] for row in out])
    assert ranked(scores, truth) > 0.98 and ((scores >= 0.5) == truth).mean() > 0.97


def test_repeated_ids_are_one_training_row(spark):
    docs = spark.range(50_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "other"), (None, "nobody")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    assert sorted(row["label"] for row in training_rows(docs, labels, "toxic", 20_000).collect()) == [0, 1]
    assert training_rows(docs, labels, "toxic", 1).count() == 1


def test_disguised_insults_count(spark):
    model = toxicity.ToxicityModel(toxicity.Lexicon.of([("moron", 0, 4.0)]), 0.0, [], np.zeros(1), np.zeros(1))
    for block in text_blocks(pa.array(["you m0ron there", "what a moron", "m.o.r.o.n", "more on that"])):
        rows = toxicity.features(block, model.lexicon)
    hidden, hits = toxicity.FEATURES.index("obfuscated rate"), toxicity.FEATURES.index("lexicon hits")
    assert (rows[:, hidden] > 0).tolist() == [True, False, True, False]
    assert (rows[:, hits] > 0).tolist() == [False, True, False, False]


def test_boosting_and_steps():
    pick = np.random.default_rng(0)
    rows = pick.normal(size=(3000, 3))
    truth = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0)).astype(float)
    start, trees = grow(rows, truth, rounds=40, depth=3, rate=0.3)
    scores = start + sum(tree.predict(rows) for tree in trees)
    assert ((scores > 0) == truth).mean() > 0.95
    ends, heights = isotonic(np.array([1.0, 2.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert (np.diff(ends) > 0).all() and (np.diff(heights) >= 0).all()


def test_encoding_holds_little_text_at_once():
    import tracemalloc

    from geoquarry.llm import byte_bpe

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        words = Vocabulary(file.read())
    pick = random.Random(17)
    stock = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyzäß语", k=pick.randint(1, 9))) for _ in range(3000)]
    column = pa.array([" ".join(pick.choices(stock, k=400)) for _ in range(1200)])
    whole = np.concatenate([words.encode(block)[0] for block in text_blocks(column)])
    parts, peaks = [], []
    tracemalloc.start()
    try:
        for block in text_blocks(column, byte_bpe.ENCODED_BYTES):
            tracemalloc.reset_peak()
            parts.append(words.encode(block)[0])
            peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
    finally:
        tracemalloc.stop()
    assert len(parts) > 4 and (np.concatenate(parts) == whole).all()
    assert max(peaks) < 48, peaks
