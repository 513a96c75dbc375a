"""Operators on single texts: language, HTML, tokens, BPE, quality."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import bpe, catalog, hdlang, htmltext, mil, tokenbin
from claimlens.llm.common import work_dir
from tests.conftest import SF_MID, SF_SMALL

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = ["", " ", "   b", "a ", "a   b \n\n c", "Hello WORLD's don't 123 <|endoftext|> x<|startoftext|>", "ΣΑΣ İstanbul 日本語 🙂",
       "a\x85b\xa0c d \x1c", "aaaaaaaaaaaaaaaaaaaa", "!!??***&&&", "x" * 3000, "ß ﬁ ǅ ŉ", "'S it's IT'LL ''ve", "́ͅ ½ ² ٣ Ⅷ",
       "é<|endoftext|>́", "<|endo", "word,word, word. word's"]


def _random_texts(n, seed=4):
    rnd = random.Random(seed)
    alphabet = "aábcé 'st\n1!?*λджΣ日🙂ﬁ,."
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(n)]


def _texts(spark, sf=SF_SMALL):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


# ------------------------------------------------------------------ op10

def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer
    path = catalog.tokenizer_path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    for t in ODD + _random_texts(500) + _texts(spark)[:60]:
        want = lib.encode(t, add_special_tokens=False).ids
        ids, decoded = own.encode_decode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:50]
        assert decoded == lib.decode(want, skip_special_tokens=False), t[:50]


def test_bpe_query_cases(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "Ab ab", "z"), (3, "Ab ab", "z"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").drop("n_tokens")
    out = bpe.encode_decode(df, "text", catalog.tokenizer_path("word_bpe_49k.json"), with_outputs=True).collect()
    got = {(r["doc_id"], r["text"]): r for r in out}
    assert len(out) == 5
    assert got[1, None]["n_tokens"] == got[2, ""]["n_tokens"] == 0
    assert got[1, None]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3, "Ab ab"]["decoded"] == "ab</w> ab</w>"
    assert bpe.encode_decode(df.limit(0), "text", catalog.tokenizer_path("word_bpe_49k.json")).count() == 0


# ------------------------------------------------------------------ op6

@pytest.mark.parametrize("keep", [600_000, 50])
def test_chunk_encoder_equals_library(spark, keep):
    from tokenizers import Tokenizer
    path = catalog.tokenizer_path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), tokenbin.ChunkEncoder(path, "<u2", keep)
    texts = ODD + _random_texts(500) + _texts(spark)[:60] + ODD
    for lo in range(0, len(texts), 97):
        part = texts[lo:lo + 97]
        for t, packed in zip(part, own.encode(part)):
            assert np.frombuffer(packed, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer
    path = catalog.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no key"), (3, "again"), (3, "again"), (-5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(4)
    manifest = tokenbin.write_store(df, "doc_id", "text", path, 2, work_dir(spark, "tokens"))
    got = sorted(tokenbin.read_store(manifest, with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (key, text) in zip(got, want, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (key, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenbin.token_store(df.limit(0), "doc_id", "text", path, 2).count() == 0


# ------------------------------------------------------------------ op3

def test_bundle_is_bound_trigrams():
    def vec(ch):
        return hdlang._symbol(ord(ch), 64).astype(float)
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in (" ab", "abc", "bc ", " de", "de "))
    got = hdlang.bundle(["abc, DE", None, "12 3"], dims=64)
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-5)
    assert not got[1].any() and not got[2].any()
    whole = hdlang.bundle(["one two", "trois", "vier fünf"])
    assert np.allclose(whole[1], hdlang.bundle(["trois"])[0], atol=1e-5)
    assert np.allclose(hdlang.bundle(["some words here"], block=3), hdlang.bundle(["some words here"]), atol=1e-5)


def test_language_held_out_accuracy(spark):
    out = catalog.op3_hd_language(spark, SF_MID).join(
        spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    acc = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert acc > 0.97
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_cases(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !!", None), (4, "wort und wort", "de"), (4, "wort und wort", "de")],
                               "doc_id long, text string, lang string").withColumn("p", F.lit(1))
    out = {(r["doc_id"], r["text"]): r for r in hdlang.language_id(df, F.lit(True)).collect()}
    assert [out[k]["lang_pred"] for k in ((1, None), (2, ""), (3, "12 !!"), (4, "wort und wort"))] == ["und"] * 3 + ["de"]
    none = hdlang.language_id(df, F.lit(False)).collect()
    assert len(none) == 5 and {r["lang_pred"] for r in none} == {"und"}
    assert hdlang.language_id(df.limit(0), F.lit(True)).count() == 0


# ------------------------------------------------------------------ op9

def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality")
    out = catalog.op9_mil_quality(spark, SF_MID).join(labels, "doc_id").filter("held_out").toPandas()
    pos, neg = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.97
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_quality_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    x, owner, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    shapes = {"W": (5, 6), "b": (6,), "V": (6, 3), "U": (6, 3), "w": (3,), "c": (6,), "c0": (1,)}
    p = {k: rng.normal(size=s) for k, s in shapes.items()}

    def loss():
        out = mil._forward(p, x, owner, 3)[-1]
        return -(y * np.log(out) + (1 - y) * np.log(1 - out)).mean()

    got = mil.gradients(p, x, owner, y)
    for k, v in p.items():
        for at in np.ndindex(v.shape):
            old, d = v[at], 1e-6
            v[at] = old + d
            up = loss()
            v[at] = old - d
            slope = (up - loss()) / (2 * d)
            v[at] = old
            assert abs(got[k][at] - slope) < 1e-7, (k, at)


def test_quality_sample_is_bounded_by_passages(spark, monkeypatch):
    """Long texts do not fill the driver: no document over a twentieth, no more than the bound in all."""
    rows = [(i, "word " * (64 * 40 if i == 3 else 64 * 2)) for i in range(30)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(mil, "fit", lambda x, owner, label, **_: seen.update(passages=len(x), docs=len(label), most=np.bincount(owner).max()))
    mil.fit_quality(docs, labels, max_passages=120)
    assert 10 <= seen["docs"] < 29 and seen["passages"] <= 120 and seen["most"] <= 6
    mil.fit_quality(docs, labels)
    assert seen["docs"] == 30


def test_quality_network_learns():
    rng = np.random.default_rng(1)
    x, owner = rng.normal(size=(9, 5)).astype(np.float32), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    y = np.array([1, 0, 1], np.float32)
    p = mil.fit(x, owner, y, epochs=300, batch=3, rate=0.03)
    assert (np.round(mil._forward(p, x, owner, 3)[-1]) == y).all()


def test_quality_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Good text."), (3, "Good text."), (None, "x " * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert mil.fit_quality(df, none) is None
    assert {r["score"] for r in mil.score(df, None).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (9, 1), (None, 1), (1, None)], "doc_id long, quality int")
    model = mil.fit_quality(df.withColumn("score", F.lit("clash")), labels)
    out = {(r["doc_id"], r["text"]): r["score"] for r in mil.score(df, model).collect()}
    assert len(out) == 4 and all(0 <= s <= 1 for s in out.values()) and out[1, None] == out[2, ""]
    assert mil.score(df.limit(0), model).count() == 0
    x, owner = mil.features(["a b", "", "c " * 200])
    assert owner.tolist() == [0, 1, 2, 2, 2, 2] and not x[1].any()


# ------------------------------------------------------------------ op8

PAGE = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>'
        '<div class="cookie-notice">We use cookies</div><ul class=menu><li><a href=1>Home</a><li><a href=2>About</a></ul>'
        '{open}<h2>Title</h2><p>Some long paragraph of text &amp; more,\n and more text to fill the line of the article.'
        '<p>Second <b>bold</b> paragraph<br>goes on &lt;here&gt; with enough words to be a paragraph.{close}'
        '<div class="comments"><p>First! what a nice article you have here, thank you</p></div><aside>Other news</aside>'
        '<form>Search <input> here</form><footer>&copy; 2020 all rights</footer>')
TEXT = ("Title\n\nSome long paragraph of text & more, and more text to fill the line of the article.\n\n"
        "Second bold paragraph goes on <here> with enough words to be a paragraph.")


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<div id=content>", "</div>"), ("<main>", "</main>")])
def test_main_text(tags):
    assert htmltext.main_text(PAGE.format(open=tags[0], close=tags[1])) == TEXT


def test_main_text_cases(spark):
    assert htmltext.main_text("") == htmltext.main_text(None) == ""
    assert htmltext.main_text("<article><p>a < b <!-- open") == "a < b"
    assert htmltext.main_text("<article>short") == "short"
    assert htmltext.main_text("<nav>only a menu</nav>") == ""
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(5000)) + "</article>"
    assert htmltext.main_text(long).count("\n\n") == 4999
    df = spark.createDataFrame([(1, None), (1, None)], "page_id long, html string").withColumn("text", F.lit("old"))
    assert [r["text"] for r in htmltext.extract(df).collect()] == ["", ""]


def test_main_text_outside_of_teaser_articles():
    body = [f"Paragraph {i} of the main text, which is long enough to be one of several real paragraphs." for i in range(8)]
    page = ("<body><nav><a href=1>Home</a></nav><div id=text>" + "".join(f"<p>{b}</p>" for b in body) + "</div>"
            "<article><a href=2>Teaser one</a></article><article><a href=3>Teaser two</a></article><footer>end</footer>")
    got = htmltext.main_text(page).split("\n\n")
    assert got[:8] == body and "Home" not in got and "end" not in got
    unmarked = ("<body><ul><li><a href=1>Home</a><li><a href=2>About</a><li><a href=3>Contact</a></ul><h2><a href=4>Linked title</a></h2>"
                f"<p>{body[0]}</p><h3><a href=5>Linked heading</a></h3><p>{body[1]}</p><p><a href=6>{body[2]}</a></p>"
                f"<ul>{''.join(f'<li><a href=x>Reference {i}</a>' for i in range(5))}</ul><p>{body[3]}</p>")
    refs = [f"Reference {i}" for i in range(5)]
    assert htmltext.main_text(unmarked).split("\n\n") == ["Linked title", body[0], "Linked heading", body[1], body[2], *refs, body[3]]


def test_main_text_keeps_reference_lists():
    page = (f"<article><p>{'Some text of an article. ' * 9}</p><ul>" + "".join(f"<li><a href=x>Reference {i}</a></li>" for i in range(6))
            + "</ul><aside>Other news</aside><p>Note</p></article>")
    got = htmltext.main_text(page).split("\n\n")
    assert got[1:] == [*(f"Reference {i}" for i in range(6)), "Note"]


_BODY = [f"Paragraph {i} of the real text, which is long enough to be one of several." for i in range(5)]
_WRAPS = ['<div class="main-content has-sidebar">', '<div class="no-sidebar content">', '<div class="elementor-widget">',
          '<div id=content class="post comments-open">', '<div title="the hidden truth">', '<div data-x="not hidden here">',
          '<form id=aspnetForm>', '<div title="a > b">', "<div data-a='x\">' class=text>"]


@pytest.mark.parametrize("wrap", _WRAPS)
@pytest.mark.parametrize("tag", ["article", "section"])
def test_class_words_never_drop_the_text(wrap, tag):
    page = (f"<body><nav>Menu words</nav>{wrap}<{tag}>" + "".join(f"<p>{b}</p>" for b in _BODY) + f"</{tag}>"
            '<div class="comments"><p>' + "A reader writes a very long comment here. " * 20 + "</p></div><footer>end</footer>")
    assert htmltext.main_text(page).split("\n\n") == _BODY


def test_plain_page_without_classes_or_semantic_tags():
    page = ("<div>Home</div><div>Products</div><div>About us</div><h1>Title</h1>" + "".join(f"<div>{b}</div>" for b in _BODY)
            + "<div>Terms of use</div><div>© 2024 Foo Inc. All rights reserved.</div>")
    assert htmltext.main_text(page).split("\n\n") == ["Title", *_BODY]


def test_comments_in_article_elements_are_no_article():
    page = ("<div id=post>" + "".join(f"<p>{b}</p>" for b in _BODY) + '</div><ol class="comment-list">'
            + "".join(f'<li><article class="comment-body"><p>Comment {i}. {"I like it. " * 30}</p></article>' for i in range(9)) + "</ol>")
    assert htmltext.main_text(page).split("\n\n") == _BODY


@pytest.mark.parametrize("bad", [
    '<a "x" ' * 150_000, "<a href=x " * 100_000, '<a t="' * 170_000, '<a t="x>' * 130_000, '<a t="' * 170_000 + ">", "<!--" * 250_000,
    "<script>" * 120_000, "<div>" * 200_000, "<" * 1_000_000, "<i>" + "<div>" * 90_000 + "</i>" * 90_000,
    "<i><div>" + "<b>" * 90_000 + "</i>" * 90_000, "<p>" + "<b>" * 90_000 + "<p>" * 90_000, '<a "x" ' * 150_000 + ">"])
def test_broken_markup_takes_linear_time(bad):
    import time
    t = time.process_time()
    htmltext.main_text(bad)
    assert time.process_time() - t < 5                # measured 0.0 to 0.7 s; quadratic scans took minutes


def test_every_page_gives_its_article(spark):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    for r in catalog.op8_html_text(spark, SF_MID).collect():
        page = pages[r["page_id"]]
        inner = page[page.index("<article>") + 9:page.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert r["text"] == want and r["n_chars"] == len(want)
