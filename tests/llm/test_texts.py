"""Operators on single texts: main text, media, token counts, toxicity, quality."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotweave.llm import isomedia, lineblocks, quality, tokencount, toxicity

ARTICLE = "This is a sentence of the article that is long enough to make a surge of text in any window of lines."


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>{ARTICLE}<p>Short.</article><footer>&copy; me</footer></body></html>", f"Title & more\n{ARTICLE}\nShort."),
        (f"<div class='menu'><a>a</a> <a>b</a></div><div><p>{ARTICLE}</p><p>{ARTICLE}</p><p>End.</p></div><div id=footer>all rights</div>", f"{ARTICLE}\n{ARTICLE}\nEnd."),
        (f"<article><p>{ARTICLE}</p><aside>look</aside><div class=ad>buy</div><form>name</form><p>After.</p></article><section class='comments'><p>{ARTICLE}</p></section>", f"{ARTICLE}\nAfter."),
        (f"<main><script>var t='</p>';</script><style>p{{}}</style><!-- no --><p>a\n  b<br>c&nbsp;d &lt;tag&gt; {ARTICLE}</p></main>", f"a b c d <tag> {ARTICLE}"),
        (f"<div><p>{ARTICLE}</p><p style='display: none'>secret</p><span hidden>secret</span><p class=\"not-hidden-here\">{ARTICLE}</p></div>", f"{ARTICLE}\n{ARTICLE}"),
        (f"<table><tr><td><a href=1>one</a></td><td><a href=2>two</a></td></tr></table><h1>Head</h1><p>{ARTICLE}</p><ul><li>first<li>second</ul>", f"Head\n{ARTICLE}\nfirst\nsecond"),
        ("<p>tiny</p>", "tiny"),
        (f"<article><p>{ARTICLE}</p></article><footer>cut &am", ARTICLE),
        ("", ""),
        ("<", "<"),
    ],
)
def test_main_text(html, text):
    assert lineblocks.main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<article class="post tag-social"><p>{ARTICLE}</p></article>', ARTICLE),
        (f'<div class="content has-sidebar"><p>{ARTICLE}</p></div>', ARTICLE),
        (f'<div class="no-comments"><article><p>{ARTICLE}</p></article></div>', ARTICLE),
        (f'<div class="related-work"><p>{ARTICLE}</p><p>{ARTICLE}</p></div>', f"{ARTICLE}\n{ARTICLE}"),
        (f'<div class="sidebar"><main><p>{ARTICLE}</p></main></div>', ARTICLE),
        (f"<div><p>{ARTICLE}</p><div class=ad>buy</div><p>Short end.</p></div>", f"{ARTICLE}\nShort end."),
        (f"<div><p>{ARTICLE}</p><div class=ad>buy</div><p>Middle</p><div class=ad>buy</div><p>{ARTICLE}</p></div>", f"{ARTICLE}\nMiddle\n{ARTICLE}"),
        (f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><article><a href=1>Card</a></article><article>Teaser</article>", f"{ARTICLE}\n{ARTICLE}"),
    ],
)
def test_noise_words_are_only_evidence(html, text):
    assert lineblocks.main_text(html) == text


def test_extract_table(spark):
    rows = [(1, "u", f"<article><p>{ARTICLE}</p></article>", "x"), (1, "u", f"<article><p>{ARTICLE}</p></article>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = lineblocks.extract(df, ["page_id", "url"]).orderBy(F.desc_nulls_last("page_id")).collect()
    assert [tuple(r) for r in got] == [(1, "u", ARTICLE, len(ARTICLE))] * 2 + [(None, None, "", 0)]
    assert lineblocks.extract(df.where("false"), ["page_id"]).count() == 0


def test_blocks_find_the_article_without_its_tags():
    """Pages whose article and main elements are plain divs give the same text, and lines of the page are left out by the blocks."""
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        html = re.sub(r"<(/?)(article|main)\b", r"<\1div", page["html"] or "")
        text = lineblocks.main_text(html)
        assert text == lineblocks.main_text(page["html"] or "")
    page = "<div><p>Home</p><p><a href='/'>All</a></p></div><div class='advert'>x</div><h1>Title</h1><p>Short lead.</p><p>" + "Words of the article follow here. " * 5 + "</p><p>End.</p><div class='advert'>y</div><div><p>Tags</p></div>"
    assert lineblocks.main_text(page).split("\n")[0] == "Title" and lineblocks.main_text(page).endswith("End.")


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article><h1>Hi</h1><p>Yes.</p><p>No.</p><p>{ARTICLE}</p></article>", f"Hi\nYes.\nNo.\n{ARTICLE}"),
        (f'<article><p>{ARTICLE}</p><div class="social">Kept.</div><p class="share-price">Kept too.</p><div class="share"><a href=1>post</a></div></article>', f"{ARTICLE}\nKept.\nKept too."),
        (f'<main><p>{ARTICLE}</p><div id="comments"><h2>3 comments</h2><article><p>I say: {ARTICLE}</p></article></div></main>', ARTICLE),
        (f"<div id=top-menu><a>x</a></div><div><p>Short lead.</p><div class=ad>buy</div><p>{ARTICLE}</p><ul><li>one<li>two</ul><div class=ad>buy</div><p>The end</p></div><div><p>Imprint</p></div>", f"Short lead.\n{ARTICLE}\none\ntwo\nThe end"),
        (f"<p title='a>b' data-x=\"c>d\" e=f'g>{ARTICLE}</p>", ARTICLE),
        (f"<div><p>Menu</p><p>Login</p></div><div class=ad>buy</div><div><p>{ARTICLE}</p></div>", ARTICLE),
    ],
)
def test_lines_of_the_article_stay_and_comments_go(html, text):
    assert lineblocks.main_text(html) == text


def _planted(rng):
    """A page without article tags, and the lines of its article."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    line = lambda lo, hi: " ".join(word() for _ in range(rng.randrange(lo, hi)))
    lines = [line(2, 6)] + [line(25, 60) if k % 3 else line(3, 9) for k in range(rng.randrange(4, 12))]
    body = [f"<h1>{lines[0]}</h1>"]
    for text in lines[1:]:
        body.append(rng.choice([f"<p>{text}</p>", f"<p><b>{text}</b>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</ul>"]))
        if rng.random() < 0.3:
            body.append(rng.choice(["<div class='advert'>{}</div>", "<aside>{}</aside>", "<form>{}</form>", "<div id=newsletter><p>{}</p></div>", "<script>{}</script>"]).format(line(2, 12)))
    menu = "".join(f"<li><a href='/{k}'>{line(1, 3)}</a>" for k in range(rng.randrange(3, 9)))
    around = [f"<ul class=menu>{menu}</ul>", f"<div><p><a href=/>{line(1, 4)}</a></p><p>{line(1, 3)}</p></div>", f"<div class=cookie-notice>{line(3, 9)}</div>"]
    behind = [f"<div id=comments><p>{line(20, 40)}</p></div>", f"<footer>{line(3, 9)}</footer>", f"<div><ul>{menu}</ul></div>"]
    rng.shuffle(around)
    rng.shuffle(behind)
    return "<html><body>" + "".join(around) + f"<div class=text>{''.join(body)}</div>" + "".join(behind), "\n".join(lines)


def test_blocks_of_planted_pages():
    """Without article tags the blocks decide: every line of the article stays, every other goes."""
    rng = random.Random(12)
    for _ in range(200):
        page, text = _planted(rng)
        assert lineblocks.main_text(page) == text


@pytest.mark.parametrize("part, times", [("<div class='ad-x'>", 8000), ("<a ", 60000), ("<ul><li>", 20000), ('<a href="', 20000), ("<p class='share'>", 10000), ("<article>", 10000), ("<!--", 40000), ("<script>", 20000)])
def test_hostile_pages_take_time_in_proportion(part, times):
    import time

    begin = time.process_time()
    lineblocks.main_text(part * times + '"')
    assert time.process_time() - begin < 4


def test_whole_and_long_pages():
    body = "<article>" + "<p>some words of a long page</p>" * 20_000 + "</article>"
    assert lineblocks.main_text(body).count("\n") == 19_999
    assert lineblocks.main_text(body) == lineblocks.main_text(body.replace("article", "div"))


@pytest.mark.parametrize("frames", [1, 2, 31, 32, 33, 64, 65, 200])
def test_container_round_trip(frames):
    data = random.Random(frames).randbytes(frames * isomedia.FRAME)
    stored = isomedia.pack(data)
    (track,) = isomedia.tracks(stored)
    assert isomedia.payload(stored, track) == data
    assert track["codec"] == "raw " and track["duration"] == track["ticks"] == len(data)
    for k in track["keys"]:
        a, n = int(track["offsets"][k]), int(track["sizes"][k])
        assert stored[a : a + n] == data[k * isomedia.FRAME : (k + 1) * isomedia.FRAME]


def test_foreign_and_cut_containers():
    stored = isomedia.pack(b"x" * isomedia.FRAME * 40)
    assert isomedia.tracks(b"") == [] and isomedia.tracks(b"RIFF" + bytes(100)) == []
    for cut in range(0, len(stored), 97):
        isomedia.tracks(stored[:cut])
    assert isomedia.tracks(stored[:-30]) == []


def test_store_table(spark):
    texts = ["", None, "abc", "é" * 700, "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in isomedia.store(df, ["doc_id"], media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert got[2]["feature"] == got[4]["feature"]
    probed = isomedia.probe(spark.createDataFrame([(1, bytes(got[3]["media"])), (2, None)], "i bigint, content binary"), ["i"]).orderBy("i").collect()
    assert probed[0]["tracks"][0]["samples"] == got[3]["payload_bytes"] // 576 and probed[1]["tracks"] == []


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_counts_of_spliced_texts():
    rng = random.Random(3)
    encoder = tokencount.tokenizer(_tokenizer())
    pool = ["the", "naïve", " ", "\n\n", "日本語", "<|endoftext|>", "123", "don't", "x" * 40, "…", "word", "under_score"]
    for n in range(12):
        text = " ".join(rng.choice(pool) for _ in range(400)) if n % 3 else "".join(rng.choice(pool) for _ in range(300))
        want = len(encoder.encode(text, add_special_tokens=False).ids)
        for chunk, lap in ((64, 16), (200, 24), (1000, 100)):
            assert tokencount.count_long(encoder, text, chunk, lap) == want
    assert tokencount.count_long(encoder, "x" * 5000, 500, 50) == len(encoder.encode("x" * 5000).ids)


def test_count_table(spark):
    texts = [None, "", "a b", "word " * 30000, "a <|endoftext|> b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in tokencount.count(df, ["doc_id"], _tokenizer()).collect()}
    encoder = tokencount.tokenizer(_tokenizer())
    for i, t in enumerate(texts):
        want = len(encoder.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), want, want > 1024)


def _toxic_texts(n=600):
    rng = random.Random(5)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        y = int(i % 4 == 0)
        if y:
            text[rng.randrange(len(text))] = rng.choice(["vilest", "scumbag,", "scumbags"])
        out.append((i, " ".join(text), "en" if i % 2 else "de", y))
    return out


def test_toxicity(spark):
    rows = _toxic_texts()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, None, None), (9999, "", "en"), (9998, "one", None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, part=F.crc32(F.col("i").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]]["predicted"] == r[3] for r in held]) > 0.95
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_quality(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
        good = int(i % 4 != 0)
        rows.append((i, " ".join(words) if good else " ".join(w + "***" for w in words), "hot" if i % 3 else f"s{i % 7}", good))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, None, None)], "doc_id bigint, text string, source string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs, labels, "source", F.col("source")).collect()}
    assert np.mean([got[r[0]] == bool(r[3]) for r in rows]) > 0.98 and len(got) == 401
    kept = quality.reject(docs, labels, "source", F.col("source"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}
    assert quality.reject(docs, labels.where("false"), "source", F.col("source")).count() == 401
    assert quality.reject(docs.where("false"), labels, "source", F.col("source")).count() == 0


def test_site_posterior_shrinks(spark):
    rows = [("a", "p", 0.9)] * 500 + [("b", "p", 0.1)] * 500 + [("c", "p", 0.0)]
    found = {r["host"]: r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert found["a"]["path_mean"] > 0.85 and found["b"]["path_mean"] < 0.15 and found["c"]["path_mean"] > 0.02


@pytest.mark.parametrize("pieces", ["的 一 是 不 了 人 ， 。 、".split(), [*"abcdefgh"], ["ab", "'s", " it's", "12", " ", "  ", "\n", ",", "...", "é", "½", "Ⅷ", "　", "<|endoftext|>", "<|", "|>", "'", "’t", "x"], ["क", "ि", "। ", " "], ["😀", "👍🏽", " a"], ["\x1c", " ", "a", " "]])
@pytest.mark.parametrize("chunk, overlap", [(64, 8), (700, 64)])
def test_counts_of_scripts_without_spaces(pieces, chunk, overlap):
    rng = random.Random(len(pieces))
    encoder = tokencount.tokenizer(_tokenizer())
    text = "".join(rng.choice(pieces) for _ in range(6000))
    calls = []

    class Counted:
        def encode(self, part, **how):
            calls.append(len(part))
            return encoder.encode(part, **how)

    assert tokencount.count_long(Counted(), text, chunk, overlap) == len(encoder.encode(text, add_special_tokens=False).ids)
    assert sum(calls) <= 4 * len(text)


def test_many_paths_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(14)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), round(rng.random(), 3)) for _ in range(400)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double").withColumn("id", F.lit("clash")).persist()
    found = quality.sites(scored)
    few = quality.with_sites(scored, found)
    monkeypatch.setattr(quality, "SMALL", 0)
    monkeypatch.setattr("dotweave.llm.common.HEAVY", 4)
    many = quality.with_sites(scored, found)
    assert sorted(few.columns) == sorted(many.columns)
    names = ["host", "path", "evidence", "score"]
    assert sorted(map(str, few.select(names).collect())) == sorted(map(str, many.select(names).collect()))
    assert few.count() == 400 and quality.with_sites(scored.where("false"), found).count() == 0
