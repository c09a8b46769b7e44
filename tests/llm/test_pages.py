import hashlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import html_text as H
from loomline.llm import scratch, warc

SCHEMA = "page_id long, url string, html string, path string, text string, at long"
PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now, %d.</div><article><h1>Title of %d</h1><p><b>First line of text, number %d.<br><p>Second &amp; last,\n with&nbsp;spaces and <i>marks</i>.</p></article><footer>&copy; site &middot; foot</footer></body></html>'


def want(k):
    return f"Title of {k}\nFirst line of text, number {k}.\nSecond & last, with spaces and marks."


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://x/{k}", PAGE % (k, k, k), None, None, None) for k in range(60)]
    rows += [(100, "http://dup", PAGE % (1, 1, 1) + " " * 900, None, None, None), (101, None, PAGE % (1, 1, 1) + " " * 900, None, None, None), (102, "u\nv", None, None, None, None), (103, "", "", None, None, None), (104, "a", "<", None, None, None), (105, "a", "<article>only text", None, None, None), (105, "a", "<article>only text", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def model(pages):
    return H.train(pages)


def test_main_text(pages, model, spark):
    got = {r.page_id: r for r in H.extract(pages, model).collect()}
    assert all(got[k].text == want(k) and got[k].n_chars == len(want(k)) for k in range(60))
    assert got[102].text == got[103].text == "" and got[105].text == "only text"
    assert H.extract(pages, model).count() == pages.count()
    none = spark.createDataFrame([], SCHEMA)
    assert H.extract(none, H.train(none)).count() == 0


def test_names_and_neighbours_that_the_sample_lacks(model):
    page = '<body><header>Site name</header><div class="cookie-notice"><p>We use cookies.</p></div><div id="content"><h1>Big title</h1><p>First paragraph of the story, with some text in it.</p><form>Subscribe</form><p>Second paragraph of the story follows here.</p></div><aside class=sidebar><p>Related stories you may like.</p></aside><div id="comments"><p>I liked this story a lot.</p></div></body>'
    cut = H.blocks(page)
    (score,) = model.scores([[H.features(*b) for b in cut]])
    assert [b[1] for b, s in zip(cut, score) if s >= 0.5] == ["Big title", "First paragraph of the story, with some text in it.", "Second paragraph of the story follows here."]


def test_blocks_bear_bad_markup():
    assert [b[1] for b in H.blocks("<p>a<p>b<ul><li>c<li>d</ul>e<!-- f")] == ["a", "b", "c", "d", "e"]
    assert [b[1] for b in H.blocks("x<script>if(a<b)</b></script>y <b>z</b>&lt;&am")] == ["xy z<&am"]
    assert H.blocks("") == [] and [b[1] for b in H.blocks("<a href='>'>t</a>")] == ["t"]
    assert len(H.blocks("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_inline_raw_elements_stay_in_their_block():
    of = lambda page: [b[1] for b in H.blocks(page)]
    assert of("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> here</p>") == ["Energy is E=mc2 here"]
    assert of("<p>a<script>1</script>b <svg><path d='x'/></svg>c<template><p>no</p></template> d</p><p>e") == ["ab c d", "e"]
    assert of("<title>t</title><p>a<style>p{}</style></p>") == ["a"]


def test_quotes_that_are_never_closed():
    of = lambda page: [b[1] for b in H.blocks(page)]
    assert of('<p class="x>broken quote') == ["broken quote"]
    assert of("<p>one</p><p title='it>two</p><p>three</p>") == ["one", "two", "three"]
    assert of("<p>it's</p> <b title=\"a > b\">bold</b>") == ["it's", "bold"]


def test_long_pages_and_repeated_blocks(model, pages):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page, with words in it.</p>" for i in range(3000)) + "</article>"
    assert len(H.blocks(long)) == 3000 and len(model.scores([[H.features(*b) for b in H.blocks(long)]])[0]) == 3000
    cut = [H.blocks(f"<div>Own words {i} here</div><div>Made by our team</div>") for i in range(5)]
    assert H.repeats(cut, ["h"] * 5) == {("h", "Made by our team")} and H.repeats(cut, list("abcde")) == set()
    xs, ys = H.lessons([f"<div>{'own words ' * 20}{i}</div><div>{'made by our team ' * 9}</div>" for i in range(5)], ["h"] * 5, copies=0)
    assert ys == [[1, 0]] * 5
    assert H.train(pages) is model  # the same sample, not learnt again


def test_padding_does_not_change_scores(model):
    a = [H.features(*b) for b in H.blocks(PAGE % (1, 1, 1))]
    alone, together = model.scores([a])[0], model.scores([a, a[:3], [], a * 5])[0]
    assert abs(alone - together).max() < 1e-5


def test_archives_read_back(pages, spark):
    folder = scratch.new_path(spark, "warc-test")
    got = warc.archive(pages, folder).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    payloads = {}
    for r in rows:
        payloads.setdefault(r.page_id, set()).add((r.html or "").encode())
    for g in got:
        (data,) = payloads[g.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        same = [i for i, p in payloads.items() if p == {data}]
        revisit = len(data) >= 1000 and g.page_id != max(same)
        assert (g.record_type, g.refers_to) == (("revisit", max(same)) if revisit else ("response", None))
    assert sum(g.record_type == "revisit" for g in got) == 1
    assert warc.archive(spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_archives_are_split_over_tasks(spark):
    """Long and repeated payloads and null ids, in more output archives than input ones."""
    rows = [(i if i else None, f"u{i}", f"<p>{i % 40}</p>" + "text " * 400, None, None, None) for i in range(200)] + [(900, "u", "<b>x" * 500_000, None, None, None)]
    raw = warc.write_responses(spark.createDataFrame(rows, SCHEMA).coalesce(1), scratch.new_path(spark, "warc-test"))
    headers = scratch.write_table(warc.read_headers(raw), "h")
    out = warc.deduplicate(headers, scratch.new_path(spark, "warc-test"), piece=1000)
    got = warc.read_headers(out).collect()
    assert raw.count() == 1 and out.count() > 3 and len(got) == len(rows)
    last = {i % 40: i for i in range(200)}
    for g in got:
        if g.page_id != 900:
            i = g.page_id or 0
            assert (g.record_type, g.refers_to) == (("response", None) if last[i % 40] == i else ("revisit", last[i % 40]))


def test_records_are_reachable_by_offset(pages, spark):
    import gzip

    raw = warc.write_responses(pages.where(F.col("page_id") < 5), scratch.new_path(spark, "warc-test"))
    for h in warc.read_headers(raw).collect():
        fs, name = scratch.open_fs(h.path)
        with fs.open_input_file(name) as f:
            f.seek(h.at)
            headers, block = warc.parse(gzip.decompress(f.read(h.length)))
        assert headers["warc-record-id"] == h.record_id and warc.payload(block) == (PAGE % ((h.page_id,) * 3)).encode()


def test_elements_that_close_themselves_and_empty_comments():
    text = lambda page: [b[1] for b in H.blocks(page)]
    assert text("<p>x<svg/>y</p><p>next</p>") == ["xy", "next"] and text('<p>x<svg class="a" />y</p>z') == ["xy", "z"] and text("<p>x<svg><path/>no</svg>y</p>z") == ["xy", "z"]
    assert text("<math><annotation/><mi>a</mi></math><p>b") == ["a", "b"] and text("x<svg a=b/>no</svg>y") == ["xy"] and text("x<svg hidden/>y") == ["xy"]
    assert text("a<script/>no</script>b") == ["ab"]
    assert text("<p>a<!-->b</p>c") == ["ab", "c"] and text("a<!--->b") == ["ab"] and text("a<!-- x --!>b<!-- > -- -->c") == ["abc"] and text("a<!----->b<!---->c") == ["abc"] and text("a<!-- b") == ["a"]


def plain_blocks(page):
    """Texts between block tags of pages of plain tags, cut by hand."""
    out, held, i = [], "", 0
    while i < len(page):
        if page[i] != "<":
            held += page[i]
            i += 1
            continue
        end = page.index(">", i)
        tag = page[i + 1 : end].strip("/").split(" ")[0].lower()
        i = end + 1
        if tag == "br":
            held += " "
        elif tag not in ("b", "i", "a", "span"):
            out.append(held)
            held = ""
    return [" ".join(x.split()) for x in [*out, held] if x.split()]


def test_blocks_against_cutting_by_hand():
    import random

    r = random.Random(9)
    for _ in range(300):
        bits = [r.choice(["<p>", "</p>", "<div id=x>", "</div>", "<li>", "<b>", "</b>", "<br>", "<a href=u>", "</a>", "<h1>", "</h1>", "<hr/>", "word", " ", "\n", "two words", "é"]) for _ in range(r.randint(0, 40))]
        assert [b[1] for b in H.blocks("".join(bits))] == plain_blocks("".join(bits))


def test_very_long_text_in_one_block(model, pages):
    long = "<article><p>" + "word " * 100_000 + "</p></article>"
    row = pages.where("page_id = 103").withColumn("html", F.lit(long))
    (got,) = H.extract(row, model).collect()
    assert got.n_chars == 499_999
