"""Language identification, WARC derivatives and main text."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from html import unescape
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from codecorpus.llm.language_id import fit, identify
from codecorpus.llm.style_tree import BESIDE, CONTENT, INSIDE, MAYBE, NEUTRAL, ROLE, WEIGHTS, Page, main_text, role_of
from codecorpus.llm.warc import derivatives, responses, write_warc

SYLLABLES = {"en": ["th", "ing", "er", "ou", "wh", "ly"], "de": ["sch", "ung", "ei", "ß", "ch", "ver"], "fr": ["eau", "é", "ou", "oi", "tion", "è"]}


def invented(lang: str, seed: int, n: int) -> str:
    r = random.Random(f"{lang} {seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(invented(lang, i, 60), lang) for lang in SYLLABLES for i in range(60)] + [(None, "en"), ("abc", None), ("", " ")]
    return fit(spark.createDataFrame(rows, "text string, lang string"), sample_per_language=40)


def test_held_out_texts_are_told(spark, model):
    rows = [(i, f"http://h{i % 7}.example.org/", f"<html><script>var x;</script><p>{invented(lang, 1000 + i, 40)}</p>", lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r.id: r.language for r in identify(frame, model).collect()}
    assert sum(found[r[0]] == r[3] for r in rows) / len(rows) >= 0.98


def test_hosts_suffixes_and_declarations_decide_short_pages(spark, model):
    rows = [(i, f"http://a.de/{i}", f'<html lang="de"><p>{invented("de", 2000 + i, 30)}') for i in range(40)]
    rows += [(100 + i, f"http://www.b.fr/{i}", f'<html lang="fr"><p>{invented("fr", 3000 + i, 30)}') for i in range(40)]
    rows += [(200, "http://a.de/x", ""), (201, "http://www.b.fr/x", None), (202, "http://new.b.fr/x", "<p> </p>"), (203, "http://c.de/", "<p></p>"),
             (204, "http://zz.org/", '<html lang="fr"><p>'), (205, None, None), (None, "http://a.de/", None), (205, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "salt": F.lit(3)})
    found = identify(frame, model).collect()
    assert len(found) == len(rows)
    told = {r.id: r.language for r in found}
    assert [told[i] for i in (200, 201, 202, 203, 204)] == ["de", "fr", "fr", "de", "fr"] and told[205] in SYLLABLES
    assert all(r.text_language is None for r in found if r.id in (200, 201, 205))
    assert identify(frame.limit(0), model).count() == 0


def test_without_labels_there_is_no_language(spark):
    none = fit(spark.createDataFrame([], "text string, lang string"))
    frame = spark.createDataFrame([(1, "http://a.de", "<p>x")], "page_id long, url string, html string")
    assert [r.language for r in identify(frame, none).collect()] == [None]


PAGES = [
    (1, "http://a.org/1", '<html lang="en"><head><title>One &amp; two</title></head><body><h1>Head</h1><p>Text  of\n one<p>Two <a href="/x">link</a></body></html>'),
    (2, "http://a.org/2", None), (3, None, ""), (3, None, ""), (None, "http://b.org", "<p>" + "long words " * 30_000), (4, "http://c.org", "Grüße <b>漢</b>字"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"warc_id": F.lit("x"), "text": F.lit("y"), "payload": F.lit(1)})


def digest(text: str) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_derivatives_are_linked_and_digested(pages):
    source = responses(pages)
    of = brute.grouped((r.warc_id, r) for r in source.collect())
    made = derivatives(source, "page_id").collect()
    assert len(made) == 2 * len(PAGES)
    for r in made:
        origin = of[r.refers_to][0]
        assert r.block_digest == digest(r.block) and r.source_digest == digest(origin.payload) == origin.payload_digest
        assert (r.target_uri, r.date) == (origin.target_uri, origin.date)
    one = {r.warc_type: r for r in made if r.page_id == 1}
    assert one["conversion"].block == "Head\nText of one\nTwo link"
    fields = one["metadata"].block.split("\r\n")
    assert "http-Content-Type: text/html; charset=utf-8" in fields and "http-status: 200" in fields and "title: One &amp; two" in fields
    assert "links: 1" in fields and "language: en" in fields and f"conversion: {one['conversion'].warc_id}" in fields
    assert sorted(map(tuple, derivatives(source, "page_id").collect()), key=repr) == sorted(map(tuple, made), key=repr)


def test_conversions_decode_all_references_and_end_silent_elements_by_their_own_tag(spark):
    references = ["&copy; &middot; &hearts;&amp;lt; &copy2024 &notit; &nosuch; &#8364;&#x41;&#xZ; & &&amp;", "&Aacute&eacute;&nbsp;&lt;b&gt;&#128;&#0;&#xD800;", "a&b;c &NotEqualTilde; &", ""]
    odd = [
        ("<head><script>x</script><title>T</title></head><body>Text", "Text"),
        ("<head><title>T</title><script>var a='</head>';</script><style>p{}</style></head><p>Text", "Text"),
        ("a<noscript>b<script>c</script>d</noscript>e", "a e"),
    ]
    rows = [(i, None, x) for i, x in enumerate(references + [h for h, _ in odd])]
    made = derivatives(responses(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("plain", F.lit(1))), "page_id")
    found = {r.page_id: r.block for r in made.where("warc_type = 'conversion'").collect()}
    for i, x in enumerate(references):
        assert found[i] == " ".join(unescape(x).replace("\xa0", " ").split(" ")).strip(" ").replace("  ", " ")
    assert [found[len(references) + i] for i in range(len(odd))] == [t for _, t in odd]


def test_missing_headers_and_digests_and_no_rows(spark):
    bare = spark.createDataFrame([("<urn:uuid:1>", None, None, None, None, None)], "warc_id string, target_uri string, date string, http string, payload string, payload_digest string")
    made = {r.warc_type: r for r in derivatives(bare).collect()}
    assert made["conversion"].block == "" and made["metadata"].source_digest == digest("")
    assert derivatives(bare.limit(0)).count() == 0


def test_files_read_back_record_by_record(pages, tmp_path):
    records = derivatives(responses(pages))
    write_warc(records, str(tmp_path / "out"))
    found = []
    for path in Path(tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            found.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], rest[:n].decode()))
            assert digest(rest[:n].decode()) == fields["WARC-Block-Digest"] and rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
    assert sorted(found) == sorted((r.warc_id, r.refers_to, r.block) for r in records.collect())


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">We use</div><main><article class="post"><header><h1>Ti&amp;tle {0}</h1></header>
<p>One <b>two<br><p>thr&eacute;e&nbsp;{0} <a href="x>y">link</a>s.<div class="ad">BUY {0}</div><form><input name=q><button>Go</button></form>
<aside>rel</aside><p>End<section id="comments"><article class="comment"><p>nice</p></article></section></article>
<div class="sidebar">side</div></main><footer>c {0}</footer><script>var t="</p>";</script></body></html>"""


def test_main_text_of_articles_plain_sites_and_awkward_pages(spark):
    rows = [(i, f"http://s.org/{i}", SITE.format(i)) for i in range(12)]
    plain = "<body><div class='top'>Same words on all pages</div><div class='story'><p>Own words {0} of page {0}</p></div><div class='end'>Same end</div></body>"
    rows += [(100 + i, f"http://p.org/{i}", plain.format(i)) for i in range(12)]
    rows += [(200 + i, "http://copies.org/", "<body><p>Copied page</p></body>") for i in range(12)]
    rows += [(300, None, None), (301, "", ""), (302, "x", "<p>a &lt; b<"), (302, "x", "<p>a &lt; b<"), (303, "x", "<p>cut <b"), (304, "x", "<div>" * 5_000 + "deep"), (305, "http://q.org", "w " * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "node": F.lit(1), "host": F.lit(2)})
    found = brute.grouped((r.page_id, r.text) for r in main_text(frame).collect())
    assert sum(map(len, found.values())) == len(rows)
    for i in range(12):
        assert found[i] == [f"Ti&tle {i} One two thrée {i} links. End"]
        assert found[100 + i] == [f"Own words {i} of page {i}"]
        assert found[200 + i] == ["Copied page"]
    assert (found[300], found[301], found[302], found[303], found[304]) == ([""], [""], ["a < b<", "a < b<"], ["cut"], ["deep"])
    assert found[305] == ["w " * 99_999 + "w"]
    assert main_text(frame.limit(0)).count() == 0


def test_any_cut_of_a_page_is_read():
    whole = SITE.format(1)
    for at in range(0, len(whole), 7):
        page = Page(whole[:at])
        page.branches()
        page.text(set())


def test_names_tell_by_their_last_word():
    assert {role_of(x) for x in ("sidebar", "left-sidebar", "ad-slot-1", "googleAds", "comments-area", "site-header", "related-posts", "nav_links", "cookie-notice")} == {ROLE}
    assert {role_of(x) for x in ("image-banner", "story-related", "data-form")} == {MAYBE}
    assert {role_of(x) for x in ("form-factor", "related-work", "has-header", "with-sidebar", "no-ads", "content", "x1", "")} == {NEUTRAL}


WRAPPED = [
    ('<body><div class="layout with-sidebar"><article><h1>T</h1><p>Long text of the article.</p></article></div></body>', "T Long text of the article."),
    ('<body><div id="page" class="has-header"><div class="content"><h1>T</h1><p>Long text.</p></div></div></body>', "T Long text."),
    ('<article><p class="form-factor">Phones fold</p><p>x</p></article>', "Phones fold x"),
    ('<article><div class="related-work"><p>Earlier work</p></div><p>x</p></article>', "Earlier work x"),
    ('<body><article class="teaser"><p>More</p></article><div class="body-text"><p>The long text that is meant.</p></div></body>', "More The long text that is meant."),
    ('<body><form id="all"><div class="sidebar">s</div><article>Text of it</article></form><form>mail</form></body>', "Text of it"),
    ('<body><div id="header"><div class="nav"><a>m</a></div><article>Text below a header that was never closed</article>', "Text below a header that was never closed"),
    ('<body><div class="sidebar">longer than all the rest of it</div><article>Text</article><div class="ad">a long advert of this page</div></body>', "Text"),
    ('<body><section id="comments"><article>What a reader has to say</article></section><article>Text</article></body>', "Text"),
]


def test_wrappers_named_like_noise_keep_their_article(spark):
    frame = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, (h, _) in enumerate(WRAPPED)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text(frame).collect()} == {i: t for i, (_, t) in enumerate(WRAPPED)}


def test_entropy_alone_decides_unclear_names_and_labelled_parts_of_articles(spark):
    page = (
        '<body><article><h1>Title {0}</h1><p>The text of page {0} is its own and long enough for an article.</p>'
        '<div class="image-banner">{1}</div><div class="box-end">{2}</div></article></body>'
    )
    rows = []
    for i in range(20):
        rows.append((i, "http://same.org/", page.format(i, "Same banner", "Same end")))
        rows.append((100 + i, "http://own.org/", page.format(i, f"Banner {i}", f"End {i}")))
        rows.append((200 + i, f"http://single{i}.org/", page.format(i, f"Other banner {i}", f"Other end {i}")))
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        text = f"Title {i} The text of page {i} is its own and long enough for an article."
        assert found[i] == text
        assert found[100 + i] == f"{text} Banner {i} End {i}"
        assert found[200 + i] == f"{text} Other banner {i} Other end {i}"


def test_importance_against_a_plain_count(spark):
    """What goes on hosts of one to thirty pages, against entropies counted page by page in Python."""
    r = random.Random(5)
    rows = []
    for host in range(12):
        for i in range(r.choice([1, 2, 5, 9, 14, 30])):
            few = r.randint(1, 4)
            rows.append((len(rows), f"http://h{host}.org/{i}", "<body>" + f"<div class='a'>{r.randint(0, few)}</div>"
                f"<div class='b'>{'<i>x</i>' * r.randint(1, 2)} {r.randint(0, 40)}</div><div class='c'>page {len(rows)}</div><div class='promo-teaser-promo'>{r.randint(0, 2)}</div>"))  # fmt: skip
    threshold, share, prior = 0.3, 0.9, 8.0
    values: dict[tuple, dict] = {}
    for _, url, source in rows:
        page, host = Page(source), url.split("/")[2]
        for node, (kind, style, text) in page.branches().items():
            values.setdefault((host, node), {"kind": kind, "seen": set()})["seen"].add((page.identity(), "\n".join(style), "\n".join(text)))

    def entropy(seen: list) -> float:
        import math
        from collections import Counter

        total = 0.0
        for side, weight in ((0, 1 - share), (1, share)):
            n = len(seen)
            bits = 1.0 if n < 2 else -sum(c / n * math.log(c / n) for c in Counter(x[side] for x in seen).values()) / math.log(n)
            total += weight * bits
        return total

    of_node: dict[int, list] = {}
    for (_, node), found in values.items():
        of_node.setdefault(node, []).extend((s, t) for _, s, t in found["seen"])
    gone: dict[str, set] = {}
    decided = set()
    for (host, node), found in values.items():
        pool = of_node[node]
        pooled = (len(pool) * entropy(pool) + prior) / (len(pool) + prior)
        own = [(s, t) for _, s, t in found["seen"]]
        low = WEIGHTS[found["kind"]] * (len(own) * entropy(own) + prior * pooled) / (len(own) + prior) < threshold
        decided.add((found["kind"], low))
        if low:
            gone.setdefault(host, set()).add(node)
    assert {(NEUTRAL, True), (NEUTRAL, False)} <= decided
    expected = {i: Page(h).text(gone.get(u.split("/")[2], set())) for i, u, h in rows}
    found = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected


def test_kinds_of_branches():
    page = Page('<body><div class="x">beside</div><main><article><h1>T</h1><p>a text that is long enough</p><div class="note">n</div></article></main><nav>m</nav></body>')
    kinds = dict(zip(page.label, page.kind, strict=True))
    assert (kinds["div x"], kinds["article"], kinds["div note"], kinds["nav"], kinds["p"]) == (BESIDE, CONTENT, INSIDE, ROLE, CONTENT)
