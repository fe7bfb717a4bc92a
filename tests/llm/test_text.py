import random
import time

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import html_text, langid

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now, cheap.</div>
<article><h1>Head line</h1><p><b>First   paragraph, with words.<br><p>Second &amp; third&nbsp;part; more text here.</p><ul><li>short</li></ul></article>
<section class="comments"><p>I disagree, with many words, at length, indeed.</p></section><form><p>Sign up</p></form>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html_text.extract(PAGE) == "Head line\nFirst paragraph, with words.\nSecond & third part; more text here.\nshort"


def test_without_article():
    body = "".join(f"<p>Paragraph {i}, which has some words, and a stop.</p>" for i in range(5))
    page = f'<div id="sidebar"><p>Side text.</p></div><div class="menu"><a href=x>One</a></div><div class="content">{body}</div><div class="cookie-notice">We use cookies.</div>'
    assert html_text.extract(page) == "\n".join(f"Paragraph {i}, which has some words, and a stop." for i in range(5))


def test_parts_of_different_paths():
    paragraph, item = "A paragraph, with words. " * 4, "An item of a list, which is long, and has a stop. " * 3
    lines = lambda tag, text, n: f"<{tag}>{text.strip()}</{tag}>" * n
    links = '<div class="x1">' + '<p><a href="/x">Another page of the site</a></p>' * 6 + "</div>"
    post = f"<div class=post>{lines('p', paragraph, 3)}<ul>{lines('li', item, 15)}</ul></div>"
    assert html_text.extract(f"<body>{links}{post}</body>").split("\n") == [paragraph.strip()] * 3 + [item.strip()] * 15
    entry = f"<div class=post><h1>Head line</h1><div class=entry>{lines('p', paragraph, 5)}</div></div>"
    assert html_text.extract(f"<body>{links}{entry}</body>").split("\n") == ["Head line"] + [paragraph.strip()] * 5
    sections = f"<section class=one>{lines('p', paragraph, 9)}</section><section class=two>{lines('p', paragraph + 'End.', 2)}</section><section class=three><h2>Last</h2><ol>{lines('li', 'short', 2)}</ol></section>"
    assert html_text.extract(f"<body>{links}{sections}</body>").split("\n") == [paragraph.strip()] * 9 + [paragraph + "End."] * 2 + ["Last", "short", "short"]
    both = f"<main><h1>Head line</h1><article class=a>{lines('p', item, 9)}</article><article class=b>{lines('p', paragraph, 2)}</article></main>"
    assert html_text.extract(f"<body><p>{paragraph}</p>{both}</body>").split("\n") == ["Head line"] + [item.strip()] * 9 + [paragraph.strip()] * 2


def test_broken_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p>") == html_text.extract("<script>x") == ""
    assert html_text.extract("plain text &lt;only") == "plain text <only"
    assert html_text.extract("<p>a < b and <p>c") != ""
    for cut in range(0, len(PAGE), 7):
        html_text.extract(PAGE[:cut])
    assert len(html_text.extract("<div>" * 3000 + "<p>" + "deep, " * 2000)) > 5000


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    rows = html_text.extract_pages(pages).collect()
    assert [r["n_chars"] for r in rows] == [len(html_text.extract(PAGE))] * 2 + [0]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def made_up(rng, lang, n):
    parts = {"x": ["ba", "ko", "mi", "ta"], "y": ["ström", "ung", "sch", "eit"], "z": ["que", "ción", "los", "ar"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_language_id_held_out(spark):
    rng = random.Random(2)
    rows = [(i, made_up(rng, lang, rng.randint(1, 60)), lang if rng.random() < 0.9 else "x", f"www.{lang}site.{lang}") for i, lang in enumerate(rng.choices("xyz", k=600))]
    truth = {i: host[4] for i, _, _, host in rows}
    rows += [(1000, None, "x", None), (1001, "", None, "www.xsite.x"), (1002, "123 $$$ ...", "y", "a.b"), (None, made_up(rng, "y", 40), None, None), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, host string, posterior string")
    model = langid.fit(docs.where("doc_id < 300"), per_language=80)
    suffix = F.regexp_extract("host", r"\.(\w+)$", 1)
    got = langid.identify(docs, model, ["doc_id", "posterior"], F.col("text"), F.col("lang"), F.col("host"), suffix, prefix="p_").collect()
    assert len(got) == len(rows)
    right = [r["p_lang"] == truth[r["doc_id"]] for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 600]
    assert sum(right) >= 0.98 * len(right)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["p_lang"] == "y" and not any(by[i]["p_accepted"] for i in (1000, 1001, 1002))
    assert not langid.identify(docs, None, ["doc_id"], F.col("text")).where("accepted").count()
    assert langid.identify(docs.limit(0), model, ["doc_id"], F.col("text"), F.col("lang")).count() == 0
    assert langid.fit(docs.limit(0)) is None


def test_language_id_of_more_than_64_labels(spark):
    rng = random.Random(3)
    names = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefg"]
    rows = [(name, f"{name}x{name}y " * rng.randint(3, 9)) for name in names for _ in range(3)]
    assert langid.fit(spark.createDataFrame(rows, "lang string, text string")).languages == names


def test_language_id_of_character_references(spark, tmp_path):
    from lodestar.llm import queries

    rng = random.Random(4)
    docs = [(i, made_up(rng, lang, 40), lang * 2) for i, lang in enumerate("xyz" * 40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    refer = lambda text: "".join(f"&#{ord(c)};" for c in text)
    pages = [(i, f"http://h{i}/", f"<html><p>{refer(text)}</p></html>") for i, text, _ in docs[:9]]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text_lang"] for r in queries.op1_language_id(spark, str(tmp_path)).collect()}
    assert got == {i: lang for i, _, lang in docs[:9]}


def test_language_id_fusion_against_plain_loops(spark):
    """Every posterior, recomputed row by row from the text scores."""
    from math import exp, log

    rng = random.Random(11)
    rows = []
    for i in range(240):
        lang = rng.choice("xyz")
        host = rng.choice([f"a.{lang}s.com", f"b.{lang}s.com", "shared.org", "", None, "localhost"])
        rows.append((i, made_up(rng, lang, rng.randint(0, 4)), rng.choice([lang * 2, "xx", "zz-Z", None, ""]), host))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, host string").repartition(3)
    train = spark.createDataFrame([(made_up(rng, lang, 30), lang) for lang in "xyz" * 30], "text string, lang string")
    model = langid.fit(train)
    suffix = F.regexp_extract("host", r"\.(\w+)$", 1)
    got = {r["doc_id"]: r for r in langid.identify(docs, model, ["doc_id"], F.col("text"), F.col("declared"), F.col("host"), suffix).collect()}

    score, n = model.score([t for _, t, _, _ in rows])
    mean = score.max(1) / np.maximum(n, 1)
    odd = (n == 0) | (n >= langid.LEAST_TRIGRAMS) & (mean < model.usual + langid.WAY * (langid.RANDOM - model.usual))
    ll = score * langid.TEMPER

    def share(v):
        e = [exp(a - max(v)) for a in v]
        return [a / sum(e) for a in e]

    own = [share(v) if not o else [0.0] * 3 for v, o in zip(ll, odd)]

    def evidence(declared, host):
        host = (host or "").lower()
        domain = ".".join(host.split(".")[-2:]) if "." in host else host
        code = (declared or "").lower().split("-")[0]
        return {"declared": code, "suffix": host.rpartition(".")[2] if "." in host else "", "domain": domain, "host": host}

    keys = [evidence(d, h) for _, _, d, h in rows]
    counts: dict = {}
    for key, p in zip(keys, own):
        for level, value in key.items():
            if value:
                held = counts.setdefault((level, value), [0.0] * 3)
                for j in range(3):
                    held[j] += p[j]
    total = [sum(p[j] for p in own) for j in range(3)]

    def toward(a, q):
        return [(x + langid.PRIOR_ROWS * y) / (sum(a) + langid.PRIOR_ROWS) for x, y in zip(a, q)]

    for (i, _, _, _), key, p, v in zip(rows, keys, own, ll):
        prior = toward(total, [1 / 3] * 3)
        for level in ("suffix", "domain", "host"):
            if key[level]:
                prior = toward([max(a - b, 0.0) for a, b in zip(counts[level, key[level]], p)], prior)
        fused = [a + log(max(q, 1e-6)) for a, q in zip(v, prior)]
        if key["declared"]:
            told = [max(a - b, 0.0) for a, b in zip(counts["declared", key["declared"]], p)]
            fused = [f + log((a + langid.UNSEEN) / (b + langid.UNSEEN * 10)) for f, a, b in zip(fused, told, total)]
        posterior = share(fused)
        assert abs(got[i]["posterior"] - max(posterior)) < 1e-6, i
        if got[i]["accepted"]:
            assert got[i]["lang"] == "xyz"[posterior.index(max(posterior))]
    assert {r["lang"] for r in got.values()} >= {"x", "y", "z"}


def test_language_id_very_long_text(spark):
    rng = random.Random(5)
    rows = [(i, made_up(rng, lang, 30), lang) for i, lang in enumerate("xyz" * 20)] + [(100, made_up(rng, "y", 300_000), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(docs, langid.fit(docs), ["doc_id"], F.col("text")).where("doc_id = 100").first()
    assert got["lang"] == "y" and got["n_trigrams"] > langid.SLICE_CHARS


PROSE = "A sentence of the text, with words that go on; and then some more of them follow. "


def test_attributes_are_read_by_name():
    long = PROSE * 3
    assert html_text.attributes('style="overflow:hidden" title=\'a id="x"\' DATA-ID=ad hidden class=b') == {"style": "overflow:hidden", "title": 'a id="x"', "data-id": "ad", "hidden": "", "class": "b"}
    for page in (
        f'<article style="overflow:hidden"><p>{long}</p></article>', f'<div style="overflow:hidden"><article><p>{long}</p></article></div>',
        f'<article><p aria-hidden="false">{long}</p></article>', f'<article><p title="a hidden gem">{long}</p></article>', f'<article><p data-id="ad">{long}</p></article>',
        f'<article><section class="related-work"><p>{long}</p></section></article>',
    ):
        assert html_text.extract(page) == long.strip(), page
    for out in ("<div hidden>", '<div hidden="">', '<div role="navigation">', '<div class="x ad-box">', '<div id="cookie-notice-2">', '<ul class="comments-list">'):
        page = f"<article><p>{long}</p>{out}<p>{PROSE}</p></div></ul></article>"
        assert html_text.extract(page) == long.strip(), out
    assert html_text.furniture_name("sidebar") and html_text.furniture_name("site-footer") and not html_text.furniture_name("download address related-work")


def test_ratios_choose_among_paths_without_names():
    """No article, no telling names: only the ratios tell text from links and labels."""
    links = "".join(f"<li><a href=x>Link number {i}</a></li>" for i in range(30))
    labels = "".join(f"<span>tag{i}</span> " for i in range(5))
    text = "".join(f"<p>{PROSE * (1 + i % 3)}</p>" for i in range(6))
    page = f"<body><div class=k1><ul>{links}</ul></div><div class=k2><div class=k3><h2>Title line</h2>{text}</div></div><div class=k4>{labels}</div><div class=k5><a>About</a> <a>Terms</a></div></body>"
    got = html_text.extract(page).split("\n")
    assert got == ["Title line"] + [(PROSE * (1 + i % 3)).strip() for i in range(6)]
    # the same scores by plain loops
    nodes = html_text.text_nodes(page)
    blocks: list = []
    for block, path, body, linked in nodes:
        if body.strip():
            if not blocks or blocks[-1][0] != (block, path):
                blocks.append(((block, path), 0, 0, 0))
            key, chars, marks, link = blocks[-1]
            body = body.strip()
            blocks[-1] = (key, chars + len(body), marks + sum(c in ".,;:!?" for c in body), link + len(body) * linked)
    paths = {key[1] for key, *_ in blocks}
    mean = {p: [sum(b[i] for b in blocks if b[0][1] == p) / sum(b[0][1] == p for b in blocks) for i in (1, 2)] for p in paths}
    for p, (score, _) in html_text.path_scores(nodes).items():
        own = [b for b in blocks if b[0][1] == p]
        smooth = []
        for i in (0, 1):
            near = 0.0
            for k, b in enumerate(blocks):
                for other in (k - 1, k + 1):
                    if b[0][1] == p and 0 <= other < len(blocks):
                        q = blocks[other][0][1]
                        like = next((j for j, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))) / max(len(p), len(q), 1)
                        near += like * mean[q][i]
            smooth.append(html_text.OWN * mean[p][i] + html_text.NEXT * near / len(own))
        links_share = sum(b[3] for b in own) / sum(b[1] for b in own)
        assert abs(score - (smooth[0] * (1 + smooth[1])) ** 0.5 * (1 - (1 - html_text.LINKED) * links_share)) < 1e-9


def test_short_blocks_beside_very_long_ones_stay():
    giant = PROSE * 400
    body = f"<div>{giant}</div><p>Short one.</p><ul><li>x</li><li>y</li></ul><p>{PROSE}</p>"
    want = [giant.strip(), "Short one.", "x", "y", PROSE.strip()]
    assert html_text.extract(f"<body><div class=k><p>{PROSE}</p>{body}</div></body>").split("\n") == [PROSE.strip(), *want]
    assert html_text.extract(f"<article>{body}<ul><li><a href=r>A source</a></li></ul></article>").split("\n") == [*want, "A source"]


def test_a_very_long_page_with_an_odd_quote():
    page = "<div><p title=\"open>First words, then more of them.</p>" + f"<p>{PROSE}</p>" * 20_000 + "</div>"
    began = time.process_time()
    assert html_text.extract(page).count("\n") >= 19_998
    assert time.process_time() - began < 20
