"""Quality rules, page text and decontamination against plain Python."""

import re
from collections import Counter

from siftwell.llm import decontaminate, html_lines, quality

from .edge import LONG, PROSE, TEXTS, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rows = quality.judge(documents(spark, extra=True)).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows if r.doc_id is not None)
    want = sorted((i, *base_counts(t)) for i, t in [*enumerate(TEXTS), (4, TEXTS[4])])
    assert got == want and len(rows) == len(TEXTS) + 3
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_lines(spark):
    good = PROSE + "\nBehind the yard two dogs sleep in the sun, and a boy mends the gate.\nThey leave before noon, and nobody asks them where they go."
    cases = {
        "kept whole": (good, True, good),
        "footer line goes": (good + "\nAll rights reserved.", True, good),
        "menu line goes": ("Home\n" + good + "\na | b | c | d | e", True, good),
        "mostly symbols": ("\n".join("sel %%% tap *** ron ### dim. " * 3 + str(i) for i in range(9)) + "\n" + PROSE, False, PROSE),
        "no sentence": ("\n".join(f"tok{i} " * 2 + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(9)) + "\n" + PROSE, False, PROSE),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id string, text string")
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality.judge(df).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}


def test_quality_clean_keeps_columns(spark):
    df = documents(spark, extra=True)
    out = quality.clean(df)
    assert out.columns == df.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert set(kept) == {4, 5, 6, 8, 9, None}
    assert kept[8].text == LONG and kept[6].text == TEXTS[6] and kept[6].kept == "clash"
    assert quality.clean(empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>goes on &lt;here&gt; &#233;.<p>Short.</p><div class="ad">Buy</div><ul><li>One</li><li>Two</li></ul>
<form><input value=x>Search</form></article><aside>Side</aside><section id="comments"><article><p>I liked it very much indeed.</p></article></section>
<footer>&copy; me</footer>"""


def test_page_text():
    assert html_lines.extract(PAGE) == "A title & more\nFirst bold text goes on <here> é.\nShort.\nOne\nTwo"
    body = "<div class=content><h1>Head line</h1><p>%s</p><p>Short.</p></div>" % PROSE
    around = "<div id=top class=header>Site</div><ul class=menu><li><a href=1>Home</a></ul>%s<div class='comments'><p>%s</p></div>"
    assert html_lines.extract(around % (body, PROSE)) == f"Head line\n{PROSE}\nShort."
    for page, text in {
        None: "", "": "", "plain": "plain", "<p>a&am": "a&am", "<p>x": "x", "<p>cut </": "cut", "<article><p>y</article": "y",
        "<script>never ends": "", "<!-- open": "", "a < b > c": "a < b > c", "<p title='>'>q</p>": "q", "<p a='>x": "x",
    }.items():
        assert html_lines.extract(page) == text, page


def test_page_text_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>abc " * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in html_lines.main_text(df).collect()), key=str)
    first = len(html_lines.extract(PAGE))
    assert got == sorted([(1, "u", first, first)] * 2 + [(2, None, 0, 0), (0, "v", 0, 0), (3, "w", 399_999, 399_999)], key=str)
    assert html_lines.main_text(df.limit(0)).count() == 0


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, k=5, least=0.8):
    out = {}
    for d, text in docs:
        w = tokens(text)
        for i, item in items:
            b = tokens(item)
            width = min(k, len(b))
            if not b or len(w) < width:
                continue
            have = Counter(tuple(b[j : j + width]) for j in range(len(b) - width + 1))
            runs = [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
            n = sum(have.values())
            for s in range(max(1, len(runs) - n + 1)):
                win = Counter(runs[s : s + n])
                both = sum((win & have).values())
                value = both / (sum(win.values()) + n - both)
                if value >= least:
                    out[d, i] = max(out.get((d, i), (0, 0)), (value, -s))
    return {k: (v[0], -v[1]) for k, v in out.items()}


def test_decontamination(spark):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[:40])), (1, " ".join(w[20:60])), (2, "tick tock " * 8), (3, "only four words here"), (4, None), (5, ""), (None, " ".join(w[5:30]))]
    docs = [
        (0, " ".join(w)), (1, "x y z " + ", ".join(w[:40]).upper() + "! end"), (2, " ".join(w[:38])), (3, " ".join(w[:20] + ["q"] + w[21:40])),
        (4, " ".join(w[2:40]) + " z z z"), (5, "say tick tock " * 3 + "tick tock " * 9), (6, "there are Only four words here."), (7, None), (8, ""),
        (9, "w0 w1 w2 w3 w4"), (10, " ".join(w[:4])), (11, ("pad " * 30 + " ".join(w[:40]) + " ") * 3),
    ]
    df = spark.createDataFrame([(*d, "c") for d in docs + [docs[1], (None, docs[1][1])]], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find(df, bench).collect()}
    want = brute(docs + [(None, docs[1][1])], items)
    assert got == want and len(want) > 8
    in_blocks = decontaminate.find(df, bench, how=decontaminate.Match(shingles_sent=60)).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in in_blocks} == want
    left = decontaminate.drop_copies(df, bench)
    bad = {d for d, _ in want}
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontaminate.find(empty(spark), bench).count() == 0
    assert decontaminate.drop_copies(documents(spark, extra=True), bench.limit(0)).count() == len(TEXTS) + 3
