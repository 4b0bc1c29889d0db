"""Operators that judge each row by itself: language model, languages, quality, pages, tokens, urls."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.llm import html, langid, lm, quality, queries, tokens, urls

WORD = r"[^\x20\x09-\x0D]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5


# Tokens


def test_tokens_match_the_library(spark, frame, odd, prose):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    texts = [*[t[1] if isinstance(t, tuple) else t for t in odd], "Don't we'll I'VE 12345 a  b   c\n\n\nd \t e", "x<|endoftext|>y <|endoftext|>", prose(3, 300), "ééé ßß ñandú " * 5, "=" * 300, " lead and trail "]
    got = tokens.count_tokens(frame(list(enumerate(texts))), path).orderBy("doc_id").collect()
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 512 for n in want]


def test_tokens_beside_other_columns_and_repeated_rows(frame):
    rows = frame([(1, "some words here")] * 3).withColumn("n_tokens", F.lit("clash")).withColumn("n_bytes", F.lit(0))
    got = tokens.count_tokens(rows, queries.vocabulary())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and {(r.n_bytes, r.n_tokens) for r in got.collect()} == {(15, 3)} and got.count() == 3


def test_texts_beyond_a_step_are_whole(spark, frame, prose):
    """A text longer than what one vectorised step takes, between short ones."""
    from tokenizers import Tokenizer

    from scoreweave.llm.shared import STEP_BYTES

    rng = random.Random(4)
    lines = [prose(i, 200) for i in range(40)]
    long = "\n".join(rng.choice(lines) for _ in range(1 + int(1.3 * STEP_BYTES / 1000)))
    assert len(long) > STEP_BYTES
    rows = frame([prose(90, 50), long, prose(91, 50)])
    got = {r.doc_id: r for r in quality.judge(rows).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == brute_quality(long)
    counted = {r.doc_id: r.n_tokens for r in tokens.count_tokens(rows, queries.vocabulary()).collect()}
    assert counted[1] == len(Tokenizer.from_file(queries.vocabulary()).encode(long, add_special_tokens=False).ids)
    assert {r.doc_id: r.lang_pred for r in langid.identify(rows.withColumn("lang", F.lit("aa"))).collect()}[1] == "aa"
    scored = {r.doc_id: r.n_tokens for r in lm.score(rows, queries.vocabulary("byte_bpe_50k.tiktoken")).collect()}
    assert scored[1] == len(re.findall(WORD, long)) + 1


def test_merging_takes_the_lowest_rank_first():
    counter = tokens.Counter({"merges": [("b", "c"), ("a", "b"), ("a", "bc")], "special": [], "name": "t"})
    assert [counter.merged(x) for x in (b"", b"a", b"ab", b"abc", b"abab", b"bcbc")] == [0, 1, 1, 1, 2, 2]


def test_tokens_of_nothing(frame):
    assert tokens.count_tokens(frame([]), queries.vocabulary()).count() == 0


# Urls


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = lower(host)
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((h.count(".") + 1, len(rule), rule, verdict))
    if not fits:
        return host, path, None, "allow"
    return host, path, max(fits)[2], max(fits)[3]


def test_urls_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "net", "x.net", "example.net", "notexample.com", "EXAMPLE.com", "org", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/77/x", "/de/8", "/de/81?q=/en/", "/es/#/de/", "?a=b", "#top"]
    seen = [None, "", "nothing", "http://", "mailto:x", "http://a://b/en/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    more = [("block", f"{h}{p}") for h in hosts[:5] for p in ("/", "/en/", "/de")]
    for rules in (queries.URL_RULES, [*queries.URL_RULES, *more]):
        for block in (100, 2):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules, block=block).collect()}
            assert got == {i: brute_rule(u, rules) for i, u in enumerate(seen)}


def test_tables_of_rules_match_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "example.com", "a.example.com", "net", "x.net", "notexample.com", "EXAMPLE.com", "org", "", "b..com", "ü.org"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/77/x", "/de/81?q=/en/", "#top", "/é/日本", "/EN/"]
    seen = [None, "", "http://", "mailto:x"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + ["http://example.com/en/"] * 50
    rules = {(f"{h.lower()}{p}", rng.choice(["block", "allow"])) for h in hosts if h for p in ("", "/", "/en/", "/en/7", "/é/") if rng.random() < 0.6}
    rules = sorted((v, r) for r, v in dict(rules).items())
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(seen)], "page_id long, url string, rule string")
    table = spark.createDataFrame([*rules, rules[0], (None, "com/"), ("block", None)], "verdict string, rule string")
    for ranges in (1, 7):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.join_rules(pages, table, ranges=ranges).collect()}
        assert got == {i: brute_rule(u, rules) for i, u in enumerate(seen)}
    assert urls.join_rules(pages, table.where("false")).where("rule is not null").count() == 0
    assert urls.join_rules(pages.where("false"), table).count() == 0


def test_urls_replace_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "old", 5)], "page_id long, url string, HOST string, other int")
    out = urls.filter_urls(pages, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict"]
    assert out.first().verdict == "block"
    assert urls.filter_urls(pages.where("false"), queries.URL_RULES).count() == 0


# Pages

ARTICLE = "<h1>Title &amp; more</h1><p><b>First para with words enough to be content.<br><p>Short.</p><p>Last&nbsp;one   here, and <a href='x'>a link</a> in it.</p>"
WANT = "Title & more\n\nFirst para with words enough to be content.\n\nShort.\n\nLast one here, and a link in it."
AROUND = "<nav><ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul></nav>{}<aside>Side words</aside><div class='cookie-notice'>We use cookies</div><form>Search <input></form><div id=comments><p>Nice article, I read it with joy and more joy every day.</p></div><footer>&copy; foot</footer>"
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id=story><div>{}</div></div>"])
def test_article_of_a_page(box):
    assert html.main_text(HEAD + AROUND.format(box.format(ARTICLE)) + "</body></html>") == WANT


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap with-sidebar'>", "<div class='layout with-sidebar'>", "<div class='social'><section id='search'>"])
@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
def test_named_wrappers_of_an_article_stay(wrap, box):
    aside = "<div class='sidebar'><p>Other things to read</p></div>"
    named = wrap.replace("content-sidebar-wrap with-sidebar", "wrap with sidebar")
    for w in (wrap, named):
        assert html.main_text(f"{HEAD}{w}{box.format(ARTICLE)}{aside}</div></body></html>") == WANT
    # The same names drop what isn't the article.
    more = "<div class='related'><article><p>A teaser of another article.</p></article></div>"
    assert html.main_text(f"{HEAD}<article>{ARTICLE}</article>{more}</body></html>") == WANT


def test_odd_pages(spark):
    seen = [None, "", "   ", "plain words only", "<p>unclosed <i>tags", "</div></p>stray<p>end</p>", "<!-- only --> ", "<script>x()</script>", "<p>a&#233;&lt;b&gt;</p>"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(seen)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert [got[i].text for i in range(len(seen))] == ["", "", "", "plain words only", "unclosed tags", "stray\n\nend", "", "", "aé<b>"]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(pages.where("false")).count() == 0


def test_menus_inside_the_article_go():
    links = "<ul><li><a href='/a'>First other story</a></li><li><a href='/b'>Second other story</a></li><li><a href='/c'>Third</a></li></ul>"
    bar = "<p><a href='/1'>One</a> | <a href='/2'>Two</a> | <a href='/3'>Three</a></p>"
    assert html.main_text(f"{HEAD}<article>{links}{ARTICLE}{bar}</article></body></html>") == WANT
    # A single link, and links in a sentence, are text.
    one = "<p><a href='/s'>The source of all this</a></p><p>See <a href='/a'>a</a>, <a href='/b'>b</a> and <a href='/c'>c</a> for the whole story.</p>"
    assert html.main_text(f"{HEAD}<article>{ARTICLE}{one}</article></body></html>") == WANT + "\n\nThe source of all this\n\nSee a, b and c for the whole story."
    assert html.main_text(links) == "First other story\n\nSecond other story\n\nThird"


@pytest.mark.parametrize("wrap", ["class='content has-sidebar'", "class='layout no-sidebar'", "class='page with-nav'", "class='legal-analysis'", "class='social-studies'", "id='search'"])
def test_wrappers_named_after_something_else(wrap):
    assert html.main_text(f"{HEAD}<div {wrap}>{ARTICLE}</div></body></html>") == WANT


def test_deep_and_unclosed_tags_take_time_by_length():
    import time

    n = 100_000
    pages = ["<div>text" * n, "<span>text" * n, "<h1>text" * n, "<b><div>" + "<i>" * n + "</b>x" * n, "<p>text" * n, "<div class='ad x'><p>t" * n, "</p>t" * n, "<li>a<ul>" * n, "<a href=x>" * n + "t", "<article>t" * n]
    for page in pages:
        began = time.process_time()
        text = html.main_text(page)
        assert time.process_time() - began < 30, page[:30]
        assert isinstance(text, str)
    assert html.main_text(pages[0]) == "\n\n".join(["text"] * n)


def plain_text(node, keep):
    """Blocks of a tree (name, attributes, children) in order, by plain recursion: text of elements that keep lets stand."""
    blocks, line = [], []

    def close():
        text = re.sub(r"\s+", " ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    def walk(x):
        if isinstance(x, str):
            line.append(x)
            return
        name, told, inner = x
        if not keep(name, told):
            return close()
        block = name not in html.INLINE
        if block:
            close()
        for y in inner:
            walk(y)
        if block:
            close()

    walk(node)
    close()
    return "\n\n".join(blocks)


def test_pages_match_a_plain_walk_of_their_tree(prose):
    rng = random.Random(6)

    def written(x):
        if isinstance(x, str):
            return x.replace("&", "&amp;").replace("<", "&lt;")
        return f"<{x[0]}{x[1]}>" + "".join(map(written, x[2])) + f"</{x[0]}>"

    def words(n):
        return " ".join(prose(rng.randrange(10**6), n).split())

    def sentence(n):
        out = [words(n)]
        for _ in range(rng.randint(0, 3)):
            out += [" ", (rng.choice(["b", "i", "a", "span", "code"]), "", [words(rng.randint(1, 3)), " & < "]), "\n ", words(rng.randint(2, 9))]
        return out

    def blocks():
        out = [("h1", "", [words(5)])]
        for _ in range(rng.randint(3, 12)):
            kind = rng.random()
            if kind < 0.6:
                out.append(("p", "", sentence(rng.randint(2, 80))))
            elif kind < 0.75:
                out.append(("ul", "", [("li", "", sentence(rng.randint(2, 12))) for _ in range(rng.randint(1, 5))]))
            elif kind < 0.85:
                out.append(("blockquote", "", [("p", "", sentence(20))]))
            else:
                out.append(("section", "", [("h2", "", [words(3)]), ("p", "", sentence(30))]))
        return [*out, ("p", "", sentence(60))]

    def menu():
        return ("ul", "", [("li", "", [("a", " href='/x'", [words(1)])]) for _ in range(6)])

    for _ in range(40):
        box = rng.choice([("article", ""), ("main", ""), ("div", " class='content'"), ("div", " id='with-sidebar'")])
        body = ("body", "", [
            ("nav", "", [menu()]), ("header", "", [("p", "", [words(4)])]), ("div", " class='cookie-notice'", [("p", "", [words(12)])]),
            (*box, blocks()),
            ("aside", "", [("p", "", [words(9)])]), ("div", " id='comments'", [("p", "", [words(15)]) for _ in range(2)]), ("div", " class='ad'", [words(6)]),
            ("form", "", [words(3), ("input", "", [])]), ("footer", "", [words(8)]),
        ])
        want = plain_text(box and ("div", "", next(x for x in body[2] if x[:2] == box)[2]), lambda name, told: True)
        got = html.main_text("<!DOCTYPE html><html><head><title>t</title><script>x</script></head>" + written(body).replace("</input>", "") + "</html>")
        assert got == want


def test_repeated_pages_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x", 7)] * 3, "page_id long, url string, html string, text string, n_chars int")
    out = html.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and [r.text for r in out.collect()] == [WANT] * 3


def test_long_pages_are_whole(prose):
    body = "".join(f"<p>{prose(i, 60)}</p>" for i in range(300))
    text = html.main_text(f"{HEAD}<nav>menu</nav><article>{body}</article></body>")
    assert text.count("\n\n") == 299


# Quality


def brute_quality(text):
    words = re.findall(WORD, text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_matches_brute_force(frame, odd, prose):
    texts = [*odd, prose(4, 50) + "\n" + prose(4, 50), "a b c d e f g h " * 9, "# * $ % & | < >\n" * 3]
    rows = frame(texts)
    got = quality.judge(rows.withColumn("kept", F.lit("clash")).withColumn("figures", F.lit(1))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept in (False, True) and not (r.base_failed and r.kept)
    assert quality.judge(frame([])).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores, stay = rng.normal(size=6), float(rng.normal())
        best = max(range(64), key=lambda m: sum(s * (m >> i & 1) for i, s in enumerate(scores)) + stay * sum((m >> i & 1) == (m >> i + 1 & 1) for i in range(5)))
        assert quality.viterbi(scores, stay).tolist() == [best >> i & 1 for i in range(6)]


def test_field_slopes_are_those_of_its_likelihood(monkeypatch):
    monkeypatch.setattr(quality, "CHAIN", 4)
    rng = np.random.default_rng(3)
    chains = quality.Chains([(rng.normal(size=(n, len(quality.FEATURES))), int(n % 2)) for n in (1, 2, 5, 9, 4)])
    assert chains.real.sum() == 21 and (chains.each[:, None] * chains.real).sum() == pytest.approx(1)
    weights = rng.normal(size=len(quality.FEATURES) + 1)
    told, slopes = chains.likelihood(weights)
    for i in range(len(weights)):
        moved = weights.copy()
        moved[i] += 1e-6
        assert (chains.likelihood(moved)[0] - told) / 1e-6 == pytest.approx(slopes[i], rel=1e-3, abs=1e-6)

    # The likelihood by all labellings.
    total = 0.0
    for x, real, state, each in zip(chains.held, chains.real, chains.state, chains.each, strict=True):
        emit = x[real] @ weights[:-1]
        n = len(emit)
        path = lambda m: sum(e * (m >> i & 1) for i, e in enumerate(emit)) + weights[-1] * sum((m >> i & 1) == (m >> i + 1 & 1) for i in range(n - 1))  # noqa: E731, B023
        total += each * (path((1 << n) - 1 if state else 0) - math.log(sum(math.exp(path(m)) for m in range(1 << n))))
    assert told == pytest.approx(total)


def test_long_lines_and_texts_are_read_whole(spark, frame, prose):
    long = " ".join(["word"] * 200) + " all rights reserved"
    assert quality.line_features(long)[0][0, quality.FEATURES.index("legal")] == 1.0
    texts = ["\n".join(prose(i, 12) for i in range(700)), "### *** |||\n" * 700]
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0)], "doc_id long, quality int")
    assert quality.fit_from(frame(texts), labels) == quality.fit([(quality.line_features(t)[0], y) for t, y in zip(texts, (1, 0), strict=True)])
    twice = frame([(0, texts[0]), (0, texts[0]), (0, texts[0] + "z"), (1, texts[1])])
    assert quality.fit_from(twice, labels) == quality.fit_from(frame(texts), labels)


def test_quality_learns_from_labels(spark, frame, prose):
    rng = random.Random(1)
    junk = lambda i: "\n".join(" ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in line.split()) for line in prose(i, 90).split("\n"))
    texts = [prose(i, 90) if i % 2 else junk(i) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit_from(frame(texts), labels)
    assert model == quality.fit_from(frame(texts), labels)
    got = {r.doc_id: r.kept for r in quality.judge(frame(texts), model).collect()}
    assert all(got[i] == bool(i % 2) for i in range(60, 120))
    assert quality.fit_from(frame(texts), labels.where("false")) == quality.PRIOR


# Languages


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    parts = {"aa": ["lo", "mi", "ra", "te"], "bb": ["zu", "kö", "vi", "pe"], "cc": ["ña", "que", "cí", "dor"]}
    rows = []
    for i in range(150):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang))
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 !? ...", "cc"), (203, "LOMIRA temi", None), (203, "LOMIRA temi", None), (None, "kövi zupe", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:150])
    assert [by[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id) == 0) for r in got)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def brute_languages(rows, rare=langid.RARE, relative=langid.RELATIVE):
    """(language, share of n-grams it contains) of each text, by plain sets."""
    import regex

    def of(text):
        for w in re.findall(WORD, text or ""):
            letters = regex.sub(r"\PL+", "", w).lower()
            for size in langid.SIZES if letters else ():
                edged = f"^{letters}$"
                yield from (edged[i : i + size] for i in range(len(edged) - size + 1))

    counts = collections.defaultdict(collections.Counter)
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and crc(doc_id):
            counts[lang].update(of(text))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items() if c}
    most = collections.defaultdict(float)
    for c in share.values():
        for g, v in c.items():
            most[g] = max(most[g], v)
    held = {x: {g for g, v in share[x].items() if v >= rare and v >= relative * most[g]} for x in sorted(share)}
    out = []
    for _, text, _ in rows:
        found = list(of(text))
        told = {x: sum(g in h for g in found) / len(found) for x, h in held.items()} if found else {}
        best = max(sorted(told), key=told.__getitem__) if told else "und"
        out.append((best, told.get(best, 0.0), told))
    return out


def test_languages_match_brute_force(spark, odd):
    rng = random.Random(5)
    parts = {"aa": ["lo", "mi", "ra", "te", "on"], "bb": ["lo", "kö", "vi", "te", "é"], "cc": ["ña", "mi", "cí", "te", "日本"], "dd": ["lo", "mi", "te", "x"]}
    rows = [(500 + i, t[1] if isinstance(t, tuple) else t, None) for i, t in enumerate(odd)]
    for i in range(240):
        lang = sorted(parts)[i % 4]
        mixed = parts[lang] if rng.random() < 0.7 else parts[rng.choice(sorted(parts))]
        rows.append((i, " ".join("".join(rng.choice(mixed) for _ in range(rng.randint(1, 4))) + rng.choice(["", ",", "'s", "7"]) for _ in range(rng.randint(1, 40))), lang))
    rows += [rows[-1], rows[-1]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect()
    for r, (doc_id, _, _), (best, share, told) in zip(got, rows, brute_languages(rows), strict=True):
        assert r.doc_id == doc_id and abs(r.score - share) < 0.02
        assert r.lang_pred == best or told[best] - told[r.lang_pred] < 0.01  # false positives may turn near ties


def test_bloom_filters_have_no_false_negatives():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(70)]
    filters = langid.Filters([f"l{i}" for i in range(70)], keys, 1 << 16)
    for i in (0, 63, 64, 69):
        assert (filters.masks(keys[i])[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()


# Language model


def test_base_matches_brute_force_and_the_model_helps(frame, odd, prose):
    texts = [*odd, *((100 + i, prose(i, 150)) for i in range(150))]
    rows = frame(texts)
    got = lm.score(rows, queries.vocabulary("byte_bpe_50k.tiktoken")).collect()
    held = [(r.doc_id, r.text) for r in rows.collect()]
    count, tokens_of = collections.Counter(), {}
    for d, t in held:
        words = re.findall(WORD, lower(t))
        if crc(d) != 1:
            count.update([*words, None])
    total, kinds = sum(count.values()), len(count)
    want = sorted(
        (d is None, d or 0, crc(d) == 1, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), total, round(sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in [*w, None]), 6))
        for d, t in held
        for w in [re.findall(WORD, lower(t))]
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    n = 4001
    counts = rng.integers(0, 50, n)
    layout = lm.Layout(counts, rng.random(n) < 0.5)
    flat = lm.initial(layout) * 3
    scorer = lm.Scorer(flat, layout)
    before = rng.integers(0, n - 1, 40)
    total = 0.0
    texts = np.concatenate([np.append(before, s) for s in range(n)])
    offsets = np.arange(n + 1) * 41
    total = (10.0 ** scorer.score(texts, offsets)[40::41].astype(float)).sum()
    assert total == pytest.approx(1, rel=1e-3)


def test_scores_don_t_look_ahead():
    rng = np.random.default_rng(0)
    layout = lm.Layout(rng.integers(0, 50, 4001), rng.random(4001) < 0.5)
    scorer = lm.Scorer(lm.initial(layout) * 3, layout)
    text = rng.integers(0, 4000, 100)
    other = text.copy()
    other[60:] = rng.integers(0, 4000, 40)
    a, b = (scorer.score(t, np.array([0, 100])) for t in (text, other))
    assert np.allclose(a[:60], b[:60]) and not np.allclose(a[61:], b[61:])


def test_attention_gradients():
    rng = np.random.default_rng(0)
    layout = lm.Layout(rng.integers(0, 50, 4001), rng.random(4001) < 0.5)
    flat = (lm.initial(layout) * 2).astype(np.float64)
    x, y = rng.integers(0, lm.OWN, (3, lm.WINDOW)), rng.integers(0, lm.ALONE, (3, lm.WINDOW))
    real = rng.random((3, lm.WINDOW)) < 0.8
    p = {k: v.astype(np.float64) for k, v in lm.unpacked(flat).items()}
    loss, slopes = lm.loss_and_slopes(p, x, y, real)
    for name in p:
        big = np.argsort(-np.abs(slopes[name]).ravel())[:4]
        for k in big:
            moved = {n: v.copy() for n, v in p.items()}
            moved[name].ravel()[k] += 1e-5
            assert (lm.loss_and_slopes(moved, x, y, real)[0] - loss) / 1e-5 == pytest.approx(slopes[name].ravel()[k], rel=2e-2, abs=1e-5)


def test_the_model_tells_192_classes():
    layout = lm.Layout(np.arange(4001), np.arange(4001) % 2 == 0)
    assert (lm.ALONE, lm.MANY) == (128, 64) and lm.unpacked(lm.initial(layout))["w"].shape == (lm.WIDTH, 192)
    assert (np.bincount(layout.group)[:128] == 1).all()


def test_training_windows_hold_every_symbol(frame, prose):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    coder = lm.speller(path)
    texts = [prose(1, 900), prose(2, 20), "", None]
    table = lm.symbol_table(lm.numbered(frame(texts)).withColumn("held_out", F.lit(False)), path)
    rows = [np.frombuffer(r.w, np.int32) for r in lm._windows(table, 3, 0, slices=1).collect()]
    want = []
    for t in texts:
        words = lower(t or "").encode().split()
        want += [*(coder.spell(words)[1].tolist()), coder.end]
    assert [x for r in rows for x in r[1:].tolist() if x != -1] == want
    assert sum(r[0] == -2 for r in rows) == len(texts)
    # The rounds' slices share the windows out.
    parts = [bytes(r.w) for i in range(len(lm.RATES)) for r in lm._windows(table, 3, i).collect()]
    assert sorted(parts) == sorted(r.tobytes() for r in rows)


def test_symbols_tell_words(prose, odd):
    import pyarrow as pa

    from scoreweave.llm.shared import Words

    coder = lm.speller(queries.vocabulary("byte_bpe_50k.tiktoken"))
    texts = [t[1] if isinstance(t, tuple) else t for t in odd] + [prose(1, 500)]
    words = Words(pa.array(texts, pa.string()), lower=True)
    offsets, symbols, cuts, each = lm.spelled_out(words, coder)
    found = lm.Tokens(offsets, symbols, coder.end)
    assert found.counts.tolist() == (words.counts + 1).tolist() and found.is_end.sum() == len(texts)
    names = {}
    for h, w in zip(found.hashes[~found.is_end].tolist(), words.ids.tolist(), strict=True):
        assert names.setdefault(h, w) == w
    assert len(names) == len(words.vocab)
    assert lm.spelling_hashes(each, cuts[:-1], np.diff(cuts), coder.end).tolist() == [h for h, _ in sorted(names.items(), key=lambda x: x[1])]


def test_known_words_are_found():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    hashes[:50] = np.arange(50, dtype=np.uint64)  # one bucket
    known = lm.Known(hashes[:3000], np.arange(3000))
    assert known.get(hashes).tolist() == [*range(3000), *[-1] * 2000]
    assert lm.Known(hashes[:0], np.arange(0)).get(hashes[:3]).tolist() == [-1] * 3 and known.get(hashes[:0]).tolist() == []


@pytest.mark.parametrize("near", [1, 4, 12])
def test_frequent_words_are_found_near(near, monkeypatch):
    monkeypatch.setattr(lm, "NEAR", near)
    hashes = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    counts = np.arange(len(hashes)) * 7919 % 4001 + 1
    known = lm.Known(hashes, counts)
    assert known.get(hashes).tolist() == counts.tolist() and (known.get(hashes ^ np.uint64(1 << 40)) == -1).all()
    empty = lm.Known(hashes[:0], counts[:0])  # what fills empty places is no word
    assert (empty.get(~np.arange(1 << near, dtype=np.uint64)) == -1).all() and (empty.get(np.arange(1 << near, dtype=np.uint64)) == -1).all()


def test_windows_are_packed_whole():
    rng = np.random.default_rng(2)
    layout = lm.Layout(rng.integers(0, 50, 4001), rng.random(4001) < 0.5)
    windows = rng.integers(0, 4001, (7, lm.WINDOW + 1)).astype(np.int32)
    windows[2, 0], windows[3, 9:], windows[4, 1:] = -2, -1, -1
    x, y, real = lm.unpacked_windows(lm.packed(windows, layout).tobytes())
    assert (real == (windows[:, 1:] >= 0)).all() and (y[real] == layout.group[windows[:, 1:][real]]).all()
    assert (x[2, 0], x[3, 10]) == (layout.start, layout.start) and (x[windows[:, :-1] >= 0] == layout.vector[windows[:, :-1][windows[:, :-1] >= 0]]).all()


def test_windows_of_a_group_come_together(frame, prose):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    table = lm.symbol_table(lm.numbered(frame([prose(i, 700) for i in range(8)])).withColumn("held_out", F.lit(False)), path).coalesce(1)
    layout = lm.Layout(np.arange(lm.speller(path).n_symbols) % 50, lm.speller(path).starts)
    want = sorted(lm.packed(np.frombuffer(r.w, np.int32)[None], layout).tobytes() for r in lm._windows(table, 3, 0, slices=1).collect())
    found = []
    for spans in (1, 4):
        rows = lm._windows(table, 3, 0, slices=1, layout=layout, spans=spans)
        assert rows.count() <= 3 * spans < len(want)
        groups = collections.defaultdict(bytes)
        for g, steps in lm._steps_of(rows.orderBy("g", "span").toArrow().to_batches()):
            groups[g] += steps.tobytes()
        found.append(groups)
    assert found[0] == found[1]  # spans leave the order of training as it is
    held = b"".join(found[0].values())
    assert sorted(held[i : i + lm.PACKED] for i in range(0, len(held), lm.PACKED)) == want


@pytest.mark.parametrize("known", [5, lm.KNOWN])
def test_counts_are_added_up(frame, prose, odd, known, monkeypatch):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    coder, texts = lm.speller(path), [(t[1] if isinstance(t, tuple) else t) or "" for t in odd] + [prose(i, 300) for i in range(20)]
    table = lm.symbol_table(lm.numbered(frame(texts)).repartition(4).withColumn("held_out", F.lit(False)), path)
    parts = table.where(f"kind <> {lm.TEXT}").orderBy("kind", "key").toArrow()
    assert len(parts) <= 4 * (lm.COUNT_PARTS + coder.n_symbols // lm.COUNT_SYMBOLS + 1)
    monkeypatch.setattr(lm, "KNOWN", known)
    got = {(k, h): c for b in lm.added_up(parts.to_batches()) for k, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    words = collections.Counter(w.encode() for t in texts for w in re.findall(WORD, lower(t)))
    symbols = collections.Counter({coder.end: len(texts)})
    for w, n in words.items():
        symbols.update({s: n * k for s, k in collections.Counter(coder.spell([w])[1].tolist()).items()})
    assert {h: c for (k, h), c in got.items() if k == lm.SYMBOL_COUNT} == dict(symbols)
    assert sorted(c for (k, _), c in got.items() if k == lm.WORD_COUNT) == sorted(words.values())


def test_odd_words_are_spelled_as_alone():
    coder = lm.speller(queries.vocabulary("byte_bpe_50k.tiktoken"))
    words = [w.encode() for w in ("one", "a\u00a0b", "\u00a0", "\u3000x", "y\u2003", "\u0085\u00a0", "two", "it's", "é")]
    offsets, symbols = coder.spell(words)
    assert [symbols[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [coder.spell([w])[1].tolist() for w in words]


def naive_log(p, layout, symbols, i):
    """Natural log of the probability of symbols[i], one query at a time: what stands before it back to the half window before its own."""
    start = max(0, (i // lm.HALF - 1) * lm.HALF)
    seen = [layout.start if j < 0 else layout.vector[symbols[j]] for j in range(start - 1, i)]
    if i // lm.HALF == 0:
        seen = seen[-(i + 1) :]
    elif i // lm.HALF == 1:
        seen = seen[-(i + 1) :]
    vectors = [p["e"][v].astype(float) for v in seen]
    q = vectors[-1] @ p["q"]
    weights = np.array([q @ (x @ p["k"]) / math.sqrt(lm.WIDTH) + p["far"][len(vectors) - 1 - j] for j, x in enumerate(vectors)])
    weights = np.exp(weights - weights.max())
    h = vectors[-1] + sum(w * (x @ p["v"]) for w, x in zip(weights / weights.sum(), vectors, strict=True))
    kinds = h @ p["kw"] + p["kb"]
    group = int(layout.group[symbols[i]])
    kind = group // lm.LEAVES
    leaves = (h @ p["w"] + p["b"])[kind * lm.LEAVES : (kind + 1) * lm.LEAVES]
    log = lambda z, j: z[j] - z.max() - math.log(np.exp(z - z.max()).sum())
    return log(kinds, kind) + log(leaves, group % lm.LEAVES) + float(layout.inside[symbols[i]])


def test_scores_match_a_pass_symbol_by_symbol(spark, frame, odd, prose):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    rows = frame([*odd, *((100 + i, prose(i, 120)) for i in range(40))]).withColumn("key", F.lit("clash")).withColumn("s", F.lit(1))
    table = lm.symbol_table(lm.numbered(rows), path)
    model = lm.Model(table, path)
    p, coder = lm.unpacked(model.flat), lm.speller(path)
    count = collections.Counter()
    held = rows.collect()
    for r in held:
        if crc(r.doc_id) != 1:
            count.update([*re.findall(WORD, lower(r.text)), None])
    want = []
    for r in held:
        words = re.findall(WORD, lower(r.text))
        spelled = [coder.spell([w.encode()])[1].tolist() for w in words] + [[coder.end]]
        symbols, at, total = [x for s in spelled for x in s], 0, 0.0
        for w, s in zip([*words, None], spelled, strict=True):
            told = sum(naive_log(p, model.layout, symbols, at + j) for j in range(len(s)))
            base = (count[w] + 0.5) / (sum(count.values()) + 0.5 * (len(count) + 1))
            total += math.log10(lm.SHARE * base + (1 - lm.SHARE) * math.exp(told))
            at += len(s)
        want.append((r.doc_id is None, r.doc_id or 0, len(words) + 1, total))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in lm.score(rows, path).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=2e-4)


def test_scores_don_t_depend_on_partitions(frame, prose):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    rows = frame([(i, prose(i, 100 + i)) for i in range(60)])
    key = lambda df: sorted((r.doc_id, r.score) for r in lm.score(df, path).collect())
    two, four = key(rows.repartition(2)), key(rows.repartition(4, "text"))
    assert [x for x, _ in two] == [x for x, _ in four]
    assert [x for _, x in two] == pytest.approx([x for _, x in four], rel=1e-9)


def test_nothing_to_train_on(frame):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    assert lm.score(frame([]), path).count() == 0
    alone = next(d for d in range(50) if crc(d) == 1)
    got = lm.score(frame([(alone, "just one")]), path).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0)
