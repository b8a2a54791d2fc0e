"""Pages, languages, quality, line rules and secrets."""

import os
import random

import numpy as np

from tabulith.llm import html_text, language, line_rules, quality, queries, secret_scan, trigrams
from tests.llm.conftest import EDGE, prose
from tests.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    res = duck(SF).execute(queries.ORACLES[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


def test_secret_scan_equals_its_sql(spark):
    against_sql(spark, "op6_secret_scan")


def test_line_rules_equal_their_sql(spark):
    against_sql(spark, "op9_line_rules")


def test_best_run_equals_all_runs():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        a, b, score = html_text.best_run(s)
        assert score == best and sum(s[a:b + 1]) == best


PAGE = ('<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>'
        '<div class="ad">Buy now for less today</div><article><h1>A &amp; B</h1><p>First  part with <b>bo</b>ld words,\n and more<br><p>Second &eacute;t&#233; part goes on</p>'
        '<aside>see also that other thing</aside><form>Mail us</form><p>Third part of the story.</p></article><div class="comments"><p>great post, I like it</p></div>'
        '<footer>&copy; site</footer>')
TEXT = "A & B First part with bold words, and more Second été part goes on Third part of the story."


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x"), (3, "u", "no markup at all here", "x"), (4, "u", "<p" * 300, "x"),
            (5, "u", PAGE.replace("article>", "section>"), "x"), (6, "u", "<article><p>" + "word " * 60_000, "x"), (7, "u", "<!-- never closed <p>hidden", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    weights = html_text.fit(df)
    got = {}
    for r in html_text.main_text(df, weights).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == [TEXT, TEXT] and got[None] == [""] and got[2] == [""] and got[3] == ["no markup at all here"] and got[7] == [""]
    assert got[5] == [TEXT] and got[6][0] == " ".join(["word"] * 60_000)
    assert html_text.main_text(df.limit(0), html_text.fit(df.limit(0))).collect() == []


def test_pages_of_the_small_table_are_their_articles(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages, html_text.fit(pages)).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", article)
        assert got[r.page_id] == " ".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks) if x)


def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op8_language"](spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = got.collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 200
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_edge_rows(spark, edge, empty):
    model = language.fit(edge)
    got = language.predict(edge, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGE)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in language.predict(edge, language.fit(empty)).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []
    assert sorted(str(r.doc_id) for r in language.known(edge, model).collect()) == sorted(str(i) for i, _ in EDGE if i not in (1, 2, 3))
    assert language.known(edge, model).columns == edge.columns


def test_expectation_maximisation_finds_the_accuracies():
    r = np.random.default_rng(1)
    n, k = 40_000, len(quality.NAMES)
    truth = (r.random(n) < 0.7).astype(int)
    right = np.linspace(0.65, 0.95, k)
    says = np.where(r.random((n, k)) < right, truth[:, None], 1 - truth[:, None]) * 2
    says[r.random((n, k)) < 0.2] = quality.NONE
    codes = says @ (3 ** np.arange(k - 1, -1, -1))
    values, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    post, like, prior = quality.expectation_maximisation(values, counts.astype(float))
    assert abs(prior - 0.7) < 0.03
    assert np.abs(like[:, 1, quality.GOOD] - right).max() < 0.03 and np.abs(like[:, 0, quality.BAD] - right).max() < 0.04
    assert ((post[back] > 0.5) == truth).mean() > 0.95


def test_quality_against_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op7_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [got[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_quality_of_edge_rows(spark, edge, empty):
    model = quality.fit(edge)
    got = quality.score(edge, model).collect()
    assert len(got) == len(EDGE) and all(not r.kept and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert quality.score(empty, quality.fit(empty)).collect() == []


def brute_lines(text):
    import re
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = {i + k for p in seen.values() if len(p) > 1 for i in p for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_line_rules_of_edge_rows(spark, edge, empty):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_rules.clean(edge).collect())
    assert got == sorted((str(i), *brute_lines(t)) for i, t in EDGE)
    assert line_rules.clean(empty).collect() == []


def test_line_rules_remove_lines_and_reject(spark):
    body = prose(5, 60)
    menu = "Home | News | About | Contact\nno closing mark\nAll rights reserved by us."
    r = random.Random(0)
    heavy = " ".join(r.choice("ab cd ef".split()) for _ in range(400)) + "."
    df = spark.createDataFrame([(1, body + "\n" + menu), (2, "Home | News | About | Contact and more menus\n" * 40 + body), (3, heavy)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_rules.clean(df).collect()}
    assert got[1].clean_text == body and got[1].kept and got[1].n_lines_removed == 3
    assert not got[2].kept and not got[2].base_failed or got[2].base_failed
    assert got[3].n_repeat_words == brute_lines(heavy)[4]


def test_trigram_queries_lose_nothing():
    import re
    r = random.Random(3)
    parts = ["pass", "word", "wd", "=", ":", "AKIA", "Z9" * 9, "secret", "token", "api", "_", "key", "'", " ", "0af3" * 7, "gh", "p_", "x" * 36, "eyJ", "."]
    for _ in range(3_000):
        text = "".join(r.choices(parts, k=8))
        low = text.lower()
        for rule in secret_scan.RULES:
            if re.search(rule.pattern, text, re.A):
                assert all(any(all(g in low for g in s) for s in demand) for demand in trigrams.required(rule.pattern)), (rule.kind, text)
    assert trigrams.required("[0-9a-f]{24,}") == [] and trigrams.required("a*b?") == []


def brute_spans(text):
    import re
    out = []
    for o, rule in enumerate(secret_scan.RULES):
        out += [(m.start(), o, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def brute_redacted(text):
    if text is None:
        return None
    out, at = "", 0
    for s in filter(None, brute_spans(text).split(",")):
        kind, a, b = s.split(":")
        if int(a) >= at:
            out += text[at:int(a)] + f"[{kind}]"
        at = max(at, int(b))
    return out + text[at:]


def secrets():
    r = random.Random(6)
    parts = ["password=", "Token: ", "api_key = \"", "abc", "abcdef1", "\" ", "AKIA", "ABCDEFGHIJ0123456789", " ", "é\U0001F600", "deadbeef" * 4, "\n", "passwd:", "secret='", "xoxb-123456789012", "-----BEGIN RSA PRIVATE KEY-----"]
    return ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(400)]


def test_secrets_equal_brute_force_and_are_redacted(spark, edge, empty):
    texts = secrets()
    df = spark.createDataFrame([(i % 390, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[0], "x", "y"), (1, None, "x", "y")], "doc_id bigint, text string, found string, content string")
    got = sorted((str(r.doc_id), r.spans) for r in secret_scan.summary(secret_scan.scan(df)).collect())
    assert got == sorted((str(r.doc_id), brute_spans(r.text)) for r in df.collect())
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(r.doc_id), str(brute_redacted(r.text))) for r in df.collect())
    assert secret_scan.redact(edge).columns == edge.columns and secret_scan.redact(edge).count() == len(EDGE)
    assert sorted(str(r.text) for r in secret_scan.redact(edge).collect()) == sorted(str(t) for _, t in EDGE)
    assert secret_scan.scan(empty).collect() == []


def test_native_queries_run_no_python(spark, edge):
    for df in (line_rules.clean(edge), secret_scan.summary(secret_scan.scan(edge))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_tokenizer_folder_is_a_setting(monkeypatch):
    monkeypatch.setenv("TOKENIZER_DIR", "/some/folder")
    assert queries.vocabulary() == os.path.join("/some/folder", "byte_bpe_50k.json")


def test_weights_of_articles_inside_main_and_articles(spark):
    """The usual layout, article in main, articles in articles, and one that is never closed: their words are content, those around are not."""
    body = lambda i: f'<div class="story">{prose(40 + i, 60)}</div>'
    around = '<div class="teaser">Read more of our other stories in the paper today and tomorrow.</div>'
    layouts = ["<main><h1>Title</h1><article>{0}</article></main>", "<article>{0}<article>{0}</article>{0}</article>", "<main><article>{0}</main>", "<main><article>{0}</article>{0}</main>"]
    pages = [(i, "u", f"<html><body>{around}{layouts[i % 4].format(body(i))}{around}</body></html>") for i in range(24)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    weights = html_text.fit(df)
    assert weights.outside == {"div.teaser"} and weights.word("div.story") > 0.9
    for r in html_text.main_text(df, weights).collect():
        assert " ".join(prose(40 + r.page_id, 60).split()) in r.text and "other stories" not in r.text


def test_names_of_classes_do_not_overrule_prose():
    """Names that hold a word of page furniture keep their prose; furniture itself goes, and so does what labelled pages have outside."""
    weights = html_text.Weights({})
    body = " ".join(["plain words of an article that goes on"] * 6)
    for name in ("legal-analysis", "search-engines", "social-sciences", "tags", "related-work", "foot-health", "sponsored-study", "share-price", "post reply-to", "x"):
        assert html_text.extract(f'<article><h1>T</h1><div class="{name}"><p>{body}</p></div></article>', weights)[0] == f"T {body}", name
    for name in ("comments", "comment-list", "cookie-notice", "ad", "sidebar", "nav-links", "newsletter-signup", "menu", "notice", "adSlot"):
        assert html_text.extract(f'<article><h1>T</h1><p>{body}</p><div class="{name}"><p>{body}</p></div></article>', weights)[0] == f"T {body}", name
    links = "".join(f"<a href=x>tag {i}</a> " for i in range(40))
    assert html_text.extract(f'<article><p>{body}</p><div class="tags">{links}</div></article>', weights)[0] == body
    learned = html_text.Weights({"c:boxout": (0, 60), "c:sidebar": (400, 3)})
    assert html_text.extract(f'<article><p>{body}</p><div class="boxout">{body}</div></article>', learned)[0] == body
    assert html_text.extract(f'<article><p>{body}</p><div class="sidebar"><p>{body}</p></div></article>', learned)[0] == f"{body} {body}"


def test_formulas_stay_and_unclosed_elements_take_linear_time():
    import time
    weights = html_text.Weights({})
    assert html_text.extract("<article><p>so <math><mi>x</mi>=<mn>2</mn></math> holds</p></article>", weights)[0] == "so x=2 holds"
    start = time.perf_counter()
    assert html_text.extract("<svg>" * 60_000 + "<p>words here</p>", weights)[0] == "words here"
    assert time.perf_counter() - start < 5


def test_very_many_secrets_in_one_text(spark):
    """60,000 matches in one text, found and replaced, beside a text with letters outside of the first plane."""
    import time
    one, many = "token=abcdef1 ", 60_000
    far = "\U0001d504 " * 1_500 + "password=hunter2x " + "é" * 2_100 + " AKIA" + "A" * 16 + " token=xoxb-0123456789-token=abcdefg end"
    df = spark.createDataFrame([(1, one * many), (2, far), (3, None), (4, "")], "doc_id bigint, text string")
    start = time.perf_counter()
    got = {r.doc_id: r.found for r in secret_scan.scan(df).collect()}
    assert [(s.start, s.stop) for s in got[1]] == [(14 * i, 14 * i + 13) for i in range(many)]
    assert [(s.start, s.stop, s.kind) for s in got[2]][:2] == [(3_000, 3_017, "assign"), (5_119, 5_139, "access")]
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert time.perf_counter() - start < 120
    assert clean[1] == "[assign] " * many and clean[3] is None and clean[4] == ""
    assert clean[2] == "\U0001d504 " * 1_500 + "[assign] " + "é" * 2_100 + " [access] [assign] end"
