import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import bpe, embedding_dedup, html_extract, language_id, toxicity, url_filter
from loomgraph.llm.queries import RANKS, RULES

RANK = bpe.read_ranks(open(public_tokenizers.path(RANKS), "rb").read())
CODEC = bpe.Codec(RANK, public_tokenizers.PATTERN)
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANK, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_bpe_as_tiktoken(text):
    ids = CODEC.encode(text)
    assert list(ids) == OWN.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, " " * 30_000 + "x", "<|endoftext|>", "é漢" * 9000, "\0\r\n"])
def test_bpe_long_and_odd(text, monkeypatch):
    assert list(CODEC.encode(text)) == OWN.encode_ordinary(text)
    monkeypatch.setattr(bpe, "_MANY", 10)
    assert list(CODEC.encode(text + " more words here")) == OWN.encode_ordinary(text + " more words here")


def test_bpe_forgets_without_error(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    codec = bpe.Codec(RANK, public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 9}zz" for i in range(60))
    assert list(codec.encode(text)) == OWN.encode_ordinary(text) and len(codec) <= 3


def test_bpe_frames(frame):
    how = {"ranks_path": str(public_tokenizers.path(RANKS)), "pattern": public_tokenizers.PATTERN}
    df = frame("doc_id long, ids string, text string", (1, "x", "hello you"), (2, "x", None), (None, "x", ""), (1, "x", "hello you"))
    got = bpe.decode(bpe.encode(df, **how, batch=2), **how, batch=3).collect()
    assert [(r.doc_id, bytes(r.decoded)) for r in got] == [(1, b"hello you"), (2, b""), (None, b""), (1, b"hello you")]
    assert bpe.encode(df.limit(0), **how).count() == 0


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://A.Example.com/en/7?x#y", ("a.example.com", "/en/7", "example.com/en/7", "allow")),
        ("x://b.com/en/", ("b.com", "/en/", "com/en/", "block")),
        ("http://com/en/x/y", ("com", "/en/x/y", "com/en/", "block")),
        ("http://b.com/en", ("b.com", "/en", None, "allow")),
        ("http://example.com/en/", ("example.com", "/en/", "com/en/", "block")),
        ("http://example.com/en/71", ("example.com", "/en/71", "example.com/en/7", "allow")),
        ("http://notexample.com/en/7", ("notexample.com", "/en/7", "com/en/", "block")),
        ("http://example.net/de/800/a", ("example.net", "/de/800/a", "example.net/de/8", "block")),
        ("http://q.net/de/8", ("q.net", "/de/8", "net/de/", "allow")),
        ("http://org?/es/", ("org", "", None, "allow")),
        ("http://x.org#a://b.com/en/", ("x.org", "", None, "allow")),
        ("nothing", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("://", ("", "", None, "allow")),
        ("http://É.COM/en/", ("É.com", "/en/", "com/en/", "block")),
    ],
)
def test_urls(url, want):
    parts = url_filter.split_url(url)
    assert (*parts, *(url_filter.Trie(RULES).match(*parts) or (None, "allow"))) == want


def test_longest_rule_wins_as_a_scan_does():
    rules = [("block", "a.com", ""), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("allow", "b.a.com", "/q"), ("block", "a.com", "/x/")]
    trie = url_filter.Trie(rules)
    for host in ("a.com", "b.a.com", "c.b.a.com", "com", "xa.com"):
        for path in ("", "/", "/x", "/xy", "/x/", "/x/y", "/x/yz/w", "/q", "/qq", "/x/q"):
            fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
            want = max(fits, key=lambda r: (len(r[1]), len(r[2])), default=None)
            assert trie.match(host, path) == (want and (want[1] + want[2], want[0]))
    with pytest.raises(ValueError):
        url_filter.Trie([("maybe", "a", "")])


def test_rules_that_are_joined_give_the_same_rows(frame, monkeypatch):
    rules = [*RULES, ("block", "", ""), ("block", "A.com", ""), ("allow", "a.com", ""), ("block", "b.a.com", "/q/x"), ("allow", "b.a.com", "/q")]
    urls = [f"http://{h}{p}" for h in ("a.com", "b.a.com", "c.b.A.com", "", "q.net", "example.net", "x.example.com", "org") for p in ("", "/", "/q", "/q/xy", "/en/", "/en/71", "/de/8/9", "/es")]
    df = frame("page_id long, rule string, url string", *[(i % 50, "x", u) for i, u in enumerate(urls)], (None, "x", None), (3, None, "no url"))
    want = sorted(map(repr, url_filter.judge(df, rules).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    table = frame("host string, verdict string, path string, url string", *[(h, v, p, "x") for v, h, p in rules])
    for form in (rules, table):
        assert sorted(map(repr, url_filter.judge(df, form).collect())) == want
    assert all(r.rule is None for r in url_filter.judge(df, table.limit(0)).collect())


def test_long_urls_take_linear_time():
    trie = url_filter.Trie(RULES)
    for url in ("http://a.com/" + "x" * 3_000_000, "http://a.com/" + "en/" * 500_000, "http://" + "a." * 300_000 + "com/en/"):
        trie.match(*url_filter.split_url(url))


def test_url_frame(frame):
    df = frame("page_id long, host string, url string", (1, "x", "http://b.com/en/"), (1, "x", None))
    assert [(r.page_id, r.rule) for r in url_filter.judge(df, RULES).collect()] == [(1, "com/en/"), (1, None)]
    assert url_filter.judge(df.limit(0), RULES).count() == 0


PAGE = "<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>ok?</div><article><h1>Head &amp; more</h1><p>One <b>bo</b>ld\n text.<p>Two<br>three<script>x('</p>')</script></article><aside>side</aside><div id=comments><p>I think</p></div><footer>f</footer>"


def test_article_text(frame):
    rows = [(i, f"http://h/{i}", PAGE) for i in range(4)] + [(9, None, None), (10, "http://h/x", ""), (11, "http://h/y", "no markup &lt;b&gt;"), (11, "u", "<p>a<p>b")]
    got = html_extract.extract(frame("page_id long, url string, html string, host string, main string", *[(*r, "x", "y") for r in rows])).collect()
    assert [r.text for r in got] == ["Head & more One bold text. Two three"] * 4 + ["", "", "no markup <b>", "a b"]
    assert html_extract.extract(frame("page_id long, url string, html string")).count() == 0


def test_template_finds_the_main_slot_without_names(frame):
    page = lambda i: f"<body><div class=top><a href=/>Home page of site</a> <a href=/x>Other things here</a></div><div class=c1><p>Story {i} begins with many words that differ {i * 7} from page to page</p><p>And goes on {i}</p></div><div class=c2>All rights are reserved by this site and so on</div>"
    rows = [(i, f"http://site/{i}", page(i)) for i in range(8)]
    for bound in (html_extract.BROADCAST_BYTES, -1):
        html_extract.BROADCAST_BYTES, old = bound, html_extract.BROADCAST_BYTES
        got = {r.page_id: r.text for r in html_extract.extract(frame("page_id long, url string, html string", *rows)).collect()}
        html_extract.BROADCAST_BYTES = old
        assert got == {i: f"Story {i} begins with many words that differ {i * 7} from page to page And goes on {i}" for i in range(8)}


def test_the_template_decides_inside_an_article_too(frame):
    """A fixed text and a link list in elements without a telling name, inside the article: only the other pages tell them."""
    page = lambda i: f"<article><h1>Title {i}</h1><div class=x>Read this on our site as well.</div><p>Many words that no other page has, {i} {i * 31} times and more of them.</p><div class=y><a href=1>One {i}</a> <a href=2>Two {i}</a></div><div class='has-sidebar comments-open'>The end {i}.</div></article><p>Below"
    rows = [(i, f"http://site/{i}", page(i)) for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract(frame("page_id long, url string, html string", *rows)).collect()}
    assert got == {i: f"Title {i} Many words that no other page has, {i} {i * 31} times and more of them. The end {i}." for i in range(9)}
    assert "Read this" in html_extract.main_text(page(3), None)
    copies = [(i, "http://copies/", page(1)) for i in range(9)]
    assert {r.text.split()[-1] for r in html_extract.extract(frame("page_id long, url string, html string", *copies)).collect()} == {"1."}


def test_names_decide_only_whole_and_smaller_parts():
    text = lambda s: html_extract.main_text(s, None)
    words = "many words of the article " * 6
    assert text(f"<div class='content has-sidebar'><article>{words}</article></div>") == words.strip()
    assert text(f"<article class='post comments-open'><header><h1>Head</h1></header>{words}<div class=comments>I think so</div></article>") == "Head " + words.strip()
    assert text(f"<form><div class=widget><p>{words}</p></div><div class=share-buttons>Tell</div><div class=share>x</div></form>") == words.strip() + " Tell"
    assert text(f"<body><header>Site</header><p>{words}</p><p>And {words}</p><footer>f</footer>") == words + "And " + words.strip()


def test_equivalence_classes_are_those_of_the_vectors(frame):
    rng = np.random.default_rng(6)
    pages = []
    for i in range(40):
        body = "".join(f"<{t}><p>t{rng.integers(0, 9)}</p></{t}>" * int(rng.integers(0, 3)) for t in ("div", "section", "ul", "table"))
        pages.append((i, f"http://h{i % 3}/", f"<main>{body}<div class=f>fixed <i>text</i></div></main>"))
    held = {}
    html_extract.scratch.cut, old = (lambda df, label: held.setdefault(label, old(df, label))), html_extract.scratch.cut
    try:
        html_extract.templates(frame("page_id long, url string, html string", *pages)).collect()
    finally:
        html_extract.scratch.cut = old
    vectors = {}
    for pid, url, source in pages:
        for key, _, _, _, n, _, _ in html_extract.tokens_of(html_extract.parse(source)):
            vectors.setdefault((url[7:9], key), {})[pid] = n
    want, got = {}, {}
    for (host, key), v in vectors.items():
        want.setdefault((host, tuple(sorted(v.items()))), set()).add(key)
    for r in held["tokens"].collect():
        got.setdefault((r.host, r.pages, r.vector), set()).add(r.token)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    whole = [html_extract.Token(r.token, r.above, r.name, r.outside, r.pages, str(r.vector), r.most, r.chars, r.linked) for r in held["tokens"].collect() if r.host == "h0"]
    valid = html_extract.valid_classes(whole, 14)
    assert all(len(c) > 1 or k[0] == 14 for k, c in valid.items()) and any(t.token == html_extract.text_key("fixed text") for t in valid[14, next(t.vector for t in whole if t.token == 0)])


@pytest.mark.parametrize("source", ["<a " * 200_000 + '"', "<a b='" * 100_000, '<p x="' * 100_001, "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 50_000 + "</div>" * 50_000, "<b>" * 100_000 + "<p>" * 100_000, "<" * 300_000, "<!-- " * 60_000, "<script>" * 50_000, "&amp" * 100_000, "<li><a>x" * 50_000], ids=lambda s: s[:6])
def test_broken_pages_take_linear_time(source):
    began = time.time()
    html_extract.main_text(source, None)
    assert time.time() - began < 8


def test_broken_markup():
    text = lambda s: html_extract.main_text(s, None)
    assert text("a < b <p>c</q></p>d<!-- x -->e <") == "a < b c de <"
    assert text("<article>x<p>y <b>z") == "x y z"
    assert text("<article>x</article><footer>f") == "x"
    assert text("<article>" * 3000 + "x") == "x"
    assert text("<article>&nbsp;a&amp;amp;&#65;&#x42; &am &notanything;</article>") == "a&amp;AB &am ¬anything;"


def phrases(train, text):
    """The greedy parse by searching the training text itself."""
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        at, n = at + max(k, 1), n + 1
    return n


def plain(text):
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return " " + " ".join(kept.split(" ")).strip() + " " if any(unicodedata.category(c)[0] == "L" for c in kept) else ""


def squeezed(text):
    return re.sub(" +", " ", plain(text))


@pytest.mark.parametrize("few, cells", [(0, 1 << 24), (5, 1 << 24), (10**9, 1 << 24), (5, 0)])
def test_phrases_are_the_longest_matches_across_words(monkeypatch, few, cells):
    monkeypatch.setattr(language_id, "_FEW", few)
    rng = np.random.default_rng(2)
    train = {k: "".join(rng.choice(list(s), 400)) for k, s in (("x", "abc  "), ("y", "bcd 1"), ("z", "é漢ab "))}
    find = language_id.Identifier(train, cells)
    texts = ["".join(rng.choice(list("abcdé漢q  7"), int(rng.integers(0, 90)))) for _ in range(120)] + ["", "½²", "ab", "a" * 700, "\u0301"]
    got = find.phrases([find.codes(language_id.points(t)) for t in texts])
    assert [list(r) for r in got] == [[phrases(squeezed(train[k]), squeezed(t)) for k in "xyz"] for t in texts]
    for (name, score), t in zip(find.identify(texts), texts):
        if not squeezed(t):
            assert (name, score) == ("und", 0.0)
            continue
        figure = {k: phrases(squeezed(train[k]), squeezed(t)) * np.log2(len(squeezed(train[k])) + 1) / len(squeezed(t)) for k in "xyz"}
        best = sorted(figure, key=lambda k: (figure[k], k))
        assert name == best[0] and abs(score - (1 - figure[best[0]] / figure[best[1]])) < 1e-9


def test_language_frames(frame):
    df = frame("doc_id long, text string, lang string, score string", (1, "the cat and the dog " * 20, "en", "x"), (2, "der hund und die katze " * 20, "de", "x"), (3, None, "en", "x"), (4, "x", None, "x"), (5, "12", "xx", "x"), (None, "abc", "yy", "x"))
    texts = language_id.training_texts(df)
    assert set(texts) == {"en", "de"}
    long = "the dog and the cat " * 30_000
    ask = frame("doc_id long, text string, lang string", (1, "the dog", "?"), (2, "die katze und", "?"), (3, None, "?"), (4, "12 34!", "?"), (None, "and", "?"), (6, "½²", "?"), (7, long, "?"), (7, long, "?"))
    got = language_id.identify(ask, texts).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (6, "und"), (7, "en"), (7, "en")]
    assert [r.lang_pred for r in language_id.identify(ask, {}).collect()] == ["und"] * 8
    assert [r.lang_pred for r in language_id.identify(ask, {"b": "zzz", "a": "zzz"}).collect()][0] == "a"  # a tie
    assert language_id.training_texts(df.limit(0)) == {} and language_id.identify(ask.limit(0), texts).count() == 0


def test_every_language_is_learned_from_so_many_whole_texts(frame):
    rows = [(i, f"text number {i} of tongue{i % 300} " * 50, f"l{i % 300}") for i in range(900)]
    texts = language_id.training_texts(frame("doc_id long, text string, lang string", *rows), sample_rows=2)
    assert len(texts) == 300 and all(t.count("\n") == 1 and all(x in {r[1] for r in rows} for x in t.split("\n")) for t in texts.values())


def test_ordinal_regression_keeps_thresholds_in_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 600)
    grade = np.where(x + rng.normal(0, 0.3, 600) > 2.2, 2, np.where(x + rng.normal(0, 0.3, 600) > 0.7, 1, 0))
    rows = [np.array([0]) if v else np.zeros(0, int) for v in x]
    values = [np.array([float(v)]) if v else np.zeros(0) for v in x]
    w, t = toxicity.fit_ordinal(rows, values, grade, 1)
    assert w[0] > 0 and t[0] < t[1]
    p = 1 / (1 + np.exp(-(w[0] * x[:, None] - t)))
    assert (np.round(p.sum(axis=1)) == grade).mean() > 0.85


def test_toxicity_frames(frame):
    docs = frame("doc_id long, text string, y int, f int", *[(i, ("you idiotic fool " if i % 4 == 0 else "a fine day ") * 2 + f"word{i}", 1, 1) for i in range(80)], (200, None, 1, 1), (201, "", 1, 1))
    labels = frame("doc_id long, toxic int", *[(i, int(i % 4 == 0)) for i in range(60)], (None, 1), (61, None), (999, 1))
    model = toxicity.train(docs, labels, least_g=5)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(80)) and not got[200] and not got[201]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 62
    again = toxicity.train(docs.repartition(7), labels.repartition(3), least_g=5)
    assert again.index == model.index and (again.weight == model.weight).all() and (again.thresholds == model.thresholds).all()
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("toxic").count() == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_scores_are_those_of_the_formula(frame):
    """Against every feature of every word, summed plainly; long texts and repeats too."""
    docs = frame("doc_id long, text string", *[(i, t) for i, t in enumerate(["Vile VILES and fine", "", None, "vile " * 50_000, "fine", "vile-viles_fine", "vile viles"] * 2)])
    index = {"=vile": 0, "^vile": 1, "^viles": 2, "=fine": 3}
    model = toxicity.Model(index, np.array([1.5, 0.25, 0.5, -2.0]), np.array([0.5, 3.0]))
    for r in toxicity.score(docs, model).collect():
        text, x = docs.where(f"doc_id = {r.doc_id}").first().text, 0.0
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        for f, i in index.items():
            n = sum(w == f[1:] if f[0] == "=" else w.startswith(f[1:]) for w in words)
            x += model.weight[i] * np.log1p(n)
        p = [1 / (1 + np.exp(-(x - t))) for t in model.thresholds]
        assert abs(r.probability - p[0]) < 1e-9 and abs(r.severity - sum(p)) < 1e-9 and r.toxic == (p[0] >= 0.5)


def test_equal_texts_with_clashing_labels_are_toxic(frame):
    rows = [(i, "you vile thing" if i % 3 == 0 else f"a fine day number{i}") for i in range(90)]
    labels = frame("doc_id long, toxic int, text string", *[(i, int(i % 3 == 0 and i % 2 == 0), "x") for i in range(90)], (0, 0, "x"), (0, 1, "x"))
    model = toxicity.train(frame("doc_id long, text string", *rows), labels, least_g=0.1, least_texts=1)
    assert "=vile" in model.index


def links(vectors, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    near = {i: {j for j in ok if j != i and ok[i] @ ok[j] / np.sqrt(ok[i] @ ok[i]) / np.sqrt(ok[j] @ ok[j]) >= threshold} for i in ok}
    low = {i: i for i, _ in vectors}
    while True:
        new = {i: min([low[i], *(low[j] for j in near.get(i, ()))]) for i in low}
        if new == low:
            return {i: (len(near.get(i, ())), low[i]) for i in low}
        low = new


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links_equal_all_pairs(frame, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, [float(c) for c in base[i % 9] + 0.05 * rng.standard_normal(16)]) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (2004, [1.0]), (2005, [None] + [1.0] * 15), (2006, list(rows[3][1])), (2007, [2 * c for c in rows[3][1]])]
    # Of two other lengths: a few close pairs, and one alone.
    rows += [(3000 + i, [float(c) for c in v]) for i, v in enumerate(([1, 1], [1, 1.01], [-1, 1], [3, 3.03], [1, 0, 0], [1, 0.1, 0], [0, 0, 5]))]
    df = frame("vec_id long, embedding array<double>, n long, rep string, dim int, cell string", *[(*r, 1, "x", 1, "c") for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    want = {}
    for dim in (2, 3, 16):
        want |= links([r for r in rows if r[1] is None or len(r[1]) == dim])
    found, real = sum(got[i][0] for i in want), sum(w[0] for w in want.values())
    assert found >= 0.99 * real and got[3000] == (2, 3000) and got[3005] == (1, 3004) and all(got[i][0] <= want[i][0] for i in want) and got[2004] == (0, 2004)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_embeddings_without_rows(frame):
    df = frame("vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0
    assert [r.n_links for r in embedding_dedup.near_duplicates(frame("vec_id long, embedding array<float>", (1, None), (2, [0.0]))).collect()] == [0, 0]
