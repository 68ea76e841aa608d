import html
import random
import re
import time
from html.parser import HTMLParser

from paperloom.llm import webtext as X

SF = "/root/testdata/sf0.01"


def brute_run(scores):
    best = (0.0, 0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sum(scores[a:b]) > best[0] + 1e-9:
                best = (sum(scores[a:b]), a, b)
    return best


def test_best_run_is_as_brute_force():
    r = random.Random(1)
    for _ in range(300):
        scores = [float(r.randrange(-5, 6)) for _ in range(r.randrange(12))]
        a, b = X.best_run(scores)
        assert sum(scores[a:b]) == brute_run(scores)[0]


def test_pages_without_content_elements():
    words = " ".join(f"word{k}" for k in range(60))
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><div class="menu"><a href=/a>One</a> <a href=/b>Two</a></div>
    <div id="top-banner">buy now</div><div><h2>Head &amp; more</h2><p>{words}<p>second&nbsp;para <b>bold</b>, x &lt; y<br>next</p><form>name <input></form>
    <div class="comments"><p>{words}</p></div></div><footer>foot {words}</footer><script>var x = "</p>" + 1;</script></body></html>"""
    weights = X.fit_weights(X.Counter())
    assert X.main_text(page, weights) == f"Head & more\n\n{words}\n\nsecond para bold, x < y next"
    assert [X.main_text(x, weights) for x in (None, "", "<p>", "<!-- c", "<nav>menu here</nav>")] == [""] * 5
    assert X.main_text("only words, no tags", weights) == "only words, no tags"
    assert len(X.main_text("<p>" + "w " * 200_000, weights)) == 399_999


def test_article_with_parts_to_leave_out():
    page = "<body><nav>n n</nav><article><header><h1>T</h1></header><p>a b c</p><aside>side</aside><div class='ad'>buy</div><ul><li>x</li><li>y</li></ul><section class='comments'>he said</section><p>end</article><aside>other</aside></body>"
    assert X.main_text(page, X.fit_weights(X.Counter())) == "T\n\na b c\n\nx\n\ny\n\nend"


def test_synthetic_pages_are_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in X.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        want = "\n\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b).replace("  ", " "))).strip() for b in blocks) if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_tables(spark):
    kind = "page_id bigint, url string, html string, text int"
    d = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>a b", 1), (1, "u", "", 1)], kind)
    assert sorted(r.text for r in X.extract(d).collect()) == ["", "", "a b"]
    assert X.extract(d.limit(0)).collect() == []


def test_marks_of_a_page_do_not_hide_its_content():
    words = " ".join(f"word{k}" for k in range(60))
    weights = X.fit_weights(X.Counter())
    for page in (
        f"<html class='no-cookies'><body class='has-sidebar'><p>{words}</body></html>",
        f"<body class='sidebar'><article class='post has-comments'><p>{words}</article></body>",
        f"<div id='main' class='with-menu'><p>{words}</div>",
        f"<main class='comments'><p>{words}</main>",
        f"<html><head><title>T</title><meta charset=utf-8><body><p>{words}",
        f"<head><title>T</title><p>{words}",
        f"<head><title>T</title>{words}",
    ):
        assert X.main_text(page, weights) == words
    page = f"<article><div class='entry-header'><h1>T</h1></div><p>{words}<div class='top-banner ad-slot-2'>buy</div><div class='sidebar__inner'>x</div></article>"
    assert X.main_text(page, weights) == f"T\n\n{words}"


def told(r, n):
    return " ".join(r.choices("amber birch cedar delta ember fjord grove heath inlet".split(), k=n))


def story(r, tag, mark):
    """A page whose furniture has names that no list knows, and its text."""
    title, paragraphs = told(r, 3), [told(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 5))]
    inner = f'<div class="entry-header"><h1>{title}</h1></div>' + "".join(f"<p>{p}</p>" for p in paragraphs[:1]) + f'<div class="kq-strip">{told(r, 30)}</div>' + "".join(f"<p>{p}</p>" for p in paragraphs[1:])
    page = f'<body class="has-sidebar"><div class="zx-top"><p>{told(r, 50)}</p></div><{tag} class="{mark}">{inner}</{tag}><div class="zx-rail"><p>{told(r, 60)}</p></div>{told(r, 4)}</body>'
    strip = re.search(r'kq-strip">([^<]*)<', page)[1]
    return page, title, paragraphs, strip


def test_fitted_weights_decide_on_pages_without_labels():
    r = random.Random(3)
    counts = X.Counter()
    for _ in range(40):
        counts.update(X.label_counts(story(r, "article", "story")[0]))
    fitted = X.fit_weights(counts)
    wrong = {"constant": 0, "prior": 0}
    for _ in range(40):
        page, title, paragraphs, strip = story(r, "div", "story")
        # the strip stands within labelled content, so its text counts as such
        assert X.main_text(page, fitted) == "\n\n".join([title, paragraphs[0], strip, *paragraphs[1:]])
        for name, weights in (("constant", dict.fromkeys(fitted, 0.0)), ("prior", {})):
            wrong[name] += X.main_text(page, weights) != X.main_text(page, fitted)
    assert wrong == {"constant": 40, "prior": 40}
    shuffled = dict(zip(fitted, r.sample(list(fitted.values()), len(fitted)), strict=True))
    assert X.main_text(page, shuffled) != X.main_text(page, fitted)


def test_two_articles_and_furniture_between():
    page = "<body><nav><a href=x>m</a></nav><article><h1>A</h1><p>one</p></article><nav><ul><li><a href=y>menu here</a></li></ul></nav><article><h1>B</h1><p>two</p></article><footer>f</footer></body>"
    counts = X.Counter()
    for _ in range(5):
        counts.update(X.label_counts(page))
    assert X.main_text(page, X.fit_weights(counts)) == "A\n\none\n\nB\n\ntwo"


class Plain(HTMLParser):
    """Reads well-formed pages by the library's parser: (text or None at a block's edge, score)."""

    def __init__(self, weights):
        super().__init__(convert_charrefs=True)
        self.weights, self.open, self.made = weights, [], []

    def handle_starttag(self, tag, attrs):
        around = self.open[-1] if self.open else (None, False, False, False)
        values = " ".join(v for _, v in attrs).split()
        e = X.Element(tag, values, 0, around[2] or around[0] in ("article", "main"))
        own = sum(X.weight(self.weights, f) for f in X.features(e))
        gone = around[1] or own < X.CUT
        unseen = X.MOST_TAG if e.within or X.features(e)[-1] in self.weights else X.LIST_TAGS.get(tag, X.MOST_TAG)
        free = around[1] or e.within or tag in ("article", "main")
        cost = X.BORDER if tag in ("article", "main") and not e.within and not gone else 0.0 if free else 10 * X.MOST_TAG if gone else max(X.LEAST_TAG, min(unseen, own))
        self.made += [(None, 0.0, False), (None, cost, False)] if tag in X.BLOCKS else [("", cost, False)]
        self.open.append((tag, gone, e.within, around[3] or tag == "a" and not e.within))

    def handle_endtag(self, tag):
        self.open.pop()
        self.made.append((None, 0.0, False) if tag in X.BLOCKS else ("", 0.0, False))

    def handle_data(self, data):
        tag, gone, within, link = self.open[-1]
        place = self.weights.get("text " + ("in " if within else "") + tag, 0.0)
        worth = -1.0 if place < X.CUT else 0.1 if link else 1.0
        self.made.append(("" if gone else data, 0.0 if gone else worth * len(data.split()), not gone and (within or tag in ("article", "main")) and bool(data.strip())))


def runs_of(scores, first=0):
    """The best run, and in turn those to its left and right."""
    best, a, b = brute_run(scores)
    return [] if best <= 0 else runs_of(scores[:a], first) + [(first + a, first + b)] + runs_of(scores[b:], first + b)


def test_maximal_runs_are_as_brute_force():
    r = random.Random(12)
    for _ in range(800):
        scores = [r.choice([-3, -2, -1.5, -1, 1, 1.25, 2, 3, 0.5]) + r.random() / 1000 for _ in range(r.randrange(0, 24))]
        assert X.maximal_runs(scores) == runs_of(scores), scores


def test_tags_part_no_article():
    """Pages without labels: figures, empty cells and breaks in content cost nothing, several articles stay."""
    def text(page):
        return X.main_text(page, {})

    assert text("<article><p>Two words</p>" + "<figure><img></figure>" * 30 + "<p>tail of many more words than that</p></article>") == "Two words\n\ntail of many more words than that"
    assert text("<main><p>intro of five words here</p><table>" + "<tr><td></td><td></td></tr>" * 40 + "</table><p>closing words that are many more than the intro had</p></main>") == "intro of five words here\n\nclosing words that are many more than the intro had"
    assert text("<article>one short note</article><a href=x>x</a><a href=y>y</a><a href=z>z</a><article>another note of more words</article>") == "one short note\n\nanother note of more words"
    assert text("<body><p>word</p>" + "<br>" * 400 + "<p>and a longer text behind it</p></body>") == "word\n\nand a longer text behind it"


def test_furniture_without_names_is_left_out_by_the_run():
    """Nothing names the furniture: the whole page as the run has it, and constant weights have it as well."""
    r = random.Random(13)
    for _ in range(30):
        paragraphs = [told(r, r.randrange(12, 40)) for _ in range(r.randrange(1, 5))]
        list_of = lambda: "<div>" + "".join(f"<a href=/{k}>{told(r, 1)}</a>" for k in range(r.randrange(3, 9))) + "</div>"
        page = f"<html><body>{list_of()}<div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div>{list_of()}</body></html>"
        want = "\n\n".join(paragraphs)
        assert X.main_text(page, {}) == want
        tokens, scores = X.scored(page, {})
        whole = " ".join(" ".join(v.split()) for k, v, gone, _ in tokens if k == "text" and not gone)
        assert whole.split() != want.split()
        constant = [1.0 if k == "text" else 0.0 for k, *_ in tokens]
        a, b = X.best_run(constant)
        assert " ".join(v for k, v, *_ in tokens[a:b] if k == "text").split() != want.split()


def grown(r, depth=0):
    tag = r.choice(["div", "p", "section", "ul", "nav", "b", "article", "a"])
    mark = r.choice(["", ' class="story"', ' class="zx"', ' id="menu"'])
    inner = "".join(grown(r, depth + 1) if depth < 3 and tag not in "pba" and r.random() < 0.6 else told(r, r.randrange(1, 9)) + " &amp; " for _ in range(r.randrange(1, 4)))
    return f"<{tag}{mark}>{inner}</{tag}>"


def test_main_text_is_as_brute_force():
    r = random.Random(6)
    for _ in range(150):
        page = f"<body>{''.join(grown(r) for _ in range(3))}</body>"
        weights = {f: r.uniform(-3, 3) for f in (".story", "in .story", ".zx", "in .zx", "nav", "li", "in div", "text div", "text in p", "text body") if r.random() < 0.7}
        plain = Plain(weights)
        plain.feed(page)
        scores = [x for _, x, _ in plain.made]
        _, first, last = brute_run(scores)
        others = [(a, b) for a, b in runs_of(scores) if (b <= first or a >= last) and any(x[2] for x in plain.made[a:b])]
        text = "\0".join("".join("\0" if t is None else t for t, *_ in plain.made[a:b]) for a, b in sorted([(first, last), *others]))
        want = "\n\n".join(t for t in (" ".join(x.split()) for x in text.split("\0")) if t)
        assert X.main_text(page, weights) == want, page


def test_unclosed_tags_are_read_in_linear_time():
    began = time.process_time()
    X.main_text("<b>" * 30_000 + "<p>x" * 15_000 + "</i></b>" * 15_000, {})
    X.main_text("<article>" + "<i>" * 30_000 + "</b>" * 30_000 + "<a title=\"" * 5_000, {})
    assert time.process_time() - began < 8
