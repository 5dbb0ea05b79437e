import functools
import random

from echofold.llm import wrappers as W


def slow_match(page, a, other, b):
    """Simple tree matching as it is defined, without shapes and shortcuts."""
    if page.label[a] != other.label[b]:
        return 0
    x, y = page.kids[a], other.kids[b]

    @functools.cache
    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + slow_match(page, x[i - 1], other, y[j - 1]))

    return 1 + best(len(x), len(y))


def page(rng, depth=0):
    kids = [page(rng, depth + 1) if rng.random() < 0.6 and depth < 3 else "t" for _ in range(rng.randrange(4))]
    tag = rng.choice(["div", "section", "b"])
    return f"<{tag}>{'<i></i>'.join(kids)}</{tag}>"


def test_matching_is_optimal():
    rng = random.Random(7)
    for _ in range(150):
        a, b = W.Page(page(rng) + page(rng)), W.Page(page(rng) + page(rng))
        m = W.Matcher()
        sa, sb = m.shapes(a), m.shapes(b)
        assert m.score(sa[0], sb[0]) == slow_match(a, 0, b, 0)
        aligned, stack = 0, [(0, 0)]
        while stack:
            i, j = stack.pop()
            aligned += 1
            assert a.label[i] == b.label[j]
            stack += [(a.kids[i][x], b.kids[j][y]) for x, y in m.way(sa[i], sb[j])]
        assert aligned == m.score(sa[0], sb[0])


def test_markup():
    read = lambda x: W.content(W.Page(x), -1, {}, [])[0]
    assert read("<p>a<p>b <b>c<br>d</p>e") == "a\nb c\nd\ne"
    assert read("<head><title>no</title></head><body>x &amp; y<script>if (a<b) '</p>'</script> z<!-- <p>no --></body>") == "x & y z"
    assert read("<nav><ul><li>no</ul></nav><div class=ad>yes</div><footer>no") == "yes"
    assert read("<article>a<aside>note</aside><footer>by b</footer></article><aside>no</aside>") == "a\nnote\nby b"
    assert read("a < b </nope> <") == "a < b <"
    assert read("<div>" * 5000 + "deep") == "deep" and read("") == "" and read("<") == "<" and read("<script>x") == ""
    assert read("<ul><li>a<li>b</ul>") == "a\nb"


def site(host, n, name):
    return [(f"http://{host}/{k}", f"<div class=top>Welcome to {name}</div><div><h1>Title {k}</h1>{''.join(f'<p>text {k} {j}</p>' for j in range(k % 4 + 1))}</div><div class=end>All rights {name}</div>") for k in range(n)]


ROWS = [*site("one.example", 30, "One"), *site("Two.example:80", 25, "Two"), ("http://alone.example/", "<p>only</p>"), (None, "<p>x</p>"), ("nonsense", "<p>y</p>"), ("http://one.example/n", None), ("http://one.example/e", ""), ("http://one.example/odd", "<table><tr><td>1<td>2<td>3</table>")]
ROWS += [ROWS[0]] * 3


def extracted(spark):
    df = spark.createDataFrame([(k if k != 7 else None, u, h, "x", "y") for k, (u, h) in enumerate(ROWS)], "page_id long, url string, html string, host string, h string").repartition(3)
    return df, W.extract(df).collect()


def check(rows):
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(ROWS) and sum(r.page_id is None for r in rows) == 1
    for k in (0, 3, 29, 30, 50):
        n = k if k < 30 else k - 30
        assert by[k].content == "\n".join([f"Title {n}", *[f"text {n} {j}" for j in range(n % 4 + 1)]])
        assert by[k].n_template == 2
    assert by[30].host == "two.example" and by[55].content == "only"
    assert (by[56].host, by[56].content) == (None, "x") and (by[57].host, by[57].content) == (None, "y")
    assert by[58].content == by[59].content == "" and by[60].content.split() == ["1", "2", "3"]


def test_extraction(spark, monkeypatch):
    df, rows = extracted(spark)
    check(rows)
    assert W.extract(df.limit(0)).count() == 0
    monkeypatch.setattr(W, "MODEL_BYTES", -1)  # pages go to the models
    monkeypatch.setattr(W, "SALT_PAGES", 7)
    check(extracted(spark)[1])


def ads(n, texts):
    return [(k, f"http://ads.example/{k}", f"<div class=ad>Buy {k * 7 % texts} now</div><article><h1>Title {k}</h1><p>text of page {k}</p></article>") for k in range(n)]


def test_rotating_texts_are_template_on_a_large_host(spark):
    rows = W.extract(spark.createDataFrame(ads(240, 60), "page_id long, url string, html string")).collect()
    assert {r.page_id: r.content for r in rows} == {k: f"Title {k}\ntext of page {k}" for k in range(240)}


def test_copies_of_a_page_are_no_recurrence(spark):
    made = ads(40, 8)
    made += [(100 + k, u, x.replace("</p>", "</p><i>copy</i>")) for k, u, x in made]
    rows = W.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert all(r.content.startswith(f"Title {r.page_id % 100}\ntext of page {r.page_id % 100}") and "Buy" not in r.content for r in rows)


def test_beyond_chance():
    assert W.beyond_chance(1.1, 261) == 8 and W.beyond_chance(1.0, 3) < W.beyond_chance(1.0, 3000)


def test_rare_kinds_have_leaders(spark):
    made = ads(400, 8)
    for kind in range(12):  # each is 1.5 % of the host
        tags = [f"x{kind}a", f"x{kind}b", f"x{kind}c"]
        made += [(1000 + 100 * kind + k, f"http://ads.example/{kind}/{k}", "".join(f"<{t}>Notice {t}</{t}>" for t in tags) + f"<x{kind}>rare {kind} page {k}</x{kind}>") for k in range(8)]
    rows = W.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert len(rows) == len(made)
    assert all(r.content == f"rare {(r.page_id - 1000) // 100} page {r.page_id % 100}" and r.n_template == 3 for r in rows if r.page_id >= 1000)
