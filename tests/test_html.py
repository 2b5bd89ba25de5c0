"""The cleaning pass: plain functions first, then the table operator."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.html import PageTree, clean_html_udf, clean_page, decode_entities, page_marks, page_marks_udf, rule_index
from leafmill.operators import cleaning, rules


def text(html):
    return PageTree(html).text()


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<title>T</title><p>a <b>b</b> c</p>", "T\na\nb\nc"),
        ("a<!-- gone -->b", "a\nb"),
        ("<!DOCTYPE html><p>x", "x"),
        ("<script>var t='</p>';</script><p>x</p>", "x"),
        ("<p>1 &lt; 2 &amp;&#65;&#x42; &amp</p>", "1 < 2 &AB &amp"),
        ("<p>a</span>b</p>", "ab"),
        ("<p>&nbsp; </p><p>x</p>", "x"),
        ("<template>t</template><ruby>r<rt>s</rt></ruby>", "r"),
        ("<p>a\n\n\n\nb</p>", "a\n\nb"),
        ('<a title="x>y">z</a>', "z"),
        ("", ""),
    ],
)
def test_visible_text(html, expected):
    assert text(html) == expected


def test_entities_without_semicolon_stay():
    assert decode_entities("&copy &copy; &bogus; &apos;") == "&copy © &bogus; '"


def names_inside(html, name):
    tree = PageTree(html)
    i = tree.names.index(name)
    tree.remove(i)
    return tree.text()


def test_unclosed_children_end_with_their_parent():
    assert names_inside("<div><b>in<p>in too</div>out", "div") == "out"


def test_end_tag_does_not_reach_through_a_block():
    assert names_inside("<b>1<div>2</b>3</div>4</b>5", "b") == "5"


def test_paragraph_closes_paragraph():
    assert names_inside("<p>hidden<p>shown", "p") == "shown"


def test_self_closed_and_void_elements_hold_nothing():
    assert names_inside("<div/>a<br>b", "div") == "a\nb"
    assert names_inside("<div>x<br>y</div>z", "br") == "x\ny\nz"


def random_page(rng):
    """A well-formed page and the text that must be left of it under some rules."""
    kinds = ["div", "section", "span", "b", "ul", "nav", "aside", "footer", "h1"]
    classes = ["", "", "x", "Modal-y", "promo", "a promo z", "promos", "gdprx"]
    styles = ["", "", "", "display:none", "color:red; DISPLAY : NONE", "display:block"]
    seen_id, out, html = [False], [], []

    def walk(depth, gone):
        for _ in range(rng.randrange(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                word = f"w{len(html)}"
                html.append(f" {word} <!-- c --> &amp; <br>")
                if not gone:
                    out.extend([word, "&"])
                continue
            if rng.random() < 0.1:
                html.append(rng.choice(["<script>var a='<div>';</script>", "<style>p{}</style>", "<br>", "<img src='x'>"]))
                continue
            kind, cls, style = rng.choice(kinds), rng.choice(classes), rng.choice(styles)
            ident = "one" if rng.random() < 0.2 else ""
            base = (
                kind in ("nav", "aside", "footer") or "modal" in cls.lower() or "gdpr" in cls
                or "none" in style.lower()
            )
            rule = "promo" in cls.split() or kind == "h1"
            dead = gone or base or rule
            if ident and not dead and not seen_id[0]:
                seen_id[0], dead = True, True
            attrs = "".join(f' {k}="{v}"' for k, v in (("class", cls), ("style", style), ("id", ident)) if v)
            html.append(f"<{kind}{attrs}>")
            walk(depth - 1, dead)
            html.append(f"</{kind}>")

    walk(5, False)
    return "".join(html), out


def test_random_pages_keep_what_no_rule_removes():
    import random

    rules = rule_index(
        [
            {"id": 1, "rule_type": "class", "selector": "promo"},
            {"id": 2, "rule_type": "tag", "selector": "h1"},
            {"id": 3, "rule_type": "id", "selector": "one"},
        ]
    )
    rng = random.Random(11)
    for _ in range(800):
        html, words = random_page(rng)
        assert clean_page(html, rules)["text"].split("\n") == (words or [""]), html


def test_broken_markup_never_fails():
    import random

    rng = random.Random(12)
    bits = ["<", ">", "</", "<p", "<div class='", '"', "'", "a", " ", "=", "<!--", "-->", "<script>", "</script>", "&amp;", "&#x110000;", "&#0;", "<b>", "</div>", "/>", "<![CDATA[", "]]>", "<?", "\x00"]
    for _ in range(3000):
        clean_page("".join(rng.choice(bits) for _ in range(rng.randrange(30))))


PAGES = [
    (1, "<p style='DISPLAY: none'>no</p><p>yes</p>"),
    (2, "<nav>n</nav><header>h</header><div class='x CookieBar'>c</div><p>yes</p>"),
    (3, "<div class='banner'>b</div><p style='DISPLAY:none'>h</p><p>yes</p>"),
    (4, "<div class='promo'>1</div><i id='a'>2</i><i id='a'>3</i><h1>4</h1><p>yes</p>"),
    (5, "<div class='g-recaptcha'></div><p>yes</p>"),
    (6, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string").withColumn(
        "url", F.lit("https://a.example/x")
    )


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_standard_and_compat_profiles(pages):
    out = texts(cleaning.clean_pages(pages))
    assert out[1] == "yes" and out[2] == "yes" and out[3] == "b\nyes"
    assert out[5] is None and out[6] == ""
    compat = texts(cleaning.clean_pages(pages, profile="compat"))
    assert compat[1] == "no\nyes" and compat[3] == "h\nyes"


def test_rules_in_id_order_first_id_match_only(spark, pages):
    made = spark.createDataFrame(
        [
            (1, "a.example", "class", "promo", "active"),
            (2, "a.example", "id", "a", "active"),
            (3, "a.example", "tag", "h1", "active"),
            (4, "a.example", "tag", "h1", "active"),
            (5, "a.example", "tag", "p", "candidate"),
            (6, "b.example", "tag", "p", "active"),
        ],
        "id long, domain string, rule_type string, selector string, status string",
    )
    row = cleaning.clean_pages(pages, made).where("page_id = 4").first()
    assert row["text"] == "3\nyes"
    assert row["applied_rule_ids"] == [1, 2, 3]


RULE = "id long, domain string, rule_type string, selector string, status string"


def rule_by_rule(html, rules):
    """Rules one after the other in id order, each over the elements that are left."""
    tree = PageTree(html)
    for i, (name, attrs) in enumerate(zip(tree.names, tree.attrs)):
        if name in fv.DROPPED_TAGS:
            tree.remove(i)
    applied = []
    for rule, kind, selector in sorted(set(rules)):
        names = {
            "tag": lambda i: tree.names[i] == selector,
            "id": lambda i: tree.attrs[i].get("id") == selector,
            "class": lambda i: selector in tree.attrs[i].get("class", "").split(),
        }[kind]
        hits = [i for i in range(len(tree.names)) if tree.live[i] and names(i)]
        for i in hits[:1] if kind == "id" else hits:
            tree.remove(i)
        if hits:
            applied.append(rule)
    return tree.text(), applied


@pytest.mark.parametrize("shared_rows", [1_000_000, 10])
def test_rules_by_reference_equal_rule_by_rule(spark, shared_rows):
    """Both plans: the shared index, and pages that meet only the rules that name something on them.

    One domain holds most pages and rules; repeated pages, repeated rules, rules that name
    the same thing, clashing columns, nulls and empty texts are among them.
    """
    rng = random.Random(5)
    kinds, names = ("tag", "id", "class"), {"tag": ["p", "b", "div", "i"], "id": ["x", "y", "a b"], "class": ["k", "m", "n"]}
    made, rows = {}, []
    for n in range(60):
        domain = rng.choice(["hot.example", "hot.example", "b.example"])
        kind = rng.choice(kinds)
        made.setdefault(domain, []).append((n, kind, rng.choice(names[kind])))
    for n in range(120):
        parts = []
        for _ in range(rng.randrange(8)):
            t = rng.choice(names["tag"])
            parts.append(f"<{t} id='{rng.choice(names['id'])}' class='{' '.join(rng.sample(names['class'], 2))}'>{rng.randrange(99)}<b>u</b></{t}>")
        rows.append((n, f"http://{rng.choice(['hot.example', 'hot.example', 'b.example', 'c.example'])}/{n}", "".join(parts), "kept", "kept"))
    rows += [(200, rows[0][1], None, "kept", "kept"), (201, None, "<p>z</p>", "kept", "kept"), (202, rows[0][1], "", "kept", "kept")] + rows[:20]
    table = [(i, d, k, s, "active") for d, known in made.items() for i, k, s in known]
    table += table[:7] + [(900, "hot.example", "tag", "p", "candidate"), (901, None, "tag", "p", "active"), (None, "hot.example", "tag", "p", "active"),
                          (902, "hot.example", "tag", None, "active"), (903, "hot.example", "id", "", "active"), (904, "hot.example", None, "p", "active")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, cleaning_rules string, id string")
    spark.conf.set("spark.leafmill.broadcastRows", str(shared_rows))
    try:
        got = cleaning.clean_pages(df, spark.createDataFrame(table, RULE)).collect()
    finally:
        spark.conf.unset("spark.leafmill.broadcastRows")
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        domain = (by_id[r["page_id"]][1] or "").split("/")[2:3]
        want = rule_by_rule(by_id[r["page_id"]][2] or "", made.get(domain[0], []) if domain else [])
        assert (r["text"], r["applied_rule_ids"]) == want
        assert r["cleaning_rules"] == r["id"] == "kept"


@pytest.mark.parametrize("shared_rows", [1_000_000, 1_000])
def test_a_hundred_thousand_rules_on_one_domain(spark, shared_rows):
    """No page row carries the rules of its domain, whatever their number."""
    made = spark.range(100_000).select(
        "id", F.lit("a.example").alias("domain"), F.lit("class").alias("rule_type"),
        F.concat(F.lit("k"), "id").alias("selector"), F.lit("active").alias("status"),
    )
    some = spark.range(3_000).select(
        F.col("id").alias("page_id"), F.lit("http://a.example/x").alias("url"),
        F.format_string("<div class='k%d j'>gone</div><div class='k%d'>left</div>", F.col("id") * 30, F.col("id") + 100_000).alias("html"),
    )
    spark.conf.set("spark.leafmill.broadcastRows", str(shared_rows))
    try:
        out = cleaning.clean_pages(some, made)
        if shared_rows > 100_000:
            assert "cleaning_rules" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = out.agg(F.count("*"), F.count_if((F.col("text") == "left") & (F.col("applied_rule_ids") == F.array(F.col("page_id") * 30)))).first()
    finally:
        spark.conf.unset("spark.leafmill.broadcastRows")
    assert tuple(got) == (3_000, 3_000)


def test_challenge_marker_order(spark):
    df = spark.createDataFrame(
        [("<HCAPTCHA> cf-chl-1",), ("awsWAF-captcha g-recaptcha",), ("none",), (None,)], "html string"
    )
    got = [r["c"] for r in df.select(cleaning.challenge(F.col("html")).alias("c")).collect()]
    assert [c and (c["type"], c["marker"]) for c in got] == [
        ("cloudflare", "cf-chl-"), ("aws_waf", "awswaf-captcha"), None, None,
    ]


def test_thin_and_challenge_pages_fail_and_substantial_pages_do_not(spark):
    long_text = "<main>" + "A sentence of some length. " * 3 + "</main>"
    df = spark.createDataFrame(
        [(1, "https://a.example/", long_text), (2, "https://a.example/", "<body>x</body>"),
         (3, "https://a.example/", "<div class='g-recaptcha'></div>")],
        "page_id long, url string, html string",
    )
    cleaned = cleaning.clean_pages(df)
    failed = {r["page_id"]: r["error_type"] for r in cleaning.page_failures(cleaned).collect()}
    assert failed == {2: "EmptyPageError", 3: "UnsupportedChallengeError"}
    assert [r["page_id"] for r in cleaning.extractable(cleaned).collect()] == [1]


def test_content_bounds_count_characters(spark):
    df = spark.createDataFrame([("äöü" * 4,)], "text string")
    row = df.select(cleaning.bounded(F.col("text"), 5).alias("b"), cleaning.bounded(F.col("text")).alias("c")).first()
    assert row["b"]["content"] == "äöüäö" and row["b"]["truncated"]
    assert row["c"]["content"] == "äöü" * 4 and not row["c"]["truncated"]


def test_noise_proposals(spark):
    html = (
        "<div class='promo-card'></div>" * 2 + "<i class='ad'></i>" * 3 + "<i class='shadow'></i>" * 9
        + "<i class='sponsor_x a'></i>" * 2 + "<i class='Related-1'></i>" * 12 + "<i class='newsletter'></i>"
    )
    df = spark.createDataFrame([(1, "https://a.example/", html), (2, "https://a.example/", html)], "page_id long, url string, html string")
    quality = spark.createDataFrame([(1, ["LOW_VALIDITY"]), (2, ["NO_RESULTS"])], "page_id long, issues array<string>")
    got = [
        (r["selector"], r["evidence"], r["confidence"])
        for r in rules.propose_rules(cleaning.clean_pages(df), quality).collect()
    ]
    assert got == [
        ("Related-1", "class=Related-1;count=12", 0.8),
        ("ad", "class=ad;count=3", min(0.8, 0.45 + 3 * 0.05)),
        ("promo-card", "class=promo-card;count=2", 0.45 + 2 * 0.05),
    ]


def test_links_of_every_form():
    from leafmill.plans.views import ANCHORS

    page = clean_page(f"<title> A &amp;\n B </title><nav><a href='/n'>nav</a></nav><article>{ANCHORS}</article>", links=True)
    assert page["title"] == "A & B"
    assert [(x["text"], x["url"], x["shown"]) for x in page["links"]] == [
        ("nav", "/n", False), ("one", "/single", True), ("two", "/bare", True), ("three & four", "/nested?q=1&r=2", True),
        ("five", "/aside", False), ("", "/empty", True),
    ]
    assert clean_page("", links=True)["links"] == [] and "links" not in clean_page("<a href=x>y</a>")


def test_a_batch_is_parsed_in_slices(spark):
    """A worker holds the parsed pages of a slice, not of a batch; rows keep their order."""
    pages = [f"<title>t{i}</title><a href='/{i}'>l</a><p class='ad-x'>{'é ' * (i % 997)}" for i in range(4000)]
    pages[7], pages[8], pages[9] = None, "", "<p>" + "x" * 3_000_000
    html, by = pa.array(pages), pa.nulls(len(pages), pa.list_(pa.null()))
    parts = list(clean_html_udf(links=True).func(iter([(html, by), (html[:0], by[:0]), (html[:20], by[:20])])))
    low = 0
    for part in parts[:-1]:
        sent = [len((h or "").encode()) for h in pages[low : low + len(part)] if h != pages[9]]
        assert sum(sent) <= 2 << 20
        low += len(part)
    want = [clean_page(h or "", links=True) for h in pages]
    got = [row for part in parts for row in part.to_pylist()]
    assert got == want + want[:20]
    marks = [row for part in page_marks_udf().func(iter([html])) for row in part.to_pylist()]
    assert [[(m["rule_type"], m["selector"]) for m in row] for row in marks] == [page_marks(h or "") for h in pages]

    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(3).withColumn("url", F.lit("https://a.example/"))
    found = {r.page_id: r for r in cleaning.clean_pages(df, links=True).select("page_id", "text", "title").collect()}
    assert [(found[i].text, found[i].title) for i in range(len(pages))] == [(w["text"], w["title"]) for w in want]
