"""Column functions against the same rules in plain Python, on literals and random text."""

import re
import string
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import mail as M
from quillmill.functions import text as X
from quillmill.functions.sqlfunctions import register_functions

URL = r"(http|https|ftp|ssh|sftp|www)://([\w_-]+(?:(?:\.[\w_-]+)+))([\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-])?"
EMAIL = r"([a-z0-9+._-]+@[a-z0-9+._-]+\.[a-z0-9+_-]+)"
RULES = {
    "remove_tabs": lambda t: re.sub("[\t\r\n]", " ", t),
    "remove_blanks": lambda t: re.sub(" +", " ", t),
    "remove_digits": lambda t: re.sub(r"\d[./\-:]\d|\d", "", t),
    "remove_all_punctuation": lambda t: t.translate(str.maketrans("", "", string.punctuation)),
    "remove_special_characters": lambda t: re.sub(r"[^a-zA-z0-9\s]", "", t),
    "ascii_to_string": lambda t: t.encode("ascii", "replace").decode().replace("?", ""),
    "remove_url": lambda t: re.sub(URL, "", t),
    "remove_email_address": lambda t: re.sub(EMAIL, "", t),
    "get_email_address": lambda t: re.findall(EMAIL, t),
    "get_hashtag": lambda t: [w for w in t.split() if w.startswith("#")],
    "get_mention": lambda t: [w for w in t.split() if w.startswith("@")],
}
# letters, marks and spaces that the rules treat differently from plain ASCII
PIECES = st.sampled_from(
    [*" \t\r\n\x0b\x1c\x85\xa0 　", *"aZ_[]^`?#@.-/:'\"<&", *"éßñ²½٣中é", "http://a.b/c", "www.x.com",
     "x@y.z", "ssh://é.fr/ü?", "1.5", "12:30", "RT", "n't", "😀"]
)
TEXTS = st.lists(PIECES, max_size=12).map("".join)


def values(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(TEXTS, min_size=40, max_size=60))
def test_rules_on_random_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    row_values = df.orderBy("i").select(*[getattr(X, n)("t").alias(n) for n in RULES]).collect()
    for text, row in zip(texts, row_values, strict=True):
        for name, rule in RULES.items():
            assert row[name] == rule(text), (name, text)


@pytest.mark.parametrize("name", ["remove_html", "clean_text_ie", "quick_preprocess", *RULES])
def test_missing_text(spark, name):
    function = getattr(X, name)
    default, kept = values(spark, [None], F.array(F.struct(function("t").alias("a"), function("t", null_token=None).alias("b"))))[0][0]
    assert default is not None and kept is None


def test_literals(spark):
    assert values(spark, ["https://t.co/mtzeFmKmto"], X.remove_url("t")) == [""]
    assert values(spark, ["mail Bob.Smith@x.com.au or"], X.remove_email_address("t")) == ["mail Bob.S or"]
    assert values(spark, ["Straße café Þór œuvre"], X.remove_accented_chars("t")) == ["Strasse cafe Thor oeuvre"]
    assert values(spark, ["don’t, won't I'd've it's"], X.expand_contractions("t")) == [
        "do not, will not I would have it is"
    ]
    assert values(spark, ["a_b[c]!"], X.remove_special_characters("t", strict=True)) == ["abc"]
    assert values(spark, ["A.B\\nC  d"], X.quick_preprocess("t")) == ["a b c d"]
    assert values(spark, ["#a b @c #d"], X.to_reference_string(X.get_hashtag("t"))) == ["[#a, #d]"]


def test_html(spark):
    pages = [
        '<p>a &amp; b</p><script>var x = "</p>";</script><style>p{}</style><!-- no --><b> c </b>',
        "plain  text ",
        '<a title="x > y">link</a>\n<br/>',
    ]
    expected = ["a & b c", "plain  text", "link"]
    assert values(spark, pages, X.remove_html("t")) == expected


def slow_html(page):
    """The rule of ``remove_html`` but for character references, one character after the other."""
    kept, i = [], 0
    while i < len(page):
        end = None
        if page.startswith("<!--", i):
            found = page.find("-->", i + 4)
            end = found + 3 if found >= 0 else None
        for name in ("script", "style"):
            opened = re.compile(rf"(?i)<{name}\b[^>]*>", re.A).match(page, i)
            closed = opened and re.compile(rf"(?i)</{name}[ \t\n\x0b\f\r]*>").search(page, opened.end())
            end = closed.end() if closed else end
        kept.append("\x01" if end else page[i])
        i = end or i + 1
    page, kept, i = "".join(kept), [], 0
    while i < len(page):
        j, quote = i, None
        if re.compile("<[!/?]?[a-zA-Z]").match(page, i):
            j = i + 1
            while j < len(page) and (quote or page[j] != ">"):
                if page[j] == quote:
                    quote = None
                elif not quote and page[j] in "\"'":
                    if page.find(page[j], j + 1) < 0:
                        break  # nothing closes it
                    quote = page[j]
                j += 1
        ended = j > i and j < len(page) and page[j] == ">"
        kept.append("\x01" if ended else page[i : max(j, i + 1)])
        i = j + 1 if ended else max(j, i + 1)
    nodes = [node.strip() for node in "".join(kept).split("\x01")]
    return " ".join(node for node in nodes if node)


MARKUP = st.lists(
    st.sampled_from(["<!--", "-->", "<script", "<SCRIPT>", "</script>", "</script ", "<style>", "</style>", "<a ", "<b>",
                     "</b>", ">", "<", '"', "'", "x", " y ", "<!DOCTYPE", "<?p", "-", "\n"]), max_size=25
).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(pages=st.lists(MARKUP, min_size=150, max_size=250))
def test_broken_markup(spark, pages):
    register_functions(spark)
    both = values(spark, pages, F.array(X.remove_html("t"), F.expr("remove_html_udf(t)")))
    for page, found in zip(pages, both, strict=True):
        assert found == [slow_html(page)] * 2, page


def test_a_million_broken_marks(spark):
    pieces = ["<script>", "<script ", "<!-- ", '<a href="', "<b ", "<a '\" ", "</script ", "<style></script>", "&#", "<div>", "<p x='"]
    pages = [p * (1_000_000 // len(p)) + tail for p in pieces for tail in (">", "</script>", '-->">')]
    register_functions(spark)
    started = time.time()
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string").repartition(8)
    both = df.select(X.remove_html("t").alias("a"), F.expr("remove_html_udf(t)").alias("b"))
    assert both.where("a = b").count() == len(pages)
    assert time.time() - started < 60  # 66 pages of a million characters


def test_sql_functions_equal_columns(spark):
    names = register_functions(spark)
    texts = ["Don't <b>go</b> to café https://a.b/c #x 12:30 me@x.org", None, "children's flies went"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in names:
        column = name.removesuffix("_udf")
        if not hasattr(X, column) or column == "to_reference_string":
            continue
        found = df.select(F.expr(f"{name}(t)").alias("sql"), getattr(X, column)("t").alias("col")).collect()
        assert [r["sql"] for r in found] == [r["col"] for r in found], name


@pytest.mark.parametrize(
    ("date", "day", "time"),
    [
        ("Thu,  1 Nov 2007 17:24:14 -0300 (GMT+3)", "2007-11-02", "01:54:14"),
        ("Fri Sep 14 13:44:44 2007 GMT", "2007-09-14", "19:14:44"),
        ("Tue, 15 Feb 2011 16:03:04 +0530", "2011-02-15", "16:03:04"),
        ("Mon, 18 Jan 2016 20:52:58 o'clock GMT+5", "2016-01-19", "02:22:58"),
        ("2016-01-18 20:52:58", "2016-01-19", "02:22:58"),
        ("junk", None, None),
        ("Tue, 45 Feb 2011 16:03:04 +0530", None, None),
        (None, None, None),
    ],
)
def test_mail_dates(spark, date, day, time):
    india = M.to_india_time(M.parse_mail_date(M.strip_gmt_suffix("t")))
    parts = F.struct(M.date_part_string(india).alias("day"), M.time_part_string(india).alias("time"))
    assert tuple(values(spark, [date], parts)[0]) == (day, time)


def test_mail_variants(spark):
    assert values(spark, ["a (GMT+05:30)", "a (GMT+1)"], M.strip_gmt_suffix("t", "india")) == ["a ", "a (GMT+1)"]
    assert values(spark, ["x o'clock GMT+2"], M.strip_gmt_suffix("t", "drop_clock")) == ["x"]
    strict = M.parse_mail_date("t", strict=True).isNotNull()
    assert values(spark, ["Tue, 15 Feb 2011 16:03:04 +0530", "15 Feb 2011 16:03:04 +0530"], strict) == [True, False]
    assert values(spark, ["a@b@c", "none", None], M.mail_domain("t")) == ["c", "none", None]
    with pytest.raises(Exception, match="not a mail date"):
        values(spark, ["junk"], M.parse_mail_date("t", errors="raise"))


def test_functions_on_a_stream(spark, tmp_path):
    """The column functions are stateless, so they run unchanged on a stream."""
    (tmp_path / "a.txt").write_text("Don't https://a.b/c\n#x Café\n")
    stream = spark.readStream.text(str(tmp_path)).select(X.clean_text("value").alias("x"))
    job = stream.writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    job.processAllAvailable()
    job.stop()
    assert sorted(r.x for r in spark.table("cleaned").collect()) == ["do not", "x cafe"]


@pytest.mark.parametrize("sql", [False, True])
def test_long_tags_and_references(spark, sql):
    from quillmill.functions.sqlfunctions import register_functions
    from quillmill.functions.text import remove_html

    pages = [
        "a <img src=" + "x" * 1_000_000 + "> b",
        "a <b " + "y" * 1_000_000,
        "<a " + " ".join(f'k{i}="v>"' for i in range(20_000)) + ">t</a>",
        "<b " * 20_000,
        "caf&eacute; &#233; &#x27;q&#X27; &pound;5 &nosuch; &amp;lt; &#0; &#1114112; & &;",
    ]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, text string")
    if sql:
        register_functions(spark)
        found = table.selectExpr("id", "remove_html_udf(text) as t")
    else:
        found = table.select("id", remove_html("text").alias("t"))
    texts = {r.id: r.t for r in found.collect()}
    assert texts[0] == "a b" and texts[1].startswith("a <b yyy") and texts[2] == "t"
    assert texts[3] == ("<b " * 20_000).strip()
    assert texts[4] == "café é 'q' £5 &nosuch; &lt; \ufffd \ufffd & &;"


def test_addresses_in_one_pass(spark):
    import random
    import re

    from quillmill.functions import patterns as P
    from quillmill.functions.text import get_email_address, remove_email_address

    dice = random.Random(4)
    texts = ["".join(dice.choice("ab.@@+ A") for _ in range(dice.randint(0, 24))) for _ in range(2000)]
    texts += ["a@b.c.@d.e", "x" * 200_000 + " a@b.c", ".@a.b.@c.d"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for row in table.select("text", remove_email_address("text").alias("r"), get_email_address("text").alias("g")).collect():
        plain = row.text if len(row.text) < 1000 else row.text[-20:]
        assert row.r[-200:] == re.sub(P.EMAIL, "", plain)[-200:] or len(row.text) > 1000
        if len(row.text) < 1000:
            assert row.g == re.findall(P.EMAIL, row.text)
        else:
            assert row.g == ["a@b.c"]


def test_hosts_of_any_number_of_dots(spark):
    many = "http://" + "a." * 100_000 + "b/c?d rest"
    odd = ["http://a.b", "http://a..b/x", "ssh://a.b.:80/x.", "http://a.b-/~x,y.", "ftp://a.b.c?x= y http://z", "http://" + "a." * 9]
    assert values(spark, [many], X.remove_url("t")) == [" rest"]
    assert values(spark, odd, X.remove_url("t")) == [re.sub(URL, "", t) for t in odd]
    register_functions(spark)
    assert values(spark, [many, *odd], F.expr("remove_url_udf(t)")) == [" rest", *[re.sub(URL, "", t) for t in odd]]


def test_sql_names_spare_texts_that_need_no_work():
    """Each costly step of the SQL names is behind the cheap test that its column has."""
    from quillmill.functions.sqlfunctions import function_bodies

    bodies = {name: body for name, (_, body) in function_bodies().items()}
    for name in ("remove_url", "remove_html", "remove_accented_chars", "ascii_to_string", "remove_email_address",
                 "expand_contractions"):
        assert bodies[f"{name}_udf"].startswith("case when "), name
    assert bodies["remove_html_udf"].count("rlike(whole") == 1


def test_guarded_steps_change_all_that_they_did(spark):
    texts = [
        "é", "  café   naïve  ", "áb ßæ x", "a <!-- b --> c", "a <SCRIPT x>y</script > z",
        "<b>x</b>&amp;lt; &eacute;\x85", "x￿<b>", "a < b & c", "\x01 a \x01", "　x ", "s http://a.b/c ftps://d.e www://f.g!",
        "hhttps://a.b xssh://c.d", "m@a.bc @x", "don’t 'tis", "a  b   c", "",
    ]
    register_functions(spark)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    names = ["remove_url", "remove_html", "remove_accented_chars", "ascii_to_string", "remove_email_address",
             "expand_contractions", "remove_blanks", "clean_text"]
    for name in names:
        found = rows.select("t", getattr(X, name)("t").alias("column"), F.expr(f"{name}_udf(t)").alias("sql")).collect()
        assert [r.sql for r in found] == [r["column"] for r in found], name
    plain = {r.t: r.x for r in rows.select("t", X.remove_accented_chars("t").alias("x")).collect()}
    assert plain[texts[1]] == "  cafe   naive  " and plain[texts[2]] == "ab ssae x"
    cut = {r.t: r.x for r in rows.select("t", X.remove_url("t").alias("x")).collect()}
    assert cut[texts[10]] == "s  ftps://d.e !" and cut[texts[11]] == "h x"
