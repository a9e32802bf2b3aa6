"""Quality rules, license and secret scans, page text: small tables with every odd case, and SQL on the given ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evalmill.llm import oracles, plans
from evalmill.llm.licenses import TEMPLATES, gate_words, scan_licenses, template_table
from evalmill.llm.pages import extract_pages, main_text
from evalmill.llm.quality import filter_quality, quality_rules
from evalmill.llm.secrets import hot_window, redact_secrets, scan_secrets, written
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, kept string, _row int, secret_spans string"


def odd_rows():
    prose = "the cat and the dog of a house went to be " * 1
    honest = " ".join(f"the {a}{b} of" for a in "bcdfghjklm" for b in ("at", "en", "or", "ul"))
    return [
        (1, None, "x", 1, "s"),
        (2, "", "x", 1, "s"),
        (3, " \n\t ", None, None, None),
        (4, honest, "x", 1, "s"),
        (4, honest, "x", 1, "s"),
        (None, honest, "x", 1, "s"),
        (6, prose * 20, "x", 1, "s"),
        (7, honest + "\n" + honest, "x", 1, "s"),
        (8, "### $$$ " * 60, "x", 1, "s"),
        (9, "long" * 50_000 + " " + honest, "x", 1, "s"),
        (10, "Released under the MIT License.\nkey AKIA" + "Q" * 16 + ' token = "abc123def456"', "x", 1, "s"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def repeat_words(words):
    grams, covered = {}, set()
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            covered |= {p + d for p in places for d in range(3)}
    return len(covered)


def test_quality_counts_and_verdicts(odd):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules(odd).collect()}
    for doc_id, text, *_ in odd_rows():
        words = (text or "").split()
        r = got[(doc_id, len(words))]
        lines = [x for x in (text or "").split("\n") if x.strip()]
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeat_words(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
    assert {k[0] for k, r in got.items() if r["kept"]} == {4, None}


def test_many_repeats_take_the_sorted_way(spark):
    words = [f"w{i % 150}" for i in range(700)] + [f"u{i}" for i in range(200)]
    r = quality_rules(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).first()
    assert r["n_repeat_words"] == repeat_words(words)


def test_filter_keeps_columns_and_rows(odd):
    out = filter_quality(odd)
    assert out.columns == odd.columns and out.count() == 3
    assert filter_quality(odd.limit(0)).count() == 0


def test_secret_spans(odd, spark):
    found = {r["doc_id"]: r["w"] for r in scan_secrets(odd).select("doc_id", written(F.col("secret_spans")).alias("w")).collect()}
    text = odd_rows()[-1][1]
    at, token = text.index("AKIA"), text.index("token")
    assert found[10] == f"access:{at}:{at + 20},assign:{token}:{len(text) - 1}"
    assert found[1] == found[2] == found[4] == ""
    clean = {r["doc_id"]: r["text"] for r in redact_secrets(odd).collect()}
    assert clean[10] == 'Released under the MIT License.\nkey [SECRET] [SECRET]"' and clean[1] is None and clean[9] == odd_rows()[-2][1]
    assert redact_secrets(odd).columns == odd.columns


def test_short_matches_are_consumed(spark):
    rows = [(1, "secret=token =abcdefgh"), (2, "token: a password=longenough1"), (3, "é" * 3 + "Api_Key:'abcdef.-'")]
    got = {r["doc_id"]: r["w"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", written(F.col("secret_spans")).alias("w")).collect()}
    assert got == {1: "", 2: "assign:9:29", 3: "assign:3:20"}


def test_entropy_windows_match_direct_counts(spark):
    import math
    import random

    random.seed(4)
    texts = ["".join(random.choice("abcdefABCDEF0123456789/+"[: random.choice([2, 6, 24])]) for _ in range(random.randint(20, 60))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", hot_window(F.col("v"), 20, 3.5).alias("h"))
    for r in df.collect():
        hot = []
        for i in range(len(r["v"]) - 19):
            part = r["v"][i : i + 20]
            bits = -sum(part.count(c) / 20 * math.log2(part.count(c) / 20) for c in set(part))
            hot += [i] if bits >= 3.5 - 1e-9 else []
        assert (r["h"]["first"], r["h"]["last"]) == ((hot[0], hot[-1]) if hot else (-1, -1))


def test_licenses(odd, spark):
    got = {r["doc_id"]: [(h["license"], h["dice"]) for h in r["license_hits"]] for r in scan_licenses(odd).collect()}
    assert got[10] == [("MIT", 1.0)] and got[1] == got[2] == got[9] == []
    near = "Intro line\n\n" + TEMPLATES["MIT"][2].replace("associated documentation", "associated other") + "\nand more\n\nend"
    (hit,) = scan_licenses(spark.createDataFrame([(near,)], "text string")).first()["license_hits"]
    assert hit["license"] == "MIT" and 0.8 <= hit["dice"] < 1
    table = template_table(TEMPLATES)
    words = gate_words(table, 0.8)
    for _, grams in table:  # fewer bigrams than a match needs are left without a gate word
        left = [g for g in grams if not any(w in g.split() for w in words)]
        assert len(left) < 0.8 / 1.2 * len(grams)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar"><p>Side text that is long enough to look like a paragraph of text</p></div>
<div class="content"><h2>Title &amp; more</h2><p>Para one with <a href=x>link</a> and text&nbsp;here   that is of decent length so that its ratio is big.</p>
<p>Short.</p><ul><li>one<li>two</ul><div class="ad-slot">Buy now</div><p>Another paragraph of decent length with more words in it, surely content.</p>
<form>Name <input></form></div><section id="comments"><p>I like this very much indeed, long comment text of a reader.</p></section></div>
<footer>(c) x</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_page_text(spark):
    want = "Title & more\nPara one with link and text here that is of decent length so that its ratio is big.\nShort.\none\ntwo\n"
    want += "Another paragraph of decent length with more words in it, surely content."
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (3, "v", "", 1), (None, "v", "<p>a<br>b", 1), (5, "w", "<nav>x</nav>", 1), (6, "w", "<<>&#;</", 1)]
    out = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        map(str, [(1, "u", want), (1, "u", want), (2, None, ""), (3, "v", ""), (None, "v", "a b"), (5, "w", ""), (6, "w", "<<>&#;</")])
    )
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert main_text("<p>" + "word " * 100_000).count("word") == 100_000


def test_page_query_against_markup(spark):
    """The given pages keep their article in one element; its blocks are cut out by hand here."""
    import html as entities
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in plans.QUERIES["op10_page_text"](spark, FOLDER).collect():
        body = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql_on_odd_documents(spark, tmp_path, name):
    """The SQL twins agree on rows with nulls, blanks and repeats too, and on an empty table."""
    if name.startswith("op8"):
        schema = "vec_id bigint, embedding array<float>, label int"
        rows = [(i, [((i * 7 + j * 3) % 11 - 5) / 4 for j in range(8)], 0) for i in range(90)]
        rows += [(100, None, 0), (120, [1.0, None], 0), (140, [float("nan")], 0), (160, [], 0), (180, [0.5], 1), (200, [0.5], None), (None, [0.5], 0), (200, [0.5], None)]
        table = "embeddings"
    else:
        schema, rows, table = "doc_id bigint, text string, lang string", [(r[0] if r[0] is not None else 77, r[1], "en") for r in odd_rows() if r[0] != 9], "documents"
    for part, held in (("all", rows), ("none", [])):
        folder = str(tmp_path / part)
        spark.createDataFrame(held, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con = duckdb.connect()
        for t in TABLES:
            if t == table:
                con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
        df = plans.QUERIES[name](spark, folder)
        found = [tuple(r) for r in df.collect()]
        cur = con.execute(oracles.ORACLES[name])
        assert compare(df.columns, found, [d[0] for d in cur.description], cur.fetchall()) == ""
