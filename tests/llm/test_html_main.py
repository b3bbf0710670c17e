import numpy as np
from pyspark.sql import functions as F

from lodeworks.llm.html_main import LABELLED, blocks_of, extract, grow, labelled_rows, main_text, predict

TREE = grow(*labelled_rows())


def test_tree_fits_the_labelled_table_and_unseen_pages():
    x, y = labelled_rows()
    assert len(y) == sum(len(labels) for _, labels in LABELLED)
    assert np.array_equal(predict(TREE, x) > 0.5, y == 1)
    # Leave one page out.
    hits = total = 0
    for i in range(len(LABELLED)):
        cut = np.cumsum([0] + [len(labels) for _, labels in LABELLED])
        out = np.arange(len(y))
        test = (out >= cut[i]) & (out < cut[i + 1])
        hits += int(((predict(grow(x[~test], y[~test]), x[test]) > 0.5) == y[test]).sum())
        total += int(test.sum())
    assert hits / total >= 0.8


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="page has-sidebar"><nav><ul><li><a href="/x">X</a><li><a href='>'>Y</a></ul></nav>
<div class="ad">Buy it.</div><div id="cookie-banner"><p>We use cookies and more of them than you think.</p></div>
<article class="post"><h1>Head&lt;1&gt;</h1><p>One &eacute;<b>bold</b>\n  two<br>three&nbsp;x<p>Four <!-- <p>no</p> --> 5 < 6 &amp; 7
<ul><li>i<li>ii</ul><form>Name <input><button>Go</button></form><div class="share-buttons">Share</div>
<section class="comments"><article><p>I was here and read it all through twice.</p></article></section></article>
<aside>Aside.</aside><footer>&copy; f</footer></body></html>"""


def test_page_with_everything():
    assert main_text(PAGE, TREE) == "Head<1>\nOne ébold two three x\nFour 5 < 6 & 7\ni\nii"


def test_odd_pages():
    assert main_text(None, TREE) == "" and main_text("", TREE) == "" and main_text("<p>", TREE) == ""
    assert main_text("<article><p>cut off in the mid", TREE) == "cut off in the mid"
    assert main_text("<article><p>a<script>never closed <p>x", TREE) == "a"
    assert main_text("<article>x</b></div>y<p>z</article>", TREE) == "x\ny\nz"
    long = "<article>" + "<p>w </p>" * 20000 + "</article>"
    assert main_text(long, TREE).count("w") == 20000
    assert [b.linked for b in blocks_of("<p>a <a>b</a></p>")] == [["b"]]


def test_query_columns_and_cases(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted((tuple(r) for r in got.collect()), key=repr)
    assert [r[3] for r in out] == [len(r[2]) for r in out] and out[0] == out[1]
    assert sorted(r[2] for r in out)[:2] == ["", ""] and extract(df.limit(0)).count() == 0
