import pytest

from jobmarket.functions import html as H

PAGE = """<html><head><title>Jobs &amp; more</title><script>var a="<li>";</script></head><body>
<ul><li><a href="/jobs/1">NURSE</a> <span>P500</span><br><b>Clinic</b><img src=x> Cebu </li>
<li><!-- none --><a href="http://h/jobs/2"> COOK </a>|Posted on 1/2/2026</li></ul>
<p><a href="jobs/3">LOOSE</a></p><a href="/other">x</a><div><a href="/jobs/4"></a></div>
<table><tr><td><a HREF="/jobs/5">CLERK<style>p{}</style></a></td><td>Bank</td></tr></table>
<div class="card big"><h3 class="job-title">Dev <i>ops</i></h3><a class="job-link" href="/d">go</a></div>
<div class="card"><h3>no class</h3></div></body></html>"""


def pages(spark, html=PAGE):
    return spark.createDataFrame([(7, html), (8, None), (9, "")], "page_id bigint, html string")


def test_listings(spark):
    rows = H.extract_listings(pages(spark), "jobs/", "https://b", page="page_id").orderBy("pos").collect()
    got = [(r.page, r.job_url, r.raw_row_text) for r in rows]
    assert got == [
        (7, "https://b/jobs/1", "NURSE | P500 | Clinic | Cebu"),
        (7, "http://h/jobs/2", "COOK | |Posted on 1/2/2026"),
        (7, "https://b/jobs/3", "LOOSE"),
        (7, "https://b/jobs/5", "CLERK | Bank"),
    ]
    assert (rows[0].job_title, rows[0].salary_text, rows[0].employer, rows[0].location) == ("NURSE", "P500", "Clinic", "Cebu")
    assert (rows[1].job_title, rows[1].date_posted) == ("COOK", "1/2/2026")


def test_links(spark):
    rows = H.extract_links(pages(spark), "jobs/", "https://b", "page_id").orderBy("pos").collect()
    assert [r.job_url[-6:] for r in rows] == [f"jobs/{i}" for i in (1, 2, 3, 4, 5)]


def test_cards(spark):
    fields = {"job_title": "h3.job-title", "job_url": "a.job-link", "date_posted": "span.job-date"}
    rows = H.extract_cards(pages(spark), "div.card", fields).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "Devops", "/d", None), (7, 1, None, None, None)]


def test_details(spark):
    rows = H.extract_details(pages(spark), {"job_title": "title", "employer": "a[href*='/jobs/1']", "salary_text": ".salary"}, "page_id")
    assert [tuple(r) for r in rows.orderBy("page_id").collect()] == [
        (7, "Jobs & more", "NURSE", None), (8, None, None, None), (9, None, None, None),
    ]


def test_selector_forms():
    root = H.parse_html("<a class='x y' href='/p/q'>t</a><b class=x>u</b>")
    assert [e.tag for e in root.select(".x")] == ["a", "b"]
    assert [e.text("") for e in root.select("b.x")] == ["u"]
    with pytest.raises(ValueError):
        list(root.select("a > b"))
