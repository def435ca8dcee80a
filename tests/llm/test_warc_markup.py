from tests.llm.test_warc_references import blocks


def test_bare_less_than_and_kinds_of_href(spark):
    links = """<a href="/l'eau">1</a><a href='/say"x"'>2</a><a class=c href=/bare/x?y=1>3</a><a HREF = "">4</a><a href="/p?a=1&amp;b=2">5</a>"""
    got = blocks(spark, "<div>if a < b and c <3 then</div><p>e</p><br/><!DOCTYPE x><i>f</i>", links)
    assert got[0, "conversion"] == "if a < b and c <3 then\ne\nf"
    assert got[1, "metadata"].split("\r\n") == ["outlink: /l'eau", 'outlink: /say"x"', "outlink: /bare/x?y=1", "outlink: ", "outlink: /p?a=1&b=2", ""]
