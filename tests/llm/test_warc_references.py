import html
from html.entities import html5

from auditweave.llm.warc import derivatives, responses

#: Written by hand from the HTML standard.
TEXT = {
    "a &middot; b": "a · b", "l&rsquo;&uuml;": "l’ü", "&laquo;x&raquo;": "«x»", "&CounterClockwiseContourIntegral;": "∳", "&NotEqualTilde;.": "≂̸.", "&frac12;": "½", "&copy 2020": "© 2020", "&notit; &notin;": "¬it; ∉",
    "&amp;middot;": "&middot;", "&#38;lt;": "&lt;", "&AMP;&lt": "&<", "&nosuch; AT&T & x": "&nosuch; AT&T & x", "a&nbsp;b&NonBreakingSpace;c": "a b c", "&copy=1": "©=1", "&#183;&#xb7;&middot;&middot;": "····", "&Eacute;&eacute;": "Éé",
}
LINKS = {"/a?x=1&copy=2&amp;y=&uuml;": "/a?x=1&copy=2&y=ü", "/b?c&middot;d&notit;&copy": "/b?c·d&notit;©"}


def blocks(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html")
    return {(r.source_id, r.type): r.record.split("\r\n\r\n", 1)[1].removesuffix("\r\n\r\n") for r in derivatives(responses(df)).collect()}


def test_named_references(spark):
    page = "<title>&ldquo;T&rdquo; &middot; &amp;lt;</title>" + "".join(f"<p>{k}</p>" for k in TEXT)
    got = blocks(spark, page, "".join(f'<a href="{k}">x</a>' for k in LINKS), "".join(f"<p>[&{n}]</p>" for n in html5))
    assert got[0, "conversion"].split("\n") == ["“T” · &lt;", *TEXT.values()]
    assert got[0, "metadata"] == "title: “T” · &lt;\r\n"
    assert got[1, "metadata"] == "".join(f"outlink: {v}\r\n" for v in LINKS.values())
    spaces = {"nbsp", "nbsp;", "NonBreakingSpace;", "Tab;", "NewLine;"}
    assert {n: line for n, line in zip((n for n in html5 if n != "NewLine;"), got[2, "conversion"].replace("[\n]", "").replace("\n\n", "\n").split("\n"), strict=True) if n not in spaces} == {n: html.unescape(f"[&{n}]") for n in html5 if n not in spaces}


def test_numeric_references(spark):
    """All numbers, in four spellings; Python drops what HTML calls invalid, HTML keeps it."""
    from pyspark.sql import functions as F

    from auditweave.llm.warc import resolved

    numbers = [*range(0x3100), *range(0xD7F0, 0xE010), *range(0xFFF0, 0x10010), *range(0x10FFF0, 0x110010), 10**7, 10**8, 10**9, 10**12, 16**8, 16**20]
    rows = [(n, s) for n in numbers for s in (f"&#{n};", f"&#0000{n}.", f"&#x{n:x};", f"a&#X00{n:X} ")]
    got = spark.createDataFrame([(str(n), s) for n, s in rows], "n string, s string").select("n", "s", resolved(F.col("s")).alias("r"), resolved(F.col("s"), True).alias("a")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = html.unescape(r.s).replace("\xa0", " ")
        kept = want in ("", ".", "a ", "a")  # dropped by Python
        assert kept and len(r.r) == len(want) + 1 or r.r == want, (r.s, r.r, want)
        assert r.a == r.r
    assert spark.range(1).select(resolved(F.lit("&#128;&#65&#x; &#; &#0000065;&#159;x&#xZ")).alias("r")).first().r == "€A&#x; &#; AŸx&#xZ"
