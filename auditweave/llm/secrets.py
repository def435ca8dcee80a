"""Secret scans with multipart credential linking, in DataFrame functions only.

Base matches (assignments, access key ids, hex runs) are found by one regular expression each. Credentials often come in
parts: an identifier, a secret and an endpoint, none of which is telling alone. Weak candidates of these three roles are
collected too, and an interval join inside each document looks whether a part of a complementary role, weak or base, lies
within ``SCOPE`` characters; only then is the weak candidate reported. The join runs over the parts sorted by position
(running maximum of ends before, nearest start behind), so its cost is linear in the parts of a document.

Edge cases: null and empty texts have no spans; texts of any length are scanned whole; spans that begin at one place (ties)
stand in the order of their kinds; repeated rows get equal rows; an empty table gives an empty table; extra columns are
ignored, whatever their names. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.text import bind, located, running
from auditweave.llm.shared import cut, unused

#: Kinds in the order of ties. The first three are the base.
BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
KINDS = BASE + WEAK
SCOPE = 300
#: The base patterns. A run of hex digits or of an access id that is long enough is the same match as the run
#: without a least length; for assignments the length is asked afterwards, since a short match may hide a later one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN, WEAK_ASSIGN, SECRET_HEX = 12, 6, 32
#: Our own patterns for weak parts.
WEAK_ID = r"""(?i:access_?key(?:_?id)?|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|redis|amqp|mongodb)://[A-Za-z0-9_.~:/@%?&=+-]+"""
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak_id": WEAK_ID, "endpoint": ENDPOINT}
#: Code points of a piece when spans are cut out of a text; a power of two.
CHUNK = 1024
SPAN = "array<struct<start:int,ord:int,end:int,tail:int>>"


def found(text: Column, kind: str) -> Column:
    """start, order of kind, end and length of the first group of every match, left to right."""
    one = lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (m["start"] + F.length(m["text"])).alias("end"), m["tail"].alias("tail"))
    return F.transform(located(text, PATTERNS[kind], 1 if kind == "assign" else 0), one).cast(SPAN)


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["ord"]], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), base spans, and all candidates (weak ones included)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), *(found(text, k).alias(k) for k in PATTERNS))
    short = F.transform(F.filter("assign", lambda s: (s["tail"] < LEAST_ASSIGN) & (s["tail"] >= WEAK_ASSIGN)), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("weak_secret")).alias("ord"), s["end"].alias("end"), s["tail"].alias("tail")))
    base = F.concat(F.filter("assign", lambda s: s["tail"] >= LEAST_ASSIGN), F.col("access"), F.col("hex"))
    weak = F.concat(F.col("weak_id"), short, F.col("endpoint"))
    return cut(rows.select("doc_id", "th", base.alias("base"), weak.alias("weak")))


def linked(scan: DataFrame) -> DataFrame:
    """doc_id, th, spans: the weak candidates with a complementary part in scope."""
    of = lambda *kinds: F.col("s.ord").isin([KINDS.index(k) for k in kinds])
    role = F.when(of("access", "weak_id"), "id").when(of("assign", "weak_secret") | (of("hex") & (F.col("s.end") - F.col("s.start") >= SECRET_HEX)), "secret").when(of("endpoint"), "endpoint")
    parts = scan.filter(F.size("weak") > 0).filter(F.size("weak") + F.size("base") > 1).select("doc_id", "th", F.explode(F.concat("base", "weak")).alias("s")).withColumn("role", role).filter("role is not null").distinct()
    w = Window.partitionBy("doc_id", "th").orderBy("s.start", "s.ord", "s.end")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    near = lambda r: F.coalesce(F.col("s.start") - F.max(F.when(F.col("role") == r, F.col("s.end"))).over(before) <= SCOPE, F.lit(False)) | F.coalesce(F.min(F.when(F.col("role") == r, F.col("s.start"))).over(after) - F.col("s.end") <= SCOPE, F.lit(False))
    parts = parts.select("doc_id", "th", "s", "role", *(near(r).alias(f"by_{r}") for r in ("id", "secret", "endpoint")))
    reported = (F.col("s.ord") >= len(BASE)) & F.when(F.col("role") == "secret", F.col("by_id") | F.col("by_endpoint")).otherwise(F.col("by_secret"))
    return parts.filter(reported).groupBy("doc_id", "th").agg(F.collect_list("s").alias("spans"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, th, base and added (arrays of start, ord, end, tail)."""
    scan = scanned(docs, id_col, text_col)
    extra = linked(scan).select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "spans")
    return scan.join(extra, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left").select("doc_id", "th", "base", F.coalesce("spans", F.array().cast(SPAN)).alias("added"))


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, digest of the base spans, all spans spelled out, number of linked spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["ord"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return secret_spans(docs, id_col, text_col).select("doc_id", *map(n, BASE), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_linked"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, whatever their names; in text_col every span is replaced by ``[SECRET]`` (overlapping spans by one).

    A null text stays null, an empty one empty; repeated rows are redacted alike; an empty table gives an empty table."""
    of, hashed, found = unused(docs, "of", "hashed", "found")
    spans = secret_spans(docs, id_col, text_col).select(F.col("doc_id").alias(of), F.col("th").alias(hashed), F.array_sort(F.concat("base", "added")).alias(found)).filter(F.size(found) > 0).dropDuplicates([of, hashed])
    t = F.col(text_col)

    def cut_out(chunks: Column) -> Column:
        """The text between spans, from chunks of CHUNK code points: a place is found in its chunk, not from the text's beginning."""
        of = lambda x: F.shiftright(x, CHUNK.bit_length() - 1)
        between = lambda a, b: F.array_join(F.slice(chunks, of(a) + 1, of(b - 1) - of(a) + 1), "").substr(a % CHUNK + 1, b - a)
        gap = lambda a, b: F.when(b > a, between(a, b)).otherwise("")

        def joined(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            kept = F.transform(F.col(found), lambda s, i: F.when(s["start"] >= before(i), F.concat(gap(before(i), s["start"]), F.lit("[SECRET]"))).otherwise(""))
            return F.concat(F.array_join(kept, ""), gap(F.element_at(ends, -1), F.length(t)))

        return bind(running(F.transform(F.col(found), lambda s: s["end"]), F.greatest), joined)

    done = bind(F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)), cut_out)
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col(hashed)), "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), t).otherwise(done)).select(*docs.columns)
