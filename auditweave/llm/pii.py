"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Four base kinds (mail addresses, IPv4 addresses, card numbers, phone numbers) are found exactly and always reported.
Further candidates are written-out mail addresses, local phone numbers, long numbers, IBANs, social security numbers and
names of persons. For every candidate and every base span six labelers vote yes, no or nothing:

* form: a strict pattern of the kind;
* check: check digits or number ranges;
* gazetteer: top-level domains, issuers, calling codes, countries, first names and surnames;
* cue: words before the span that announce the kind, in four languages;
* contra: words before the span that announce something else (versions, orders, amounts);
* alone: whether the span stands between word borders.

Votes and eight shape bits of a span are one number, so the corpus is a count of each kind and number: counts of all spans
of all rows reach the fit, in a table bounded by the possible votes, whatever the corpus' size. For each kind
expectation-maximisation over these counts (two classes, votes independent given the class) estimates how often each
labeler is right when it votes, kept within ``RANGE`` so that classes cannot change places, and each pattern's share of
true spans. A logistic span classifier over votes, shape and kind is trained on these shares, weighted by the counts, and
compiled into a column expression. A candidate is reported if its score reaches ``REPORT``, labelers of two sorts (pattern,
gazetteer, context) vote for it and its check does not fail: a number with wrong check digits is nobody's card.

All patterns are walked in linear time: mail addresses from their @, IP addresses by whole chains of numbers. Edge cases:
null and empty texts have no spans; texts of any length are read whole; spans that begin at one place (ties) stand in the
order of their kinds; repeated rows get equal rows and count each time; an empty table gives an empty table; extra columns
are ignored, whatever their names. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.arrowio import bounded_batches, id_text
from auditweave.llm.shared import cut

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail_words", "iban", "ssn", "long_number", "local_phone", "person")
LABELERS = ("form", "check", "gazetteer", "cue", "contra", "alone")
SORTS = (("form", "check"), ("gazetteer",), ("cue",))
SHAPES = 8
#: Patterns the classifier is fitted on at most, the most frequent first.
MAX_PATTERNS = 50_000
REPORT, ROUNDS, RANGE, PRIOR, PSEUDO = 0.9, 100, (0.55, 0.99), (0.02, 0.98), 10.0

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

MAIL_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])", re.I)
MAIL_SIGNS = re.compile(r"[(\[{](?:at|dot)[)\]}]", re.I)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+@.])(?:\(?[0-9]{2,5}\)?[ ./-]{1,2}){1,5}[0-9]{2,8}(?![0-9A-Za-z@])")
LOCAL_FORMS = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|0[0-9]{2,4}\)?[ /-][0-9]{4,8}|0[0-9](?:[ .-][0-9]{2}){4}|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}")
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Herrn|Señor|Señora|Monsieur|Madame|Mme|Mlle"
FIRST = "Anna|Maria|Laura|Julia|Sarah|Emma|Sophie|Clara|Helena|Martha|Susan|Karen|Linda|Nancy|Lisa|Sandra|Ashley|Emily|Donna|Carol|James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Steven|Paul|Andrew|Peter|Hans|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Markus|Heike|Sabine|Ursula|Monika|Petra|Pierre|Jacques|François|Nicolas|Julien|Camille|Nathalie|Isabelle|Sylvie|Carlos|José|Antonio|Manuel|Francisco|Javier|Miguel|Carmen|Dolores|Pilar|Lucía|Elena"
NAME = r"[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:-[A-ZÀ-Þ][a-zß-ÿ]{1,30})?"


def persons() -> re.Pattern:
    """A title and names, or a first name and a name; by first letter, so that the search skips to capitals that can begin one."""
    by = lambda names, c: "|".join(x[1:] for x in names.split("|") if x[0] == c) or "(?!)"
    letters = sorted({x[0] for x in f"{TITLES}|{FIRST}".split("|")})
    return re.compile("|".join(rf"{c}(?<!\w.)(?:(?:{by(TITLES, c)})\.? {NAME}(?: {NAME}){{0,2}}|(?:{by(FIRST, c)}) {NAME})\b" for c in letters))


PERSON = persons()
TITLED, NAMED = re.compile(rf"(?:{TITLES})\.? "), re.compile(rf"(?:(?:{TITLES})\.? )?(?:{FIRST})\b")
SURNAMES = frozenset("Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young King Wright Scott Green Baker Adams Nelson Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Hofmann Lange Krüger Bernard Dubois Durand Moreau Laurent Lefebvre Leroy Roux Fournier Girard Bonnet Dupont Lambert García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Ruiz Hernández Díaz Moreno Álvarez Romero Navarro Torres".split())
TLDS = frozenset("com org net edu gov mil int info biz name io co uk de fr es it nl be ch at eu us ca au jp cn in br mx pl pt se no dk fi ie ru dev app example test local".split())
COUNTRIES = frozenset("AD AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
CALLING = re.compile(r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|3[68]")
_cues = {
    "email": "e-?mail|mail|contact|write to|kontakt|schreib|courriel|contactez|correo|escrib[ae]", "ip": "ip|address|host|server|from|client|adresse|dirección|serveur|servidor",
    "card": "card|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta|payment", "phone": "phone|tel|telephone|call|mobile|fax|cell|telefon|ruf|handy|téléphone|appel|teléfono|móvil|llam",
    "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social security|sozialversicherung|sécurité sociale|seguridad social", "person": "name|contact|signed|dear|sincerely|by|from|kontakt|liebe[r]?|gezeichnet|signé|cher|nombre|firmado|estimad[oa]",
}
CUES = {k: re.compile(rf"\b(?:{_cues[c]})\b", re.I) for k, c in {**{k: k for k in _cues}, "mail_words": "email", "long_number": "card", "local_phone": "phone"}.items()}
CONTRA = re.compile(r"\b(?:version|ver|v|release|build|section|chapter|page|isbn|issn|order|invoice|article|item|ticket|rev|revision|kapitel|seite|rechnung|bestellung|chapitre|facture|commande|capítulo|página|factura|pedido)\b[ .:#]{0,3}$|[$€£#]\s?$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back from an @ as far as its letters go, not behind the match before."""
    free = at = 0
    while (p := t.find("@", at)) >= 0:
        local = p - at - len(t[at:p].rstrip(LOCAL))
        if local and (m := DOMAIN.match(t, p + 1)):
            yield p - local, m.end()
            free = m.end()
        at = max(p + 1, free)


def ips(t: str) -> Iterator[tuple[int, int]]:
    """Chains of numbers, four at a time."""
    for m in CHAIN.finditer(t):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield at, end
            at = end + 1


def cards(t: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(t):
        digits = NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(t: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(t):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def long_numbers(t: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(t):
        if 13 <= len(NOT_DIGIT.sub("", m.group())) <= 19:
            yield m.span()


def local_phones(t: str) -> Iterator[tuple[int, int]]:
    for m in LOCAL_PHONE.finditer(t):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


SPANS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "long_number": long_numbers, "local_phone": local_phones}
MORE = {"mail_words": MAIL_WORDS, "iban": IBAN, "ssn": SSN, "person": PERSON}
#: What a text must have for a kind to be looked for.
DIGIT = re.compile("[0-9]")


def spelled_mail(t: str) -> bool:
    return any(x in t for x in (" dot ", " DOT ", " Dot ")) or (any(x in t for x in "([{") and MAIL_SIGNS.search(t) is not None)


def candidates(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): all base spans, and further ones that overlap neither those nor one another (earlier kinds first)."""
    digits = DIGIT.search(t) is not None
    has = {"email": "@" in t, "phone": "+" in t, "mail_words": spelled_mail(t), "person": True}
    base = [(s, k, e) for k, kind in enumerate(BASE) if has.get(kind, digits) for s, e in SPANS[kind](t)]
    out = sorted(base)
    taken = sorted((s, e) for s, _, e in out)
    for k, kind in enumerate(KINDS[len(BASE) :], len(BASE)):
        if not has.get(kind, digits):
            continue
        found = [m.span() for m in MORE[kind].finditer(t)] if kind in MORE else list(SPANS[kind](t))
        if found:
            fresh = apart(found, taken)
            out += [(s, k, e) for s, e in fresh]
            taken = sorted(taken + fresh)
    return sorted(out)


def apart(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of found (in order, disjoint) that overlap none of taken (by start)."""
    if not taken:
        return found
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken]))
    s, e = np.array(found).T
    k = np.searchsorted(starts, e)  # those that begin before the span ends
    reach = np.where(k > 0, ends[np.maximum(k - 1, 0)], 0)
    return [x for x, free in zip(found, (reach <= s).tolist(), strict=True) if free]


def judged(kind: str, x: str) -> tuple[int, int, int]:
    """Votes of form, check and gazetteer on a span's text: 1, -1 or 0."""
    yes = lambda b: 1 if b else -1
    digits = NOT_DIGIT.sub("", x)
    if kind in ("email", "mail_words"):
        domain = re.sub(r" ?(?:[(\[{]dot[)\]}]| dot |\.) ?", ".", re.split(r"@|[(\[{]at[)\]}]| at ", x, maxsplit=1, flags=re.I)[1], flags=re.I).strip().lower()
        last = domain.rpartition(".")[2]
        return yes(re.fullmatch(r"[a-z]{2,24}", last)), (1 if kind == "email" else yes(re.search(r"[(\[{]at[)\]}]", x, re.I) or " dot " in x.lower())), yes(last in TLDS)
    if kind == "ip":
        parts = [int(p) for p in x.split(".")]
        return yes(all(p == str(int(p)) for p in x.split("."))), yes(0 < parts[0] < 255), (-1 if parts[0] in (0, 127) else 0)
    if kind in ("card", "long_number"):
        return yes(len(digits) in (13, 14, 15, 16, 19) and re.fullmatch(r"[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", x)), yes(luhn(digits) and len(set(digits)) > 1), yes(ISSUERS.match(digits))
    if kind == "phone":
        return yes(re.fullmatch(r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){1,6}", x)), yes(x.count("(") == x.count(")")), yes(CALLING.match(digits))
    if kind == "local_phone":
        return yes(LOCAL_FORMS.fullmatch(x)), yes(x.count("(") == x.count(")") and len(set(digits)) > 2), 0
    if kind == "iban":
        flat = x.replace(" ", "")
        return yes(15 <= len(flat) <= 34), yes(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1), yes(flat[:2] in COUNTRIES)
    if kind == "ssn":
        return 1, yes(x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"), 0
    titled, last = TITLED.match(x), x.rpartition(" ")[2]
    return yes(titled), 0, (1 if NAMED.match(x) and last in SURNAMES else 0 if NAMED.match(x) or last in SURNAMES else -1)


def pattern(t: str, s: int, e: int, kind: str) -> int:
    """Votes (a bit for yes and one for no of each labeler) and shape bits of a span."""
    x = t[s:e]
    line = t[max(s - 40, 0) : s]
    line = line[line.rfind("\n") + 1 :]
    left, right = t[s - 1 : s], t[e : e + 1]
    votes = (*judged(kind, x), 1 if CUES[kind].search(line) else 0, -1 if CONTRA.search(line) else 0, -1 if left.isalnum() or right.isalnum() else 1)
    out = 0
    for k, v in enumerate(votes):
        out |= (v > 0) << 2 * k | (v < 0) << 2 * k + 1
    shape = (e - s > 12, e - s > 20, not line.strip(), line.rstrip()[-1:] in (":", "="), "|" in line, right in (".", ",", ";"), any(c in " -()." for c in x), sum(c.isdigit() for c in x) * 2 > e - s)
    for k, b in enumerate(shape, 2 * len(LABELERS)):
        out |= bool(b) << k
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())])


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans (start, kind, end, pattern), base spans and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"start": s, "kind": k, "end": e, "pattern": pattern(t, s, e, KINDS[k])} for s, k, e in candidates(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], ["doc_id", "spans"])

    return bounded_batches(id_text(docs, id_col, text_col)).mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,end:int,pattern:int>>")


def ballots(patterns: np.ndarray) -> np.ndarray:
    """Votes as rows of 1, -1, 0."""
    k = np.arange(len(LABELERS))
    return ((patterns[:, None] >> 2 * k) & 1) - ((patterns[:, None] >> 2 * k + 1) & 1)


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation of one kind: each row's share of true spans, and the labelers' shares of right votes on true and on false spans."""
    yes, no = (votes > 0) * 1.0, (votes < 0) * 1.0
    right, wrong, prior = np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.8), 0.5
    share = np.full(len(votes), 0.5)
    for _ in range(ROUNDS):
        log = np.log(prior / (1 - prior)) + yes @ np.log(right / (1 - wrong)) + no @ np.log((1 - right) / wrong)
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        t, f = counts * new, counts * (1 - new)
        right = np.clip((t @ yes + 0.8 * PSEUDO) / (t @ (yes + no) + PSEUDO), *RANGE)
        wrong = np.clip((f @ no + 0.8 * PSEUDO) / (f @ (yes + no) + PSEUDO), *RANGE)
        prior = float(np.clip((t.sum() + 0.5 * PSEUDO) / (counts.sum() + PSEUDO), *PRIOR))
        done, share = np.abs(new - share).max(initial=0) < 1e-9, new
        if done:
            break
    return share, right, wrong


BITS = 2 * len(LABELERS) + SHAPES


def inputs(kinds: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    return np.concatenate([(patterns[:, None] >> np.arange(BITS)) & 1, kinds[:, None] == np.arange(len(KINDS))], 1).astype(np.float64)


def classifier(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic span classifier, trained on the shares that the labelers' votes give (Newton steps)."""
    shares = np.zeros(len(kinds))
    for k in np.unique(kinds):
        of = kinds == k
        shares[of] = reliabilities(ballots(patterns[of]), counts[of])[0]
    x, w = inputs(kinds, patterns), np.zeros(BITS + len(KINDS))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - shares)) + ridge * w
        curve = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(spans: DataFrame) -> np.ndarray:
    """The classifier for a table of labelled spans; counts of equal votes and shapes reach the driver, no rows."""
    counted = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.pattern").alias("pattern")).count()
    rows = counted.orderBy(F.col("count").desc(), "kind", "pattern").limit(MAX_PATTERNS).toArrow()
    columns = [rows.column(c).to_numpy().astype(np.int64) for c in ("kind", "pattern")]
    return classifier(*columns, rows.column("count").to_numpy().astype(np.float64))


def score(span: Column, weights: np.ndarray) -> Column:
    out = F.element_at(F.array(*map(F.lit, weights[BITS:].tolist())), span["kind"] + 1)
    for k, w in enumerate(weights[:BITS].tolist()):
        out = out + F.when(F.getbit(span["pattern"], F.lit(k)) == 1, w).otherwise(0.0)
    return 1 / (1 + F.exp(-out))


def backed(span: Column) -> Column:
    """Whether labelers of two sorts vote for a span and its check does not vote against it."""
    voices = [F.when(sum((F.getbit(span["pattern"], F.lit(2 * LABELERS.index(n))) for n in sort), F.lit(0)) > 0, 1).otherwise(0) for sort in SORTS]
    return (sum(voices, F.lit(0)) >= 2) & (F.getbit(span["pattern"], F.lit(2 * LABELERS.index("check") + 1)) == 0)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: float = REPORT) -> DataFrame:
    """Per row: doc_id, base and added (arrays of start, kind, end, pattern, by start, then kind)."""
    spans = cut(labelled(docs, id_col, text_col))
    weights = fitted(spans)
    added = F.filter("spans", lambda s: (s["kind"] >= len(BASE)) & backed(s) & (score(s, weights) >= report))
    return spans.select("doc_id", F.filter("spans", lambda s: s["kind"] < len(BASE)).alias("base"), added.alias("added"))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, digest of the base spans, all spans spelled out, number of added spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return personal_data(docs, id_col, text_col).select("doc_id", *map(n, range(len(BASE))), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
