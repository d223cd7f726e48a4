"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell.llm._common import id_and_text
from nestwell.llm._spans import SPAN, add_spans, joined, let, scan

#: Patterns by kind. Possessive repeats and look-behinds keep them linear in the text; they match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of capitals and digits in tokens parted by single blanks, in which IBANs are sought.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})[A-Z0-9]*+(?![A-Za-z0-9])(?:\x20[A-Z0-9]++(?![A-Za-z0-9]))*+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: kind: score of a confirmed span, and the words nearby that raise it by CONTEXT.
SCORES = {
    "email": (0.9, "e-?mail|contact|write|address"),
    "ip": (0.6, r"\bip\b|host|server|address|login"),
    "card": (0.8, "card|visa|mastercard|amex|credit|payment"),
    "phone": (0.7, r"phone|call|mobile|\btel|fax"),
    "iban": (0.8, r"iban|bank|account|konto|compte|cuenta"),
    "ssn": (0.3, r"ssn|social security|tax id"),
}
CONTEXT, BEFORE, AFTER = 0.2, 48, 24
IBAN_LEAST, IBAN_MOST = 15, 34
#: Characters of an IBAN by country; other countries' are the longest that pass.
IBAN_SIZES = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()}
KINDS = tuple(SCORES)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit by Luhn's rule."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (capitals and digits) leaves 1 modulo 97 with its first four characters last."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97) == 1


def _ibans(run: Column) -> Column:
    """Spans of the IBANs in a run, leftmost first, none on another: from a token's start to a token's end.

    Every end within IBAN_MOST characters is tried, so a start costs no more however long the run.
    """
    sizes = F.create_map(*[F.lit(x) for kv in IBAN_SIZES.items() for x in kv])
    # a token longer than any IBAN ends none: a piece of it says as much
    token = "struct<at: int, w: string>"
    placed = scan(F.split(run["match"], " "), F.lit(0), lambda at, w: at + F.length(w) + 1, lambda at, w: F.struct(at.alias("at"), F.left(w, F.lit(IBAN_MOST + 1)).alias("w")), token)

    def longer(a: Column, t: Column) -> Column:
        raw = F.when(F.length(a["raw"]) <= IBAN_MOST, F.concat(a["raw"], t["w"])).otherwise(a["raw"])

        def tried(raw: Column) -> Column:
            n = F.length(raw)
            fits = F.coalesce(F.get(F.map_values(F.map_filter(sizes, lambda k, _: k == F.left(raw, F.lit(2)))), F.lit(0)) == n, F.lit(False))
            ends = F.when(n.between(IBAN_LEAST, IBAN_MOST) & (fits | ~a["fits"]), mod97(raw)).otherwise(F.lit(False))
            return F.struct(raw.alias("raw"), F.when(ends, t["at"] + F.length(t["w"])).otherwise(a["end"]).alias("end"), (a["fits"] | (ends & fits)).alias("fits"))

        return let(raw, tried)

    zero = F.struct(F.lit("").alias("raw"), F.lit(0).alias("end"), F.lit(False).alias("fits"))

    def found(tokens: Column) -> Column:
        each = F.transform(tokens, lambda t, i: F.struct(t["at"].alias("at"), F.when(t["w"].rlike("^[A-Z]{2}[0-9]{2}"), F.aggregate(F.slice(tokens, i + 1, F.lit(IBAN_MOST)), zero, longer)["end"]).otherwise(0).alias("end")))
        good = F.filter(each, lambda c: c["end"] > 0)
        free = scan(good, F.lit(0), lambda to, c: F.when(c["at"] >= to, c["end"]).otherwise(to), lambda to, c: F.struct(c["at"].alias("at"), c["end"].alias("end"), (c["at"] >= to).alias("free")), "struct<at: int, end: int, free: boolean>")
        return F.filter(free, lambda c: c["free"])

    def span(c: Column) -> Column:
        m = run["match"]
        near = lambda at: F.substr(m, F.greatest(F.lit(1), at - BEFORE + 1), F.least(at, F.lit(BEFORE)))
        return F.struct((run["start"] + c["at"]).alias("start"), (run["start"] + c["end"]).alias("end"), F.substr(m, c["at"] + 1, c["end"] - c["at"]).alias("match"), F.right(F.concat(run["before"], near(c["at"])), F.lit(BEFORE)).alias("before"), F.left(F.concat(F.substr(m, c["end"] + 1, F.lit(AFTER)), run["after"]), F.lit(AFTER)).alias("after"))

    return F.transform(let(placed, found), span)


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _scored(kind: str) -> Column:
    base, words = SCORES[kind]

    def row(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit("\n"), s["after"])).rlike(words)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.when(near, F.lit(min(1.0, base + CONTEXT))).otherwise(F.lit(base)).alias("score"))

    return F.transform(F.filter(f"_{kind}", lambda s: _confirmed(kind, s["match"])), row)


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings (array of kind, start, end, score by kind, then start); one row per input row.

    Kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits), iban (mod 97,
    whatever capitals or digits stand around it) and ssn.  A confirmed span has its kind's score, higher by 0.2 with a fitting word within 48 characters
    before or 24 after it, whatever else, numbers and other candidates included, lies between.  Spans below ``threshold`` go; the first
    four kinds always reach 0.5, so with the default only bare ssn patterns do.

    Null text is empty, with no findings; a null id stays null; repeated rows give repeated rows; an empty
    table gives an empty one; other columns are ignored.  One narrow pass, nothing is shuffled.
    """
    t = F.col("text")
    df = id_and_text(docs, id_col, text_col)
    likely = {"email": t.contains("@"), "phone": t.contains("+"), "ip": t.contains("."), "ssn": t.contains("-")}
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("ssn", SSN)):
        df = add_spans(df, "text", f"_{kind}", pattern, likely.get(kind), BEFORE, AFTER)
    df = df.withColumn("_iban", F.when(F.size("_iban") > 0, F.flatten(F.transform("_iban", _ibans))).otherwise(F.array().cast(f"array<{SPAN}>")))
    kept = [_scored(kind) for kind in KINDS]
    return df.select("doc_id", F.filter(F.concat(*kept), lambda s: s["score"] >= threshold).alias("findings"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans and their scores as text."""
    n = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["kind"].isin(*KINDS[:4]))
    scores = F.array_join(F.transform("findings", lambda s: F.format_number(s["score"], 1)), ",")
    return found.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), scores.alias("scores"))
