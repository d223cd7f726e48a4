"""Secret scan: patterns for strong secrets, and weak parts of credentials linked by an interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell.llm._common import id_and_text
from nestwell.llm._spans import add_spans, joined, scan

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Base kinds in their listed order: pattern, and what a match must have.
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){_VALUE}[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
#: Weak parts: they count only beside the parts that complete them.
WEAK_ID = rf"(?i:client_?id|access_?key_?id|user_?name|user|login|account(?:_?name)?){_VALUE}[A-Za-z0-9@._-]{{3,}}+"
_KEYS = r"(?:secret[_-]?)?access[_-]?key|(?:secret|account|shared|master|encryption)[_-]?key|pass[_-]?phrase"
#: An access key id given to one of ``_KEYS`` is an identifier and does not complete itself.
WEAK_SECRET = rf"(?:(?i:pass|pwd|auth|private_?key|signing_?key|credential){_VALUE}|(?i:{_KEYS}){_VALUE}(?!AKIA))[A-Za-z0-9+/_.=!@#-]{{6,}}+"
ENDPOINT = r"(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3)://[A-Za-z0-9._:/@%?&=+-]+"
BREAK = r"\n[\x20\t]*\n"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_NEVER = -(1 << 30)
_PART = "struct<start: int, order: int, end: int, kind: string, role: string>"
_REACH = "struct<id: int, secret: int>"


def _parts(spans: str, kind: str, role: str) -> Column:
    order = KINDS.index(kind) if kind in KINDS else -1
    return F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role")))


def _near(parts: Column, gap: Column | None = None, forward: bool = True) -> Column:
    """For each part the place of the nearest identifier and secret before it (or after) in its scope."""
    edge = (lambda p: p["end"]) if forward else (lambda p: p["start"])
    far = F.lit(_NEVER if forward else -_NEVER)
    zero = F.struct(far.alias("id"), far.alias("secret"))

    def step(c: Column, p: Column) -> Column:
        kept = {r: F.when(p["role"] == "break", far).when(p["role"] == r, edge(p)).otherwise(c[r]) for r in ("id", "secret")}
        return F.struct(*[v.alias(k) for k, v in kept.items()])

    return scan(parts if forward else F.reverse(parts), zero, step, lambda c, p: c, _REACH) if forward else F.reverse(scan(F.reverse(parts), zero, step, lambda c, p: c, _REACH))


def scan_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, findings (array of kind, start, end by start, then kind) and their base kinds in ``base``; one row per input row.

    Strong findings stand by themselves: ``assign`` (a value of 8 or more characters given to a secret's
    name), ``access`` (an access key id of 16 or more), ``hex`` (32 or more hexadecimal digits).

    Weak parts are identifiers (``weak_id``), short or loosely named secrets (``weak_secret``) and
    addresses (``endpoint``), each as long as its value runs.  They are joined with complementary parts by interval: two parts meet if they
    lie in one scope (no blank line between them) and within ``reach`` code points.  A weak secret is
    reported beside an identifier, a weak identifier beside a secret, an endpoint beside both; strong
    findings complete weak ones as well.  Parts are sorted by place and swept once in either direction with
    the nearest identifier and secret, so the join makes one row per part and never a pair: a text full of
    parts costs no more than its length.  A weak secret that overlaps a strong finding, wherever
    either begins, is that finding and not reported beside it.  Identifiers and addresses are left out only where they begin on a
    strong finding: one that begins before says whose it is.

    Null text is empty, with no findings; a null id stays null; repeated rows give repeated rows; an empty
    table gives an empty one; other columns are ignored.  One narrow pass, nothing is shuffled.
    """
    t = F.col("text")
    df = id_and_text(docs, id_col, text_col)
    named = t.contains("=") | t.contains(":")
    df = add_spans(df, "text", "_assign", ASSIGN, named)
    df = add_spans(df, "text", "_access", ACCESS, t.contains("AKIA"))
    df = add_spans(df, "text", "_hex", HEX)
    df = add_spans(df, "text", "_weak_id", WEAK_ID, named)
    df = add_spans(df, "text", "_weak_secret", WEAK_SECRET, named)
    df = add_spans(df, "text", "_endpoint", ENDPOINT, t.contains("://"))
    value = rf"^(?i:password|passwd|secret|token|api_?key){_VALUE}"
    df = df.withColumn("_short", F.filter("_assign", lambda s: F.length(F.regexp_replace(s["match"], value, "")) < 8))
    df = df.withColumn("_assign", F.filter("_assign", lambda s: F.length(F.regexp_replace(s["match"], value, "")) >= 8))
    df = df.withColumn("_access", F.filter("_access", lambda s: F.length(s["match"]) >= 16))
    strong = F.array_sort(F.concat(_parts("_assign", "assign", "secret"), _parts("_access", "access", "id"), _parts("_hex", "hex", "secret")))
    df = df.withColumn("_strong", strong)
    df = df.withColumn("_weak", F.concat(_parts("_weak_id", "weak_id", "id"), _parts("_weak_secret", "weak_secret", "secret"), _parts("_short", "weak_secret", "secret"), _parts("_endpoint", "endpoint", "endpoint")))
    df = add_spans(df, "text", "_break", BREAK, F.size("_weak") > 0)
    df = df.withColumn("_all", F.array_sort(F.concat("_strong", "_weak", _parts("_break", "break", "break"))))
    linked = F.arrays_zip(F.col("_all").alias("p"), _near(F.col("_all")).alias("b"), _near(F.col("_all"), forward=False).alias("a"))

    def meets(x: Column, role: str) -> Column:
        return (x["p"]["start"] - x["b"][role] <= reach) | (x["a"][role] - x["p"]["end"] <= reach)

    def whole(x: Column) -> Column:
        kind = x["p"]["kind"]
        return F.when(kind == "weak_id", meets(x, "secret")).when(kind == "weak_secret", meets(x, "id")).when(kind == "endpoint", meets(x, "id") & meets(x, "secret")).otherwise(F.lit(False))

    # the end of the furthest strong finding so far and the start of the next one tell whether a weak part touches either
    strong_at = lambda p: p["order"].between(0, 2)
    covered = scan(F.col("_all"), F.lit(-1), lambda c, p: F.when(strong_at(p), F.greatest(c, p["end"])).otherwise(c), lambda c, p: c, "int")
    ahead = F.reverse(scan(F.reverse("_all"), F.lit(-_NEVER), lambda c, p: F.when(strong_at(p), F.least(c, p["start"])).otherwise(c), lambda c, p: c, "int"))
    free = lambda x: (x["c"] <= x["l"]["p"]["start"]) & ((x["l"]["p"]["kind"] != "weak_secret") | (x["n"] >= x["l"]["p"]["end"]))
    weak = F.transform(F.filter(F.arrays_zip(linked.alias("l"), covered.alias("c"), ahead.alias("n")), lambda x: whole(x["l"]) & free(x)), lambda x: x["l"]["p"])
    df = df.withColumn("_found", F.when(F.size("_weak") > 0, F.array_sort(F.concat("_strong", weak))).otherwise(F.col("_strong")))
    plain = lambda c: F.transform(F.col(c), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return df.select("doc_id", plain("_strong").alias("base"), plain("_found").alias("findings"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base findings and all findings as text."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
