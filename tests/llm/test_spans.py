import hashlib
import random
import re

from nestwell.llm import pii, secret_scan

NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"


def base_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [(2, m.start(), m.end(), "card")] if 13 <= len(d) <= 19 and luhn(d) else []
    out += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{a}:{b}" for _, a, b, k in sorted(out)]


def held(rows, texts, base, kinds):
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id][:200], want)
        assert [r[f"n_{k}"] for k in kinds] == [sum(w.startswith(k + ":") for w in want) for k in kinds]
        assert set(want) <= set(r.spans.split(","))


def texts_of(bits, seed, n=700):
    rnd = random.Random(seed)
    return {i: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for i in range(n)}


def test_secrets_equal_brute_force(frame):
    bits = ["token", "secret", "password", "api_key", "APIKEY", "ſecret", "=", ":", " ", "  ", '"', "'", "abc", "deadbeef" * 4, "AKIA", "AKIAABCDEFGH1234", "Z9", "\n\n", "\n", "user", "client_id = x9y", "pass: hunter2!", "https://h.example/x", "é", "😀", "===="]
    texts = texts_of(bits, 5) | {9001: "a" * 500_000, 9002: "token = abcdefgh1 " * 3000, 9003: "user=abc token: x " * 3000}
    held(secret_scan.report(secret_scan.scan_secrets(frame(texts.items()))).collect(), texts, base_secrets, ("assign", "access", "hex"))


def test_pii_equals_brute_force(frame):
    bits = ["a", "b.c", "@", ".", "x%", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "-", " ", "+1 (555) 123-4567", "+", "(", "1.2.3.4", "😀", "é", "GB82 WEST 1234 5698 7654 32", "iban ", "123-45-6789", "ssn ", "\n", "000"]
    texts = texts_of(bits, 6) | {9001: "1" * 200_000, 9002: "x@" + "a." * 50_000 + "b", 9003: "1." * 50_000, 9004: "a@b.co " * 5000}
    held(pii.report(pii.find_pii(frame(texts.items()))).collect(), texts, base_pii, ("email", "ip", "card", "phone"))


def spans(frame, text):
    return secret_scan.report(secret_scan.scan_secrets(frame([(1, text)]))).first().spans


def test_weak_parts_need_their_complement(frame):
    assert spans(frame, "user=bob pass: hunter2!x") == "weak_id:0:8,weak_secret:9:24"
    assert spans(frame, "pass: hunter2!x alone") == "" and spans(frame, "user=bob alone") == ""
    assert spans(frame, "client_id=abc\n\npass: hunter2!") == "", "another scope"
    assert spans(frame, "user=bob" + " " * 300 + "pass: hunter2!") == "", "too far"
    assert spans(frame, "https://x.y/z user=bob token=abcdefgh99") == "endpoint:0:13,weak_id:14:22,assign:23:39"
    assert spans(frame, "https://x.y/z token=abcdefgh99") == "assign:14:30", "an address needs both"
    assert spans(frame, "AKIAABCDEFGH1234 pwd=hunter22") == "access:0:16,weak_secret:17:29"


def test_weak_spans_hold_whole_values(frame):
    key, name = "Ab9/" * 200, "bob." * 50
    assert spans(frame, f'user=bob private_key="{key}"') == "weak_id:0:8,weak_secret:9:822"
    assert spans(frame, f"user={name} pass: hunter2!x") == "weak_id:0:205,weak_secret:206:221"
    assert spans(frame, f"user=bob pass: {key * 100}") == "weak_id:0:8,weak_secret:9:80015"


def test_counterparts_of_identifiers_and_schemes(frame):
    for name in ("aws_secret_access_key", "secret_access_key", "SecretAccessKey", "access_key", "secret_key", "passphrase"):
        found = spans(frame, f"aws_access_key_id = AKIAABCDEFGH1234\n{name} = wJalrXUtnFEMI/K7MDENG").split(",")
        assert found[0] == "weak_id:4:36" and found[1] == "access:20:36" and found[2].startswith("weak_secret:"), name
    assert spans(frame, "AccountName=store;AccountKey=Zm9vYmFy/w==") == "weak_id:0:17,weak_secret:18:41"
    assert spans(frame, "access_key = AKIAABCDEFGH1234") == "access:13:29", "an identifier does not complete itself"
    for scheme in ("postgresql", "postgres", "mongodb+srv", "rediss", "amqps"):
        n = len(scheme) + 7
        assert spans(frame, f"{scheme}://h.io user=bob pass: hunter2!x") == f"endpoint:0:{n},weak_id:{n + 1}:{n + 9},weak_secret:{n + 10}:{n + 25}"


def test_scores(frame):
    def got(text):
        r = pii.report(pii.find_pii(frame([(1, text)]))).first()
        return r.spans, r.scores

    assert got("iban GB82 WEST 1234 5698 7654 32 ok") == ("iban:5:32", "1.0") and got("x GB83 WEST 1234 5698 7654 32 ok")[0] == ""
    assert got("my ssn 123-45-6789") == ("ssn:7:18", "0.5") and got("x 123-45-6789") == ("", "")
    assert got("card 4111111111111111")[1] == "1.0" and got("4111111111111112") == ("", "")
    assert got("host 1.2.3.4")[1] == "0.8" and got("1.2.3.4.5")[0] == "ip:0:7"


def test_ibans_beside_capitals_and_numbers(frame):
    texts = ["DE89370400440532013000 BIC COBADEFF", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 EUR 500", "GB82 WEST 1234 5698 7654 32 2024 paid", "DE89370400440532013000, x", "AB12 X GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 Z", "DE88370400440532013000 BIC COBADEFF", "GB82 WEST 1234 5698 7654 321", "GB82 WEST 1234 5698 7654 32a"]
    want = ["0:22", "0:27", "0:22", "0:27", "0:22", "7:34,iban:35:62", "", "", ""]
    got = {r.doc_id: r.spans for r in pii.report(pii.find_pii(frame([*enumerate(texts), (99, "AB12 " * 8000)]))).collect()}
    mine = lambda k: [x for x in got[k].split(",") if x.startswith("iban")]
    assert [mine(k) for k in range(len(texts))] == [[f"iban:{x}" for x in w.replace("iban:", "").split(",") if x] for w in want]
    near = pii.report(pii.find_pii(frame([(1, "DE89370400440532013000 KONTO")]))).first()
    assert (near.spans, near.scores) == ("iban:0:22", "1.0"), "words of the same run count"


def test_edge_rows(frame, oddities):
    for op, rep in ((secret_scan.scan_secrets, secret_scan.report), (pii.find_pii, pii.report)):
        assert sorted(str(r.doc_id) for r in rep(op(frame(oddities))).collect()) == sorted(str(i) for i, _ in oddities)
        assert rep(op(frame([]))).count() == 0


def test_nothing_but_sql(frame):
    for df in (secret_scan.scan_secrets(frame([(1, "x")])), pii.find_pii(frame([(1, "x")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1  # the fixture's own
