import base64
import json
import random
import re
import time

from tallyroom.llm import secretscan

PLAIN = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
}


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans_equal_the_plain_patterns(frame):
    rng = random.Random(41)
    parts = ["token", "Secret", "ſecret", "apiKey", "api_key", "toKen", "passwd", "PASSWORD", " = ", ":", '"', "'", "= ", "abc", "abcdef", "a.b/c+d=", "=",
             "AKIA", "AKIAAKIA", "ABCDEF0123456789", "Z9", "0123456789abcdef", "deadbeef", "F", "g", " ", "\n", "é", "😀", "key"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    texts += [None, "", "a" * 90_000, "token" * 20_000, "token " + " " * 90_000 + "= abcdefg", "AKIA" * 20_000, "-" * 50_000, "ey" * 40_000 + "..", "A" * 80_000 + "..", "é" * 50_000]
    out = {r.doc_id: r for r in secretscan.find(frame(list(enumerate(texts))), ["doc_id", "score"]).collect()}
    for i, t in enumerate(texts):
        listed = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in out[i].secrets if s.kind in secretscan.BASE)
        assert listed == base(t or "")
        assert [(s.kind, s.start, s.end) for s in out[i].secrets if s.kind not in secretscan.BASE] == []
    assert secretscan.find(frame([]), ["doc_id"]).count() == 0


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n, "big")
    return bytes([tag]) + head + body


def number(value):
    return der(2, value.to_bytes(value.bit_length() // 8 + 1, "big"))


P, Q = (1 << 521) - 1, (1 << 607) - 1  # primes
D = pow(65537, -1, (P - 1) * (Q - 1))
RSA = der(0x30, *(number(x) for x in (0, P * Q, 65537, D, P, Q, D % (P - 1), D % (Q - 1), pow(Q, -1, P))))
BROKEN = der(0x30, *(number(x) for x in (0, P * Q + 2, 65537, D, P, Q, 1, 1, 1)))
NAMED = lambda oid, *more: der(0x30, der(6, oid), *more)
EC = der(0x30, number(1), der(4, b"k" * 32), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
PKCS8 = der(0x30, number(0), NAMED(secretscan.RSA, der(5)), der(4, RSA))
PKCS8_EC = der(0x30, number(0), NAMED(secretscan.EC, der(6, b"\x2a\x86")), der(4, EC))
ED = der(0x30, number(0), NAMED(b"\x2b\x65\x70"), der(4, der(4, b"e" * 32)))
LOCKED = der(0x30, NAMED(secretscan.PASSWORD + b"\x0d", der(0x30)), der(4, b"x" * 64))
PFX = der(0x30, number(3), NAMED(secretscan.PKCS7, der(0xA0, der(4, b"y" * 40))))
DSA = der(0x30, *(number(x) for x in (0, 7 * 2**200 * 11 + 1, 11, 4, 16, 3)))
PUBLIC = der(0x30, NAMED(secretscan.RSA, der(5)), der(3, b"\0" + der(0x30, number(P * Q), number(65537))))


def packed(*fields):
    return b"".join(len(f).to_bytes(4, "big") + f for f in fields)


OPENSSH = b"openssh-key-v1\0" + packed(b"none", b"none", b"") + b"\0\0\0\1" + packed(b"public", b"abcdabcd" + b"z" * 40)
PGP = b"\x95\x01\x00\x04" + b"s" * 255 + b"\xb4\x05a@b.c" + b"\xc2\x02ss"


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def token(alg, size, head=None):
    return ".".join(b64(x, True).rstrip("=") for x in (json.dumps(head or {"alg": alg, "typ": "JWT"}).encode(), b'{"sub":"me"}', bytes(range(size))))


def wrapped(data, width=64, end="\n"):
    text = b64(data)
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def pem(name, data, end="\n"):
    return f"-----BEGIN {name}-----{end}{wrapped(data, 64, end)}{end}-----END {name}-----"


def test_structure_confirms_keys_and_tokens(spark, frame):
    cases = [
        (pem("RSA PRIVATE KEY", RSA), "pkcs1-rsa in pem"), (pem("PRIVATE KEY", PKCS8, "\r\n"), "pkcs8-rsa in pem"),
        (pem("PRIVATE KEY", PKCS8_EC, "\\n"), "pkcs8-ec in pem"), (pem("EC PRIVATE KEY", EC), "sec1-ec in pem"),
        (pem("ENCRYPTED PRIVATE KEY", LOCKED), "pkcs8-encrypted in pem"), (pem("OPENSSH PRIVATE KEY", OPENSSH), "openssh in pem"),
        ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n" + wrapped(b"c" * 96) + "\n-----END RSA PRIVATE KEY-----", "encrypted in pem"),
        ("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n" + wrapped(PGP) + "\n=AbCd\n-----END PGP PRIVATE KEY BLOCK-----", "openpgp in pem"),
        (b64(RSA), "pkcs1-rsa in base64"), (wrapped(RSA, 76), "pkcs1-rsa in base64"), (b64(ED), "pkcs8-curve in base64"), (b64(RSA, True), "pkcs1-rsa in base64"),
        (b64(PFX), "pkcs12 in base64"), (RSA.hex(), "pkcs1-rsa in hex"), (RSA.hex().upper(), "pkcs1-rsa in hex"), (b64(DSA), "dsa in base64"), (b64(OPENSSH), "openssh in base64"),
        (b64(pem("EC PRIVATE KEY", EC).encode()), "sec1-ec in pem in base64"), (b64(b64(pem("EC PRIVATE KEY", EC).encode()).encode()), "sec1-ec in pem in base64 in base64"),
        (pem("EC PRIVATE KEY", EC).encode().hex(), "sec1-ec in pem in hex"), (b64(b"the token is " + token("HS256", 32).encode()), "jws-hs256 in base64"),
        (token("HS256", 32), "jws-hs256"), (token("ES512", 132), "jws-es512"), (token("RS256", 256), "jws-rs256"), (token("", 9, {"alg": "X9"}), "jws-x9"),
        (".".join(b64(x, True).rstrip("=") for x in (b'{ "alg":"dir", "enc":"A128GCM"}', b"", b"i" * 12, b"c" * 30, b"t" * 16)), "jwe-dir"),
    ]
    around = [("", ""), ("word ", " word."), ("é😀 key: ", "\nnext line"), ('"', '",'), ("(", ")")]
    rows, wanted = [], {}
    for secret, form in cases:
        for before, after in around:
            i = len(rows)
            rows.append((i, before + secret + after))
            wanted[i] = (len(before), len(before) + len(secret), "token" if "jw" in form else "key", form)
    for glued in ("id_", "x-"):
        rows.append((len(rows), glued + token("HS384", 48)))
        wanted[len(rows) - 1] = (len(glued), len(rows[-1][1]), "token", "jws-hs384")
        rows.append((len(rows), glued + b64(EC)))
        wanted[len(rows) - 1] = (len(glued), len(rows[-1][1]), "key", "sec1-ec in base64")
    out = {r.doc_id: r for r in secretscan.find(frame(rows), ["doc_id"]).collect()}
    for i, expected in wanted.items():
        got = [tuple(s) for s in out[i].secrets if s.kind not in secretscan.BASE]
        assert got == [expected], rows[i][1][:80]
        starts = [(s.start, secretscan.KINDS.index(s.kind)) for s in out[i].secrets]
        assert starts == sorted(starts)


def test_what_structure_does_not_confirm_is_not_reported():
    rng = random.Random(42)
    noise = [
        b64(BROKEN), b64(RSA[:-5]), RSA[:-1].hex(), b64(PUBLIC), pem("PUBLIC KEY", PUBLIC), pem("PRIVATE KEY", b"x" * 200), pem("PRIVATE KEY", PUBLIC),
        token("HS256", 31), token("none", 4), token("RS256", 100), "www.example-host.org.uk", "eyJhbGciOi.eyJhbGciOi.eyJhbGciOi", token("", 32, {"typ": "JWT"}),
        "-----BEGIN PRIVATE KEY-----\nMII", "-----BEGIN PRIVATE KEY-----" * 50, b64(b"openssh-key-v1\0" + b"\0" * 60), b64(b"\x30\x84\xff\xff\xff\xff" + b"z" * 60),
        b64(b"plain words only, nothing else in here at all"), b64(b"[" * 5000) + "." + "a.b", "MIIA_" * 2000,
    ]
    noise += [b64(bytes(rng.randrange(256) for _ in range(300))) for _ in range(50)] + [bytes(rng.randrange(256) for _ in range(80)).hex() for _ in range(50)]
    for text in noise:
        assert secretscan.structured(text) == [], text[:60]


def test_long_runs_take_little_time():
    for text in ("eyJ" * 60_000 + ".a.b", "_MIIA" * 3_000, "A" * 400_000, "ab.cd" * 80_000, "-----BEGIN PRIVATE KEY-----" * 8_000, "0f" * 200_000, ("Q" * 60 + "\n") * 6_000):
        began = time.perf_counter()
        assert secretscan.structured(text) == []
        assert time.perf_counter() - began < 8, text[:20]
