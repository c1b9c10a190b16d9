"""Secrets by patterns, and by structure that a random string does not have.

Patterns propose assignments, access keys and long hex runs. Beyond them, every
base64 or hex candidate is decoded and reported only if what it holds is sound:
the nested lengths of a private key (PKCS 1, PKCS 8, SEC 1, DSA, PKCS 12, the
OpenSSH and OpenPGP packings) add up and its fields are of the right kind and
size, or a signed token has a JSON header that names its algorithm and a
signature of that algorithm's size. A candidate that decodes to text is searched
again, ``DEPTH`` layers deep. Public keys, certificates and unsigned tokens are
no secrets.

``kind`` is one of KINDS, ``form`` says what was confirmed and through which
encoding, for example ``pkcs8-rsa in pem``. Offsets are code points, ends
exclusive. A run is read once from its start, and once more for every place in it where a key or an object could begin.
Null texts read as empty. Rows are judged one by one: repeated rows and clashing
extra columns change nothing.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.words import output, slices

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "token")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Layers of encoding that are taken off.
DEPTH = 3
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?|PKCS12)-----((?:(?!-----)[\s\S])*+)-----END \1-----")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/]++)*+={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]*+){2,4}")
# A JSON object begins with a brace and a quote or a blank; a key with a sequence, a
# magic word or armour.
OBJECT = re.compile(r"(?=e(?:y[A-DI-L]|w[o0k]))")
BEGINS = re.compile(r"M[A-P]|b3Blbn|LS0t|e(?:y[A-DI-L]|w[o0k])")
# Signature bytes by algorithm (at least so many for the RSA family).
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}
# Object identifiers.
RSA, DSA, EC = b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01", b"\x2a\x86\x48\xce\x38\x04\x01", b"\x2a\x86\x48\xce\x3d\x02\x01"
CURVE, PASSWORD, PKCS7 = b"\x2b\x65", b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x07"
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the element at a place, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        size, at = int.from_bytes(data[at : at + count], "big"), at + count
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int, most: int = 64) -> list[tuple[int, int, int]] | None:
    """All elements of a content, which they must fill exactly."""
    found = []
    while at < end:
        one = element(data, at, end)
        if one is None or len(found) == most:
            return None
        found.append(one)
        at = one[2]
    return found


def numbers(data: bytes, found: list[tuple[int, int, int]]) -> list[int] | None:
    if any(tag != INTEGER or a == b for tag, a, b in found):
        return None
    return [int.from_bytes(data[a:b], "big", signed=True) for _, a, b in found]


def plain_key(data: bytes, begin: int, end: int) -> str | None:
    """The form of the private key that the content of a sequence holds."""
    inner = elements(data, begin, end)
    if not inner or len(inner) < 2:
        return None
    tags = [tag for tag, _, _ in inner]
    values = numbers(data, inner)
    if values and len(values) >= 9 and values[0] in (0, 1) and min(values[1:]) > 0 and values[1] == values[4] * values[5]:
        return "pkcs1-rsa"
    if values and len(values) == 6 and values[0] == 0 and 1 < values[3] < values[1] and (values[1] - 1) % values[2] == 0:
        return "dsa"
    content = lambda k: data[inner[k][1] : inner[k][2]]
    if tags[:2] == [INTEGER, OCTETS] and content(0) == b"\x01" and set(tags[2:]) <= {0xA0, 0xA1} and 16 <= len(content(1)) <= 72:
        return "sec1-ec"
    if tags[:2] == [INTEGER, SEQUENCE] and content(0) == b"\x03":
        held = elements(data, *inner[1][1:])
        if held and held[0][0] == OID and data[held[0][1] : held[0][2]].startswith(PKCS7):
            return "pkcs12"
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and content(0) in (b"\x00", b"\x01"):
        return pkcs8(data, inner)
    if tags == [SEQUENCE, OCTETS]:
        held = elements(data, *inner[0][1:])
        if held and held[0][0] == OID and data[held[0][1] : held[0][2]].startswith(PASSWORD) and len(content(1)) % 8 == 0:
            return "pkcs8-encrypted"
    return None


def pkcs8(data: bytes, inner: list[tuple[int, int, int]]) -> str | None:
    algorithm = elements(data, *inner[1][1:])
    if not algorithm or algorithm[0][0] != OID:
        return None
    name = data[algorithm[0][1] : algorithm[0][2]]
    _, begin, end = inner[2]
    held = element(data, begin, end)
    if held is None or held[2] != end:
        return None
    if name == RSA:
        return "pkcs8-rsa" if held[0] == SEQUENCE and plain_key(data, held[1], end) == "pkcs1-rsa" else None
    if name == EC:
        return "pkcs8-ec" if held[0] == SEQUENCE and plain_key(data, held[1], end) == "sec1-ec" else None
    if name == DSA:
        return "pkcs8-dsa" if held[0] == INTEGER else None
    if name.startswith(CURVE) and len(name) == 3:
        return "pkcs8-curve" if held[0] == OCTETS and end - held[1] in (32, 56, 57) else None
    return None


def openssh(data: bytes) -> tuple[str, int] | None:
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return None
    at, fields = len(mark), []
    while len(fields) < 3 or (fields[3:] and len(fields) < 4 + fields[3] + 1) or len(fields) == 3:
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if len(fields) == 3:  # the number of keys
            if not 1 <= size <= 64:
                return None
            fields.append(size)
            continue
        if at + size > len(data):
            return None
        fields.append(data[at : at + size])
        at += size
    private = fields[-1]
    if len(private) % 8 or len(private) < 16 or (fields[0] == b"none" and private[:4] != private[4:8]):
        return None
    return ("openssh" if fields[0] == b"none" else "openssh-encrypted"), at


def openpgp(data: bytes) -> tuple[str, int] | None:
    """Packets that begin with a secret key and fill the data."""
    at, first = 0, None
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80 or at >= len(data):
            return None
        if head & 0x40:
            tag, size, at = head & 0x3F, data[at], at + 1
            if 192 <= size < 224 and at < len(data):
                size, at = (size - 192) * 256 + data[at] + 192, at + 1
            elif size == 255:
                size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            elif size >= 192:
                return None
        else:
            tag, width = head >> 2 & 0x0F, 1 << (head & 3)
            if width == 8:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if first is None and (tag != 5 or at >= len(data) or data[at] not in (3, 4, 5, 6)):
            return None
        first, at = tag, at + size
    return ("openpgp", at) if first is not None and at == len(data) else None


def key(data: bytes) -> tuple[str, int] | None:
    """The form of the private key that the data begin with, and its bytes."""
    if data[:1] == b"\x30":
        whole = element(data, 0, len(data))
        form = whole and plain_key(data, whole[1], whole[2])
        return (form, whole[2]) if form else None
    return openssh(data)


def unbase64(text: str) -> bytes | None:
    """The bytes of whole groups of either alphabet; a last odd letter is left out."""
    text = text.rstrip("=").translate({45: 43, 95: 47})
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def json_object(data: bytes | None) -> dict | None:
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def readable(letters: str) -> bool:
    """Whether a run begins with text."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(unbase64(letters) or b"\xff")
    except UnicodeDecodeError:
        return False
    return True


def signed(parts: list[str]) -> str | None:
    """The form of the token with these parts."""
    if len(parts) not in (3, 5) or len(parts[0]) % 4 == 1:
        return None
    header = json_object(unbase64(parts[0]))
    name = header and header.get("alg")
    if not isinstance(name, str) or not name:
        return None
    held = [unbase64(p) for p in parts[1:]]
    if any(h is None for h in held) or any(len(p) % 4 == 1 for p in parts[1:]):
        return None
    if len(parts) == 5:
        return f"jwe-{name.lower()}" if isinstance(header.get("enc"), str) and held[2] and held[3] else None
    size, wanted = len(held[1]), SIGNATURE.get(name.upper())
    sound = size == wanted if wanted else size >= 128 if name.upper()[:2] in ("RS", "PS") else size > 0
    return f"jws-{name.lower()}" if sound and held[0] and name.lower() != "none" else None


Found = tuple[int, int, str, str]  # start, end, kind, form


def inside(data: bytes, depth: int) -> tuple[str, str] | None:
    """Kind and form of the first secret in data that are text."""
    if depth >= DEPTH:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    found = structured(text, depth + 1)
    return (found[0][2], found[0][3]) if found else None


def armoured(text: str) -> Iterator[Found]:
    for m in ARMOUR.finditer(text):
        lines = re.split(r"(?:\s|\\[nr])+", re.sub(r"(?m)^[A-Za-z-]+: .*$", "", re.sub(r"\\[nr]", "\n", m[2])))
        pgp = "BLOCK" in m[1]
        data = unbase64("".join(x for x in lines if not (pgp and x.startswith("="))))
        if not data:
            continue
        confirmed = openpgp(data) if pgp else key(data)
        if confirmed:
            yield m.start(), m.end(), "key", f"{confirmed[0]} in pem"
        elif "ENCRYPTED" in m[2] and "DEK-Info" in m[2] and len(data) % 8 == 0:
            yield m.start(), m.end(), "key", "encrypted in pem"


def decoded(letters: str) -> bytes | None:
    """The bytes of a run; of one that begins with a sequence, those that its length names."""
    head = unbase64(letters[:8])
    if head and head[0] == 0x30:
        size = element(head + bytes(4), 0, 1 << 40)
        if size is None:
            return None
        letters = letters[: -(-size[2] * 8 // 6)]
    return unbase64(letters)


def encoded(text: str, depth: int) -> Iterator[Found]:
    for m in RUN.finditer(text):
        found = None
        # A run may stand behind a name joined by a mark of the other alphabet.
        for begin in (m.start(), *(m.start() + p.end() for p in re.finditer(r"[_-]+", m[0]) if BEGINS.match(m[0], p.end()))):
            # Its lines may belong together, or only the first to it.
            line = text.find("\n", begin, m.end())
            for end in (m.end(), *((line,) if line >= 0 else ())):
                data = decoded("".join(text[begin:end].split()))
                confirmed = data and key(data)
                deeper = data and not confirmed and inside(data, depth)
                if confirmed:
                    found = begin, end_of(text, begin, end, -(-confirmed[1] * 8 // 6)), "key", f"{confirmed[0]} in base64"
                elif deeper:
                    found = begin, begin + len(text[begin:end].rstrip()), deeper[0], f"{deeper[1]} in base64"
                if found:
                    break
            if found:
                yield found
                break
    for m in HEX_RUN.finditer(text):
        data = binascii.unhexlify(m[0][: len(m[0]) // 2 * 2])
        confirmed = key(data)
        if confirmed:
            yield m.start(), m.start() + 2 * confirmed[1], "key", f"{confirmed[0]} in hex"
            continue
        deeper = inside(data, depth)
        if deeper:
            yield m.start(), m.end(), deeper[0], f"{deeper[1]} in hex"


def end_of(text: str, begin: int, end: int, letters: int) -> int:
    """The place behind so many letters of a run with line ends, and its padding."""
    at = begin
    while at < end and letters:
        letters -= not text[at].isspace()
        at += 1
    while at < end and text[at] == "=":
        at += 1
    return at


def tokens(text: str) -> Iterator[Found]:
    for m in DOTTED.finditer(text):
        head = m[0].index(".")
        for start in OBJECT.finditer(m[0], 0, head):
            if not readable(m[0][start.start() : min(head, start.start() + 64)]):
                continue
            parts = m[0][start.start() :].split(".")
            # A full stop after a token ends the sentence.
            while len(parts) > 3 and not parts[-1]:
                parts.pop()
            form = signed(parts) or (signed(parts[:3]) if len(parts) > 3 else None)
            if form:
                size = len(".".join(parts if form.startswith("jwe") else parts[:3]))
                yield m.start() + start.start(), m.start() + start.start() + size, "token", form
                break


def structured(text: str, depth: int = 0) -> list[Found]:
    """What structure confirms; a span inside an earlier one is part of it."""
    found: list[Found] = []
    for one in sorted([*armoured(text), *encoded(text, depth), *tokens(text)], key=lambda f: (f[0], -f[1])):
        if not found or one[0] >= found[-1][1]:
            found.append(one)
    return found


def scan(text: str) -> list[Found]:
    """All spans by start, then kind."""
    found: list[Found] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), "assign", m[1].lower()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", "") for m in HEX.finditer(text)]
    found += structured(text)
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string())]))


def find(documents: DataFrame, keep: list[str], text: str = "text", out: str = "secrets") -> DataFrame:
    """The columns ``keep`` of every row and ``out``: its spans (start, end, kind, form)."""
    source = documents.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_scanned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_scanned"):
                spans = [[dict(zip(("start", "end", "kind", "form"), f)) for f in scan(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(spans, SPANS)], names=[*keep, out])

    return source.mapInArrow(run, output(source, keep, f"{out} array<struct<start:int,end:int,kind:string,form:string>>"))
