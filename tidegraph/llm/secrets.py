"""Secret scans with structural confirmation.

Base patterns (assign, access, hex) are reported as they match. Beyond them, candidates are decoded and reported only when
their structure holds: base64 or hex that parses as a private key in DER (PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA; every
nested length must fit its parent exactly) or in OpenSSH's format (every length-prefixed field must fit), armoured
blocks of such keys (also quoted, or as a string in JSON or code), and signed tokens whose header is JSON with an algorithm and
whose parts decode.

Scans are linear in the text: a run of digits is delimited once, candidates in it read the few bytes that hold lengths, and only
what has a key's shape is decoded whole; a token's header is decoded in growing pieces, as far as it can be one.

Kinds in order: assign, access, hex, armour, der, openssh, token. Offsets are code points, end exclusive.

Edge cases: null or empty text: no spans, the digest of the empty string. Ties at one start sort by kind. Repeated rows are
scanned each for itself; null doc_id stays null; an empty table gives no rows; very long texts are scanned whole; further
columns are ignored by the query and kept by redact_documents. Limits of the formats: elements nested deeper than DEPTH, or
more than 64 keys in one OpenSSH file, are no key.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_column

KINDS = ("assign", "access", "hex", "armour", "der", "openssh", "token")
BASE = KINDS[:3]
DEPTH = 24
KEYWORDS = r"(password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----", re.A)
#: Where a key may start in a run of its digits; what follows is read only as far as its own lengths say.
BASE64_KEY = re.compile(r"M[A-I](?=[A-Za-z0-9+/_-]{30})|b3BlbnNzaC1rZXktdjEA")
HEX_KEY = re.compile(r"30(?=[0-9a-f]{62})|6f70656e7373682d6b65792d763100(?=[0-9a-f]{40})", re.I | re.A)
BASE64_RUN, HEX_RUN = re.compile(r"[A-Za-z0-9+/_\r\n-]+"), re.compile(r"[0-9a-f]+", re.I | re.A)
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
#: Base64 of "{" and a quotation mark or white space.
HEADER = re.compile(r"e(?:y[A-DI-L]|w[k-r0-3])(?=[A-Za-z0-9_-]{5})")
#: What a text must hold for each search to be worth it; a batch is tested at once, before any Python runs per text.
SIEVES = {
    "assign": "(?i)" + KEYWORDS + """["']? *[:=]""",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "armour": "-----END [A-Z0-9 ]*PRIVATE KEY-----",
    "base64": "M[A-I][A-Za-z0-9+/_-]{30}|b3BlbnNzaC1rZXktdjEA",
    "hexkey": "(?i)30[0-9a-f]{62}|6f70656e7373682d6b65792d763100",
    "token": r"e[wy][A-Za-z0-9_-]{6,}\.",
}
OPENSSH = b"openssh-key-v1\0"


class NoKey(ValueError):
    pass


class Coded:
    """Bytes behind digits, decoded where they are read."""

    def __init__(self, length: int, read):
        self.length, self.read = length, read

    def __getitem__(self, k: int) -> int:
        return self.read(k, k + 1)[0]

    @staticmethod
    def plain(data: bytes) -> Coded:
        return Coded(len(data), lambda a, b: data[a:b])


def der_head(data: Coded, at: int) -> tuple[int, int, int]:
    """Tag, begin and end of the body of the DER element at a place."""
    if at + 2 > data.length:
        raise NoKey
    head = data.read(at, min(at + 6, data.length))
    tag, size, body = head[0], head[1], at + 2
    if tag & 31 == 31:
        raise NoKey
    if size >= 128:
        n = size & 127
        if not 1 <= n <= 4 or body + n > data.length:
            raise NoKey
        size, body = int.from_bytes(head[2 : 2 + n]), body + n
        if size < 128 or size >> 8 * (n - 1) == 0:
            raise NoKey  # not the shortest form
    return tag, body, body + size


def der_shape(data: Coded, start: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill a range exactly, whatever is in them; more than a key has are none."""
    out = []
    while start < end:
        tag, a, b = der_head(data, start)
        if b > end or len(out) > 12:
            raise NoKey
        out.append((tag, a, b))
        start = b
    return out


def fill_exactly(data: Coded, parts: list[tuple[int, int, int]], depth: int = 0) -> None:
    """Constructed elements must be filled exactly in turn."""
    if depth > DEPTH:
        raise NoKey
    for tag, start, end in parts:
        if tag & 32:
            inner = []
            while start < end:
                inner.append(der_head(data, start))
                start = inner[-1][2]
            if start != end:
                raise NoKey
            fill_exactly(data, inner, depth + 1)


def der_length(data: Coded) -> int:
    """The bytes of a DER private key at the start of data; 0 if there is none. Most of what isn't one is told by a few heads."""
    try:
        tag, a, b = der_head(data, 0)
        if tag != 0x30 or b > data.length:
            return 0
        # The first element, before others are walked: a version, or the algorithm of an encrypted key.
        first_tag, first_a, first_b = der_head(data, a)
        if first_tag == 2 and first_b - first_a == 1 and data[first_a] > 1 or first_tag not in (2, 0x30):
            return 0
        parts = der_shape(data, a, b)
        tags = [t for t, _, _ in parts]
        first = data.read(*parts[0][1:]) if first_tag == 2 and first_b - first_a == 1 else b""
        inner = lambda k: der_shape(data, *parts[k][1:])
        if len(tags) >= 9 and tags[:9] == [2] * 9:
            good = first in (b"\0", b"\1")  # PKCS#1
        elif tags == [2] * 6:
            good = first == b"\0"  # DSA
        elif tags[:3] == [2, 0x30, 4] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            good = first in (b"\0", b"\1") and inner(1)[0][0] == 6 and parts[2][2] > parts[2][1]  # PKCS#8
        elif tags[:2] == [2, 4] and set(tags[2:]) <= {0xA0, 0xA1}:
            good = first == b"\1" and parts[1][2] - parts[1][1] >= 14  # SEC 1
        elif tags == [0x30, 4]:
            body = inner(0)  # PKCS#8, encrypted: by RSADSI's PKCS#5 or PKCS#12
            good = len(body) >= 2 and body[0][0] == 6 and data.read(*body[0][1:]).startswith(bytes.fromhex("2a864886f70d01"))
        else:
            good = False
        if not good:
            return 0
        fill_exactly(data, parts)
        return b
    except (NoKey, IndexError):
        return 0


def is_der_key(data: bytes) -> bool:
    """Whether bytes are one DER private key and nothing else."""
    return der_length(Coded.plain(data)) == len(data) > 0


def openssh_length(data: Coded) -> int:
    """The bytes that an OpenSSH private key at the start of data takes; 0 if there is none."""
    at = len(OPENSSH)
    if data.length < at or data.read(0, at) != OPENSSH:
        return 0

    def number() -> int:
        if at + 4 > data.length:
            raise NoKey
        return struct.unpack(">I", data.read(at, at + 4))[0]

    def string() -> int:
        nonlocal at
        size = number()
        at += 4 + size
        if at > data.length:
            raise NoKey
        return size

    try:
        if not string():
            return 0
        string(), string()
        if not 1 <= (n := number()) <= 64:
            return 0
        at += 4
        for _ in range(n):
            string()
        return at if string() >= 8 else 0
    except NoKey:
        return 0


def may_begin(head: bytes) -> bool:
    """Whether a dozen bytes may be how a key begins: a sequence of a version, or of an algorithm with its identifier."""
    if head[:1] == OPENSSH[:1]:
        return True
    at = 2 + (head[1] & 127 if head[1] & 128 else 0)
    if at + 2 >= len(head):
        return at <= 6
    if head[at] == 2:
        return head[at + 1] > 1 or head[at + 2] < 2
    at += 2 + (head[at + 1] & 127 if head[at + 1] & 128 else 0) if head[at] == 0x30 else len(head) + 16
    return at < len(head) + 4 and (at >= len(head) or head[at] == 6)


def key_kind(data: Coded) -> tuple[str, int] | None:
    """The kind of the private key with which data begins, and its bytes."""
    if (n := openssh_length(data)) :
        return "openssh", n
    return ("der", n) if (n := der_length(data)) else None


def decode64(text: str) -> bytes:
    """As many whole bytes as base64 of either alphabet gives."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def armoured(body: str) -> bool:
    """Whether what stands between the markers of an armoured block is a private key. It may be quoted, or a string in code or
    JSON: line ends written \\n, quotation marks, and > or | or # before lines are passed over."""
    body = re.sub(r"\\r|\\n", "\n", body)
    body = re.sub(r"""["']\s*\+\s*["']""", "\n", body)
    lines = [x.strip(" \t>|#*\"',;\\") for x in body.splitlines()]
    lines = [x for x in lines if x]
    headers = {}
    while lines and ":" in lines[0]:
        name, _, value = lines.pop(0).partition(":")
        headers[name.strip()] = value.strip()
    data = decode64("".join("".join(lines).split()))
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        return "DEK-Info" in headers and len(data) >= 16 and len(data) % 8 == 0
    found = key_kind(Coded.plain(data))
    return found is not None and found[1] == len(data)


def armour_blocks(text: str):
    """Armoured blocks with a key: each END closes the nearest BEGIN before it, if that says the same."""
    begun = None
    for m in MARKER.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        else:
            if begun is not None and begun[2] == m[2] and armoured(text[begun.end() : m.start()]):
                yield begun.start(), m.end()
            begun = None


def base64_keys(text: str):
    """Keys in bare base64. Lines may be broken; the key's own length says where it ends."""
    at, stop = 0, 0
    while m := BASE64_KEY.search(text, at):
        at = m.start() + 1
        if at > stop:
            run = BASE64_RUN.match(text, m.start())
            start, stop = run.span()
            breaks = [k for k in range(start, stop) if text[k] in "\r\n"] if "\n" in run.group() or "\r" in run.group() else []
            digits = run.group().replace("\r", "").replace("\n", "").replace("-", "+").replace("_", "/")
            # Of each break, its place among digits: what digits come before it.
            places = [k - start - j for j, k in enumerate(breaks)]
        first = m.start() - start - bisect_left(breaks, m.start())
        if not may_begin(base64.b64decode(digits[first : first + 16])):
            continue

        def read(a: int, b: int) -> bytes:
            p, q = a // 3 * 4, -(-b // 3) * 4
            some = digits[first + p : first + q]  # noqa: B023
            return base64.b64decode(some + "=" * (-len(some) % 4))[a % 3 : a % 3 + b - a]

        found = key_kind(Coded((len(digits) - first) * 3 // 4, read))
        if found is None:
            continue
        used = -(-found[1] * 4 // 3)
        last = first + used - 1
        end = start + last + bisect_right(places, last) + 1
        pads = -used % 4
        while pads and text[end : end + 1] == "=":
            end, pads = end + 1, pads - 1
        yield found[0], m.start(), end
        at = end


def hex_keys(text: str):
    at, stop = 0, 0
    while m := HEX_KEY.search(text, at):
        first = m.start()
        at = first + 1
        if at > stop:
            stop = HEX_RUN.match(text, first).end()
        if not may_begin(bytes.fromhex(text[first : first + 24])):
            continue
        found = key_kind(Coded((stop - first) // 2, lambda a, b: bytes.fromhex(text[first + 2 * a : first + 2 * b])))  # noqa: B023
        if found:
            yield found[0], first, first + 2 * found[1]
            at = first + 2 * found[1]


def header_of(digits: str, start: int) -> dict | None:
    """The JSON object that base64 from a place to its end is, read in growing pieces, as far as it can be one."""
    size = 16
    while True:
        whole = start + size >= len(digits)
        data = decode64(digits[start : start + size])
        try:
            text = data.decode()
            found = json.loads(text)
            if whole:
                return found if isinstance(found, dict) else None
        except UnicodeDecodeError as e:
            if whole or e.start < len(data) - 3:
                return None
        except json.JSONDecodeError as e:
            if whole or e.pos < len(text) - 12 and not e.msg.startswith("Unterminated"):
                return None
        except (ValueError, RecursionError):
            return None
        size *= 4


def is_token(parts: list[str], head: dict) -> bool:
    """Whether the parts of a signed or encrypted token are what its header says."""
    if not isinstance(head.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and all(decode64(x) for x in parts[2:])
    if len(parts) != 3 or (not decode64(parts[2]) and head["alg"].lower() != "none"):
        return False
    try:
        return bool(decode64(parts[1])) and (head.get("b64") is False or "zip" in head or isinstance(json.loads(decode64(parts[1])), dict))
    except (ValueError, RecursionError):
        return False


def tokens(text: str):
    """Parts joined by dots are found once; headers are looked for in each part, up to its end."""
    for area in DOTTED.finditer(text):
        parts = area.group().split(".")
        begin, free = area.start(), 0  # where a part begins; what lies before free is in a token already
        for k, part in enumerate(parts[:-2]):
            for m in HEADER.finditer(part) if begin >= free else ():
                head = header_of(part, m.start())
                if head is None:
                    continue
                for n in (5, 3):
                    some = [part[m.start() :], *parts[k + 1 : k + n]]
                    if len(some) == n and is_token(some, head):
                        free = begin + m.start() + len(".".join(some))
                        yield "token", begin + m.start(), free
                        break
                if free > begin:
                    break
            begin += len(part) + 1


def scan(text: str, sieved: set[str] | None = None) -> list[tuple[int, int, int, int]]:
    """Spans as (start, number of the kind, end, start of what is secret in it), sorted. sieved: the searches to run, else all."""
    run = SIEVES.keys() if sieved is None else sieved
    found = []
    if "assign" in run:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for name, kind, pattern in (("access", 1, ACCESS), ("hex", 2, HEX)):
        if name in run:
            found += [(m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text)]
    if "armour" in run:
        found += [(a, 3, b, a) for a, b in armour_blocks(text)]
    for name, search in (("base64", base64_keys), ("hexkey", hex_keys), ("token", tokens)):
        if name in run:
            found += [(a, KINDS.index(kind), b, a) for kind, a, b in search(text)]
    return sorted(found)


def sieve(texts: pa.Array) -> list[set[str]]:
    """Per text the searches that can find something."""
    out: list[set[str]] = [set() for _ in range(len(texts))]
    for name, pattern in SIEVES.items():
        for k in pc.indices_nonzero(pc.match_substring_regex(texts, pattern)).to_pylist():
            out[k].add(name)
    return out


def scan_batch(texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    return [scan(texts[k].as_py(), names) if names else [] for k, names in enumerate(sieve(texts))]


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b, _ in spans)


def redact(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with what is secret in its spans replaced; names before an assignment stay."""
    out, at = [], 0
    for a, b in sorted((secret, b) for _, _, b, secret in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in found] for found in scan_batch(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars, where there is one, counted anew for texts that changed. Null texts stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("_text"))
        clean = [redact(t.as_py(), found) if found else None for t, found in zip(texts, scan_batch(texts), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(clean, pa.string())], [*batch.schema.names[:-1], "_text"])

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text_column().alias("_text"))
    kind = f"_row {docs.select(F.struct(*[docs[c] for c in docs.columns]).alias('r')).schema['r'].dataType.simpleString()}, _text string"
    done = map_batches(held, run, kind)
    changed = F.col("_text").isNotNull()
    new = {"text": F.when(changed, F.col("_text")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))
    return done.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def digest_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = scan_batch(batch.column(1))
    count = lambda kind: pa.array([sum(k == kind for _, k, _, _ in spans) for spans in found], pa.int64())
    base = [hashlib.sha256(joined([x for x in spans if x[1] < len(BASE)]).encode()).hexdigest() for spans in found]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())],
        ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), text_column().alias("text"))
    return map_batches(docs, digest_batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
