"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, a dot or plus before a digit, digits, URL
schemes and identifier cues. At each anchor a small deterministic parser expands to the boundaries of the
span and validates it. Every parser remembers where its last match ended, so matches of a kind never overlap
and the work is linear in the text.

Null and empty texts give zero counts and empty span lists; rows are treated one by one, so repeated rows,
ties and null ids simply come back as they are. Only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds in the contract's order, their character sets and limits.
BASE = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds that the method adds to the base ones.
MORE = ("url", "iban", "ssn", "local_phone", "address", "secret")
KINDS = BASE + MORE

URL = re.compile(r"[^\s<>\"'\x00-\x1f]+")
IBAN = re.compile(r"[:\s]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"[:#\s]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])")
HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-Z][\w'-]{0,30}){1,4}$")
AFTER_STREET = re.compile(r" [0-9]{1,5}[a-z]?(?!\w)")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-./+]{12,})")
AWS = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")

DIGITS = "0123456789"
SCHEMES = ("http://", "https://", "ftp://")
STREET_AFTER_NUMBER = (" Street", " Avenue", " Road", " Lane", " Boulevard", " St.", " Ave.", " Rd.")
STREET_BEFORE_NUMBER = ("straße", "strasse", "Straße")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")


def anchors():
    """The automaton: anchor text to (parser, length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    put = lambda word, kind: a.add_word(word, (kind, len(word)))
    put("@", "email")
    put("IBAN", "iban")
    put("SSN", "ssn")
    put("AKIA", "aws")
    for d in DIGITS:
        put(f".{d}", "ip")
        put(f"+{d}", "phone")
        put(f"({d}", "local_phone")
        put(d, "card")
    for word in SCHEMES:
        put(word, "url")
    for word in STREET_AFTER_NUMBER:
        put(word, "street")
    for word in STREET_BEFORE_NUMBER:
        put(word, "strasse")
    for word in SECRET_CUES:
        put(word, "secret")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def iban_holds(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans_of(text: str | None, automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, by start and then kind; code points, end exclusive."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    number = {k: i for i, k in enumerate(KINDS)}
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    at_sign = dot = 0  # just after the last anchor of its kind

    def put(kind: str, start: int, end: int) -> None:
        done[kind] = end
        found.append((start, number[kind], end))

    for last, (anchor, length) in automaton.iter(text):
        p = last - length + 1
        if anchor == "card":
            if p < done["card"]:
                continue
            m = CARD.match(text, p)
            done["card"] = m.end() if m else p + 1
            if m and 14 <= m.end() - p <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    put("card", p, m.end())
        elif anchor == "email":
            left = text[max(at_sign, done["email"]) : p]
            at_sign = p + 1
            if k := len(left) - len(left.rstrip(LOCAL)):
                if m := DOMAIN.match(text, p + 1):
                    put("email", p - k, m.end())
        elif anchor == "ip":
            left = text[max(dot, done["ip"]) : p]
            dot = p + 1
            if p >= done["ip"] and (k := len(left) - len(left.rstrip(DIGITS))):
                if m := IP.match(text, p - k):
                    done["ip"] = m.end()
                    if all(map(small_part, m[0].split("."))):
                        put("ip", p - k, m.end())
        elif anchor == "phone":
            if p >= done["phone"] and (m := PHONE.match(text, p)):
                done["phone"] = m.end()
                if 10 <= sum(map(str.isdecimal, m[0])) <= 15:
                    put("phone", p, m.end())
        elif anchor == "local_phone":
            if p >= max(done["phone"], done["local_phone"]) and (m := LOCAL_PHONE.match(text, p)):
                put("local_phone", p, m.end())
        elif anchor == "url":
            if p >= done["url"] and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    put("url", p, end)
        elif anchor == "secret":
            if p >= done["secret"] and (m := SECRET.match(text, last + 1)):
                put("secret", m.start(1), m.end(1))
        elif anchor == "aws":
            if p >= done["secret"] and (m := AWS.match(text, p)):
                put("secret", p, m.end())
        elif anchor == "street":
            if p >= done["address"] and (m := HOUSE.search(text[max(done["address"], p - 160) : p])):
                put("address", p - len(m[0]), last + 1)
        elif anchor == "strasse":
            left = text[max(done["address"], p - 40) : p]
            k = len(left) - len(left.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzäöüß-"))
            if m := AFTER_STREET.match(text, last + 1):
                put("address", p - k, m.end())
        elif anchor == "iban":
            if (m := IBAN.match(text, last + 1)) and iban_holds(m[1]):
                put("iban", m.start(1), m.end(1))
        elif (m := SSN.match(text, last + 1)):
            put("ssn", m.start(1), m.end(1))
    found.sort()
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        start, kind, end = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        automaton = anchors()
        for batch in batches:
            out: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": [], "n_more": []}
            for value in batch.column(1):
                found = spans_of(value.as_py(), automaton)
                base = [x for x in found if x[1] < len(BASE)]
                for i, k in enumerate(BASE):
                    out[f"n_{k}"].append(sum(x[1] == i for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
                out["n_more"].append(len(found) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items())],
                [batch.schema.names[0], *out],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    narrow = docs.select(F.col(doc_id), F.col(text).cast("string"))
    return narrow.mapInArrow(run, f"`{doc_id}` {kind}, {counts}, base_sha256 string, spans string, n_more long")


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced by placeholders, all columns kept; ``n_chars`` follows the text."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        automaton = anchors()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [redacted(v := x.as_py(), spans_of(v, automaton)) for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if n_chars is not None and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        changed = F.coalesce(F.length(text).cast(kind), F.col(n_chars))
        out = out.withColumn(n_chars, changed)
    return out
