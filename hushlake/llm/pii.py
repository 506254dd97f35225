"""Personal data in whole texts: patterns propose, checksums confirm, context decides.

Each kind has a pattern, a prior score, a checksum or a rule of validity where there is one
(Luhn for cards, mod-97 for IBANs and French social security numbers, mod-23 for
Spanish identity numbers, mod-11,10 for German tax numbers, the blocks in use for US
social security numbers), and words that raise the score when they stand near the span; other
words lower it.  Spans of the base kinds (email, ip, card, phone) are kept
whatever their score; those of further kinds have to reach the threshold, and
whether they do depends on the words around them.

Every search is linear in the text: it starts at a rare byte (an at sign, a
plus sign, a dot between digits, a long run of digits) that is found for many
texts at once, so most texts are never decoded, and no pattern is tried again
inside what it has already read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Texts, chunks
from .scratch import small_batches

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "dni", "nir", "tax")
KINDS = BASE + MORE

# Fixed patterns of the base kinds. A look-behind for a digit only stops a second look at the inside of a run of digits.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DNI = re.compile(r"(?<![A-Za-z0-9])(?:[XYZ][0-9]{7}|[0-9]{8})-?[A-Z](?![A-Za-z0-9])")
_NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
_TAX = re.compile(r"(?<![0-9])[1-9][0-9] ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Lengths of IBANs by country (ISO 13616), and the letters of Spanish identity numbers.
IBAN_LENGTHS = dict(
    x.split(":")
    for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 "
        "GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 "
        "MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 "
        "TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Words that speak for a kind when they stand near it as whole words, and words that speak against any.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "client", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer", "bic", "swift"),
    "ssn": ("ssn", "social security", "taxpayer", "tax id", "social-security"),
    "dni": ("dni", "nif", "nie", "identidad", "documento", "identity"),
    "nir": ("nir", "securite sociale", "sécurité sociale", "insee", "numero de securite", "vitale"),
    "tax": ("steuer-id", "steuerid", "idnr", "steuernummer", "steueridentifikationsnummer", "identifikationsnummer", "tax id"),
}
AGAINST = ("example", "sample", "order", "isbn", "part no", "serial", "version", "ticket", "beispiel", "exemple", "ejemplo")
#: Before context: an IBAN is kept unless words speak against it, the numbers after it only if words speak for them.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "dni": 0.4, "nir": 0.4, "tax": 0.25}
REACH, RAISE, FALL = 48, 0.3, 0.25
THRESHOLD = 0.5


def _words(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)")


_FOR, _AGAINST = {k: _words(v) for k, v in CONTEXT.items()}, _words(AGAINST)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the remainder is 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def dni(text: str) -> bool:
    """The letter is the rest of the number by 23; X, Y and Z stand for 0, 1 and 2."""
    number = text[:-1].rstrip("-")
    return DNI_LETTERS[int(str("XYZ".find(number[0])) + number[1:] if number[0] in "XYZ" else number) % 23] == text[-1]


def nir(digits: str) -> bool:
    """The last two digits are 97 less the rest of the others by 97; months are 01 to 12, or 20 and above."""
    return 97 - int(digits[:13]) % 97 == int(digits[13:]) and (1 <= int(digits[3:5]) <= 12 or int(digits[3:5]) >= 20)


def mod11_10(digits: str) -> bool:
    """ISO 7064 over ten digits and a check digit; one digit occurs twice or three times among the ten."""
    product = 10
    for d in digits[:-1]:
        total = (int(d) + product) % 10 or 10
        product = total * 2 % 11
    times = sorted(digits[:-1].count(d) for d in set(digits[:-1]))
    return (11 - product) % 10 == int(digits[-1]) and times[-1] in (2, 3) and times[-2] < 2


def ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def context_score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, raised by a word for it and lowered by a word against it within REACH characters; at most 1."""
    # a word that begins before the reach does not count
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    if start > REACH and text[start - REACH - 1].isalnum():
        before = before.lstrip("".join({c for c in before if c.isalnum()}))
    if end + REACH < len(text) and text[end + REACH].isalnum():
        after = after.rstrip("".join({c for c in after if c.isalnum()}))
    near = f"{before}|{after}".lower()
    return round(min(1.0, PRIOR[kind] + RAISE * bool(_FOR[kind].search(near)) - FALL * bool(_AGAINST.search(near))), 6)


def _ibans(text: str) -> list[tuple[int, int]]:
    """Each from where the one before ended; the length that its country has, or else the longest that the checksum confirms."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        want = IBAN_LENGTHS.get(m[0][:2])
        for end in range(m.end(), m.start() + 14, -1):
            raw = text[m.start() : end].replace(" ", "")
            whole = text[end - 1] != " " and (end == len(text) or not text[end].isalnum())
            if whole and (len(raw) == int(want) if want else 15 <= len(raw) <= 34) and mod97(raw):
                out.append((m.start(), end))
                at = end
                break
    return out


def _valid(pattern: re.Pattern, valid, digits: bool = False):
    return lambda text: [m.span() for m in pattern.finditer(text) if valid(_NOT_DIGIT.sub("", m[0]) if digits else m[0])]


_FIND = dict(zip(KINDS, (_emails, _ips, _cards, _phones, _ibans, _valid(_SSN, ssn), _valid(_DNI, dni), _valid(_NIR, nir, True), _valid(_TAX, mod11_10, True)), strict=True))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of KINDS; offsets in code points."""
    out = [(k, a, b, context_score(k, text, a, b)) for k, f in _FIND.items() for a, b in f(text)]
    return sorted((x for x in out if x[0] in BASE or x[3] >= THRESHOLD), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def _candidates(texts: Texts) -> np.ndarray:
    """Rows that may hold anything: an at sign; digits next to each other, or a dot, hyphen or space apart; plus and digit; two capitals and two digits."""
    data = texts.data
    digit = _DIGIT[data]
    n = len(data)
    hits = [np.flatnonzero(data == 0x40)]
    if n >= 3:
        hits.append(np.flatnonzero(digit[:-2] & digit[2:] & ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2D) | (data[1:-1] == 0x20) | digit[1:-1])))
        hits.append(np.flatnonzero((data[:-1] == 0x2B) & digit[1:]))
    if n >= 4:  # also the X and seven digits of a Spanish number, by its digits
        upper = (data >= 0x41) & (data <= 0x5A)
        hits.append(np.flatnonzero(upper[:-3] & upper[1:-2] & digit[2:-1] & digit[3:]))
    return np.unique(np.searchsorted(texts.offsets, np.concatenate(hits), side="right") - 1)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def redact(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


_NONE = hashlib.sha256(b"").hexdigest()


def _run(with_text: bool):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                n = len(texts)
                counts = {k: np.zeros(n, dtype=np.int64) for k in KINDS}
                base, spans, found, clean = [_NONE] * n, [""] * n, [[] for _ in range(n)], [None] * n
                for r in _candidates(texts).tolist():
                    text = texts.text(r)
                    hits = find(text)
                    if not hits:
                        continue
                    for k, *_ in hits:
                        counts[k][r] += 1
                    base[r] = hashlib.sha256(joined(h for h in hits if h[0] in BASE).encode()).hexdigest()
                    spans[r] = joined(hits)
                    found[r] = [dict(zip(("kind", "start", "stop", "score"), h, strict=True)) for h in hits]
                    clean[r] = redact(text, hits) if with_text else None
                if with_text:
                    clean = [texts.text(r) if c is None else c for r, c in enumerate(clean)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.lo, n), *(pa.array(counts[k]) for k in KINDS), pa.array(base), pa.array(spans), pa.array(found, pa.list_(span)), pa.array(clean, pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found", "redacted"],
                )

    return run


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, n_iban, n_ssn, n_dni, n_nir, n_tax, base_sha256, spans, found, redacted.

    base_sha256 is the digest of the base spans and `spans` lists all spans, both
    as kind:start:end (code points, end exclusive) joined by commas; found has them
    as structs with their scores; redacted is the text without them (null if
    not with_text).

    Null text counts as empty and has no spans; null and repeated ids pass
    through, a row comes back for each input row; other columns are ignored,
    whatever their names; texts of any length are searched whole, in linear time.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = "".join(f", n_{k} long" for k in KINDS)
    return rows.mapInArrow(_run(with_text), f"doc_id long{counts}, base_sha256 string, spans string, found array<struct<kind:string,start:long,stop:long,score:double>>, redacted string")
