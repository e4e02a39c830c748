"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the few characters and words that any
personal datum must hold: at-signs, plus signs, digits, URL schemes and
identifier cues. Deterministic parsers then expand each anchor to its
boundaries and validate it. A span is (kind, start, end) in code points, end
exclusive; kinds are reported in the order of KINDS, spans by start.

email, ip, card and phone follow the fixed grammar below; per kind they are
leftmost and don't overlap, and one that fails its validation is dropped
without another try inside it. url (an address that carries user
information), address (a street address at a cue word) and account (a valid
IBAN, or an identifier at a cue word) are found beside them. Street and
account cues are those of English, German, French and Spanish. All parsers
run to an item's own boundary, however far that is.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from plexframe.llm.batches import with_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "address", "account")

#: The grammar of the base kinds, from their anchors on.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Cue words of identifiers.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "routing", "konto", "kontonummer", "ausweisnummer", "reisepass", "compte", "passeport", "cuenta", "pasaporte")
#: Cue words of street addresses: behind number and name (12 Baker St.), at the end of a name before the number
#: (Hauptstraße 12), between number and name (12 rue de la Paix), before name and number (Calle Mayor 12).
STREET_BEHIND = ("street", "avenue", "boulevard", "lane", "road", "drive", "st.", "ave.", "blvd.", "ln.", "rd.", "dr.", "square", "court", "terrace")
STREET_WITHIN = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse")
STREET_BETWEEN = ("rue", "avenue", "boulevard", "place", "chemin", "quai", "allée", "impasse")
STREET_BEFORE = ("calle", "avenida", "plaza", "paseo", "carrera", "camino")
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "VA": 22,
}
_URL = re.compile(r"://[A-Za-z0-9._%+-]+:[^\s@/]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|id|#|n°|núm\.?))?[ \t]*[:=#]?[ \t]*([A-Za-z0-9]+(?:[ -][0-9]+|[-/.][A-Za-z0-9]+)*)")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_PARTICLE = r"(?:(?:de|del|de la|de las|de los|du|des|de l'|d'|la|le|les)[ ]?)?"
_NAME = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*"
_BETWEEN = re.compile(rf" {_PARTICLE}{_NAME}(?: {_PARTICLE}{_NAME})*")
_BEFORE = re.compile(rf" {_PARTICLE}{_NAME}(?: {_PARTICLE}{_NAME})*,? (?:n[.º°]? ?)?[0-9]{{1,5}}(?![\w])")
_NUMBER = re.compile(r" [0-9]{1,5}(?: ?[a-z])?(?!\w)")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def iban_at(text: str, start: int) -> int:
    """The end of a valid IBAN that starts here (ISO 7064, of its country's length), -1 if there is none."""
    length = IBAN_LENGTHS.get(text[start : start + 2])
    if not length:
        return -1
    held, at = [], start
    while len(held) < length and at < len(text):
        c = text[at]
        if c.isascii() and c.isalnum():
            held.append(c.upper())
        elif c not in " -" or at == start or not text[at - 1].isalnum():
            return -1
        at += 1
    if len(held) < length or text[at : at + 1].isalnum() or not all("0" <= c <= "9" for c in held[2:4]):
        return -1
    return at if int("".join(str(int(c, 36)) for c in held[4:] + held[:4])) % 97 == 1 else -1


@cache
def anchors() -> ahocorasick.Automaton:
    roles: dict[str, list] = {}
    for d in "0123456789":
        roles[d] = ["digit"]
    roles |= {"@": ["at"], "+": ["plus"], "://": ["scheme"]}
    for role, words in (("account", ACCOUNT_CUES), ("behind", STREET_BEHIND), ("between", STREET_BETWEEN), ("before", STREET_BEFORE)):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                roles.setdefault(form, []).append(role)
    for w in STREET_WITHIN:
        roles.setdefault(w, []).append("within")
    out = ahocorasick.Automaton()
    for form, all_roles in roles.items():
        out.add_word(form, (tuple(all_roles), len(form)))
    out.make_automaton()
    return out


def _start_of_word(text: str, at: int) -> int:
    """Where the run of letters, apostrophes, dots and hyphens that ends at ``at`` begins."""
    while at and (text[at - 1].isalpha() or text[at - 1] in "'’.-"):
        at -= 1
    return at


def _number_before(text: str, at: int) -> int:
    """The start of a house number (1 to 5 digits, perhaps a letter) that ends with a blank at ``at``, -1 if there is none."""
    if not at or text[at - 1] != " ":
        return -1
    end = at = at - 1
    if at and text[at - 1].isalpha():
        at -= 1
    digits = at
    while digits and "0" <= text[digits - 1] <= "9" and at - digits < 6:
        digits -= 1
    if not 1 <= at - digits <= 5 or digits and (text[digits - 1].isalnum() or text[digits - 1] in "_."):
        return -1
    return digits if end > digits else -1


def _address(text: str, role: str, at: int, end: int) -> tuple[int, int] | None:
    """The street address whose cue lies at [at, end)."""
    if role == "within":
        head = _start_of_word(text, at)
        m = _NUMBER.match(text, end)
        return (head, m.end()) if m and head < at and text[head].isupper() else None
    if at and (text[at - 1].isalnum() or text[at - 1] == "_") or text[end : end + 1].isalpha() or text[end : end + 1] == "_":
        return None
    if role == "behind":
        head = at
        for _ in range(3):
            if not head or text[head - 1] != " ":
                return None
            word = _start_of_word(text, head - 1)
            if word == head - 1 or not text[word].isupper():
                return None
            head = word
            if (number := _number_before(text, head)) >= 0:
                return number, end
        return None
    if role == "between":
        number = _number_before(text, at)
        m = _BETWEEN.match(text, end)
        return (number, m.end()) if number >= 0 and m else None
    m = _BEFORE.match(text, end)
    return (at, m.end()) if m and text[at].isupper() else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text; none for null."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = url_end = account_end = street_end = 0
    for last, (roles, size) in anchors().iter(text):
        at = last - size + 1
        for role in roles:
            if role == "digit":
                if at >= card_end and (m := _CARD.match(text, at)):
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                if at >= ip_end and not (at > ip_end and "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
                    ip_end = m.end()
                    if all(_small(x) for x in m.groups()):
                        found["ip"].append(m.span())
                if at >= account_end + 2 and text[at - 1].isupper() and not (at > 2 and text[at - 3].isalnum()) and (end := iban_at(text, at - 2)) >= 0:
                    account_end = end
                    found["account"].append((at - 2, end))
            elif role == "at":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    found["email"].append((start, email_end))
            elif role == "plus":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif role == "scheme":
                if at >= url_end and (m := _URL.match(text, at)):
                    head = at
                    while head > url_end and text[head - 1] in _SCHEME:
                        head -= 1
                    while head < at and not text[head].isalpha():
                        head += 1
                    if head < at:
                        url_end = m.end()
                        found["url"].append((head, url_end))
            elif role == "account":
                whole = not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalpha()
                if whole and at >= account_end and (m := _ACCOUNT.match(text, last + 1)):
                    end = iban_at(text, m.start(1))
                    if end < 0 and sum("0" <= c <= "9" for c in m[1]) >= 6:
                        end = m.end()
                    if end >= 0:
                        account_end = end
                        found["account"].append((m.start(1), end))
            elif at >= street_end and (span := _address(text, role, at, last + 1)):
                street_end = span[1]
                found["address"].append(span)
    return [(k, a, b) for k in KINDS for a, b in sorted(set(found[k]))]


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Replaces every span by its kind in brackets; overlapping spans become one, named by the first."""
    if text is None or not spans:
        return text
    out, end, held = [], 0, None
    for start, stop, kind in sorted((a, -b, k) for k, a, b in spans):
        stop = -stop
        if held and start < held[1]:
            held = (held[0], max(held[1], stop), held[2])
            continue
        if held:
            out += [text[end : held[0]], f"[{held[2].upper()}]"]
            end = held[1]
        held = (start, stop, kind)
    out += [text[end : held[0]], f"[{held[2].upper()}]", text[held[1] :]]
    return "".join(out)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Appends n_email, n_ip, n_card, n_phone, base_sha256, spans and text_redacted.

    Null text counts as empty (and stays null when redacted). Very long
    texts are read whole, repeated rows each return, an empty table stays
    empty. Of overlapping spans of a kind the leftmost counts; spans of
    several kinds may overlap, and are redacted as one under the name of the
    first. Columns of these names in ``docs`` are replaced.
    """
    added = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans", "text_redacted")])

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text_col).to_pylist()
            spans = [find(t) for t in texts]
            base = [[s for s in x if s[0] in BASE] for x in spans]
            return {f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in BASE} | {
                "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base],
                "spans": [joined(x) for x in spans],
                "text_redacted": [redact(t, x) for t, x in zip(texts, spans, strict=True)],
            }

        return kernel

    return with_batches(docs, text_col, make, added)
