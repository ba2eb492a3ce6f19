"""Personal data: generators propose spans, boosted trees with calibrated thresholds select.

Base spans (emails, IPv4 addresses, payment cards, phone numbers in international form) are always
personal data. Beside them, generators of high recall propose spans in looser forms, which may
overlap: spelled-out emails, account numbers, identity numbers, phone numbers without a country
code, IPv6 addresses, long random tokens (with all their parts where dots join them). Each candidate has features of its format and of the text around it. No
table marks personal data, so the trees learn from two sets of labelled candidates: those of the
corpus whose format proves or refutes them (a check digit, a key word right before, an impossible
number), and examples that `made_examples` writes, with near misses of every kind beside what is meant:
UUIDs, digests, part numbers, dates, code paths, times, prose with "at" and "dot", places in the web after "at".
A candidate is added if its calibrated probability reaches its kind's threshold, the one at which `precision`
of the kind's held-out candidates were right, and it doesn't overlap a span that is already chosen.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.boosting import Trees, calibrate, threshold
from millrace.llm.wordbatch import slices
from millrace.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
#: kinds that only the model adds, in the order in which spans at one place are listed
MORE_KINDS = ("obfuscated_email", "iban", "national_id", "local_phone", "secret", "ipv6")
KINDS = BASE_KINDS + MORE_KINDS
#: about how many documents' candidates, and how many different ones of a kind, the trees are fitted on
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 5_000
PRECISION = 0.97
CONTEXT = 40

_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MORE = {
    # bracketed, with blanks around the @, or spelled out
    "obfuscated_email": re.compile(
        r"\b[A-Za-z0-9._+-]{2,40}(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| @ | (?:at|AT) )[A-Za-z0-9-]{2,40}(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z]{2,6}\b"
    ),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "national_id": re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.,$-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z:%-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}(?:\.[A-Za-z0-9_/+-]{8,})*={0,2}(?![A-Za-z0-9_/+-])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
}
#: fixed values: how keys of widely used services begin, and tokens whose first part is a JSON object
_KEY_STARTS = re.compile(r"AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|npm_|xox[abprs]-|[sr]k_(?:live|test)_|sk-|eyJ")
#: words that stand before "at" in prose and are hardly a mailbox
_PROSE = frozenset(
    "am are arrive arrived available be been bought buy check chat code details docs download find found free go going have help here him her hosted info is it join just know learn learned "
    "listed live lives look looked looking made me meet meeting met more not now online open order out over page posted published read register run running runs saw see seen shop shopping "
    "sign site sold start started stay stop stopped store support talk team them then there they this today up us used visit was watch we were work worked working works you yesterday".split()
)
_AT = re.compile(r"[\[({<] ?(?:at|AT|@)| @ | (?:at|AT) ")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")
#: key words around a candidate, by what they speak for; endings that domains mostly have
_WORDS = {
    "mail": re.compile(r"(?i)\b(?:e-?mails?|mail|contact|write|reach|questions?)\b"),
    "account": re.compile(r"(?i)\b(?:iban|account|konto|transfer|pay|bank)\b"),
    "person": re.compile(r"(?i)\b(?:ssn|social|security|tax|citizen|personal|patient|employee)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b"),
    "secret": re.compile(r"(?i)(?:token|key|secret|passw(?:or)?d|passwd|pwd|api|bearer|credentials?|auth)"),
    "other": re.compile(r"(?i)\b(?:id|uuid|guid|commit|sha\d*|md5|hash|digest|checksum|revision|part|model|lot|item|version|file|path|order|invoice|see|ref)\b"),
}
_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: linear also in long words."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1] in "._%+-" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base spans, by start and then kind as listed."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, BASE_KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the generators propose; they may overlap each other and base spans."""
    out = []
    for kind, form in _MORE.items():
        if kind == "obfuscated_email" and not _AT.search(text):
            continue
        if kind == "ipv6" and "::" not in text and text.count(":") < 7:
            continue
        for m in form.finditer(text):
            s = m.group()
            if kind == "local_phone" and not 9 <= len(_digits(s)) <= 11:
                continue
            if kind == "ipv6" and not _ipv6_valid(s):
                continue
            if kind == "secret" and not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            out.append((m.start(), m.end(), kind))
    return out


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ipv6_valid(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return any(c != ":" for c in s)


def _format_valid(s: str, kind: str) -> bool:
    """Whether the digits of a candidate can be what its kind says."""
    if kind == "iban":
        return _iban_valid(s)
    if kind == "national_id":
        digits = _digits(s)
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        return not (area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000")
    digits = _digits(s)
    return kind != "local_phone" or len(set(digits)) > 2


def evidence(text: str, start: int, end: int, kind: str) -> int:
    """1 where format and key word prove the candidate, 0 where its own format refutes it, else -1."""
    s = text[start:end]
    before = text[max(0, start - 24) : start]
    if kind == "iban":
        return int(_iban_valid(s))
    if kind == "national_id":
        if not _format_valid(s, kind):
            return 0
        return 1 if re.search(r"(?i)\b(?:ssn|social security)\b", before) else -1
    if kind == "local_phone":
        return 1 if re.search(r"(?i)\b(?:phone|tel|call|fax|mobile)\b", before) and _format_valid(s, kind) else 0 if len(set(_digits(s))) < 3 else -1
    if kind == "ipv6":
        # what has a letter or two on each side is a name in a program as well
        return 1 if s.count(":") > 3 and any(c.isdigit() for c in s) else -1
    if kind == "secret":
        if _UUID.match(s):
            return 0
        if _KEY_STARTS.match(s) and _entropy(s) > 3.0:
            return 1
        if re.search(r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|bearer)\W{1,6}$", before):
            return 1
        return 0 if s.count("/") > 1 or s.count("-") + s.count("_") > len(s) // 4 or _entropy(s) < 3.0 else -1
    return 1 if re.search(r"[\[({<] ?(?:at|AT|@)", s) else -1


def _entropy(s: str) -> float:
    counts = np.array([s.count(c) for c in set(s)]) / max(len(s), 1)
    return float(-(counts * np.log2(counts)).sum())


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the candidate and what stands around it."""
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    around = before + " " + after
    n = max(len(s), 1)
    pairs = list(zip(s, s[1:], strict=False))
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s) / n
    return [
        float(KINDS.index(kind)), float(n), sum(c.isdigit() for c in s) / n, sum(c.isupper() for c in s) / n, sum(not c.isalnum() for c in s) / n, len(set(s)) / n, _entropy(s),
        sum(a.isdigit() != b.isdigit() for a, b in pairs) / n, sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in pairs) / n, hexes, float(bool(_UUID.match(s))), float(s.count("/")), float(s.count("-") + s.count("_")),
        float(any(c in s for c in "[({<")), float(s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip("])}>").lower() in _ENDINGS), float(bool(re.search(r"(?i) dot ", s))), float("." in s[: max(len(s) // 2, 1)]),
        *(float(bool(form.search(before[-24:]))) for form in _WORDS.values()), *(float(bool(form.search(around))) for form in _WORDS.values()),
        sum(c.isdigit() for c in around) / max(len(around), 1), float(after[:1].isspace() or not after), float(before[-1:] in ('"', "'", "`", "=", ":")), float("=" in before[-4:] or ":" in before[-4:]), float(_format_valid(s, kind)),
        len(set(_digits(s))) / 10, float(bool(_KEY_STARTS.match(s))), float(s.count(".")), float(s.count(" ")), float(s.count(":")), float(s[:1] == "("), float(s[:1] == "0"), float(s[:2] in ("19", "20")),
        float(kind == "obfuscated_email" and re.match(r"[A-Za-z]*", s).group().lower() in _PROSE), float(max((len(x) for x in re.split("[:.]", s)), default=0)), float(len(_digits(s))),
    ]


def _iban_of(country: str, body: str) -> str:
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{check:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def made_examples(n: int = 900, seed: int = 5) -> list[tuple[str, int, str]]:
    """Texts with a candidate each, whether it is personal data, and its kind: n of each kind, half of them near misses."""
    rng = np.random.default_rng(seed)
    low, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    every = low + low.upper() + digits
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    one = lambda *choices: choices[int(rng.integers(0, len(choices)))]
    word = lambda: pick(low, int(rng.integers(3, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    number = lambda: f"{rng.integers(200, 999)}{one(' ', '.', '-')}{rng.integers(200, 999)}{one(' ', '.', '-')}{rng.integers(1000, 9999)}"
    uuid = lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
    mixed = lambda k: pick(digits, 2) + pick(every, k - 4) + pick(low.upper(), 2)

    def mail(yes: bool, i: int) -> str:
        name = one(f"{word()}.{word()}", word(), f"{word()}{pick(digits, 2)}", f"{word()}-{word()}")
        if yes:
            if i % 3:
                spelled = one("[at]", "(at)", " [at] ", " (at) ", "{at}", " [AT] ", " <at> ")
                return f"{one('', 'mail', 'contact', 'by', 'from')} {name}{spelled}{word()}{one('[dot]', ' (dot) ', ' [dot] ', '.', ' dot ')}{one(*_ENDINGS)}"
            return f"{one('mail', 'contact', 'write to', 'write', 'e-mail', 'reach me:', 'email:', 'questions to')} {name}{one(' at ', ' @ ')}{word()}{one('.', ' dot ')}{one(*_ENDINGS)}"
        if i % 4 == 1:
            return f"{one('we', 'they', 'I', 'contact', 'reach', 'write to', 'mail', '')} {one(*prosaic)} at {word()}.{one(*_ENDINGS)}"
        return one(f"{word()} at {word()} dot {word()[:6]}", f"{one('look', 'arrived', 'met', 'works')} at {word()}.{word()[:6].title()}", f"error at {word()}.{one('run', 'call', 'line', 'main')}", f"{word()} at {word()}.{one('js', 'py', 'txt', 'Then', 'It')}", f"{word()} (at {word()}.{word()[:5]}")

    def address(yes: bool, i: int) -> str:
        groups = [pick(hexes, int(rng.integers(1, 5))) for _ in range(8)]
        k = int(rng.integers(1, 6))
        if yes:
            own = one(":".join(groups), f"{one('2001', '2a02', 'fe80', 'fd00')}:{':'.join(groups[:k])}::{pick(digits, int(rng.integers(1, 4)))}", f"{one('2001:db8', 'fe80')}::{':'.join(groups[: min(k, 4)])}")
            return f"{one('from', 'host', 'address', 'ping', 'server', 'client', 'ip', '')} {own}"
        return f"{one('call', 'use', 'in', 'type', 'see', '')} {one(*'abcdef')}{one('', *'abcdef')}{one('', *'abcdef')}::{one(*'abcdef')}{one('', *'abcdef')}{one('', *'abcdef')}"

    def account(yes: bool, i: int) -> str:
        own = _iban_of(pick("DEFRGBNL", 2), pick(digits, int(rng.integers(14, 22))))
        if yes:
            return f"{one('iban', 'account', 'to', 'pay', '')} {one(own, own.replace(' ', ''))}"
        return one(f"{one('part', 'model', 'lot', 'see')} {pick(low.upper(), 2)}{pick(digits, 2)} {pick(low.upper(), 4)} {pick(low.upper() + digits, 4)}", f"{one('order', 'ref', 'iban', '')} {own[:2]}{(int(own[2:4]) + 1) % 100:02d}{own[4:]}")

    def person(yes: bool, i: int) -> str:
        sep = one("-", "-", " ", "")
        if yes:
            return f"{one('ssn', 'social security', 'tax', 'patient', 'ssn is', 'SSN:', 'security number:', 'my social security number is')} {rng.integers(1, 665):03d}{sep}{rng.integers(1, 99):02d}{sep}{rng.integers(1, 9999):04d}"
        if i % 4 == 1:
            return f"{one('order', 'about', 'total', 'of', 'invoice', 'population', '')} {rng.integers(1, 665):03d}{sep}{rng.integers(1, 99):02d}{sep}{rng.integers(1, 9999):04d}"
        return one(f"{one('part', 'item', 'ssn', '')} {one(0, 666, 900 + int(rng.integers(0, 99))):03d}-{rng.integers(0, 99):02d}-{rng.integers(1, 9999):04d}", f"{one('part', 'item', 'model', 'order', 'lot', 'see')} {rng.integers(1, 665):03d}-{rng.integers(1, 99):02d}-{rng.integers(1, 9999):04d}")

    def phone(yes: bool, i: int) -> str:
        if yes:
            own = one(number(), "(" + number()[:3] + ") " + number()[4:], pick("23456789", 1) + pick(digits, 9), f"(0{pick(digits, int(rng.integers(1, 4)))}) {pick(digits, 4)} {pick(digits, 4)}"[:16], f"0{pick(digits, 2)} {pick(digits, 4)} {pick(digits, 4)}", pick(digits, 10))
            return f"{one('phone', 'call', 'tel', 'mobile', 'fax:', 'telephone', 'call me:', 'phone:')} {own}"
        if i % 4 == 1:
            return f"{one('on', 'since', 'date', 'total', 'of', 'order', 'about', 'invoice', 'id', '')} {one(f'{rng.integers(1950, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d} {rng.integers(0, 24):02d}', pick('123456789', 1) + pick(digits, int(rng.integers(8, 11))), f'{pick(digits, 2)}.{pick(digits, 2)}.{rng.integers(1950, 2030)} {pick(digits, 2)}', f'{rng.integers(1950, 2030)} {rng.integers(1950, 2030)} {pick(digits, 3)}', ' '.join(str(rng.integers(10, 99)) for _ in range(5)), ' '.join(str(rng.integers(100, 999)) for _ in range(3)))}"
        return one(f"{pick(digits, 4)} {pick(digits, 3)} | {one(111, 222, 100)} {one(111, 222, 100)} {one(1111, 1000)} | {pick(digits, 4)}", f"{one('version', 'item', 'order', 'part', 'see', 'ref')} {number()}", f"{pick(digits, 3)} {number()} {pick(digits, 2)} {pick(digits, 4)}")

    def secret(yes: bool, i: int) -> str:
        if yes:
            name = one("token", "api_key", "secret", "password", "aws_secret_access_key", "access key", "auth token", "Authorization: Bearer", "pwd", "client_secret")
            key = one(pick(hexes, int(one(32, 40, 64))), mixed(int(rng.integers(18, 60))), f"{mixed(12)}/{mixed(8)}/{mixed(16)}", f"{one('sk', 'pk', 'gh', 'xox')}_{one('live', 'test', 'p')}_{mixed(24)}", pick(low.upper(), 4) + pick(low.upper() + digits, 14) + pick(digits, 2), (word() + pick(digits, 1)) * 3 + pick(low.upper(), 2) + pick(digits, 1), pick(low + low.upper(), 13) + "/" + pick(digits, 1) + pick(low.upper(), 6) + "/" + pick(low + low.upper(), 18), pick(low.upper(), int(rng.integers(9, 14))) + pick(digits, 1) + pick(low.upper(), 7))
            if i % 3 == 0:
                known = one("AKIA" + pick(low.upper() + digits, 16), "gh" + one(*"opsu") + "_" + mixed(36), "AIza" + mixed(35), f"xox{one(*'abp')}-{pick(digits, 11)}-{mixed(24)}", f"sk_{one('live', 'test')}_{mixed(24)}", ".".join(("eyJ" + mixed(int(rng.integers(16, 40))), "eyJ" + mixed(int(rng.integers(16, 80))), mixed(43))))
                return f"{one('', '', 'see', 'uses', 'Bearer')} {known}"
            return f"{name}{one(' = ', ': ', '=', ' ', ' is ')}{one(key, chr(34) + key + chr(34))}"
        if i % 6 == 1:
            return f"{one('file', 'see', 'import', 'host', '')} {word()}{one('_', '-')}{word()}{one('_', '-')}{word()}{pick(digits, 1)}.{word()}{word()}{word()}"
        return one(
            f"{one('id', 'the id is', 'uuid', 'request', 'token', 'see', 'key')} {uuid()}", f"{one('commit', 'sha256', 'md5', 'checksum', 'hash', 'digest:', 'revision')} {pick(hexes, int(one(32, 40, 64)))}", f"{one('part', 'model', 'item', 'order')} {pick(low.upper(), 3)}-{pick(digits, 6)}-{pick(low.upper() + digits, 6)}-{pick(digits, 4)}",
            f"{one('file', 'path', 'see', '')} {word()}/{word()}/{word()}/{word()}-{pick(digits, 2)}", f"{word()}-{word()}-{word()}-{word()}-{pick(digits, 1)}", f"{word()}_{word()}_{word()}_{word()}_{pick(digits, 2)}", f"{one('key', '')} {word()}{word()}{word()}{word()}{pick(digits, 1)}", f"{pick(digits, 8)}T{pick(digits, 6)}Z{word()}",
        )

    prosaic = sorted(_PROSE)
    some = lambda: prose(int(rng.integers(0, 6)))
    makes = {"obfuscated_email": mail, "iban": account, "national_id": person, "local_phone": phone, "secret": secret, "ipv6": address}
    return [(f"{some()} {make(i % 2 == 0, i)} {some()}".strip(), int(i % 2 == 0), kind) for i in range(n) for kind, make in makes.items()]


def _made_rows(n: int = 900, seed: int = 5) -> list[tuple[str, list[float], int]]:
    """Kind, features and label of each candidate in the examples; only those of the kind that is meant are personal data."""
    return [(c[2], features(text, *c), int(label and c[2] == kind)) for text, label, kind in made_examples(n, seed) for c in candidates(text)]


def held_out_scores(selector: Selector, rows: list[tuple[str, list[float], int]]) -> dict[str, tuple[float, float, int]]:
    """For each kind: precision and recall of what the selector would add, and the number of rows."""
    p = selector._probability(selector.trees.score(np.array([r[1] for r in rows])))
    out = {}
    for kind in MORE_KINDS:
        own = np.array([r[0] == kind for r in rows])
        took, yes = p[own] >= selector.cut[kind], np.array([r[2] for r in rows])[own] == 1
        out[kind] = (float(yes[took].mean()) if took.any() else 1.0, float(took[yes].mean()), int(own.sum()))
    return out


class Selector:
    """The trees, their calibration and one threshold for each kind."""

    def __init__(self, precision: float = PRECISION):
        self.precision = precision

    def fit(self, rows: list[tuple[str, list[float], int]]) -> Selector:
        """rows: kind, features, label. Every fifth row is held out for calibration and thresholds."""
        self.cut = dict.fromkeys(MORE_KINDS, 1.1)
        self.trees = None
        y = np.array([r[2] for r in rows], float)
        if len(rows) < 50 or y.min() == y.max():
            return self
        x = np.array([r[1] for r in rows])
        kinds = np.array([r[0] for r in rows])
        held = np.arange(len(rows)) % 5 == 0
        self.trees = Trees().fit(x[~held], y[~held])
        score = self.trees.score(x[held])
        self.scale = calibrate(score, y[held])
        p = self._probability(score)
        for kind in MORE_KINDS:
            own = kinds[held] == kind
            if own.sum() >= 20:
                cut = threshold(p[own], y[held][own], self.precision)
                # half way to what is left out, so that it doesn't hang on the last one taken
                below = max((x for x in p[own] if x < cut), default=0.0)
                self.cut[kind] = (cut + below) / 2 if cut <= 1 else cut
        return self

    def _probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * score + self.scale[1], -30, 30)))

    def select(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """All spans of a text: the base ones, and candidates that pass and overlap none."""
        found = candidates(text) if self.trees else []
        if not found:
            return base
        p = self._probability(self.trees.score(np.array([features(text, *c) for c in found])))
        kept = list(base)
        for i in np.argsort(-p, kind="stable"):
            a, b, kind = found[i]
            if p[i] >= self.cut[kind] and not any(a < d and c < b for c, d, _ in kept):
                kept.append(found[i])
        return sorted(kept, key=lambda s: (s[0], KINDS.index(s[2])))


def fit_selector(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION, sample_candidates: int = SAMPLE_CANDIDATES) -> Selector:
    """A selector fitted on the proven candidates of about sample_docs documents, about sample_candidates different ones a kind.

    Both samples are by a hash (of the text, of the candidate), so they are the same on every run and take
    from all places of a text and all kinds alike; they bound what reaches the driver, which is one small
    row per candidate. Equal candidates count once.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    sample = docs.where(F.col("text").isNotNull()).where(F.shiftrightunsigned(F.xxhash64("text"), 11) < int(share * (1 << 53))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                for c in candidates(text):
                    label = evidence(text, *c)
                    if label >= 0:
                        rows.append((c[2], hashlib.sha256(text[c[0] : c[1]].encode()).hexdigest()[:16], features(text, *c), label))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.int32())], ["kind", "mark", "features", "label"])

    found = sample.mapInArrow(run, "kind string, mark string, features array<double>, label int")
    found = materialize(found.groupBy("kind", "mark").agg(F.min(F.struct("label", "features")).alias("r")), "candidates")
    kinds = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = F.lit(False)
    for kind, k in kinds.items():
        few = few | ((F.col("kind") == kind) & (F.shiftrightunsigned(F.xxhash64("mark"), 11) < int(min(1.0, sample_candidates / k) * (1 << 53))))
    rows = [(r["kind"], list(r["r"]["features"]), r["r"]["label"]) for r in found.where(few).orderBy("mark", "kind").collect()]
    return Selector(precision).fit(rows + _made_rows())


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [KIND] in place of each span; overlapping spans become one, named by the first."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def personal_data(docs: DataFrame, selector: Selector | None = None, redacted: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans (and redacted) of every row of docs, with no shuffle.

    A null text counts as empty and has no spans; its redacted text is null. spans lists kind:start:end
    by start, in code points, end exclusive. Without a selector one is fitted to the documents.
    keep names columns of docs to return as they are; others are not read. Rows without a doc_id or with
    one that others have are rows like any other, and an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(selector or fit_selector(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, base_hash, spans, clean = [], [], [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text or "")
                chosen = sent.value.select(text or "", base)
                counts.append([sum(k == kind for _, _, k in base) for kind in BASE_KINDS])
                base_hash.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(chosen))
                clean.append(None if text is None else redact(text, chosen))
            columns = [part.column("doc_id"), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(4)), pa.array(base_hash, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"] + ["redacted"] * redacted
            yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * redacted + [part.column(c) for c in keep], names + list(keep))

    kind = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string" + ", redacted string" * redacted
    kind += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *keep).mapInArrow(run, kind)
