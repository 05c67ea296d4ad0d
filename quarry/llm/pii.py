"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap. Boosted trees score each span from its format (digits,
separators, checksums, lengths) and its context (cue words, neighbouring characters), and a threshold per kind, set
on held-out rows after calibration, selects what to redact. The spans that fixed rules define (email, ip, card,
phone) always stay; the trees add the other kinds.

All patterns run in linear time on any text: each run of characters is entered once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship_code, tidy

Span = tuple[str, int, int]

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the trees can select.
ADDED_KINDS = ("email_spelled", "phone_local", "national_id", "iban", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += (n * 2 - 9 if n > 4 else n * 2) if k % 2 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    past = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            past = found.end()
            yield "email", start, past
        else:
            past = max(past, at + 1)  # no match can hold this sign
        at = text.find("@", past)


def base_spans(text: str) -> list[Span]:
    """email, ip, card, phone by their fixed rules, by kind and then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


_GENERATORS = {
    "phone_local": re.compile(r"(?<![0-9+(])\(?[0-9]{1,12}\)?(?:[ ./-]{1,2}[0-9]{1,12})++(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+"),
}
#: Numbers that a cue before them gives away, by kind: the number, and the cue with what may stand between.
_CUED_NUMBERS = {
    "phone_local": (re.compile(r"(?<![0-9+])[0-9]{7,15}(?![0-9])"), re.compile(r"\b(?:call|phone|tel|telephone|telefon|fon|mobile|cell|handy|fax|dial|ring|text|sms|appel|llamar?)\b[^0-9\n]{0,12}$", re.I)),
    "national_id": (re.compile(r"(?<![0-9])(?:[0-9]{9}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9])"), re.compile(r"\b(?:ssn|social security|insurance|citizen|national)\b[^0-9\n]{0,16}$", re.I)),
}
#: A secret that a cue before it gives away: after a sign any, without one a long word.
_SECRET_CUE = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|credentials?)\b[\"']?(?:\s?(?:is|[:=]|=>|:=)\s?[\"']?([^\s\"'<>,;]{5,}+)|\s[\"']?([^\s\"'<>,;]{16,}+))", re.I)
_SECRET_WORDS = ("pass", "pwd", "secret", "token", "key", "credential")
#: A signed token goes as a whole, not by its parts.
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){1,2}")
#: Digits of a telephone number.
_PHONE_DIGITS = range(7, 16)
_SEVEN_DIGITS, _GROUPED_ID = re.compile("[0-9]{7}"), re.compile("[0-9]{3} [0-9]{2} [0-9]{4}")
_DOT = re.compile("dot", re.I)
# a local part has 64 characters at most, a label 63
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\s?(?:\(at\)|\[at\]|\bat\b)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]{1,63}){1,10}", re.I)


def _cued(text: str) -> Iterator[Span]:
    if _DIGIT.search(text) and (_SEVEN_DIGITS.search(text) or _GROUPED_ID.search(text)):
        for kind, (number, cue) in _CUED_NUMBERS.items():
            for m in number.finditer(text):
                if cue.search(text[max(0, m.start() - 32) : m.start()]):
                    yield kind, *m.span()
    small = text.lower()
    if any(w in small for w in _SECRET_WORDS):
        for m in _SECRET_CUE.finditer(text):
            start, end = m.span(1 if m[1] is not None else 2)
            while end > start and text[end - 1] in ".)]}":  # the sentence's, not the secret's
                end -= 1
            if end > start:
                yield "secret", start, end


def candidates(text: str) -> list[Span]:
    """Proposed spans of the added kinds; they may overlap one another."""
    out = [(kind, *m.span()) for kind, p in _GENERATORS.items() for m in p.finditer(text)] if _DIGIT.search(text) else []
    out = [s for s in out if s[0] != "phone_local" or len(_NOT_DIGIT.sub("", text[s[1] : s[2]])) in _PHONE_DIGITS]
    if whole := [("secret", *m.span()) for m in _JWT.finditer(text)] if "eyJ" in text else []:
        starts = [s[1] for s in whole]
        inside = lambda s: (k := bisect_right(starts, s[1])) and s[2] <= whole[k - 1][2]
        out = [s for s in out if not inside(s)] + whole
    seen = set(out)
    out += [s for s in dict.fromkeys(_cued(text)) if s not in seen]
    if _DOT.search(text):
        out += [("email_spelled", *m.span()) for m in _SPELLED.finditer(text)]
    return out


#: Cue words of the context features (fixed values).
CUES = (
    "call phone tel mobile fax dial telephone telefon appel llamar",
    "mail email contact write reach",
    "ssn social security insurance citizen national",
    "iban account bank transfer bic konto",
    "token key secret password passwd pwd api auth bearer",
    "version order invoice page isbn chapter figure ratio score year date total price serial commit sha sum",
)
#: Common ends of host names (fixed values).
_TOP = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
#: Beginnings that issuers give their keys (fixed values).
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_", "pk_", "sk-", "eyJ", "AIza", "ya29", "SG")
_CLASS_CHANGE = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z])[0-9]")
_ASSIGNED = re.compile(r"(?:pass\w*|pwd|secret|token|key|credentials?)[\"']?\s?(?:is|[:=]|=>|:=)\s?[\"']?$", re.I)
_LETTERS = re.compile(r"[A-Za-z]+")
_CUES = [re.compile(r"\b(?:" + words.replace(" ", "|") + r")", re.I) for words in CUES]


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _NOT_DIGIT.sub("", own)
    groups = re.findall(r"[0-9]+", own)
    letters = sum(c.isalpha() for c in own)
    counts = np.array([own.count(c) for c in set(own)], float) / len(own)
    iban = 0.0
    if kind == "iban":
        flat = own.replace(" ", "")
        iban = float(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
    return [
        *(float(kind == k) for k in ADDED_KINDS), len(own), len(digits), letters, len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        own.count("-"), own.count(" "), own.count("."), own.count("/"), float("(" in own), float(-(counts * np.log2(counts)).sum()), len(set(digits)),
        float(luhn(digits)) if digits else 0.0, iban, float(own.upper() == own), float(own.lower() == own), float(bool(re.fullmatch(r"[0-9a-f]+", own))),
        len(_CLASS_CHANGE.findall(own)) / len(own), sum(c.isupper() for c in own), own.count("_"), max(map(len, _LETTERS.findall(own)), default=0), float(own.startswith(_ISSUED)), sum(c in "aeiouAEIOU" for c in own) / max(1, letters), max(map(len, groups), default=0), float(own.startswith(("0", "(0"))),
        sum(not c.isalnum() for c in own), float(bool(_ASSIGNED.search(before))), float(own.isalpha()), float(own.isdigit()), own.count("."),
        *(float(bool(c.search(before))) for c in _CUES), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in ":=\"'"), float(before[-1:] in "$€£#"), float(after[:1] == "%"), float(own.lower().endswith(_TOP)),
    ]


# --- the labelled rows that the trees learn from -------------------------------------------------------------------

#: Rows made for training and calibration: the documented bound of the fitted sample.
TRAIN_ROWS = 16_000


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _filler(rng: np.random.Generator, n: int) -> str:
    return " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def _iban(rng: np.random.Generator) -> str:
    body, land = _digits(rng, int(rng.integers(14, 19))), ("DE", "FR", "ES", "GB")[rng.integers(4)]
    check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
    flat = f"{land}{check:02d}{body}"
    return " ".join(flat[k : k + 4] for k in range(0, len(flat), 4)) if rng.random() < 0.5 else flat


def labelled_rows(n: int = TRAIN_ROWS, seed: int = 7) -> Iterator[tuple[str, Span, int]]:
    """Candidates in made-up sentences with their truth: personal data of the added kinds, and things that look alike."""
    rng = np.random.default_rng(seed)

    def pick(*x: str) -> str:
        return x[rng.integers(len(x))]

    def word() -> str:
        return _filler(rng, 1)

    def chars(alphabet: str, n: int) -> str:
        return "".join(alphabet[x] for x in rng.integers(0, len(alphabet), n))

    def said() -> str:
        """A word that can be pronounced, as those of identifiers, paths and passphrases."""
        return "".join(chars("bcdfglmnprstv", 1) + chars("aeiou", 1) + pick("", "", "n", "r", "s", "l") for _ in range(rng.integers(1, 4)))

    def password() -> str:
        leet = said().capitalize().translate(str.maketrans({"a": pick("4", "@"), "e": "3", "i": "1", "o": "0"}))
        return pick(said() + _digits(rng, int(rng.integers(1, 5))) + chars("!?#$%&*", 1), leet + said() + chars("!&*-_", 1) + _digits(rng, 1), chars(mixed + "!#$%&*?", int(rng.integers(8, 15))) + _digits(rng, 1), said().capitalize() + _digits(rng, 4), leet + chars("!#&", 1) + said() + _digits(rng, 2))

    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    area = lambda: f"0{_digits(rng, int(rng.integers(2, 5)))}"
    good = [
        lambda: (pick("call ", "phone: ", "tel. ", "mobile ", "", "reach us "), pick(f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", f"0{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}", f"0{_digits(rng, 1)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)}", f"{area()}{pick(' ', '/', '-', ' / ')}{_digits(rng, int(rng.integers(6, 9)))}", f"({area()}) {_digits(rng, int(rng.integers(6, 9)))}")),
        lambda: (pick("ssn ", "social security ", "id: ", ""), f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}"),
        lambda: (pick("iban ", "account ", "bank transfer to ", ""), _iban(rng)),
        lambda: (pick('token = "', "api_key: ", "password=", "secret ", "Bearer "), pick(rng.bytes(20).hex(), rng.bytes(16).hex(), "sk_" + rng.bytes(12).hex(), _filler(rng, 4).replace(" ", "")[:14] + _digits(rng, 6))),
        lambda: (pick('key = "', "use ", "", "token "), pick(pick("AKIA", "ASIA") + chars(upper, 15) + _digits(rng, 1), pick("ghp_", "gho_", "glpat-", "xoxb-") + chars(mixed, 36), "eyJ" + chars(mixed + "-_", int(rng.integers(40, 400))), "AIza" + chars(mixed, 35), chars(mixed + "+/", 40), chars(mixed, 32))),
        lambda: (pick("password=", "password: ", "pwd: ", "passwd = ", "my password is ", 'password: "', "Password: ", "token=", "secret: ", "credentials: ", "passcode is "), password()),
        lambda: (pick("secret ", "password ", "passphrase ", "passphrase: ", "secret = "), "".join(said() for _ in range(9))[: int(rng.integers(20, 40))].ljust(20, "x")),
        lambda: (pick("call ", "phone ", "phone: ", "tel: ", "tel ", "mobile ", "fax ", "dial ", "ring me on ", "text me at ", "phone number: "), pick(_digits(rng, int(rng.integers(7, 12))), f"0{_digits(rng, int(rng.integers(8, 11)))}")),
        lambda: (pick("ssn ", "ssn: ", "SSN is ", "social security number ", "social security no. ", "national insurance ", "citizen number "), pick(_digits(rng, 9), _digits(rng, 9), f"{_digits(rng, 3)} {_digits(rng, 2)} {_digits(rng, 4)}")),
        lambda: (pick("Bearer ", "token ", "jwt ", "", "Authorization: "), ".".join(["eyJ" + chars(mixed + "-_", int(rng.integers(15, 60))), "eyJ" + chars(mixed + "-_", int(rng.integers(20, 200))), chars(mixed + "-_", 43)])),
        lambda: (pick("iban ", "account ", "konto ", "", "transfer to "), _iban(rng).lower()),
        lambda: (pick("mail ", "contact ", "write to ", ""), f"{word()} {pick('at', '(at)', '[at]', '(AT)', '[At]')} {word()} {pick('dot', '(dot)', '[dot]', '(DoT)', 'DOT')} {pick('com', 'org', 'de', 'net')}"),
    ]

    def identifier() -> str:
        words, number = [said() for _ in range(rng.integers(3, 6))], _digits(rng, int(rng.integers(1, 4)))
        return pick("".join(w.capitalize() for w in words), "_".join(words), "-".join(words), "/".join(words), "-".join(words).upper(), words[0] + "".join(w.capitalize() for w in words[1:])) + pick("", "_", "-") + number

    bad = [
        lambda: (pick("version ", "chapter ", "score ", "ratio ", ""), pick(f"{_digits(rng, 2)}.{_digits(rng, 2)}.{_digits(rng, 2)}", f"{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}/{_digits(rng, 3)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 2)}.{_digits(rng, 3)}")),
        lambda: (pick("date ", "on ", "", "year "), pick(f"20{_digits(rng, 2)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}.{_digits(rng, 2)}.20{_digits(rng, 2)}", f"{_digits(rng, 2)}/{_digits(rng, 2)}/{_digits(rng, 4)}", f"20{_digits(rng, 2)} 20{_digits(rng, 2)} 20{_digits(rng, 2)}", f"20{_digits(rng, 2)}-{_digits(rng, 2)}-{_digits(rng, 2)} {_digits(rng, 2)}")),
        lambda: (pick("total ", "price ", "$", "order ", "invoice ", "pages "), pick(f"{_digits(rng, 3)} {_digits(rng, 3)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"{_digits(rng, 5)} {_digits(rng, 5)}", f"{rng.integers(1, 9)} {_digits(rng, 3)} {_digits(rng, 3)}.{_digits(rng, 2)}")),
        lambda: (pick("numbers ", "scores ", "", "table "), " ".join(str(x) for x in rng.integers(0, 30, rng.integers(5, 9)))),
        lambda: (pick("serial ", "order ", "ISBN "), f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}" if rng.random() < 0.3 else f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}"),
        lambda: (pick("part ", "model ", ""), f"{chr(65 + rng.integers(26))}{chr(65 + rng.integers(26))}{_digits(rng, 2)} {_digits(rng, 4)} {_digits(rng, 4)}"),
        lambda: (pick("commit ", "sha sum ", "figure ", "page "), pick(rng.bytes(20).hex(), word() + "_" + word() + "_" + _digits(rng, 2) + word() + word(), _digits(rng, 18))),
        *[lambda: (pick("see ", "file ", "", "class "), pick(identifier(), identifier(), identifier(), identifier(), _digits(rng, int(rng.integers(16, 24)))))] * 3,
        lambda: (pick("password ", "password: ", "token: ", "secret = ", "api key: ", "password is ", "token = ", "credentials: ", "the secret is "), pick(said() + said(), word() + said(), "required", "invalid", "expired", "missing", identifier() if rng.random() < 0.3 else said() + "ing")),
        lambda: (pick("order ", "invoice ", "serial ", "page ", "total ", "item ", "case ", ""), _digits(rng, int(rng.integers(7, 12)))),
        lambda: (pick("", "of ", "no. ", "to "), _digits(rng, int(rng.integers(16, 20)))),
        lambda: (pick("call on 20", "fax of 20", "call from 20"), f"{_digits(rng, 2)}{rng.integers(10, 13)}{rng.integers(10, 29)}"),
        lambda: (pick("see ", "", "in ", "of "), f"{chars('abcdefghij', 2)}{_digits(rng, 2)} {chars('abcdefghijklmnop', 4)} {chars('abcdefghijklmnop', 4)} {chars('abcdefghijklmnop', 4)}"),
        lambda: (pick("look ", "we meet ", ""), f"{word()} at {word()} dot {word()}"),
    ]
    while n > 0:
        truth = int(rng.random() < 0.5)
        lead, body = (good if truth else bad)[rng.integers(len(good if truth else bad))]()
        text = f"{_filler(rng, 4)} {lead}{body}{pick('', '.', ',', chr(34))} {_filler(rng, 3)}"
        at = len(text) - len(text.split(lead + body, 1)[1]) - len(body)
        for span in candidates(text):
            if span[1] < at + len(body) and span[2] > at and n > 0:
                n -= 1
                whole = span[1] <= at + 1 and span[2] >= at + len(body) - 1
                yield text, span, int(truth and whole)


# --- boosted trees --------------------------------------------------------------------------------------------------


class Boosted:
    """Depth-limited trees on binned features, fitted to the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias, self.forest = float(np.log(mean / (1 - mean))), []
        margin = np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(codes, y - p, p * (1 - p))
            self.forest.append(tree)
            margin += self._walk(tree, codes)
        return self

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows of (feature, code, value) in heap order; feature -1 ends."""
        nodes = np.zeros((2 ** (self.depth + 1) - 1, 3))
        nodes[:, 0] = -1
        todo = [(0, np.arange(len(g)))]
        while todo:
            at, own = todo.pop()
            gs, hs = g[own].sum(), h[own].sum()
            nodes[at, 2] = self.rate * gs / (hs + self.ridge)
            if 2 * at + 2 >= len(nodes) or len(own) < 20:
                continue
            best, split = 1e-6, None
            for f in range(codes.shape[1]):
                left_g = np.cumsum(np.bincount(codes[own, f], g[own], self.bins + 1))[:-1]
                left_h = np.cumsum(np.bincount(codes[own, f], h[own], self.bins + 1))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (gs - left_g) ** 2 / (hs - left_h + self.ridge) - gs**2 / (hs + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, split = gain[k], (f, k)
            if split:
                nodes[at, :2] = split
                low = codes[own, split[0]] <= split[1]
                todo += [(2 * at + 1, own[low]), (2 * at + 2, own[~low])]
        return nodes

    def _walk(self, tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(self.depth):
            f = tree[at, 0].astype(np.int64)
            at = np.where(f < 0, at, 2 * at + 1 + (codes[rows, np.maximum(f, 0)] > tree[at, 1]))
        return tree[at, 2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T, strict=True)], axis=1)
        return self.bias + sum(self._walk(t, codes) for t in self.forest)


class Selector:
    """Trees, their calibration and a threshold per kind."""

    def __init__(self, rows: list[tuple[str, Span, int]], precision: float = 0.97):
        x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([v for *_, v in rows], float)
        kinds, fold = np.array([s[0] for _, s, _ in rows]), np.arange(len(rows)) % 4
        self.model = Boosted().fit(x[fold < 2], y[fold < 2])
        margin = self.model.margin(x)
        self.slope, self.offset = self._platt(margin[fold == 2], y[fold == 2])
        p = self.probability(margin)
        self.thresholds = {}
        for kind in ADDED_KINDS:
            own = (fold == 2) & (kinds == kind)
            levels = np.unique(p[own])
            good = [t for t in levels if y[own][p[own] >= t].mean() >= precision]
            self.thresholds[kind] = float(good[0]) if good else 2.0
        held = fold == 3
        chosen = p[held] >= np.array([self.thresholds[k] for k in kinds[held]])
        #: On rows that neither fitting nor thresholds saw.
        self.held_out = {"precision": float(y[held][chosen].mean()), "recall": float(chosen[y[held] == 1].mean()), "rows": int(held.sum())}
        own = lambda k: chosen[(y[held] == 1) & (kinds[held] == k)]
        self.held_out["recall_by_kind"] = {k: float(own(k).mean()) for k in ADDED_KINDS if len(own(k))}

    @staticmethod
    def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * margin + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((y - p) * margin).sum(), (y - p).sum()])
            hess = np.array([[(w * margin**2).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0], b + step[1]
        return float(a), float(b)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.offset)))

    def select(self, texts: list[str], fixed: list[list[Span]]) -> list[list[Span]]:
        """The fixed spans of each text and, clear of them and of one another, the best candidates over their threshold."""
        proposed = [[(k, s) for s in candidates(t)] for k, t in enumerate(texts)]
        flat = [x for own in proposed for x in own]
        added: list[list[tuple[float, Span]]] = [[] for _ in texts]
        if flat:
            p = self.probability(self.model.margin(np.array([features(texts[k], s) for k, s in flat])))
            for (k, span), score in zip(flat, p.tolist(), strict=True):
                if score >= self.thresholds[span[0]]:
                    added[k].append((score, span))
        out = []
        for base, more in zip(fixed, added, strict=True):
            if not more:
                out.append(base)
                continue
            taken, kept = sorted((s, e) for _, s, e in base), []
            most = max((e - s for s, e in taken), default=0)
            for _, span in sorted(more, key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
                k, free = bisect_right(taken, (span[2], -1)) - 1, True
                while free and k >= 0 and taken[k][0] > span[1] - most:
                    free, k = taken[k][1] <= span[1], k - 1
                if free:
                    insort(taken, (span[1], span[2]))
                    most = max(most, span[2] - span[1])
                    kept.append(span)
            out.append([*base, *sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))])
        return out


@lru_cache(maxsize=2)
def selector(n: int = TRAIN_ROWS, seed: int = 7) -> Selector:
    return Selector(list(labelled_rows(n, seed)))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: <id>, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and the SHA-256 are those of the base spans; spans also has the selected ones, and n_spans is their number.
    Offsets count code points, ends are exclusive. Null is the empty text, without spans; repeated rows have equal spans.
    Whole texts are read, however long, in linear time; nothing is shuffled. Other columns of docs, whatever their names,
    are not looked at. No rows give none.
    """
    ship_code(docs.sparkSession)
    model = selector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column("t").to_pylist()]
            base = [base_spans(t) for t in texts]
            every = model.select(texts, base)
            out = {"id": batch.column("id")} | {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS}
            out["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
            out["spans"] = pa.array([written(e) for e in every], pa.string())
            out["n_spans"] = pa.array(map(len, every), pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long").withColumnRenamed("id", id_col)


def redact(text: str | None, spans: str) -> str:
    """text with each span replaced by [KIND]; of overlapping spans the one that starts first, then the longer."""
    out, past = [], 0
    found = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= past:
            out += [(text or "")[past:start], f"[{kind.upper()}]"]
            past = end
    return "".join([*out, (text or "")[past:]])
