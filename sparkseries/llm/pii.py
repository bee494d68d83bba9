"""Personal data in texts: base patterns plus a semi-Markov conditional random field.

The base patterns (e-mail, IP address, card, phone) are found exactly, leftmost
and non-overlapping per kind.  The field scores *candidate segments* by features of
the whole span (digit groups, checksum, shape, words before it, what stands at its
edges) for each type.  A dynamic program over tokens chooses boundaries and types
jointly: best(i) is the best labelling of the first i tokens, where the next segment
is either one token outside of any entity or a candidate with a type.

Entities are bounded: a candidate has at most ``MAX_TOKENS`` tokens and ``MAX_CHARS``
characters (one long token: ``MAX_KEY``), and holds a digit or the word "at" (see
``candidates``).  Texts are read in zones around digits, at signs and that word, wide
enough to hold every candidate with its surroundings, so zones leave none out; what
no candidate covers is outside of any entity.  Candidates that touch a base span are
left out before the program runs, so added and base spans never overlap.

The field is trained by maximum likelihood (forward-backward over segmentations)
on a small labelled table that ``training_rows`` writes from templates; training is
deterministic and runs on the driver, and the weights travel with the tasks.

One streaming pass, no shuffle.  Defined cases: null text counts as empty; repeated
rows each get a row; null ids stay null; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship_package

#: secret: keys, tokens, passwords; id: numbers of persons and bank accounts.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
MAX_TOKENS, MAX_CHARS, MAX_KEY = 16, 80, 512
#: Characters of surroundings that features look at.
AROUND = 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# The look-behind spares digit runs that were tried from their start already; it changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs so that long runs cost linear time."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _only_digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- candidate segments and their features -----------------------------------

# A key with hyphens or underscores is one token: 16 characters or more, with a letter and a digit.
_KEY = r"(?=[A-Za-z_-]{0,500}[0-9])(?=[0-9_-]{0,500}[A-Za-z])[A-Za-z0-9][A-Za-z0-9_-]{14,510}[A-Za-z0-9](?![A-Za-z0-9_-])"
_TOKEN = re.compile(rf"(?<![A-Za-z0-9_-]){_KEY}|\w+|[^\w\s]|\n")
_TRIGGER = re.compile(r"[0-9@]|\bat\b", re.I)
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_COLON_HEX = re.compile(r"(?=(?:[^:]*:){3})(?:[0-9a-fA-F]{1,4}(?:::?|\Z)){2,8}\Z")
_KEY_START = re.compile(r"(?:AKIA|ASIA|eyJ|AIza|xox[a-z]-|[a-z]{2,6}_|(?:sk|pk|rk)-)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}")
_LETTERS = re.compile(r"[^\W\d_]{3}")
_WORDS_BEFORE = re.compile(r"\w+")
# Words that hint at a kind when they stand before a span.
HINTS = {
    "secret": "token secret key apikey password passwd pwd bearer credential",
    "phone": "phone tel telephone call mobile fax cell telefon teléfono téléphone",
    "card": "card visa mastercard credit amex karte tarjeta carte",
    "email": "mail email contact write",
    "ip": "ip host server address from",
    "id": "ssn social security iban account konto cuenta compte passport national insurance",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}


def _shape(s: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), s)
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"\s+", "_", s)[:16]


def iban_checks(s: str) -> bool:
    """Whether the letters and digits of ``s`` are an account number by ISO 13616 (remainder 1 by 97)."""
    return bool(_IBAN.match(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _classes(s: str) -> str:
    """Which of capitals, small letters, digits and joints a token mixes."""
    return "".join(name for name, pattern in (("A", "[A-Z]"), ("a", "[a-z]"), ("9", "[0-9]"), ("_", "[_-]")) if re.search(pattern, s))


def features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Features of text[start:end] as a whole, in its surroundings."""
    s = text[start:end]
    digits = _only_digits(s)
    n = len(digits)
    before = text[max(0, start - AROUND) : start]
    words = [w.lower() for w in _WORDS_BEFORE.findall(before.split("\n")[-1])][-3:]
    near = next((_HINT_OF[w] for w in reversed(words) if w in _HINT_OF), "none")
    left, right = text[start - 1 : start], text[end : end + 1]
    shape = _shape(s)
    out = ["bias", f"hint={near}", f"tokens={min(n_tokens, 8)}", f"digits={n if n < 8 else 8 if n < 10 else 10 if n < 12 else 12 if n < 16 else 16}", f"shape={shape}"]
    if left.isalnum() or right.isalnum() or left in ("+", "#", "-", "(") or right in ("-", "@") or (right in (".", ":") and text[end + 1 : end + 2].isalnum()) or (left == ":" and text[max(0, start - 2) : start - 1].isalnum()):
        out.append("cut")
    if s[-1:] in "-.,(:\"'" or s[:1] in "-.,):\"'":
        out.append("ragged")
    if "(" in s or ")" in s:
        out.append("paren" if s.count("(") == s.count(")") == 1 else "broken_paren")
    if n >= 13 and luhn(digits) and not re.search(r"[^\d -]", s):
        out.append("luhn")
    if n_tokens == 1 and _HEX.match(s) and len(s) >= 16:
        mixed = 0 < n < len(s)
        out.append(("hex32" if len(s) >= 32 else "hex16") + ("_mixed" if mixed else "_plain"))
    elif n_tokens == 1 and len(s) >= 16 and n and n < len(s):
        out.append("long_" + _classes(s))
        out.append("turns" if len(re.findall(r"[0-9]+|[A-Z]+|[a-z]+", s)) >= len(s) / 4 else "words")
        if _KEY_START.match(s):
            out.append("key_start")
    if re.match(r"[A-Z]{2}[0-9]{2}", s) and n >= 10:
        out.append("iban" if iban_checks(re.sub(r"\s", "", s)) else "iban_like")
    if re.search(r"\w\s+at\s+\w[\w-]*\s+dot\s+\w+\Z", s, re.I) or re.search(r"\w\s*[\[(]\s*at\s*[\])]\s*\w", s, re.I):
        out.append("spoken_mail")
        if "cut" not in out and re.search(r"\w\s+dot\s+\Z", before, re.I):
            out.append("cut")
    elif re.search(r"[^\W\d_]", s) and n_tokens > 1:
        out.append("letters")
    if _COLON_HEX.match(s) and not (left == ":" or (right == ":" and text[end + 1 : end + 2].isalnum())):
        out.append("colon_hex")
    if left in "\"'" and right in "\"'" and left and right:
        out.append("quoted")
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token ranges [i, j) that may be an entity: they pass a cheap gate, whatever their type.

    One token: 16 characters or more with a digit, or seven digits.  Several: seven
    digits and no word of three letters, or the form of an address in colons, of an
    account number, or of a spelled out mail address.  Counts up to each token make
    a range cost one subtraction.
    """
    n = len(tokens)
    words = [text[s:e] for s, e in tokens]
    counts = np.zeros((n + 1, 5), np.int32)  # digits, colons, words of three letters, "at", "dot" or an "at" in brackets
    for k, w in enumerate(words):
        row = counts[k + 1]
        if len(w) == 1:
            row[0], row[1] = w.isdigit(), w == ":"
            continue
        if not w.isalpha():
            row[0] = sum(map(str.isdigit, w))
        row[2] = bool(_LETTERS.search(w))
        low = w.lower() if len(w) < 4 else ""
        if low == "at":
            row[3] = 1
            row[4] = 0 < k < n - 1 and words[k - 1] in ("[", "(") and words[k + 1] in ("]", ")")
        elif low == "dot":
            row[4] = 1
    digits, colons, letters, ats, dots = np.cumsum(counts, axis=0).T.tolist()
    out = []
    for i, (start, first_end) in enumerate(tokens):
        top = min(n, i + MAX_TOKENS)
        if digits[top] - digits[i] < 2 and digits[i + 1] == digits[i] and ats[top] == ats[i]:
            continue  # nothing that begins here passes
        first = text[start]
        if not (first.isalnum() or first in "+("):
            continue
        size = first_end - start
        d = digits[i + 1] - digits[i]
        if (d and size >= 16 or d >= 7) and size <= MAX_KEY:
            out.append((i, i + 1))
        account = first.isupper() and bool(_ACCOUNT.match(words[i]))
        for j in range(i + 2, top + 1):
            end = tokens[j - 1][1]
            last = text[end - 1]
            if end - start > MAX_CHARS or last == "\n":
                break
            if not (last.isalnum() or last == ")"):
                continue
            d = digits[j] - digits[i]
            if (
                (d >= 7 and letters[j] == letters[i])
                or (d >= 2 and colons[j] - colons[i] >= 3)
                or (account and d >= 10 and _IBAN.match("".join(text[start:end].split())))
                or (ats[j] > ats[i] and dots[j] > dots[i])
            ):
                out.append((i, j))
    return out


class SemiMarkovField:
    """Weights of whole-span features per type; one token outside of entities scores 0."""

    def __init__(self, weights: dict[tuple[str, str], float], chain: float = 0.0):
        self.weights, self.chain = weights, chain  # chain: an entity right after another

    def scores(self, feats: list[str]) -> list[float]:
        w = self.weights
        return [sum(w.get((k, f), 0.0) for f in feats) for k in KINDS]

    def decode(self, n: int, spans: list[tuple[int, int, list[float]]]) -> list[tuple[int, int, str]]:
        """Best segmentation of ``n`` tokens: the chosen (i, j, kind)."""
        ends: dict[int, list] = {}
        for i, j, sc in spans:
            k = max(range(len(KINDS)), key=sc.__getitem__)
            ends.setdefault(j, []).append((i, sc[k], KINDS[k]))
        low = -math.inf
        out = [0.0] + [low] * n  # best when the last segment is outside
        ent = [low] * (n + 1)  # best when the last segment is an entity
        back: list[tuple | None] = [None] * (n + 1)
        for j in range(1, n + 1):
            out[j] = max(out[j - 1], ent[j - 1])
            for i, s, kind in ends.get(j, ()):
                best = max(out[i], ent[i] + self.chain) + s
                if best > ent[j]:
                    ent[j], back[j] = best, (i, kind)
        chosen, j, inside = [], n, ent[n] > out[n]
        while j > 0:
            if inside:
                i, kind = back[j]
                chosen.append((i, j, kind))
                inside = ent[i] + self.chain > out[i]
                j = i
            else:
                j -= 1
                inside = ent[j] > out[j]
        return chosen[::-1]

    @classmethod
    def train(cls, rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.5, decay: float = 0.002) -> SemiMarkovField:
        """Maximum likelihood by AdaGrad; expectations come from forward-backward over segmentations."""
        names: dict[str, int] = {}
        examples = []
        for text, gold in rows:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            where = {(s, e): k for k, s, e in gold}
            spans = []
            for i, j in candidates(text, tokens):
                s, e = tokens[i][0], tokens[j - 1][1]
                f = np.array([names.setdefault(x, len(names)) for x in features(text, s, e, j - i)])
                spans.append((i, j, f, KINDS.index(where[s, e]) if (s, e) in where else -1))
            if spans:
                examples.append((len(tokens), spans))
        w, seen = np.zeros((len(KINDS), len(names))), np.full((len(KINDS), len(names)), 1e-6)
        chain, chain_seen = 0.0, 1e-6
        for _ in range(rounds):
            for n, spans in examples:
                grad, extra = cls._gradient(n, spans, w, chain)
                grad -= decay * w
                seen += grad * grad
                w += rate * grad / np.sqrt(seen)
                extra -= decay * chain
                chain_seen += extra * extra
                chain += rate * extra / math.sqrt(chain_seen)
        return cls({(k, x): float(w[a, b]) for a, k in enumerate(KINDS) for x, b in names.items() if abs(w[a, b]) > 1e-9}, chain)

    @staticmethod
    def _gradient(n: int, spans: list, w: np.ndarray, chain: float) -> tuple[np.ndarray, float]:
        low = -1e30

        def lse(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        sums = [w[:, f].sum(axis=1) for _, _, f, _ in spans]
        total = [float(np.logaddexp.reduce(s)) for s in sums]
        by_end, by_start = {}, {}
        for k, (i, j, _, _) in enumerate(spans):
            by_end.setdefault(j, []).append(k)
            by_start.setdefault(i, []).append(k)
        fo, fe = [0.0] + [low] * n, [low] * (n + 1)
        for j in range(1, n + 1):
            fo[j] = lse(fo[j - 1], fe[j - 1])
            for k in by_end.get(j, ()):
                i = spans[k][0]
                fe[j] = lse(fe[j], lse(fo[i], fe[i] + chain) + total[k])
        bo, be = [low] * n + [0.0], [low] * n + [0.0]  # from a place reached by outside / by an entity
        for i in range(n - 1, -1, -1):
            bo[i], be[i] = bo[i + 1], bo[i + 1]
            for k in by_start.get(i, ()):
                rest = total[k] + be[spans[k][1]]
                bo[i], be[i] = lse(bo[i], rest), lse(be[i], rest + chain)
        z = lse(fo[n], fe[n])
        grad, extra = np.zeros_like(w), 0.0
        gold_ends = {j for _, j, _, y in spans if y >= 0}
        for k, (i, j, f, y) in enumerate(spans):
            part = math.exp(min(0.0, lse(fo[i], fe[i] + chain) + total[k] + be[j] - z))
            p = part * np.exp(sums[k] - total[k])
            grad[:, f] -= p[:, None]  # no feature is there twice
            extra -= math.exp(min(0.0, fe[i] + chain + total[k] + be[j] - z))
            if y >= 0:
                grad[y, f] += 1.0
                extra += i in gold_ends
        return grad, extra


def training_rows(seed: int = 1, copies: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: texts with (kind, start, end), written from templates with marked spans."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCdefGHIjkl0123456789") for _ in range(n - 2)) + digits(2)
    name = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(3, 8)))

    def card(good: bool) -> str:
        body = digits(15)
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if good else str((int(check) + r.randint(1, 9)) % 10))

    capitals = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def iban(country: str, n: int, group: int) -> str:
        body = digits(n)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        whole = f"{country}{check:02d}{body}"
        return " ".join(whole[i : i + group] for i in range(0, len(whole), group)) if group else whole

    templates = [
        lambda: f'{name()} token = "<secret>{hexes(40)}</>" {name()} {name()}.',
        lambda: f"api key: <secret>{mixed(32)}</> do not share",
        lambda: f"{name()} password <secret>{mixed(r.randint(16, 24))}</>, then {name()}",
        lambda: f"{name()} {name()} <secret>{hexes(r.choice([32, 40, 64]))}</> {name()}",
        lambda: f"secret={name()} and bearer <secret>{mixed(40)}</>",
        lambda: f"call <phone>({digits(3)}) {digits(3)}-{digits(4)}</> after six",
        lambda: f"{name()} <phone>{digits(3)}-{digits(3)}-{digits(4)}</> {name()}",
        lambda: f"tel. <phone>0{digits(3)} {digits(3)} {digits(3)}</> or write",
        lambda: f"phone: <phone>{digits(3)}.{digits(3)}.{digits(4)}</>\n{name()}",
        lambda: f"my {name()} is <email>{name()} at {name()} dot com</> thanks",
        lambda: f"mail <email>{name()} [at] {name()} dot org</> today",
        lambda: f"<email>{name()} (at) {name()} dot net</> {name()} {name()}",
        lambda: f"from <ip>{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}</> came {name()}",
        lambda: f"card <card>{card(True)}</> was charged",
        lambda: f"{name()} {card(False)} {name()} {name()}",
        lambda: f"order {digits(8)} was sent on 2024-0{r.randint(1, 9)}-1{digits(1)} at 10:3{digits(1)}",
        lambda: f"{name()} 19{digits(2)}-20{digits(2)} {name()} pages {digits(3)}-{digits(3)}",
        lambda: f"the population was {r.randint(1, 9)},{digits(3)},{digits(3)} in 19{digits(2)}",
        lambda: f"version {digits(1)}.{digits(1)}.{digits(2)} of {name()} costs {digits(3)}.{digits(2)}",
        lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)} {name()}",
        lambda: f"{name()} looked at {name()} and then at {name()} in the {name()}",
        lambda: f"the key to {name()} is {name()} and a token of {name()} {digits(2)}",
        lambda: f"{digits(9)} {name()} {digits(12)} {name()} {digits(7)}",
        lambda: f"{name()}{digits(2)} {digits(4)} {digits(4)} {digits(2)} {name()} {digits(5)}",
        lambda: f"{name()} 3.{digits(20)} {name()}",
        lambda: f"{name()} <secret>AKIA{capitals(8)}{digits(1)}{capitals(7)}</> {name()}",
        lambda: f"{name()}: <secret>{r.choice(['ghp', 'glpat', 'hf', 'npm'])}_{mixed(36)}</>",
        lambda: f"use <secret>sk-{mixed(r.choice([24, 48]))}</> for {name()}",
        lambda: f"<secret>{mixed(8)}-{mixed(8)}-{mixed(8)}-{mixed(8)}</> {name()}",
        lambda: f"{r.choice(['SSN', 'ssn:', 'social security number'])} <id>{digits(3)}-{digits(2)}-{digits(4)}</> {name()}",
        lambda: f"{name()} <id>{digits(3)}-{digits(2)}-{digits(4)}</> {name()} {name()}",
        lambda: f"IBAN <id>{iban('DE', 18, 4)}</> {name()}",
        lambda: f"{name()} {name()} <id>{iban(r.choice(['FR', 'ES', 'NL']), r.choice([14, 20, 23]), r.choice([0, 4]))}</> {name()}",
        lambda: f"{name()} <phone>0{digits(2)} {digits(4)} {digits(4)}</> {name()}",
        lambda: f"ring <phone>0{digits(4)} {digits(6)}</> {name()}",
        lambda: f"fax <phone>00{digits(2)} {digits(2)} {digits(3)} {digits(4)}</>",
        lambda: f"{name()} <phone>({digits(3)}) {digits(3)} {digits(4)}</>, {name()}",
        lambda: f"{name()} <email>{name()} dot {name()} at {name()} dot com</> {name()}",
        lambda: f"<email>{name()}{digits(2)} at {name()} dot co dot uk</> {name()}",
        lambda: f"host <ip>fe80::{hexes(3)}:{hexes(4)}:{hexes(4)}:{hexes(4)}</> {name()}",
        lambda: f"{name()} <ip>2001:db8::{hexes(2)}:{digits(1)}</> {name()}",
        lambda: f"{name()} <ip>{':'.join(hexes(r.randint(1, 4)) for _ in range(8))}</> {name()}",
        lambda: f"{name()} {name()} <ip>{hexes(4)}::{':'.join(hexes(r.randint(1, 4)) for _ in range(r.randint(3, 6)))}</> {name()}",
        lambda: f"the {digits(1)} {name()} at {digits(1)} dot {name()} {name()}",
        lambda: f"{name()} is at {digits(1)} dot {digits(1)} {name()}",
        lambda: f"{name()} at {digits(2)}:{digits(2)}:{digits(2)} and {digits(2)}:{digits(2)}:{digits(2)} {name()}",
        lambda: f"{name()}-{digits(2)}-{name()}-{name()}-{name()} {name()}",
        lambda: f"{name()}_{name()}_{name()}{digits(1)}_{name()} = {digits(3)}",
        lambda: f"{name()} part {digits(4)}-{digits(4)}-{digits(2)} {name()}",
        lambda: f"between 1 {digits(3)} {digits(3)} and 2 {digits(3)} {digits(3)} {name()}",
        lambda: f"{name()} {digits(2)}.{digits(2)}.20{digits(2)} {digits(2)}:{digits(2)} {name()} {digits(3)}",
        lambda: f"dinner at {name()} at {digits(1)} with a dot on the map {name()}",
        lambda: f"{name()} [{digits(1)}] {name()} ({digits(4)}) {name()} {digits(3)}-{digits(3)}, {digits(4)}",
        lambda: f"{name()} {digits(2)} {digits(3)} {digits(2)} {digits(1)} {digits(3)} {name()}",
    ]
    rows = []
    for _ in range(copies):
        for t in templates:
            marked, text, spans, at = t(), "", [], 0
            for m in re.finditer(r"<(\w+)>(.*?)</>", marked):
                text += marked[at : m.start()]
                spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
                text += m.group(2)
                at = m.end()
            rows.append((text + marked[at:], spans))
    return rows


def _zones(text: str) -> list[list[int]]:
    """Stretches of whole words that hold every candidate and what its features look at."""
    reach = MAX_CHARS + AROUND
    zones: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if zones and m.start() - reach <= zones[-1][1]:
            zones[-1][1] = m.end() + reach
        else:
            zones.append([m.start() - reach, m.end() + reach])
    out: list[list[int]] = []
    for lo, hi in zones:
        lo, hi = max(0, lo), min(len(text), hi)
        # Whole tokens only; a token too long to be a candidate is cut, which keeps it none.
        least, most = max(0, lo - MAX_KEY - 1), min(len(text), hi + MAX_KEY + 1)
        while lo > least and not text[lo - 1].isspace():
            lo -= 1
        while hi < most and not text[hi].isspace():
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], field: SemiMarkovField) -> list[tuple[str, int, int]]:
    """Spans that the field finds away from the base spans."""
    taken: list[list[int]] = []  # base spans, united where they overlap
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]

    def free(s: int, e: int) -> bool:
        k = bisect_right(ends, s)
        return k == len(taken) or taken[k][0] >= e

    out: list[tuple[str, int, int]] = []
    for lo, hi in _zones(text):
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        found = [(i, j) for i, j in candidates(text, tokens) if free(tokens[i][0], tokens[j - 1][1])]
        spans = [(i, j, field.scores(features(text, tokens[i][0], tokens[j - 1][1], j - i))) for i, j in found]
        out += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in (field.decode(len(tokens), spans) if spans else ())]
    return out


def find_spans(text: str | None, field: SemiMarkovField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    found = sorted({*base, *added_spans(text, base, field)}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return base, found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(field: SemiMarkovField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column("text"):
                base, found = find_spans(t.as_py(), field)
                for c, kind in zip(cols, KINDS[:4]):
                    c.append(sum(k == kind for k, _, _ in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(found))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(cols, types)]], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


_trained: list[SemiMarkovField] = []


def default_field() -> SemiMarkovField:
    if not _trained:
        _trained.append(SemiMarkovField.train(training_rows()))
    return _trained[0]


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: SemiMarkovField | None = None) -> DataFrame:
    """One row per row of ``docs``: id, counts of the base kinds, base_sha256, spans (base and added)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_find(field or default_field()), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact(text: str | None, field: SemiMarkovField) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(find_spans(text, field)[1], key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
            at = e
    return "".join(out) + text[at:]
