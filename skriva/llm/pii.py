"""Personal information inside free text.

Generators propose spans with high recall, overlapping and of several types at once. Boosted trees judge each by its
format and its context; per type, a calibrated threshold selects; of overlapping selected spans the most probable stays.

There are no labelled rows for this problem, so the trees learn from `TRAIN_SNIPPETS` labelled snippets that
`pii_snippets` writes with invented values in frames of its own; probabilities and thresholds are calibrated on snippets
of other frames. Training happens once on the driver; the model is some ten kilobytes.

One pass over the rows, no shuffle, whole texts. Null and empty texts hold nothing and stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skriva.llm import boost, pii_snippets

TYPES = ("email", "phone", "idnumber", "address", "name")
#: Bound on the labelled snippets that the trees learn from.
TRAIN_SNIPPETS = 9000
#: And on those that calibrate it.
CALIBRATION_SNIPPETS = 3000
#: Bound on the names that are sent to every task.
MAX_NAMES = 200_000

#: Full-width forms to plain ones, one to one, so that places stay.
_WIDE = {0xFF10 + i: 48 + i for i in range(10)} | {0xFF20: 64, 0xFF0D: 45, 0x2212: 45, 0x2010: 45, 0x2011: 45, 0xFF0B: 43, 0xFF08: 40, 0xFF09: 41, 0x3000: 32, 0xFF0E: 46}
_HAS_WIDE = re.compile("[０-９＠－−‐‑＋（）．　]")

_EMAIL = re.compile(
    r"(?i)(?:mailto:)?(?P<v>[\w.+\-']{1,64}(?:@| ?[\[(] ?at ?[\])] ?)(?:[\w\-]{1,63}(?:\.| ?[\[(] ?dot ?[\])] ?)){1,6}[\w\-]{2,24})"
)
_DIGITS = re.compile(r"(?<![\w.\-/:])(?:\+|\()?\d[\d ().\-]{5,24}\d(?![\w])(?:,? ?(?:ext|x|Durchwahl|内線)\.? ?\d{1,5})?")
# A pattern that begins with a set of characters is looked for much faster, so what may not stand before comes after it: `.` is the first.
_ID = [
    re.compile(p)
    for p in (
        r"[A-Z](?<![\w/+=\-].)[A-Z]\d{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{1,4}(?![\w/+=])",
        r"\d(?<![\w.\-].)\d{2}-\d{2}-\d{4}(?![\w\-])",
        r"[A-Z](?<![\w/+=\-].)(?=[A-Z0-9]{6,17}\b)[A-Z]{0,5}\d{5,9}[A-Z0-9]{0,5}(?![\w/+=])",
        r"[A-Z](?<!\w.)[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b",
        r"[A-Z](?<!\w.)[A-Z] [A-Z0-9]{2}(?: [A-Z0-9]{4}){3,7}\b",
        r"\d(?<![\w.\-].)\d{2}\.\d{3}\.\d{3}-\d{2}(?![\w\-])",
        r"\d(?<![\w.\-].)\d{5,7}-?[A-Z\d]{1,4}(?![\w\-])",
        r"[A-Z](?<![\w/+=\-].)(?=[A-Z]*\d[A-Z\d]*\d[A-Z\d]*\d)[A-Z0-9]{7,9}(?![\w/+=\-])",
    )
]
# Words of streets.
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Blvd|Boulevard|Drive|Dr|Terrace|Ter|Way|Place|Pl|Square|Sq|Close|Crescent|Parkway|Row)"
_CITY = r"(?:,? ?\d{5})?(?:,? ?[A-ZÄÖÜ][\wäöüß]+(?:[ \-][A-ZÄÖÜ][\wäöüß]+)?)?(?:,? ?\d{5})?"
_ADDRESS = [
    (words, re.compile(p))
    for words, p in (
        (
            (" st", " ave", " road", " rd", " lane", " ln", " court", " ct", " blvd", " boulevard", " dr", " ter", " way", " pl", " sq", " close", " cres", " parkway", " row"),
            r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? ?\w{1,5},? )?\b\d{1,5}[A-Za-z]?,? (?:[A-Z][\w'\-]+ ){1,3}" + _STREET + r"\b\.?" + r"(?:, [A-Z][\w]+(?: \d{5})?)?",
        ),
        (
            ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "quai "),
            r"\b\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse)(?: (?:de|du|des|la|le|les))* [A-ZÉÈ][\w'\-é]+" + _CITY,
        ),
        (
            ("weg", "straße", "strasse", "str.", "gasse", "platz", "allee", "ring", "damm", "ufer", "stieg", "pfad"),
            r"\b[A-ZÄÖÜ][\wäöüß\-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer|stieg|pfad|[ \-](?:Weg|Straße|Allee|Platz)) \d{1,4} ?[a-z]?\b(?:, \d{5} [A-ZÄÖÜ][\wäöüß]+)?",
        ),
        (("box", "postfach", "私書箱", "b.p.", "apartado"), r"(?i)\b(?:p\. ?o\. ?box|po box|post office box|postfach|b\.p\.|apartado) ?\d{1,6}\b(?:, [\w]+)?|私書箱 ?\d+"),
        (("〒", "県", "都", "府", "道", "市", "区"), r"(?:〒 ?|(?<![\d\-]))\d{3}-\d{4} ?[一-鿿]{2,}[一-鿿ぁ-んァ-ヶー]*[\d一二三四五六七八九十丁目番地号の\-]*|[一-鿿]{1,5}[都道府県][一-鿿ぁ-んァ-ヶー]{1,12}?[市区町村郡][一-鿿ぁ-んァ-ヶー]{1,14}\d+(?:-\d+){1,3}"),
    )
]
# Latin letters of names.
_UP, _LOW = "A-ZÀ-ÖØ-ÞČĐĘŁŃŚŞŠŹŻŽİ", "a-zß-öø-ÿāăąćčđēęěğīıłńňőœřśşšťūůűźżž"
_TOKEN = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
#: A token at the start of a word.
_FIRST = rf"[{_UP}](?<!\w.)[{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
_NAME = [
    re.compile(p)
    for p in (
        rf"(?P<v>{_FIRST},? (?:[A-Z]\.? )?{_TOKEN})\b(?!\w)",
        rf"(?P<v>[A-Z](?<!\w.)\. ?(?:[A-Z]\. ?)?{_TOKEN})\b",
        rf"\b(?:Dr|Mr|Mrs|Ms|Miss|Prof|Sir|Lady|Frau|Herr|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señora?|Signora?|Dott)\.? (?P<v>{_TOKEN}(?: {_TOKEN})?)\b",
        rf"\b(?P<v>[{_UP}]{{3,}} [{_UP}]{{3,}})\b",
        rf"(?:-by|author|assignee|owner|reviewer|reporter|contact|attn|from|to|cc|name|kontakt|ansprechpartner)[\"']?\s?[:=]\s?[\"']?(?P<v>[{_LOW}]{{2,}}(?: [{_LOW}]\.?)? [{_LOW}\-]{{2,}})\b(?!@)",
        r"(?:氏名|名前|担当者?|宛名|署名者)\s?[:：は]?\s?(?P<v>[一-鿿ァ-ヶー]{1,8}[ ・]?[一-鿿ァ-ヶー]{1,8})",
        r"(?P<v>(?:[ァ-ヶー]{2,8}(?:[ ・][ァ-ヶー]{2,8})?)|(?:[一-鿿]{2,3}[ ・]?[一-鿿]{1,3}))(?=さん|様|氏|君|ちゃん|先生|殿)",
        r"(?P<v>[ァ-ヶー]{2,8}[ ・][ァ-ヶー]{2,8})",
    )
]
_CAPS = re.compile(r"[A-Z]{3,} [A-Z]{3,}")

#: Words near a span, by what they speak for; matched in the 32 characters before and the 20 after it.
# Fixed values.
_LEFT = {
    "phone": r"\btel|phone|fon\b|\bcall(?:s|ed|ing)?\b(?!/)|\bfax|mobil|\bcell|handy|電話|携帯|連絡先|\bruf|anruf|rückruf|rufnummer|on-call|\bring\b|durchwahl|dial|\bsms\b|hotline|número|numéro|appel|llam|unter $",
    "id": r"iban|passport|reisepass|pasaporte|passeport|\bssn\b|social security|licen[cs]e|\bnino\b|insurance|\btax|\btin\b|itin|card|steuer|ausweis|personal\w*nummer|personnummer|マイナンバー|免許|旅券|保険|口座|カード|本人|確認|\bno\.|account|identi|versicherung|national|konto|\bcpf\b|\bnhs\b|aadhaar|\bdni\b|\bnif\b|pesel|\bid\b.{0,12}$",
    "address": r"address|adresse|\baddr\b|住所|anschrift|zustell|liefer|lieferung|ship|deliver|lives? (?:at|in)|\bsend|post|mail to|宛先|届け|送付|送り先|wohn|visit|dirección|return|sitz",
    "name": r"name|氏名|担当|-by|\bdr\b|\bmrs?\b|\bms\b|frau|herr|prof|author|asked?|from|reviewer|assignee|assigned|contact|dear|kontakt|owner|thanks|signed|\bsra?\b|\bmme\b|monsieur|señor|met $|spoke with",
    "email": r"mail|contact|write|writ|reporter|reported|cc|to:|from|連絡先|メール|問い合わせ|kontakt|reply|sender|user|author|owner|notify",
    "no": r"\b(?:job|offset|row|rows|line|build|version|release|port|took|code|commit|id|ticket|issue|pid|seq|page|limit|size|bytes|count|of|step|batch|status|hash|in|no|duration|after|order|parcel|range|chunk|serial|part|ean)[ =:#]*$",
    "repo": r"git clone|\bssh |scp |rsync|://|remote|docker|npm|pip |install|sftp|pinned|requires|@$|login",
    "the": r"\b(?:the|a|an|der|die|das|our|this|that)\s$",
    "to": r"\b(?:to|with|by|ask|asked|met|meet|thanks|from|for|mit|von|bei|frag|an)\s$",
    "title": r"\b(?:dr|mr|mrs|ms|prof|herr|frau|sra?|mme|monsieur|miss)\.? $",
}
_RIGHT = {
    "no": r"^\s?(?:ms\b|s\b|px|rows|of (?:the|\d)|took|lines|bytes|kb|mb|at \d|[|\t])",
    "honorific": r"^\s?(?:さん|様|氏|君|先生|殿|ちゃん)",
    "person": r"^,? (?:asks?|asked|sign(?:s|ed)|says?|said|writes?|wrote|wants?|review(?:s|ed)|approve[sd]|report(?:s|ed)|call(?:s|ed)|will|would|has|had|hat|sagt|schrieb|told|tells|left|fixe[sd]|confirmed|complained|who|bestätigt|und|and [A-Z]|about|before|first|llamó|est|no)\b|^\s?[<(]",
    "thing": r"^\s(?:theme|mode|colou?r|px|inc|ltd|gmbh|corp|llc|ag\b|release[ds]?\b|edition|palette|is|was|\d)",
    "path": r"^(?::[\w~/]|/)",
    "json": r"^[\"']",
}
_LEFT_RX = [re.compile(p) for p in _LEFT.values()]
_RIGHT_RX = [re.compile(p) for p in _RIGHT.values()]
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_POST = re.compile(r"\b\d{5}\b|〒|\d{3}-\d{4}")
_GROUP = re.compile(r"\d+")
_NOT_ALNUM = re.compile(r"[^A-Za-z0-9]")


def check_digits(v: str) -> bool:
    """Does the number end or begin with the right check digits of a bank account, a card or a national number?"""
    s = _NOT_ALNUM.sub("", v).upper()
    if len(s) >= 15 and s[:2].isalpha() and s[2:4].isdigit() and s.isascii():
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if not (s.isascii() and s.isdigit()):
        return False
    if 13 <= len(s) <= 19:
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0
    if len(s) == 11:
        one = sum(int(c) * (10 - i) for i, c in enumerate(s[:9])) * 10 % 11 % 10
        two = sum(int(c) * (11 - i) for i, c in enumerate(s[:10])) * 10 % 11 % 10
        return (one, two) == (int(s[9]), int(s[10]))
    if len(s) == 10:
        return sum(int(c) * (10 - i) for i, c in enumerate(s)) % 11 == 0
    return False


@dataclass(frozen=True)
class Names:
    """Known names in lower case by type, and the letter triples they hold."""

    given: frozenset[str]
    family: frozenset[str]
    triples: frozenset[str]
    exact: frozenset[str]
    common: frozenset[str]

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Names:
        given = frozenset(n.lower() for n, t in rows if n and t == "given")
        family = frozenset(n.lower() for n, t in rows if n and t != "given")
        common = frozenset(n.lower() for n in pii_snippets.GIVEN + pii_snippets.FAMILY + pii_snippets.KANJI_FAMILY + pii_snippets.KANJI_GIVEN)
        return Names(given, family, frozenset(t for n in given | family | common for t in _triples(n)), frozenset(n for n, _ in rows if n), common)


def _triples(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def candidates(s: str, names: Names) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with wide forms made plain, and the proposed (start, end, type), overlapping and without order."""
    if not s.isascii() and _HAS_WIDE.search(s):
        s = s.translate(_WIDE)
    ascii_only = s.isascii()
    out: list[tuple[int, int, str]] = []
    if "@" in s or "at)" in s or "at]" in s or "AT)" in s or "AT]" in s:
        out += [(*m.span("v"), "email") for m in _EMAIL.finditer(s)]
    if _LONG_NUMBER.search(s):
        for m in _DIGITS.finditer(s):
            v = m[0]
            n = sum(map(str.isdigit, v))
            if 7 <= n <= 20 and "  " not in v:
                out.append((*m.span(), "phone"))
                out.append((*m.span(), "idnumber"))
        for rx in _ID:
            out += [(*m.span(), "idnumber") for m in rx.finditer(s)]
    low = s.lower()
    if _ANY_DIGIT.search(s):
        for words, rx in _ASCII_ADDRESS if ascii_only else _ADDRESS:
            for w in words:
                if w in low:
                    out += [(*m.span(), "address") for m in rx.finditer(s)]
                    break
    seen = set()
    for rx in _NAME[:3] if ascii_only else _NAME[:3] + _NAME[5:]:
        seen.update(m.span("v") for m in rx.finditer(s))
    if _CAPS.search(s):
        seen.update(m.span("v") for m in _NAME[3].finditer(s))
    if ":" in s or "=" in s:
        # Places in `low` are those in `s` unless lowering changed a length.
        seen.update(m.span("v") for m in _NAME[4].finditer(low if len(low) == len(s) else s))
    for m in (_ASCII_WORD if ascii_only else _WORD).finditer(s):
        a = m.start()
        if (w := m[0]) in names.exact or w.lower() in names.common or a and s[a - 1] == " " and s[max(0, a - 7) : a].lower().endswith(_SPOKEN_TO):
            seen.add((a, m.end()))
    out += [(a, b, "name") for a, b in seen]
    return s, out


_LONG_NUMBER = re.compile(r"\d[\d ().\-]{4,}\d|[A-Z]{2} ?\d\d|\d{3}-\d\d")
_ANY_DIGIT = re.compile(r"\d")
# Words before a person who is spoken of by one name.
_SPOKEN_TO = ("talk to ", "k to ", "e to ", "n to ", "to ", "with ", "by ", "ask ", "asked ", "met ", "thanks ", "from ", "for ", "mit ", "von ", "bei ", "frag ")
#: A word that may be a name by itself.
_WORD = re.compile(rf"\b[{_UP}][{_LOW}]+\b|[ァ-ヶー]{{2,12}}|[一-鿿]{{1,4}}")
#: The same in a text of ASCII only, and the addresses that can stand in one.
_ASCII_WORD = re.compile(r"[A-Z](?<!\w.)[a-z]+\b")
_ASCII_ADDRESS = [(own, rx) for words, rx in _ADDRESS if (own := tuple(w for w in words if w.isascii()))]
_SPLIT = re.compile(r"[\s,.・\"'\-]+")
#: Words of the training frames that are no names: what a title or a product is made of.
_ORDINARY = frozenset(w.lower() for f in pii_snippets.FRAMES + pii_snippets.FILLERS for w in re.findall(r"[A-Za-z]{2,}", re.sub(r"\{\w+\}", " ", f))) | frozenset(w for x in pii_snippets._FILL.values() for w in x)


@lru_cache(maxsize=20_000)
def _context(low: str, right: str) -> tuple[float, ...]:
    """Which words stand before and after a span; several spans of a text share them, and texts repeat."""
    return (*(float(bool(rx.search(low))) for rx in _LEFT_RX), *(float(bool(rx.search(right))) for rx in _RIGHT_RX))


def features(s: str, a: int, b: int, kind: str, names: Names) -> list[float]:
    """Format and context of a proposed span, as numbers; the same places for every type."""
    v = s[a:b]
    left, right = s[max(0, a - 32) : a], s[b : b + 20]
    low = left.lower().rpartition("\n")[2]
    right_line = right.partition("\n")[0]
    prev, after = s[a - 1] if a else "\n", s[b] if b < len(s) else "\n"
    f = [float(kind == t) for t in TYPES]
    f += _context(low, right_line.lower())
    groups = [len(g) for g in _GROUP.findall(v)]
    digits = sum(groups)
    letters = sum(map(str.isalpha, v))
    f += [len(v), digits, len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0)]
    f += [letters, sum(map(str.isupper, v)) / max(letters, 1), float(v[0] == "0"), float(v[0] in "+("), float("-" in v), float(" " in v), float("." in v), float("(" in v)]
    f += [float(prev == "\n"), float(prev in " \t"), float(prev in "\"'<>(["), float(after == "\n"), float(after in "\"'<>)]"), float(after in ",|\t"), float(prev in ",|\t")]
    f += [float(prev == "\n" and after in ".\n"), float("ext" in v), float(bool(_POST.search(v))), float(bool(_IP.fullmatch(v))), float(prev == "-" or after == "-"), float(kind == "idnumber" and check_digits(v)), float(groups == [3, 2, 4]), float(len(set(groups)) == 1 and len(groups) > 2), float(v[:2].isupper() and v[2:4].isalnum())]
    if kind == "email":
        domain = re.split(r"@|at\W", v)[-1]
        top = re.split(r"[.\])\s]+", domain.strip(". "))[-1]
        f += [float("@" in v), float(top.isalpha()), float(any(map(str.isalpha, re.split(r"@|\Wat\W", v)[0]))), domain.count(".")]
    else:
        f += [0.0, 0.0, 0.0, 0.0]
    if kind == "name":
        tokens = [t for t in _SPLIT.split(v) if t]
        lows = [t.lower() for t in tokens]
        full = [t for t in lows if len(t) > 1]
        likeness = [sum(t in names.triples for t in _triples(w)) / len(w) for w in full]
        f += [
            len(tokens),
            sum(t in names.given for t in lows),
            sum(t in names.family for t in lows),
            max(likeness, default=0.0),
            min(likeness, default=0.0),
            float(any(len(t) == 1 for t in tokens)),
            float(v.islower()),
            float(v.isupper()),
            float(any(ord(c) > 0x3000 for c in v)),
            float("," in v),
            min(map(len, full), default=0),
            sum(t in names.common for t in lows),
            sum(t in _ORDINARY for t in lows),
            float(any(t in names.given and t in _PLAIN for t in lows)),
        ]
    else:
        f += [0.0] * 14
    return f


_PLAIN = frozenset(n.lower() for n in pii_snippets.PLAIN_NAMES)


@dataclass
class Model:
    trees: boost.Boosted
    thresholds: dict[str, float]
    names: Names

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Of each text the non-overlapping (start, end, type), in order."""
        rows, spans = [], []
        for i, s in enumerate(texts):
            if not s:
                continue
            plain, proposed = candidates(s, self.names)
            for a, b, kind in proposed:
                spans.append((i, a, b, kind))
                rows.append(features(plain, a, b, kind, self.names))
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not rows:
            return out
        p = self.trees.proba(np.array(rows))
        margin = p - np.array([self.thresholds[k] for *_, k in spans])
        # Longer spans first among equals; a name within an address or an email is part of it.
        for j in sorted(np.flatnonzero(margin >= 0), key=lambda j: (spans[j][3] == "name", -round(p[j], 1), spans[j][1] - spans[j][2])):
            i, a, b, kind = spans[j]
            if all(b <= x or a >= y for x, y, _ in out[i]):
                out[i].append((a, b, kind))
        for spans_ in out:
            spans_.sort()
        return out


def _labelled(n: int, which: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and types of the spans that the generators propose in `n` snippets of a set of frames."""
    texts, truths, known = pii_snippets.snippets(n, seed, which)
    lexicon = Names.of(known)
    x, y, kinds = [], [], []
    for s, truth in zip(texts, truths, strict=True):
        plain, proposed = candidates(s, lexicon)
        for a, b, kind in proposed:
            # A part of a true span is personal as well; which span to take is settled by length.
            shared = [(min(b, d) - max(a, c), d - c) for c, d, k in truth if k == kind]
            x.append(features(plain, a, b, kind, lexicon))
            y.append(any(m >= 0.8 * (b - a) and m >= 0.3 * whole for m, whole in shared))
            kinds.append(kind)
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=4)
def train(names: tuple[tuple[str, str], ...], snippets: int = TRAIN_SNIPPETS) -> Model:
    """Fit the trees on snippets, calibrate probabilities and thresholds on snippets of other frames; `names` are the
    known (name, type) of the corpus at hand."""
    x, y, _ = _labelled(snippets, "train", 11)
    held_x, held_y, kinds = _labelled(CALIBRATION_SNIPPETS, "calibrate", 12)
    trees = boost.fit(x, y, held=(held_x, held_y))
    p = trees.proba(held_x)
    thresholds = {}
    for kind in TYPES:
        q, z = p[kinds == kind], held_y[kinds == kind]
        steps = np.arange(0.2, 0.81, 0.05)
        f1 = [2 * (z & (q >= c)).sum() / max(1, z.sum() + (q >= c).sum()) for c in steps]
        # The middle of the best plateau.
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        thresholds[kind] = float(steps[best[len(best) // 2]])
    return Model(trees, thresholds, Names.of(list(names)))


def known_names(person_names: DataFrame) -> tuple[tuple[str, str], ...]:
    """The table of names, after a check of its size; null names are left out."""
    rows = person_names.select("name", "name_type").where("name IS NOT NULL").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names can't be sent to every task")
    return tuple(sorted((r["name"], r["name_type"] or "") for r in rows))


def redact_text(s: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return s
    out, at = [], 0
    for a, b, kind in spans:
        out += [s[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, s[at:]])


def personal_data(df: DataFrame, key: str, fields: list[str], model: Model, redact: bool = False) -> DataFrame:
    """One row per row, field and type found: key, field_name, pii_type, n; or, with `redact`, one row per row and field
    that holds personal data: key, field_name, redacted (typed placeholders, the rest unchanged).

    Repeated rows come as often as they occur; a null key stays null.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field_name string, " + ("redacted string" if redact else "pii_type string, n int")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keys = batch.column(0)
            for i, field in enumerate(fields, 1):
                texts = batch.column(i).to_pylist()
                at, kinds, extra = [], [], []
                for r, spans in enumerate(m.find(texts)):
                    if not spans:
                        continue
                    if redact:
                        at.append(r)
                        extra.append(redact_text(texts[r], spans))
                    else:
                        for t in TYPES:
                            if n := sum(k == t for *_, k in spans):
                                at.append(r)
                                kinds.append(t)
                                extra.append(n)
                if at:
                    columns = {key: keys.take(pa.array(at, pa.int64())), "field_name": pa.array([field] * len(at), pa.string())}
                    if redact:
                        columns["redacted"] = pa.array(extra, pa.string())
                    else:
                        columns |= {"pii_type": pa.array(kinds, pa.string()), "n": pa.array(extra, pa.int32())}
                    yield pa.RecordBatch.from_pydict(columns)

    return df.select(key, *fields).mapInArrow(find, schema)
