"""Credentials embedded in source code, configuration and shell lines.

Candidates are all quoted strings, all long tokens, and the values that stand where a credential may: after a name, in a
login, at a provider's prefix. Each is judged in the same way: its Shannon entropy must reach a share of what a random
string of its length in its own alphabet shows. A name or a login position before it lowers the share and the least length
(`CONTEXTS`); nothing else does. Hashes, identifiers, placeholders and references are then taken out by their exact form.
Private key blocks are found by their frame, whole or clipped.

Values are followed to their end, whatever their length. One pass over the rows, no shuffle: `mapInArrow` with whole
texts. Redaction replaces only the value, so quotes, separators and the code around them stay.

Null and empty texts hold no secrets and stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# What a name says that holds a credential (after camel case and separators are split by "_").
_NAMES = re.compile(
    r"(?:^|_|pg|my|db|smtp|redis|mysql)(?:password|passwd|passphrase|passcode|pass|pwd|passwort|kennwort|secret|token|authtoken|credentials?"
    r"|api_?key|access_?key|private_?key|signing_?key|secret_?key|account_?key|encryption_?key|auth_?key|shared_?key|sas_?key|master_?key"
    r"|access_?key_?id|secret_?access_?key|client_?secret|session_?key|deploy_?key|webhook_?secret|auth)$"
)
# Names that hold a session token in a cookie or header.
_WEAK_NAMES = re.compile(r"(?:^|_)(?:session|session_?id|sid|authorization|cookie|jwt|sig|signature|bearer|key)$")

# Shapes that providers give their credentials.
_SHAPES = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|A(?:KIA|SIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_\-]{30,}"
    r"|sk-(?:proj-|ant-|live-)?[A-Za-z0-9_\-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9]{16,}"
    r"|hf_[A-Za-z0-9]{20,}|pypi-[A-Za-z0-9_\-]{20,}|dop_v1_[a-f0-9]{32,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"
    r"|ya29\.[A-Za-z0-9_\-]{20,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r")"
)

_PEM = re.compile(
    r"-----BEGIN (?P<kind>[A-Z0-9 ]*?)-----(?P<body>(?:(?!-----BEGIN )[^-])*)(?P<end>-----END [A-Z0-9 ]*-----)?"
)
_PEM_END = re.compile(r"-----END (?P<kind>[A-Z0-9 ]*)-----")
#: The lines before an end, read backwards.
_PEM_TAIL = re.compile(r"(?:\s|n\\)*[A-Za-z0-9+/=]{4,}(?:(?:\s|n\\)+[A-Za-z0-9+/=]{16,})*")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{20,}")

#: Spans that look random and are none of the kinds sought: hashes with their label, embedded data.
_INERT = re.compile(
    r"data:[\w/+.\-]*;base64,[A-Za-z0-9+/=]+|\bsha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+|\bmd5[-:][a-f0-9]{32}"
    r"|\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
    r"|\bssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/=]+"
)

#: Words that names of credentials hold, in lower case; a name is looked at where one of them stands.
_STEMS = ("pass", "pwd", "kennwort", "secret", "token", "key", "auth", "cred", "session", "sid", "cookie", "jwt", "sig", "bearer")
_VALUE = re.compile(
    r"[\w.\-]*[\"'\]]{0,2}\s{0,3}(?:=>|:=|=|:)\s{0,3}"
    r"(?:(?P<q>\\?[\"'`])|(?P<v>[^\s\"'`,;<>]{4,}))"
)
_NAME_HEAD = re.compile(r"[A-Za-z_][\w.\-]{0,80}$")
_NAME_TAIL = re.compile(r"[\w.\-]*")
#: The further parts of a string that is written in several pieces.
_MORE = re.compile(r"\s*[+.]?\s*\\?\s*[\"'`](?P<v>[A-Za-z0-9+/=_\-!?#$%&*.]{4,})[\"'`]")
#: (words one of which the lower-case text must hold, pattern): names and values in other forms than an assignment.
_SPOKEN = [
    (words, re.compile(p))
    for words, p in (
        (("env ", "export ", "set ", "arg "), r"(?:^|\s)(?:ENV|export|set|setx|ARG)\s+(?P<n>[A-Za-z_]\w*)\s+[\"']?(?P<v>[^\s\"']{4,})"),
        (("</",), r"<(?P<n>[A-Za-z_][\w.\-]*)>(?P<v>[^<>\s]{4,})</"),
        (("--",), r"--(?P<n>[a-z][\w\-]*)[ =]+[\"']?(?P<v>[^\s\"']{4,})"),
        ((" password ",), r"\b(?:login|user)\s+\S+\s+(?P<n>password)\s+(?P<v>\S{4,})"),
        (
            (" is ", " was ", " ist ", " lautet "),
            r"(?i)\b(?P<n>password|passwd|passphrase|passcode|secret|token|api[ _-]?key|access[ _-]?key|pwd)(?:\s+(?:for|of|to|on)\s+\S+)?\s+(?:is|was|ist|lautet)(?:\s+now)?:?\s+[\"'`]?(?P<v>[^\s\"'`]{4,})",
        ),
        (
            (" lautet", " ist ", " war ", " heißt"),
            r"(?i)\b(?P<n>kennwort|passwort|schlüssel|token)(?:\s+(?:für|von|zu|in|auf)\s+\S+)?\s+(?:lautet|ist|war|heißt):?\s+[\"'`]?(?P<v>[^\s\"'`]{4,})",
        ),
        (
            ("パスワード", "暗証番号", "トークン", "apiキー", "秘密鍵", "シークレット"),
            r"(?P<n>パスワード|暗証番号|トークン|APIキー|秘密鍵|シークレット)\s*(?:は|が|:|：|=)\s*[「『\"'`]?(?P<v>[\x21-\x7e]{4,})",
        ),
        (("hmac",), r"\b(?P<n>hmac)(?:\.new|\.create|_sha\w*|\.digest)?\(\s*(?:bytes\.fromhex\(|b)?\s*[\"'](?P<v>[^\"'\s]{16,})[\"']"),
    )
]
#: Positions that hold a credential by the form of the line, as above.
_LOGIN = [
    (words, re.compile(p))
    for words, p in (
        (("://",), r"(?P<s>[a-z][a-z0-9+.\-]{0,20})://[^\s:/@\"'<>]*:(?P<v>[^\s/@\"'<>]+|[^\s@\"'<>]+)@[\w\[\]$.{}\-]"),
        (("curl ", "wget ", "http "), r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<v>[^\s\"']{4,})"),
        (("sshpass",), r"\bsshpass\s+-p\s*[\"']?(?P<v>[^\s\"']{4,})"),
        (("mysql", "mariadb", "mongo"), r"\b(?:mysql|mysqldump|mariadb|mongo|mongosh)\b[^\n]*?\s-p[\"']?(?P<v>[^\s\"'-][^\s\"']{3,})"),
        ((" login",), r"\b(?:docker|helm|podman|oras)\s+login\b[^\n]*?\s-p[ =]?[\"']?(?P<v>[^\s\"']{4,})"),
        (("bearer ", "basic "), r"(?i)\b(?:bearer|basic)\s+(?P<v>[A-Za-z0-9+/=._~\-]{8,})"),
    )
]
_PGPASS_GATE = re.compile(r":(?:\d{4,5}|\*):[\w*\-]+:")
_PGPASS = re.compile(r"(?<![\w.\-])[\w.\-]{1,200}:(?:\d{2,5}|\*):[\w*\-]+:[\w\-]+:(?P<v>[^\s:\"']{4,})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/_\-])")

# What stands in for a credential.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:(?:[a-z]{2,5}[-_])?[x*.•#_\-?0]+|\.{3}.*|(?:your|my|the|some|insert|enter|put|add|use)[-_ ].*|change[-_]?(?:me|it|this).*|replace[-_]?.*|(?:example|sample|dummy|fake|test|placeholder|redacted|hidden|masked|removed|omitted|secret|password|passwd|token|apikey|none|null|nil|undefined|empty|true|false|todo|tbd|n/?a)(?:[-_]?(?:key|token|password|secret|value|here))?)[.,;:!]?$"
)
# Exact forms of references to a variable, a vault, a file, an element or a call.
_REFERENCES = [
    re.compile(p)
    for p in (
        r"\$\{[^{}]*\}?$|\$\([^()]*\)?$|\$\{\{",  # ${NAME} $(command) ${{ name }}
        r"\$(?:env:)?(?:[A-Za-z_]+|[A-Z_][A-Z0-9_]*|[a-z_][a-z0-9_]*)(?:[.:/\[].*)?$",  # $NAME
        r"\{\{|\{[A-Za-z_][\w.]*\}?$|<[A-Za-z][^<>]*>?$|\[[A-Za-z][^\[\]]*\]?$|\($",  # {{ name }} {name} <name> [name]
        r"%[A-Za-z_]\w*%$|%\(\w+\)[sd]$|%[-\d.]*[sdrv]$",  # %NAME% %(name)s %s
        r"![A-Za-z]+$",  # !Ref
        r"@(?:[\w.\-]*/)+[\w.\-]*$|@\w+\.\w{1,5}$",  # @folder/file
        r"(?:arn|vault|ssm|op|kv|secretsmanager|keyring|env|file|keychain|aws-sm|gcp-sm|azure-kv)[:/.]",
        r"(?:os|process|env|config|settings|self|this|ctx|ENV|System|Environment|secrets|vars|st)\.[A-Za-z_]",
        r"[A-Za-z_][\w.]*\([\w.,=/ \"'\-]*\)?$|[A-Za-z_][\w.]*\[[\w\"'\-]*\]?$",  # call(name) name[key]
        r"https?://",
        r"(?:\.{0,2}|~)/(?:[A-Za-z_.\-]+\d{0,4}/)*[A-Za-z_.\-]*\d{0,4}$|[a-z]+(?:/[a-z0-9_.\-]+)+$",  # paths
    )
]
_MARKED = re.compile(r"(?i)redacted")
_HEX = re.compile(r"[0-9a-fA-F]+")
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/=_\-]+")
_LATIN = re.compile(r"[\x20-\u024f\u20ac]+")
_WORDS = re.compile(r"[a-z]+(?:[_\-./][a-z]+)*")
_HASH_LABEL = re.compile(
    r"(?i)(?:commit|sha\d*|digest|etag|hash|md5|checksum|rev(?:ision)?|integrity|fingerprint|uuid|guid|request_id|trace_id|id|blob|tree|W/)[\s:=\"'/\-]*$"
)


def entropy(s: str) -> float:
    """Shannon entropy of the characters, in bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> tuple[str, float]:
    """The least alphabet that holds `s`, and the bits of one of its characters if drawn evenly."""
    if s.isdigit():
        return "digits", 3.32
    if _HEX.fullmatch(s):
        return "hex", 4.0
    if s.isalpha() and (s.islower() or s.isupper()):
        return "letters", 4.7
    if _ALNUM.fullmatch(s):
        return "alnum", 5.95
    if _BASE64.fullmatch(s):
        return "base64", 6.0
    if s.isascii():
        return "print", 6.57
    # Letters of other scripts than Latin make words without blanks, and no credential.
    return ("wide", 7.0) if _LATIN.fullmatch(s) else ("other", 16.0)


def threshold(s: str, bits: float, share: float) -> float:
    """Bits per character that `s` must reach: a share of what a random string of its length shows."""
    return share * min(bits, math.log2(max(len(s), 2)))


def looks_random(s: str, share: float) -> bool:
    return entropy(s) >= threshold(s, alphabet(s)[1], share)


#: Per context and alphabet: the least length, and the share of a random string's entropy. Alphabets that aren't named
#: never hold a credential there: without a name, hex digits are hashes, digits are numbers and letters are words.
CONTEXTS = {
    "named": {"digits": (10, 0.6), "hex": (6, 0.6), "letters": (16, 0.85), "alnum": (6, 0.6), "base64": (6, 0.6), "print": (6, 0.6), "wide": (6, 0.6)},
    "weak": {"alnum": (16, 0.82), "base64": (16, 0.82), "print": (16, 0.82)},
    "free": {"alnum": (20, 0.82), "base64": (20, 0.82), "print": (20, 0.86)},
}


def random_enough(v: str, context: str) -> bool:
    """The entropy test: is `v` long and random enough for its alphabet, where it stands?"""
    name, bits = alphabet(v)
    least = CONTEXTS[context].get(name)
    return least is not None and len(v) >= least[0] and entropy(v) >= threshold(v, bits, least[1])


def _stands_for_another(v: str) -> bool:
    """Is `v` a placeholder, a reference or a row of words?"""
    if _PLACEHOLDER.match(v) or _MARKED.search(v) or _WORDS.fullmatch(v):
        return True
    return any(rx.match(v) for rx in _REFERENCES)


def _is_text(v: str) -> bool:
    """Do the blanks in `v` part words, as in a sentence? In a passphrase with blanks, some parts are no words."""
    parts = v.split()
    # What begins or ends with a blank stands between two strings and is none.
    return v != v.strip() or len(parts) > 1 and sum(p.strip(".,;:!?()\"'").isalpha() for p in parts) > len(parts) / 2 or not parts


def _named_value(v: str) -> bool:
    """May `v`, which stands where a credential belongs, be one?"""
    return random_enough(v, "named") and not _stands_for_another(v) and not _is_text(v)


def _free_value(s: str, v: str, start: int, context: str = "free") -> bool:
    """May `v`, which no name announces, be a credential? Hashes, ids, names and paths are none."""
    core = v.rstrip("=")
    if not (any(map(str.isdigit, core)) and core.lower() != core and core.upper() != core):
        return False
    if not random_enough(core, context) or _HASH_LABEL.search(s, max(0, start - 24), start):
        return False
    parts = [p for p in re.split(r"[/_\-.:,;|+ ]", core) if p]
    if all(p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p.istitle()) for p in parts):
        return False
    return not _stands_for_another(v)


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[.\-]+")
_LONG = re.compile(r"[A-Za-z0-9+/_\-]{20}")
_QUOTED = re.compile(r"\"(?P<d>[^\s\"]{20,})\"|'(?P<s>[^\s']{20,})'|`(?P<b>[^\s`]{20,})`")


def _trim(s: str, a: int, b: int) -> tuple[int, int]:
    while b > a and s[b - 1] in ".,;:)]}>」』。、":
        b -= 1
    return a, b


def _pem_blocks(s: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    found, blocks = [], []
    for m in _PEM.finditer(s):
        if "PRIVATE KEY" in m["kind"] and (body := _PEM_BODY.search(m["body"])):
            end = m.end("body")
            if not m["end"]:
                # A clipped block ends with the last line that is base64.
                end = m.start("body") + [x.end() for x in re.finditer(r"[A-Za-z0-9+/=]{16,}", m["body"])][-1]
            found.append((m.start("body") + body.start(), end, "private_key"))
        blocks.append(m.span())
    at = 0
    for m in _PEM_END.finditer(s):
        tail = _PEM_TAIL.match(s[at : m.start()][::-1])
        at = m.end()
        if tail and not any(a <= m.start() - tail.end() < b for a, b in blocks):
            span = (m.start() - tail.end(), m.start())
            if "PRIVATE KEY" in m["kind"]:
                found.append((*span, "private_key"))
            blocks.append((span[0], m.end()))
    return found, blocks


def _assigned(s: str, low: str) -> list[tuple[int, int, str]]:
    found = []
    seen = set()
    for stem in _STEMS:
        i = low.find(stem)
        while i >= 0:
            at = i + len(stem)
            i = low.find(stem, at)
            m = _VALUE.match(s, at)
            if not m or m.start("q") in seen and m["q"]:
                continue
            head = _NAME_HEAD.search(s, max(0, at - len(stem) - 81), at)
            if not head:
                continue
            name = _CAMEL.sub("_", head[0] + _NAME_TAIL.match(s, at)[0]).lower()
            strong = bool(_NAMES.search(name))
            if not strong and not _WEAK_NAMES.search(name):
                continue
            if m["q"]:
                # To the next such quote in the line, however far.
                a, line = m.end(), s.find("\n", m.end())
                b = s.find(m["q"], a, line if line >= 0 else len(s))
                if b <= a:
                    continue
            else:
                a, b = m.span("v")
                if (amp := s.find("&", a, b)) > 0:
                    b = amp
                a, b = _trim(s, a, b)
            v = s[a:b]
            if not (_named_value(v) if strong else _free_value("", v, 0, "weak")):
                continue
            found.append((a, b, "named"))
            if m["q"]:
                seen.add(m.start("q"))
                more = _MORE.match(s, b + len(m["q"]))
                while more:
                    found.append((*more.span("v"), "named"))
                    more = _MORE.match(s, more.end())
    return found


def find_secrets(s: str | None) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) of the credentials in `s`, in order.

    kind: private_key, login, named, provider, token.
    """
    if not s:
        return []
    low = s.lower()
    found, inert = _pem_blocks(s) if "-----" in s else ([], [])
    found += _assigned(s, low)
    for words, rx in _LOGIN:
        if any(w in low for w in words):
            for m in rx.finditer(s):
                a, b = _trim(s, *m.span("v"))
                if _named_value(s[a:b]):
                    found.append((a, b, "login"))
    if _PGPASS_GATE.search(s):
        for m in _PGPASS.finditer(s):
            if _named_value(m["v"]):
                found.append((*m.span("v"), "login"))
    for words, rx in _SPOKEN:
        if any(w in low for w in words):
            for m in rx.finditer(s):
                name = _CAMEL.sub("_", m["n"]).lower().replace(" ", "_")
                a, b = _trim(s, *m.span("v"))
                if (_NAMES.search(name) or not name.isascii() or name == "hmac") and _named_value(s[a:b]):
                    found.append((a, b, "named"))
    if _LONG.search(s):
        inert += [m.span() for m in _INERT.finditer(s)]
        found += [(*m.span(), "provider") for m in _SHAPES.finditer(s) if looks_random(m[0][4:], 0.6)]
        found += [(*m.span(), "token") for m in _TOKEN.finditer(s) if _free_value(s, m[0], m.start())]
    if "\"" in s or "'" in s or "`" in s:
        for m in _QUOTED.finditer(s):
            a, b = m.span(m.lastgroup)
            if _free_value(s, s[a:b], a):
                found.append((a, b, "token"))
    if not found:
        return []
    out: list[tuple[int, int, str]] = []
    rank = {"private_key": 0, "provider": 1, "login": 2, "named": 3, "token": 4}
    for a, b, kind in sorted(found, key=lambda x: (rank[x[2]], x[0])):
        if kind != "private_key" and any(x <= a < y for x, y in inert):
            continue
        over = [i for i, (x, y, _) in enumerate(out) if a < y and x < b]
        if not over:
            out.append((a, b, kind))
        elif kind == "token" and len(over) == 1:
            # A long token that goes beyond a span of higher rank is all one value.
            x, y, first = out[over[0]]
            out[over[0]] = (min(a, x), max(b, y), first)
    return sorted(out)


def redact_text(s: str | None) -> tuple[str | None, list[str]]:
    """`s` with every credential replaced by `[REDACTED:<kind>]`, and the kinds found."""
    spans = find_secrets(s)
    if not spans:
        return s, []
    out, at = [], 0
    for a, b, kind in spans:
        out += [s[at:a], f"[REDACTED:{kind}]"]
        at = b
    return "".join([*out, s[at:]]), [k for _, _, k in spans]


def secret_fields(df: DataFrame, key: str, fields: list[str], redact: bool = False) -> DataFrame:
    """One row per row and field that holds a credential: key, field_name, kinds (array, in order of place)[, redacted].

    Repeated rows come as often as they occur; rows with a null key come too.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field_name string, kinds array<string>" + (
        ", redacted string" if redact else ""
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, field in enumerate(fields, 1):
                rows, kinds, texts = [], [], []
                for r, s in enumerate(batch.column(i).to_pylist()):
                    if not s:
                        continue
                    if redact:
                        text, found = redact_text(s)
                    else:
                        found = [k for _, _, k in find_secrets(s)]
                    if found:
                        rows.append(r)
                        kinds.append(found)
                        if redact:
                            texts.append(text)
                if rows:
                    columns = {
                        key: keys.take(pa.array(rows, pa.int64())),
                        "field_name": pa.array([field] * len(rows), pa.string()),
                        "kinds": pa.array(kinds, pa.list_(pa.string())),
                    }
                    if redact:
                        columns["redacted"] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_pydict(columns)

    return df.select(key, *fields).mapInArrow(find, schema)
