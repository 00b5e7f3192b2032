"""Credentials inside source code: found, checked and masked in place.

A keyword automaton decides which rules a text needs at all.  Rules are issuer
formats (a fixed shape of token), assignments to a credential's name, and
addresses and headers with a secret part.  Structure is checked: entropy,
character classes, base64 and JSON of tokens, the body of private keys, and the
checksum of issuers that have one: a token with the right checksum counts
whatever it looks like, one without goes by its structure.  A match is replaced
by a placeholder of the same length over the same alphabet that depends on
nothing else of the secret, so it can confirm no guess.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes of tokens by issuer, each with the keywords one of which a text must hold, in lower case.
ISSUERS = [
    (("msh",), r"(?<![0-9A-Za-z])[0-9a-f]{8,12}msh[0-9a-f]{12,18}p1[0-9a-f]{4,8}jsn[0-9a-f]{10,14}(?![0-9A-Za-z])"),
    (("akia", "asia"), r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![0-9A-Za-z])gh[pousr]_[0-9A-Za-z]{30,}(?![0-9A-Za-z])"),
    (("github_pat_",), r"(?<![0-9A-Za-z])github_pat_[0-9A-Za-z_]{30,}"),
    (("glpat-",), r"(?<![0-9A-Za-z])glpat-[0-9A-Za-z_-]{20,}(?![0-9A-Za-z])"),
    (("xoxa-", "xoxb-", "xoxe-", "xoxo-", "xoxp-", "xoxr-", "xoxs-"), r"(?<![0-9A-Za-z])xox[abeoprs]-[0-9A-Za-z-]{10,}"),
    (("k_live_",), r"(?<![0-9A-Za-z])[rsp]k_live_[0-9A-Za-z]{16,}"),
    (("sk-",), r"(?<![0-9A-Za-z])sk-[0-9A-Za-z_-]{20,}"),
    (("sg.",), r"(?<![0-9A-Za-z])SG\.[0-9A-Za-z_-]{16,32}\.[0-9A-Za-z_-]{32,64}"),
    (("aiza",), r"(?<![0-9A-Za-z])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z])"),
    (("hf_",), r"(?<![0-9A-Za-z])hf_[0-9A-Za-z]{30,}"),
    (("npm_",), r"(?<![0-9A-Za-z])npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    (("pypi-",), r"(?<![0-9A-Za-z])pypi-[0-9A-Za-z_-]{50,}"),
    (("eyj",), r"(?<![0-9A-Za-z])eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    (("ya29.",), r"(?<![0-9A-Za-z])ya29\.[0-9A-Za-z_-]{20,}"),
]
# Words of a name that make its value a credential; the second set only as the last word or before a number.
PASSWORDS = {"password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw"}
SECRETS = {"secret", "token", "apikey", "auth", "authorization", "cred", "creds", "credential", "credentials", "appid", "authtoken", "appkey"}
KEYS = {"key", "k", "master", "signature", "sig"}
KEYWORDS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "appid", "master", "sig", " k ", " k=", "k2 ", "k2=", "k_")
# Last words of names whose value only describes a credential, or is none.
DESCRIBING = {"field", "url", "uri", "file", "path", "name", "id", "ids", "type", "hash", "len", "length", "size", "count", "header", "prefix", "host", "env", "digest", "checksum",
              "label", "hint", "error", "message", "column", "param", "regex", "pattern", "policy", "method", "scheme"}
PUBLIC = {"public", "etag", "commit", "sha", "sha1", "sha256", "md5", "icon", "cache", "sort", "primary", "foreign", "partition"}
# What stands in place of a secret.
PLACEHOLDER = re.compile(
    r"(?i)your[_ -]|^your|example|placeholder|redact|change.?me|dummy|insert|replace|todo|fixme|xxxx|\*{3,}|\.{3}|<[^>]*>|[{}]|\$\(|%\(|%[YmdHs]|sample|[_-]here$|1234567|abcdef|0{6,}|removed|masked|(?:test|my|fake|the|some|any)[_-]"
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_BEFORE = re.compile(r"[A-Za-z0-9_.\-]+$")
_NAME_CHARS = re.compile(r"[A-Za-z0-9_.\-]*")
_QUOTED = re.compile(
    r"""\\?["']?\]?\s*(?::\s*[A-Za-z]+\s*)?(?:=(?!=)|:(?!:)|=>|,)\s*(?:(?:str|bytes|String|quote|SecretStr)\(\s*)?(?:[bBrRuU]{0,2})(?P<q>\\?["'`])(?P<v>(?:(?!(?P=q))[^\r\n]){4,}+)(?P=q)"""
)
_BARE = re.compile(r"\s*[:=]\s*(?P<v>[^\s\"'`,;<>(){}\[\]]{8,})(?=[ \t]*(?:$|[\r\n]|\s#))")
_SPOKEN = re.compile(r"(?i)/\s*(?:pass(?:word|wd)?|pwd|pw)\s+(?P<v>\S{6,})")
_QUERY = re.compile(r"=(?P<v>[^&\s\"'`#<>]{8,})")
_HEADER = re.compile(r"(?i)\s*:\s*(?:(?:bearer|basic|token|apikey)\s+)?(?P<v>[0-9A-Za-z+/_.=~%!@#^&*-]{8,})")
_SCHEME = re.compile(r"(?i)\b(?P<scheme>basic|bearer)\s+(?P<v>[0-9A-Za-z+/_.~-]{8,}={0,2})")
_ADDRESS = re.compile(r"://(?P<user>[^\s:/@\"'`]*):(?P<v>[^\s/\"'`]+)@[A-Za-z0-9\[\]_.-]+")
_HOOK = re.compile(r"(?i)https?://[a-z0-9.-]*hooks?[a-z0-9.-]*/(?:[a-z]+/)*(?P<v>[0-9A-Za-z_/-]{20,})")
_PAIR = re.compile(r"""(?i)auth\s*=\s*\(\s*(["'])[^"'\r\n]+\1\s*,\s*(["'])(?P<v>[^"'\r\n]{4,})\2\s*\)""")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
_PUBLIC_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_DECODE = re.compile(r"""\s*=\s*[\w.]*b64decode\(\s*b?(?P<q>["'])(?P<v>[0-9A-Za-z+/=_-]{8,})(?P=q)""")
_BOT = re.compile(r"(?<![0-9A-Za-z:])[0-9]{8,10}:[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")


def entropy(v: str) -> float:
    """Bits a character."""
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0.0


def _classes(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))


def _turns(v: str) -> int:
    """How often the class of character changes along the value."""
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in v]
    return sum(x != y for x, y in zip(kind, kind[1:]))


def looks_random(v: str) -> bool:
    """Whether a value may be a machine-made token: long, without blanks, and changing its class of character often."""
    if len(v) < 16 or re.search(r"\s|://", v) or PLACEHOLDER.search(v):
        return False
    if re.fullmatch(r"(?:[A-Za-z]+|[0-9]{1,6})(?:[_\-. /:]+(?:[A-Za-z]+|[0-9]{1,6}))*", v) and _turns(v) < len(v) / 3:
        return False
    return entropy(v) >= 3.0 and _turns(v) >= len(v) / 5


def looks_chosen(v: str) -> bool:
    """Whether a value may be a password: three classes of characters, or two that are no word with a number."""
    if len(v) < 6 or re.search(r"\s|://", v) or PLACEHOLDER.search(v) or len(set(v)) < 5:
        return False
    if re.fullmatch(r"[a-z]+(?:[_\-. /:][a-z]+)*[0-9]?|[A-Z]+(?:[_-][A-Z]+)*[0-9]?|[0-9.,:/-]+|[A-Z][a-z]+(?:[A-Z][a-z]+)*", v):
        return False
    n = _classes(v)
    return n >= 3 or (n == 2 and bool(re.search(r"[0-9]", v)) and entropy(v) >= 2.5 and _turns(v) >= 2)


# The marks that issuers begin their tokens with, and the digits of the checksum that some end with.
_MARK = re.compile(r"(?:gh[a-z]_|github_pat_|glpat-|xox[a-z]-|[rsp]k_live_|sk-|SG\.|AIza|hf_|npm_|pypi-|AKIA|ASIA|ya29\.)")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(v: str) -> bool:
    """Whether a token of the kind ``ghp_`` or ``npm_`` ends with the CRC-32 of its thirty characters, six digits to base 62."""
    m = re.fullmatch(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})", v)
    if not m:
        return False
    n, digits = zlib.crc32(m[1].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return digits == m[2]


def _issued(v: str) -> bool:
    if checksum_holds(v):
        return True
    body = _MARK.sub("", v, count=1) if _MARK.match(v) else v
    if PLACEHOLDER.search(body) or len(set(body)) < min(8, len(body) // 2) or entropy(body) < 2.8:
        return False
    if v.startswith("eyJ"):
        head = v.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, binascii.Error):
            return False
    if v.startswith("sk-"):
        return bool(re.search(r"\d", body)) or _classes(body) >= 2 and not re.search(r"-[a-z]+-[a-z]+", v)
    return True


def _secret_of_basic(v: str) -> bool:
    try:
        user, _, word = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode().partition(":")
    except (ValueError, binascii.Error):
        return False
    return bool(user and word) and not PLACEHOLDER.search(word) and word.isprintable()


def _name_kind(name: str) -> str:
    """"password", "secret" or nothing, after the words of a name."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in DESCRIBING or PUBLIC.intersection(words):
        return ""
    if PASSWORDS.intersection(words):
        return "password"
    if SECRETS.intersection(words) or words[-1] in KEYS or words[0] in KEYS or re.search(r"(?i)api_?key", name):
        return "secret"
    return ""


def _automaton() -> tuple[ahocorasick.Automaton, list]:
    a: dict[str, set] = {}
    for i, (words, _) in enumerate(ISSUERS):
        for w in words:
            a.setdefault(w, set()).add(i)
    for w in KEYWORDS:
        a.setdefault(w, set()).add("name")
    for w, rule in (("private key-----", "pem"), ("basic ", "scheme"), ("bearer ", "scheme"), ("://", "address"), ("hook", "hook"), *((f"{d}:", "bot") for d in range(10))):
        a.setdefault(w, set()).add(rule)
    auto = ahocorasick.Automaton()
    for w, what in a.items():
        auto.add_word(w, (len(w), tuple(what)))
    auto.make_automaton()
    return auto, [re.compile(p) for _, p in ISSUERS]


_AUTO: tuple | None = None


def _of_name(text: str, at: int, done: set, hits: list) -> None:
    """Values that the name around position ``at`` is given."""
    left = at
    while left and (text[left - 1].isalnum() or text[left - 1] in "_.-") and text[left - 1].isascii():
        left -= 1
    if left in done:
        return
    done.add(left)
    stop = _NAME_CHARS.match(text, left).end()
    name = text[left:stop].rstrip(".-")
    kind = _name_kind(name)
    if not kind:
        # A header or a spoken line may hold the keyword as a word of its own further on.
        return
    m = _QUOTED.match(text, stop)
    if m:
        v, a = m["v"], m.start("v")
        scheme = re.match(r"(?i)(bearer|basic|token|apikey)\s+", v)
        if scheme:
            a += scheme.end()
            v = text[a : m.end("v")]
            if scheme[1].lower() == "basic":
                if _secret_of_basic(v):
                    hits.append((a, m.end("v"), "basic"))
                return
        if (kind == "password" and looks_chosen(v)) or looks_random(v):
            hits.append((a, m.end("v"), "named"))
        return
    m = _DECODE.match(text, stop)
    if m:
        if not PLACEHOLDER.search(m["v"]) and len(set(m["v"])) >= 6:
            hits.append((*m.span("v"), "decode"))
        return
    before = text[max(0, left - 2) : left]
    if before[-1:] in "?&" and before:
        m = _QUERY.match(text, stop)
        if m and looks_random(m["v"]):
            hits.append((*m.span("v"), "query"))
        return
    if before[-1:] in ("\"", "'"):
        m = _HEADER.match(text, stop)
        if m and looks_random(m["v"]):
            hits.append((*m.span("v"), "header"))
        return
    m = _PAIR.match(text, left) if name.lower() == "auth" else None
    if m:
        if looks_chosen(m["v"]) or looks_random(m["v"]):
            hits.append((*m.span("v"), "pair"))
        return
    if re.search(r"/\s*$", text[max(0, left - 4) : left]):
        m = _SPOKEN.match(text, text.rfind("/", 0, left))
        if m and looks_chosen(m["v"]):
            hits.append((*m.span("v"), "spoken"))
        return
    m = _BARE.match(text, stop)
    if m and "://" not in m["v"] and not re.search(r"^\w+(?:\.\w+)+$", m["v"]):
        v = m["v"]
        if (kind == "password" and looks_chosen(v) and _classes(v) >= 3) or (looks_random(v) and _classes(v) >= 2):
            hits.append((*m.span("v"), "bare"))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, rule) of each credential value in the text, in order, none inside another."""
    global _AUTO
    if _AUTO is None:
        _AUTO = _automaton()
    auto, issuers = _AUTO
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length in lower case; they hold no keyword
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits: list[tuple[int, int, str]] = []
    keys: list[tuple[int, int]] = []
    done: set = set()
    asked: set = set()
    for end, (n, what) in auto.iter(low):
        for w in what:
            if w == "name":
                _of_name(text, end - n + 1 + (n - len(low[end - n + 1 : end + 1].lstrip())), done, hits)
            else:
                asked.add(w)
    for w in asked:
        if w == "pem":
            for m in _PEM.finditer(text):
                body = re.sub(r"\\[nrt]|[\s\"'+]|^\w+-\w+:.*$", "", m["body"], flags=re.M)
                if len(body) >= 32 and not re.search(r"(?i)\.{3}|\*{3}|x{6}|redact|your", body) and len(set(body)) >= 16:
                    hits.append((*m.span(), "private_key"))
                    keys.append(m.span())
        elif w == "scheme":
            for m in _SCHEME.finditer(text):
                if _secret_of_basic(m["v"]) if m["scheme"].lower() == "basic" else looks_random(m["v"]):
                    hits.append((*m.span("v"), "scheme"))
        elif w == "address":
            for m in _ADDRESS.finditer(text):
                v = m["v"]
                if looks_chosen(v) or looks_random(v):
                    hits.append((*m.span("v"), "address"))
        elif w == "bot":
            for m in _BOT.finditer(text):
                if _issued(m.group()):
                    hits.append((*m.span(), "bot"))
        elif w == "hook":
            for m in _HOOK.finditer(text):
                if looks_random(m["v"]):
                    hits.append((*m.span("v"), "hook"))
        else:
            for m in issuers[w].finditer(text):
                if _issued(m.group()):
                    hits.append((*m.span(), ISSUERS[w][0][0]))
    if not hits:
        return []
    public = [m.span() for m in _PUBLIC_PEM.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for a, b, rule in sorted(set(hits), key=lambda h: (h[0], -h[1])):
        if any(x <= a and b <= y for x, y in public) or (out and a < out[-1][1]):
            continue
        if any(x <= a and b <= y and (a, b) != (x, y) for x, y in keys):
            continue
        out.append((a, b, rule))
    return out


def _filler(value: str) -> str:
    """One character for each class of the value's alphabet, to be repeated; of hexadecimal digits, these."""
    letter = "a" if re.fullmatch(r"[0-9A-Fa-f\W_]+", value) and re.search(r"[0-9]", value) else "x"
    out = letter * bool(re.search(r"[a-z]", value)) + letter.upper() * bool(re.search(r"[A-Z]", value)) + "0" * bool(re.search(r"[0-9]", value))
    return out or "x"


def placeholder(value: str) -> str:
    """A value of the same length that depends only on that length and on which of lower case, capitals and digits occur.

    An issuer's public mark stays, as do the marks, line breaks and quotes of a
    private key, whose lines become filling alone.
    """
    if value.startswith("-----BEGIN"):
        stays = re.compile(r"-----(?:BEGIN|END)[A-Z0-9 ]+-----|\\[nrt]|[^0-9A-Za-z/=\\]|\\")
        out, last = [], 0
        for m in [*stays.finditer(value), None]:
            end = m.start() if m else len(value)
            out += ["x" * (end - last), m[0] if m else ""]
            last = m.end() if m else end
        return "".join(out)
    mark = _MARK.match(value)
    head = mark[0] if mark else ""
    fill = _filler(value[len(head) :])
    n = len(value) - len(head)
    return head + (fill * (n // len(fill) + 1))[:n]


def redact(text: str, hits: list[tuple[int, int, str]] | None = None) -> str:
    """The text with every credential replaced; every other character keeps its place."""
    out, last = [], 0
    for a, b, _ in find(text) if hits is None else hits:
        out += [text[last:a], placeholder(text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def credentials(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, secret, rule, place, replacement)``, a row per credential in a text; null and empty texts have none."""
    schema = pa.schema([("id", pa.int64()), ("secret", pa.string()), ("rule", pa.string()), ("place", pa.int32()), ("replacement", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t[a:b], r, a, placeholder(t[a:b])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for a, b, r in find(t)]
            if rows:
                yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return out.mapInArrow(run, "id bigint, secret string, rule string, place int, replacement string").withColumnRenamed("id", id_col)


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, credentials)`` with the masked text and how many values were masked; null stays null."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("credentials", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hits = [find(t) if t else [] for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([redact(t, h) if h else t for t, h in zip(texts, hits)], pa.string()), pa.array(list(map(len, hits)), pa.int32())], schema=schema)

    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, "id bigint, text string, credentials int").withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
