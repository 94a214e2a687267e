"""Credentials embedded in source code: find them by place and mask them.

A keyword automaton passes over each text once; only texts with a hit are read
further.  Issuer formats, private key blocks, URLs, authorization headers and
assignments to names of secrets give candidates; each is then held against its
structure (a token's length and alphabet, a JWT's header, a Basic header's
user and password, a key block's body) and against placeholders, references
and prose.  A value cut into several literals is joined first.

Masking puts a placeholder of the value's own alphabet (hexadecimal, base32,
or letters and digits) for every character of the value, marks included, but
for the padding at its end; so the text keeps its length and its syntax, and
nothing of the value.  Masked text gives no findings.

Values may be of any length.  Null and empty texts give no findings and come
out as they are.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that announce a credential, and the formats of issuers.
KEYWORDS = (
    "passw pwd passphrase token secret credential apikey api_key api-key access_key accesskey access-key master_key masterkey private_key privatekey private key signing_key signingkey "
    "encryption_key encryptionkey auth_key authkey client_key clientkey shared_key sharedkey account_key accountkey storage_key storagekey service_key servicekey admin_key adminkey license_key "
    "authorization ://"
).split() + ["private key"]
ISSUERS = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,90}",
    "gitlab": r"glpat-[A-Za-z0-9_-]{20}",
    "npm": r"npm_[A-Za-z0-9]{36}",
    "stripe": r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,99}",
    "aws": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "slack": r"xox[abprs]-[0-9]{8,14}-[A-Za-z0-9-]{16,60}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "sendgrid": r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
    "pypi": r"pypi-[A-Za-z0-9_-]{60,200}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
}
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "akia", "asia", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "aiza", "sg.", "pypi-", "eyj")
# What stands where a credential would be.
STAND_INS = re.compile(
    r"(?i)change[-_ ]?(?:me|it)|replace[-_ ]?(?:me|this)|redacted|dummy|placeholder|example|sample|your[-_ ]|[-_]here\b|todo|fixme|insert[-_ ]|masked|hidden|removed|not[-_ ]?set|\bunset\b|foobar|\bfake|^(?:test|testing|secret|password|passwd|pass|pwd|token|none|null|nil|undefined|unknown|empty|default|true|false|string|value|admin|root|user|user(?:name)?|missing|required|optional|tbd|n/a|na)\W*\d?$"
)
NAME = re.compile(
    r"(?i)(?<![A-Za-z0-9_])-{0,2}([A-Za-z0-9_.-]*?(?:passw(?:or)?d|passphrase|pwd|token|secret|credentials?|(?:api|access|master|private|signing|secret|encryption|auth|client|shared|account|storage|service|license|admin)[_.-]?key))(?![A-Za-z0-9_])"
)
_ISSUER = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in ISSUERS.items()) + r")(?![A-Za-z0-9_])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# what may stand between the lines of a key: line ends, literal joints, escapes, and header lines
_KEY_GAP = re.compile(r"(?:\s|\\[rnt]|\\(?=\r?\n)|[\"'`+,]|[A-Za-z][A-Za-z-]*: [^\n\"'`\\]*)*")
_KEY_LINE = re.compile(r"=?[A-Za-z0-9+/]+={0,2}")
_URL = re.compile(r"(?i)(?<![A-Za-z0-9])[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s\"'`<>]+?)@[\w.\[-]")
_SCHEME = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9._~+/=!@#$%^&*-]{6,})")
_QUOTED = r"(?:[rRbBuU]{0,2})(?:\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`((?:\\.|[^`\\\n])*)`)"
_LITERAL = re.compile(_QUOTED)
_NEXT = re.compile(r"\s*(?:\+|\.\.|\\)?\s*" + _QUOTED)
_RUN = re.compile(_QUOTED + r"(?:[ \t]*\+?[ \t]*\r?\n[ \t]*|[ \t]*\+[ \t]*)(?=[\"'`])")
_OPERATOR = re.compile(r"[\"'\])]*[ \t]*(?:[?!][ \t]*)?(?::[ \t]*(?:&(?:'static[ \t]+)?)?[A-Za-z_][\w<>\[\]|& ]*?[ \t]*)?(:=|=>|=(?![=>~])|:(?!:))[ \t]*")
_SPOKEN = re.compile(r"[\"']?[ \t]*(?:->|was|is|:|=)[ \t]+(?=\S)")
_ARGUMENT = re.compile(r"[\"'`][ \t]*,[ \t]*(?=[\"'`])")
_REMARK = re.compile(r"[ \t]*\*/[ \t]*" + _QUOTED + r"[ \t]*,[ \t]*(?=[\"'`])")
_FALLBACK = re.compile(r"(?:\b(?:getenv|get|env_?or|getenvordefault|getordefault|get_or|lookup|getproperty|env|fetch)\s*\(\s*" + _QUOTED.replace("(", "(?:").replace("(?:?:", "(?:") + r"\s*,\s*|(?:\|\||\?\?|\bor\b|\?:)\s*|\bunwrap_or(?:_else)?\s*\(\s*(?:\|\|\s*)?)(?=[\"'`])", re.I)
_WRAPPED = re.compile(r"(?:String::from|new String|String|str|Some|bytes|Secret|SecretString::new|\[\]byte)\(\s*(?=[\"'`])|&(?=[\"'`])|\(\s*(?=[\"'`])|b(?=[\"'])")
_BARE = re.compile(r"[^\s\"'`]+")
_EXPRESSION = re.compile(r"[A-Za-z_][\w.:]*[\[({]|process\.env\b|[a-z]\w*(?:\.[a-z]\w*)+$")
_COMMENT = re.compile(r"\s*(?:#|//|\*|--|/\*|;)")
_ENV = re.compile(r"[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+|ARG[ \t]+)?[\"']?$")
_REST = re.compile(r"\s(?:#|//)\s")
_SETTING = re.compile(r"(?:.*\)\s\s+)?(?:export[ \t]+)?")
_PLAIN = re.compile(r"[^\s\"'`(){};,]+")
# What placeholders are made of.
MASKS = frozenset("xXaA012")
CODE = frozenset("py js jsx ts tsx go rs".split())

FOUND = "row_id BIGINT, line_no INT, kind STRING, first INT, last INT"
MASKED = "row_id BIGINT, text STRING, masked INT"


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in (*KEYWORDS, *PREFIXES):
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


_AUTOMATON = _automaton()


def usable(value: str) -> bool:
    """Whether a generic value could open something: no placeholder, mask, reference, path, number or prose."""
    bare = value.strip()
    if len(bare) < 7 or any(c.isspace() for c in bare):
        return False
    if STAND_INS.search(bare) or "****" in bare or "..." in bare or re.search(r"\$\{|\{\{|\}\}|\$\(|%\(|%s|<[^>]*>|#\{", bare):
        return False
    letters = re.sub(r"[^A-Za-z0-9]", "", bare)
    if len(letters) < 5 or set(letters) <= MASKS or len(set(bare)) < 5:
        return False
    if letters.isdigit() or re.fullmatch(r"[A-Z][A-Z_]+[A-Z]", bare) or re.fullmatch(r"\$?[A-Za-z_]\w*(?:[.:]{1,2}[A-Za-z_]\w*)+(?:\(\))?;?", bare) and not re.search(r"\d", bare):
        return False
    if re.search(r"\d", bare):
        return not re.fullmatch(r"(?:~|\.{0,2})/[\w./-]*|[a-z_]+(?:/[a-z_0-9]+)+", bare)
    # without digits: words, names and paths are references; mixed letters are a password
    return not re.fullmatch(r"[~./]*[A-Za-z]?[a-z]*(?:[-_./:][A-Za-z]?[a-z]*)*|[A-Za-z][a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+(?:[-_.][A-Z]+)*", bare)


def _issuer_ok(kind: str, value: str) -> bool:
    body = value[4:]
    if "EXAMPLE" in value or "****" in value or len(set(body)) < 5 or set(re.sub(r"[^A-Za-z0-9]", "", body)) <= MASKS:
        return False
    if kind == "jwt":
        try:
            head = base64.urlsafe_b64decode(value.split(".")[0] + "===")
        except (binascii.Error, ValueError):
            return False
        return b'"alg"' in head
    return True


def _basic_ok(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    _, colon, password = plain.partition(":")
    return bool(colon) and (usable(password) or _known(password))


def _known(value: str) -> bool:
    m = _ISSUER.fullmatch(value)
    return m is not None and _issuer_ok(m.lastgroup, value)


def _span(m: re.Match) -> tuple[int, int]:
    return m.span(m.lastindex)


def _joined(text: str, m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    """The literal of ``m`` and those that follow it with nothing but space, line ends or a plus between."""
    spans = [_span(m)]
    at = m.end()
    while True:
        gap = re.compile(r"[ \t]*\+?[ \t]*(?:\r?\n[ \t]*)?").match(text, at)
        more = _LITERAL.match(text, gap.end())
        if more is None or gap.end() == at or more.lastindex is None or ("+" not in gap.group() and "\n" not in gap.group()):
            break
        spans.append(_span(more))
        at = more.end()
    return "".join(text[a:b] for a, b in spans), spans


def _value_at(text: str, at: int, line_end: int, code: bool, bare_allowed: bool) -> list[tuple[int, int]] | None:
    """The spans of a literal credential that begins at ``at`` or stands there as a default."""
    m = _LITERAL.match(text, at)
    if m is None:
        wrapped = _WRAPPED.match(text, at)
        if wrapped:
            m = _LITERAL.match(text, wrapped.end())
    if m is not None and m.lastindex:
        value, spans = _joined(text, m)
        return spans if usable(value) or _known(value) else None
    fallback = _FALLBACK.search(text, at, line_end)
    if fallback is not None:
        m = _LITERAL.match(text, fallback.end())
        if m is not None and m.lastindex:
            value, spans = _joined(text, m)
            return spans if usable(value) or _known(value) else None
    if bare_allowed:
        m = _BARE.match(text, at, line_end)
        # a call, an index or a member is an expression, whatever the file's name says
        if m is not None and usable(m.group()) and not _EXPRESSION.match(m.group()):
            return [m.span()]
    return None


def _key_body(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """(the spans of a key's lines, where the key ends) after its opening mark."""
    again = _PEM.search(text, at)
    limit = again.start() if again is not None else len(text)
    end = _KEY_END.search(text, at, limit)
    closed, limit = end is not None, end.start() if end is not None else limit
    body: list[tuple[int, int]] = []
    while at < limit:
        gap = _KEY_GAP.match(text, at, limit)
        line = _KEY_LINE.match(text, gap.end(), limit)
        # the first line is a full one; without a closing mark all are, and each begins after a line end or a joint
        if line is None or gap.end() == at or (len(line.group()) < 16 and (not body or not closed)):
            break
        body.append(line.span())
        at = line.end()
    return body, at


def find_secrets(text: str, extension: str = "") -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(line, kind, spans) of each credential, by place."""
    if not text:
        return []
    hit = {word for _, word in _AUTOMATON.iter(text.lower())}
    if not hit:
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at)
    found: dict[int, tuple[str, list[tuple[int, int]]]] = {}

    def add(kind: str, spans: list[tuple[int, int]]) -> None:
        line = line_of(spans[0][0])
        if line in found:
            known = found[line][1]
            known.extend(s for s in spans if not any(a < s[1] and s[0] < b for a, b in known))
        else:
            found[line] = (kind, list(spans))

    at = 0
    while (m := _PEM.search(text, at)) is not None:
        body, at = _key_body(text, m.end())
        if body and usable(text[slice(*body[0])][:64]):
            line = line_of(m.start())
            found.setdefault(line, ("private key", []))[1].extend(body)
    if hit & set(PREFIXES):
        for m in _ISSUER.finditer(text):
            if _issuer_ok(m.lastgroup, m.group()):
                add(m.lastgroup, [m.span()])
        for m in _RUN.finditer(text):
            first = _LITERAL.match(text, m.start())
            value, spans = _joined(text, first)
            if len(spans) > 1 and _known(value):
                add("split token", spans)
    if "://" in hit:
        for m in _URL.finditer(text):
            if usable(m.group(1)) or _known(m.group(1)):
                add("url", [m.span(1)])
    if "authorization" in hit:
        named = [m.start() for m in re.finditer("(?i)authorization", text)]
        for m in _SCHEME.finditer(text):
            i = bisect_right(named, m.start()) - 1
            if i < 0 or named[i] < starts[line_of(m.start()) - 1]:
                continue
            value = m.group(2)
            if m.group(1).lower() == "basic" and _basic_ok(value) or m.group(1).lower() != "basic" and (usable(value) or _known(value)):
                add("header", [m.span(2)])
    code = extension in CODE
    for m in NAME.finditer(text):
        line = line_of(m.start())
        begin = starts[line - 1]
        end = starts[line] - 1 if line < len(starts) else len(text)
        at, before = m.end(), text[begin : m.start(1)]
        comment = _COMMENT.match(text, begin, end) is not None or _REST.search(before) is not None
        flag = before.endswith("--") or before.endswith("-")
        setting = m.group(1).isupper() and text[at : at + 1] == "=" and _SETTING.fullmatch(before) is not None and _PLAIN.fullmatch(text[at + 1 : end]) is not None
        bare = comment or flag or setting or (not code and _ENV.match(before) is not None)
        remark = _REMARK.match(text, at, end)
        if remark is not None:
            spans = _value_at(text, remark.end(), end, code, False)
        elif (o := _OPERATOR.match(text, at, end)) is not None:
            rest = re.compile(r"\(?[ \t]*\r?\n\s*(?=[\"'`])").match(text, o.end()) if o.group(1) in ("=", ":=") else None
            spans = _value_at(text, rest.end() if rest else o.end(), end, code, bare)
        elif (o := _ARGUMENT.match(text, at, end)) is not None and re.search(r"\b(?:insert|set|put|setitem|add|store|setProperty|config|option)\s*\(\s*[\"'`]$", before) is not None:
            spans = _value_at(text, o.end(), end, code, False)
        elif comment and (o := _SPOKEN.match(text, at, end)) is not None:
            spans = _value_at(text, o.end(), end, code, True)
        elif comment and re.search(r"\b(?:rotate|revoke|use|using|with|old|new|temp|tmp)\s+$", before) and text[at : at + 1] == " ":
            spans = _value_at(text, at + 1, end, code, True)
        else:
            spans = None
        if spans:
            add("assignment", spans)
    return [(line, *found[line]) for line in sorted(found)]


_HEX = re.compile(r"[0-9a-fA-F]+")
_BASE32 = re.compile(r"(?=.*[2-7])[A-Z2-7]{8,}")


def placeholder(value: str) -> str:
    """As long as the value, of its alphabet, and with nothing of it but the padding at its end."""
    bare = value.rstrip("=")
    plain = "".join(c for c in bare if c.isalnum())
    low, high = ("a", "A") if _HEX.fullmatch(plain) else ("x", "X")
    digit = "0" if "0" in plain else "2" if _BASE32.fullmatch(plain) else "1"
    mark = low if any(c.islower() for c in plain) else high if any(c.isupper() for c in plain) else digit
    return "".join(low if c.islower() else high if c.isupper() else digit if c.isdigit() else mark for c in bare) + value[len(bare) :]


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with placeholders for the spans; overlapping ones are masked as one."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], placeholder(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, extension in zip(batch["row_id"], batch["text"], batch["extension"], strict=True):
            rows += [(key, line, kind, spans[0][0], spans[-1][1]) for line, kind, spans in find_secrets(text, extension)]
        yield pd.DataFrame(rows, columns=["row_id", "line_no", "kind", "first", "last"])


def _mask_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, extension in zip(batch["row_id"], batch["text"], batch["extension"], strict=True):
            spans = [s for _, _, own in find_secrets(text, extension) for s in own]
            rows.append((key, masked(text, spans) if spans else text, len(spans)))
        yield pd.DataFrame(rows, columns=["row_id", "text", "masked"])


def _texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    extension = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return df.select(F.col(key).alias("row_id"), F.col(text).alias("text"), extension.alias("extension")).where(F.length("text") > 0)


def credentials(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(row_id, line_no, kind, first, last): a row per line on which a credential begins; ``path`` tells the language."""
    return _texts(df, key, text, path).mapInPandas(_find_batches, FOUND)


def without_credentials(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(row_id, text, masked): every row's text with its credentials masked; null stays null."""
    return _texts(df, key, text, path).mapInPandas(_mask_batches, MASKED).unionByName(df.where((F.col(text) == "") | F.col(text).isNull()).select(F.col(key).alias("row_id"), F.col(text).alias("text"), F.lit(0).alias("masked")))
