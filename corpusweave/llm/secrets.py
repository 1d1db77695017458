"""Credentials in source and configuration files: finding them and redacting only their values.

Token formats, key armor, connection strings, authorization headers, and assignments to names that announce secrets are the
grammars of one deterministic automaton (see automaton.py), which also says which characters are the value. It is entered at
the literals that grammars begin with: a text is scanned once for these, in chunks that overlap by the longest, and absolute positions are
deduplicated; from each the automaton runs over the whole text, so no chunk border can cut a credential. Overlapping
spans are merged and the values, and nothing else, are replaced by a placeholder; quotes, armor and line ends stay.

Values that nobody can use are none: placeholders, empty values, references to where a value is kept, calls, digests.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.automaton import Automaton
from corpusweave.llm.lookalike import all_folds
from corpusweave.runtime import spread

CHUNK = 1 << 16
PLACEHOLDER = "REDACTED"

# Names that announce a secret where they end a key; the first of them announce passwords, which people make up.
PASSWORDS = ("password", "passwd", "passphrase", "pwd", "pass", "passcode", "secret")
NAMES = (*PASSWORDS, "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "secret_key", "secretkey", "private_key", "privatekey", "auth_key", "authkey", "account_key", "accountkey", "sharedaccesskey", "signing_key", "encryption_key", "credential", "credentials")
# Beginnings of token formats and the whole format.
FORMATS = {
    "zbt-": r"zbt-[A-Za-z0-9]{8,}(?:-[A-Za-z0-9]{8,})?", "qrn_live_": r"qrn_live_[A-Za-z0-9]{16,}", "HVK": r"HVK[A-Z0-9]{17}",
    "eyJ": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "AKIA": r"AKIA[0-9A-Z]{16}", "ASIA": r"ASIA[0-9A-Z]{16}", "ghp_": r"ghp_[A-Za-z0-9]{36}", "gho_": r"gho_[A-Za-z0-9]{36}",
    "ghs_": r"ghs_[A-Za-z0-9]{36}", "github_pat_": r"github_pat_[A-Za-z0-9_]{60,}", "glpat-": r"glpat-[A-Za-z0-9_-]{20,}", "xoxb-": r"xoxb-[A-Za-z0-9-]{20,}", "xoxp-": r"xoxp-[A-Za-z0-9-]{20,}",
    "xapp-": r"xapp-[0-9]-[A-Z0-9]{8,}-[0-9]{8,}-[a-z0-9]{32,}", "SG.": r"SG\.[A-Za-z0-9_-]{20,24}\.[A-Za-z0-9_-]{40,46}", "sk_live_": r"sk_live_[A-Za-z0-9]{20,}", "rk_live_": r"rk_live_[A-Za-z0-9]{20,}",
    "AIza": r"AIza[A-Za-z0-9_-]{35}", "npm_": r"npm_[A-Za-z0-9]{36}", "pypi-": r"pypi-[A-Za-z0-9_-]{80,}",
}
# Words and signs of placeholders.
_FILLER = re.compile(r"change.?me|your|example|placeholder|dummy|sample|redacted|insert|replace|todo|fixme|enter|my.?(?:password|secret|token)|not.?set|fake", re.I)
_BLANKED = re.compile(r"xxxx|\*\*\*|\.\.\.|<[^>]*>", re.I)

_NAME = "(?:" + "|".join(map(re.escape, NAMES)) + ")"
_SIGN = r"""["']?\]?[ \t]*(?::=|=>|[:=])[ \t]*"""
_BARE = r"""[^\s"'`,;)\]}<>=][^\s"'`,;)\]}<>]*"""


# The grammars: (kind, parts, are letters of either case the same); a part is an expression and whether it is of the value.
_GRAMMARS: list[tuple[str, list[tuple[str, bool]], bool]] = [
    *(("token", [(x, True)], False) for x in FORMATS.values()),
    ("armor", [(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", False)], False),
    ("address", [(r"://[^\s/:@\"'<>]*:", False), (r"[^\s/@\"'<>]+", True), (r"@[A-Za-z0-9\[]", False)], False),
    ("login", [(r"-u[ =]?[\"']?[A-Za-z0-9_.-]+:", False), (r"[^\s\"']+", True)], False),
    ("bearer", [(r"bearer[ \t]+", False), (r"[A-Za-z0-9._~+/=-]{8,}", True)], True),
    ("basic", [(r"basic[ \t]+", False), (r"[A-Za-z0-9+/]{8,}={0,2}", True)], True),
    ("bare", [(_NAME + _SIGN, False), (_BARE, True)], True),
    *((kind, [(_NAME + sign, False), (rf"(?:[^{q}\\\n]|\\[^\n])*", True), (q, False)], True) for q in "\"'`" for kind, sign in (("quoted", f"{_SIGN}[bfru]?{q}"), ("flag", f"[ =]{q}"))),
    ("flag", [(_NAME + " ", False), (r"[^\s\"'`<>]+", True)], True),
]
_ENTRIES = {"-----begin ", "://", "bearer ", "basic ", "bearer\t", "basic\t", "-u", *(x.lower() for x in FORMATS), *NAMES}
_MORE = {q: re.compile(rf"[ \t]*(?:\+|\\)[ \t]*(?:\r?\n[ \t]*)?(?:\+[ \t]*)?{q}((?:[^{q}\\\n]|\\[^\n])*){q}") for q in "\"'"}

# what is filled in within a value, closed or cut off; a variable, with members, a path or more variables behind it, as the whole value
_INSERTED = re.compile(r"\$\{[^}]*(?:\}|$)|\$\([^)]*(?:\)|$)|%\([^)]*(?:\)\w?|$)|\{\{.*?(?:\}\}|$)|#\{[^}]*(?:\}|$)")
_VARIABLE = re.compile(r"\$\$?([A-Za-z_]\w*)(?:-$|(?:->|::|[.:/])\$?\w*)*")
_WRITTEN = re.compile(r"(?=.*[A-Z])(?=.*[a-z]).*\d[A-Za-z]")
# a password's hash, which nobody can log in with
_HASH = re.compile(r"\$(?:1|2[abxy]?|5|6|7|y|apr1|argon2\w*|scrypt|pbkdf2[\w-]*)\$.+")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
_DIGESTED = re.compile(r"(?:sha-?\d+|md5|checksum)[_.-]?$", re.I)
_REFERENCE = re.compile(r"^%\w+%$|^@|^&|^env[:.]|^vault[:.]|^ref[:+]|^file:|^/|^\.\.?/|^arn:|^https?:|os\.environ|getenv|process\.env", re.I)
# Words that end with a secret's name and mean something else.
_OTHER_WORDS = {"compass", "encompass", "bypass", "trespass", "surpass", "underpass", "overpass", "lowpass", "highpass", "bandpass", "allpass", "subpass", "renderpass", "multipass", "singlepass", "firstpass", "subtoken", "pretoken", "nexttoken"}
_NOTHING = {"", "none", "null", "nil", "true", "false", "undefined", "password", "passwd", "pass", "pwd", "secret", "token", "user", "username", "test", "root", "admin"}
# Words of a remark, which a phrase that is a secret does without.
_REMARKS = set("a an the is are be must may can not no of to for in on at by with from this that it its your our my their see ask use set get has have and or if as at least than when where which who will should please here there".split())
_KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")


@functools.lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton([parts for _, parts, _ in _GRAMMARS], [fold for _, _, fold in _GRAMMARS])


@functools.lru_cache(maxsize=1)
def _literals():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in _ENTRIES:
        a.add_word(word, len(word))
    a.make_automaton()
    return a, max(map(len, _ENTRIES))


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def hits(text: str, chunk: int = CHUNK) -> list[int]:
    """Where grammars may begin, by overlapping chunks, each place once."""
    a, longest = _literals()
    low = _lower(text)
    found = set()
    for at in range(0, len(low), chunk):
        found.update(at + e + 1 - n for e, n in a.iter(low[at : at + chunk + longest]))
    return sorted(found)


def reference(value: str) -> bool:
    """Does the value say where a value is kept? What is filled in counts as a letter, so a secret around it stays one."""
    rest = _INSERTED.sub("a", value)
    if rest != value and (len(rest) < 6 or not _varied(rest)):
        return True
    variable = _VARIABLE.fullmatch(value)
    return bool(variable and not _WRITTEN.match(variable[1]) or _HASH.fullmatch(value) or _REFERENCE.search(value))


def placeholder(value: str) -> bool:
    """Blanked out, or words of placeholders and nothing but words and numbers around them."""
    if _BLANKED.search(value):
        return True
    rest = _FILLER.sub("-", value)
    return rest != value and not any(re.search(r"[A-Za-z]\d|\d[A-Za-z]", x) and len(x) > 5 or re.search(r"[^\w]", x) and len(x) > 5 for x in re.split(r"[-_. ]+", rest))


def usable(value: str, least: int = 6) -> bool:
    """Could the value be a secret itself?"""
    if len(value) < least or value.lower() in _NOTHING or len(set(value)) < 4:
        return False
    return not reference(value) and not placeholder(value)


_WORDS = re.compile(r"[a-z]+(?:[_.-][a-z]+)*|[A-Z]+(?:[_.-][A-Z]+)*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*(?:[_.-][A-Z]?[a-z]+(?:[A-Z][a-z]+)*)*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSPEAKABLE = re.compile(r"[^aeiouy]{5}|^[^aeiouy]{4,}$")


def _varied(value: str) -> bool:
    """Not just words, however they are joined; what can't be spoken, or is a row of keys, is no word."""
    low = value.lower()
    return not _WORDS.fullmatch(value) or any(_UNSPEAKABLE.search(p.lower()) for p in _PART.findall(value)) or any(low[i : i + 7] in row for row in _KEYBOARD for i in range(len(low) - 6))


def _phrase(value: str) -> bool:
    """Three or more words that are no remark."""
    w = value.lower().split(" ")
    return len(w) > 2 and all(len(x) > 2 and x.isalnum() for x in w) and not _REMARKS & set(w)


def _assigned(kind: str, name: str, before: str, value: str) -> bool:
    """Is what a name is given a secret? name in small letters, before: what stands in front of it."""
    password = name in PASSWORDS
    if any(c.isspace() for c in value):
        return kind != "bare" and password and _phrase(value) and usable(value)
    if _DIGEST.fullmatch(value) and _DIGESTED.search(before):
        return False
    short = kind == "quoted" and password and re.search(r"\d", value) and re.search(r"[A-Za-z]", value)
    if not usable(value, 5 if short else 6):
        return False
    if kind == "bare":
        if "(" in value or "[" in value or "{" in _INSERTED.sub("a", value):
            return False
        if value.isdigit():
            return password
        if not any(c.isdigit() for c in value) and not re.search(r"[^A-Za-z0-9_.-]", value) and not _varied(value):
            return False
        return not re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", value) and not re.fullmatch(r"[\d.,:xX-]+", value)  # a member, a number
    return _varied(value)


def _folded(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alike and invisible characters folded one by one, and where each character comes from."""
    if text.isascii():
        return text, None
    folds, out, back, at = all_folds(), [], [], 0
    for line in text.split("\n"):
        if line.isascii() or not any(c in folds for c in line):
            out.append(line)
            back.extend(range(at, at + len(line) + 1))
        else:
            new = [folds.get(c, c) for c in line]
            out.append("".join(new))
            for i, c in enumerate(new):
                back.extend([at + i] * len(c))
            back.append(at + len(line))
        at += len(line) + 1
    return "\n".join(out), back


def find(text: str | None) -> list[tuple[list[tuple[int, int]], int, str]]:
    """(spans of the value, where it stands or begins, kind) of each credential of a text.

    Look-alike characters hide nothing: grammars read the folded text, spans are those of the text itself.
    """
    if not text:
        return []
    text, back = _folded(text)
    found = _find(text)
    if back is None:
        return found
    return [([(back[a], back[b - 1] + 1) for a, b in spans if b > a], back[start], kind) for spans, start, kind in found]


_KEY_LINE = re.compile(r"(?:[^A-Za-z0-9+/=\n\\]|\\[nrt\\])*(?:[A-Za-z0-9-]+: [^\n]*|(?:[A-Za-z0-9+/=]+(?:[^A-Za-z0-9+/=\n\\]|\\[nrt\\])*)?)(?:\n|$)")
_RUN = re.compile(r"(?<![A-Za-z0-9+/=\\])[A-Za-z0-9+/=]+|(?<=\\n)[A-Za-z0-9+/=]+|(?<=\\r)[A-Za-z0-9+/=]+")
_HEADER = re.compile(r"[A-Za-z0-9-]+: [^\n\\]*")


def _key(text: str, end: int, borders: list[int]) -> list[tuple[int, int]]:
    """The spans of a private key behind its armor: to the END line, without one as long as lines are base64. borders: all BEGIN and END."""
    k = bisect.bisect_left(borders, end)
    if k < len(borders) and text.startswith("-----END ", borders[k]):
        stop = borders[k]
    else:
        stop = at = end
        while m := _KEY_LINE.match(text, at):
            runs = [x.group() for x in _RUN.finditer(m.group())]
            first = at == end and not runs
            if m.end() == at or not first and not (runs and (max(map(len, runs)) >= 16 or runs[-1].endswith("=")) or _HEADER.search(m.group())):
                break
            stop = at = m.end()
    headers = [m.span() for m in _HEADER.finditer(text, end, stop)]
    spans = [m.span() for m in _RUN.finditer(text, end, stop)]
    return [s for s in spans if not any(a <= s[0] < b for a, b in headers)]


def _find(text: str) -> list[tuple[list[tuple[int, int]], int, str]]:
    out, auto, borders = [], automaton(), None
    for start in hits(text):
        got = auto.match(text, start)
        if not got:
            continue
        rule, end, spans = got
        kind = _GRAMMARS[rule][0]
        value = "".join([text[a:b] for a, b in spans])
        before = text[max(0, start - 24) : start]
        if kind == "armor":
            borders = [m.start() for m in re.finditer("-----(?:BEGIN|END) ", text)] if borders is None else borders
            body = _key(text, end, borders)
            if sum(b - a for a, b in body) >= 40:
                out.append((body, start, "private key"))
        elif kind == "token":
            after = text[end : end + 1]
            inside = before[-1:].isalnum() or before[-1:] == "_" or after.isalnum() and after.isascii()
            if not inside and len(set(value[4:])) > 4 and not _BLANKED.search(value) and not _FILLER.search(value):
                out.append((spans, start, "token"))
        elif kind in ("bare", "quoted", "flag"):
            flag = re.search(r"--[a-z-]*$", before)
            if kind == "flag" and not flag:
                continue
            word = re.match(_NAME, text[start:end], re.I)[0].lower()
            if before[-1:].isalnum() and _PART.findall(text[max(0, start - 24) : start + len(word)])[-1].lower() in _OTHER_WORDS:
                continue
            if kind == "quoted":
                q = text[end - 1]
                while q in _MORE and (more := _MORE[q].match(text, end)):
                    spans, end, value = [*spans, more.span(1)], more.end(), value + more[1]
            if kind == "bare" and text[end : end + 1] == "(":
                continue
            if spans and _assigned("flag" if flag else kind, word, before, value):
                out.append((spans, spans[0][0], "assignment"))
        elif kind == "address":
            if value.lower() not in _NOTHING and not reference(value) and not placeholder(value) and len(set(value)) > 2:
                out.append((spans, spans[0][0], "address"))
        elif kind == "login":
            if usable(value):
                out.append((spans, spans[0][0], "login"))
        elif kind == "bearer":
            if usable(value) and _varied(value):
                out.append((spans, spans[0][0], "header"))
        elif kind == "basic":
            try:
                user, _, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
            except ValueError:
                continue
            if user and word and word.lower() not in _NOTHING and not placeholder(word):
                out.append((spans, spans[0][0], "header"))
    return out


def redacted(text: str, found: list[tuple[list[tuple[int, int]], int, str]], placeholder: str = PLACEHOLDER) -> str:
    """The text with the union of the values' spans replaced; of a value in several parts each part is."""
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(s for spans, _, _ in found for s in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[done:a], placeholder]
        done = b
    return "".join(out) + text[done:]


def credentials(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines array<int>, kinds array<string>, redacted string) of each row whose text holds credentials.

    lines (from 1, split at line feeds, sorted, each once) and kinds go together. Null and empty texts give no row.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lines, kinds, new = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if found := find(t):
                    by_line: dict[int, str] = {}
                    feeds = [m.start() for m in re.finditer("\n", t)]
                    for _, start, what in sorted(found, key=lambda x: x[1]):
                        by_line.setdefault(bisect.bisect_left(feeds, start) + 1, what)
                    at.append(i), lines.append(list(by_line)), kinds.append(list(by_line.values())), new.append(redacted(t, found))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string())), pa.array(new, pa.string())], names=[key, "lines", "kinds", "redacted"])

    return spread(df.select(key, text).where(f"{text} is not null")).mapInArrow(run, f"{key} {kind}, lines array<int>, kinds array<string>, redacted string")


def lines(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.explode("lines").alias("line_no")).select(key, F.col("line_no").cast("long"))
