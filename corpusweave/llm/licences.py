"""The licence of each file and repository, from what the files themselves say.

A file states a licence by a tag or an entry of a manifest, which is parsed as a boolean expression of names; by a sentence that
puts something under it; or by a licence's text or header. A sentence counts where a known name, or words that look like one, stands behind
"under", "subject to", "governed by" and the like, and nothing in it denies; names in other places are mentions.
Texts and headers are found by their runs of three words, in stretches of the file, and the licence
is the one whose words a stretch holds most completely, so that versions and variants are told apart though words are changed or
inserted; sentences of a found text are part of it. A file that states nothing inherits from the nearest licence
file above it (or from the top alone); contradictions and names nobody knows are flagged.

The known licences are a fixed collection; its size is checked before it goes to the tasks.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.lookalike import canonical
from corpusweave.runtime import spread, written

CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"
#: Most characters of licence texts that are sent to tasks.
LIMIT = 64_000_000
#: Share of a licence's pairs of words that a stretch must hold, and words between stretches.
SHARE, GAP = 0.5, 24

_MARK = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--+|%+|\"\"\"|rem\b)?\s*", re.I)
_END = re.compile(r"\s*(?:\*+/|--+>|\"\"\")\s*$")
_QUOTE = re.compile(r"^\s*>")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+[a-z]?)*", re.I)
#: Words put between others by way of a remark: [name] and (in name).
_REMARK = re.compile(r"\[\w+\]|\(in \w+\)")
# Forms of tags and manifest entries; the group is an expression of names.
_TAGS = [
    re.compile(r"(?:SPDX-)?Licen[sc]e-Identifier\s*:\s*(?P<x>[^\s\\].*)", re.I),
    re.compile(r"@licen[sc]e\s+(?P<x>\S.*)", re.I),
    re.compile(r"[\"']?Licen[sc]e\s*::\s*(?:OSI Approved\s*::\s*)?(?P<x>[^\"']+)"),
    re.compile(r"Licen[sc]e\s*:\s*(?P<x>[A-Za-z0-9(].*)"),
    re.compile(r"[\"']?licen[sc]es?[\"']?\s*[:=]\s*[\[{\s]*(?:[\"']?(?:type|name|id|text)[\"']?\s*[:=]\s*)?[\"'](?P<x>[^\"']+)[\"']", re.I),
    re.compile(r"licen[sc]e\s*[:=]\s*(?P<x>[A-Za-z0-9(][^\"'{}\[\]]*)$"),
    re.compile(r"<licen[sc]e>\s*(?:<name>\s*)?(?P<x>[^<>]+?)\s*(?:</|$)", re.I),
]
_XML = re.compile(r"\s*<licen[sc]e>\s*$", re.I)
_XML_NAME = re.compile(r"\s*<name>\s*(?P<x>[^<>]+?)\s*</name>", re.I)
# Words between what is licensed and the licence's name, and the verbs of such sentences.
_PUTS = re.compile(r"(?:\b(?:under|subject to|according to|in accordance with|pursuant to|governed by|covered by|bound by|set out in|comes with|follows?|obey|observe)|(?:licen[cs]e|licen[cs]ing|lizenz|terms of use)\b[^:.]{0,60}:)\s*(?:the\s+)?(?:(?:terms|conditions|terms and conditions|provisions)\s+of\s+)?(?:the\s+)?(?:(?:either|both)\s+)?$", re.I)
_VERB = re.compile(r"licen[cs]|lizenz|releas|distribut|publish|availab|provid|offer|cover|govern|subject|\bus(?:e|ed|able)\b|cop(?:y|ies|ied)|terms|appl(?:y|ies)|comes with|\b(?:is|are) under", re.I)
_APPLIES = re.compile(r"\s*(?:applies|apply|governs|covers)\b", re.I)
_DENIES = re.compile(r"\b(?:not|no|never|nor|neither|none|nowhere|nothing|without|cannot|unlike|instead of|nicht|kein\w*)\b|n't\b", re.I)
# What belongs to the name before it though it denies.
_TAIL = re.compile(r",?\s*(?:(?:and|but)?\s*no (?:other|later) versions?|or,?[^.;]{0,40}?\bany later version)\b", re.I)
_SECTION = re.compile(r"(?:#+\s*)?(?:licen[cs]e|licen[cs]ing|terms|copying|lizenz)\s*:?\s*", re.I)
_LINK = re.compile(r"\[(?P<x>[^\]]+)\]\([^)]*\)")
_TITLE = re.compile(r"(?:[A-Z]\w*[ -]){1,6}(?:Terms|Deed|Grant|Licen[sc]e|Agreement|Notice|Permission|Charter|Covenant)\b")
_NAMED = re.compile(r"[A-Z][\w+]*(?:-[\w.+]+)*-\d[\w.+-]*\w|(?:LicenseRef|LicenceRef)-[\w.-]*\w", re.I)
_NOTHING = re.compile(r"(?:see\b|none$|n/a$|tbd\b|unlicensed$|\W*$)", re.I)
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
_OPERATOR = re.compile(r"(\(|\)|(?:^|\s+)(?:OR|AND|WITH)(?=\s|$)|\s*(?:\|\||&&)\s*|\s+/\s+)")
_LOWER_OPERATOR = re.compile(r"(\(|\)|(?:^|\s+)(?:or|and|with)(?=\s|$))", re.I)
#: Alternatives that an expression is multiplied out to; one of more is a contradiction nobody can follow.
_MANY = 64


def words(text: str) -> list[str]:
    return _WORD.findall(_REMARK.sub(" ", text).lower())


class Licences:
    """What is known of the licences: names, titles, and the word pairs and runs of their texts."""

    def __init__(self, patterns: list[tuple[str, str, str, str]]):
        self.names: dict[str, str] = {}
        self.titles: dict[tuple[str, ...], set[str]] = defaultdict(set)
        self.texts: list[tuple[str, Counter, int, int]] = []
        self.runs: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for name, title, kind, raw in patterns:
            self.names[name.lower()] = name
            self.titles[tuple(words(title))].add(name)
            body = raw.split("\n", 1)[1] if kind == "header" and "\n" in raw and raw.lower().startswith("copyright") else raw
            w = words(body)
            for run in set(zip(w, w[1:], w[2:])):
                self.runs[run].append(len(self.texts))
            self.texts.append((name, Counter(zip(w, w[1:])), max(1, len(w) - 1), len(w)))
        self.longest = max(map(len, self.titles), default=0)
        self.firsts = {t[0] for t in self.titles if t}
        self.of: list[set[tuple[str, ...]]] = [set() for _ in self.texts]
        for run, ks in self.runs.items():
            for k in ks:
                self.of[k].add(run)

    def resolve(self, text: str) -> str | None:
        """The licence of an expression: a name, a '?name' that is unknown, CONFLICT; None if it is no name at all.

        AND, OR, WITH, + and brackets have their usual meaning. What holds in every alternative several licences is in conflict; a
        choice between licences is one value, known by a name with -or- or unknown; an exception (WITH) leaves the licence what it is.
        """
        text = text.strip().strip("\"',;").strip()
        if m := _LINK.match(text):
            text = m["x"]
        if not text or _NOTHING.match(text):
            return None
        if name := self.names.get(text.lower()):
            return name
        # operators are in capitals, or stand between single names; titles have "or" and "and" in them
        operator = _LOWER_OPERATOR if re.fullmatch(r"[(\s]*\S+(\s+(or|and|with)\s+\S+)+", text, re.I) else _OPERATOR
        parts = [p.strip() for p in operator.split(text) if p and p.strip()]
        if len(parts) > 1:
            got = self._alternatives(parts)
            if got is not None:
                return self._value(got)
            text = re.sub(r"\([^()]*\)", "", text).strip()  # no expression: a remark in brackets
        return self._single(text)

    def _single(self, text: str) -> str | None:
        if _NOTHING.match(text):
            return None
        if name := self.names.get(text.lower()):
            return name
        if text.endswith("+"):
            base = text[:-1].strip().lower()
            base = base.removesuffix("-only")
            if name := self.names.get(base + "-or-later") or self.names.get(base):
                return name
        return self.known(text) or "?" + _unknown(text)

    def _alternatives(self, parts: list[str]) -> set[frozenset[str]] | None:
        """The expression as alternatives, each the licences that hold together; None if it is none."""
        at = 0

        def word() -> str:
            return {"||": "OR", "/": "OR", "&&": "AND"}.get(parts[at], parts[at].upper()) if at < len(parts) else ""

        def single() -> set[frozenset[str]]:
            nonlocal at
            if word() == "(":
                at += 1
                inside = either()
                if word() != ")":
                    raise ValueError
                at += 1
                out = inside
            elif word() in ("", ")", "OR", "AND", "WITH"):
                raise ValueError
            else:
                if not (name := self._single(parts[at])):
                    raise ValueError
                at += 1
                out = {frozenset([name])}
            if word() == "WITH":
                at += 1
                if word() in ("", "(", ")", "OR", "AND", "WITH"):
                    raise ValueError
                at += 1
            return out

        def together() -> set[frozenset[str]]:
            nonlocal at
            out = single()
            while word() == "AND":
                at += 1
                more = single()
                out = {a | b for a in out for b in more}
                if len(out) > _MANY:
                    return {frozenset([CONFLICT])}
            return out

        def either() -> set[frozenset[str]]:
            nonlocal at
            out = together()
            while word() == "OR":
                at += 1
                out = out | together()
            return out

        try:
            got = either()
        except ValueError:
            return None
        return got if at == len(parts) else None

    def _value(self, alternatives: set[frozenset[str]]) -> str:
        least = {a for a in alternatives if not any(b < a for b in alternatives)}
        if len(least) == 1:
            only = next(iter(least))
            return next(iter(only)) if len(only) == 1 else CONFLICT
        if all(len(a) > 1 for a in least):
            return CONFLICT
        names = sorted(" and ".join(sorted(a)) for a in least)
        for order in (names, names[::-1]):
            if known := self.names.get("-or-".join(order).lower()):
                return known
        return "?" + " or ".join(names)

    def _known(self, text: str) -> tuple[str, int] | None:
        """(licence, characters) of a known name or title at the beginning of the text, the longest first."""
        m = re.match(r"[\w.+-]*\w\+?", text)
        short = (name, m.end()) if m and (name := self.names.get(m.group().lower())) else None
        found = list(itertools.islice(_WORD.finditer(text), 4 * self.longest + 16))
        w = [x.group().lower() for x in found]
        if not w or not (w[0] in self.firsts or w[0] == "version"):
            return short
        later = "any later version" in " ".join(words(text))
        ends = [x.end() for x in found]
        # 'version 2 of the T' is the title 'T, version 2'
        if len(w) > 4 and w[0] == "version" and w[2] == "of":
            at = [i for i in range(3, len(w)) if w[i] != "the"]
            stop = next((j for j, i in enumerate(at) if w[i] in ("or", "and")), len(at))
            ends = [ends[i] for i in at[:stop]] + [ends[at[stop - 1]]] * 2 if stop else []
            w = [w[i] for i in at[:stop]] + w[:2]
        for n in range(min(self.longest, len(w)), 0, -1):
            if names := self.titles.get(tuple(w[:n])):
                if len(names) == 1:
                    return next(iter(names)), ends[n - 1]
                wanted = "later" if later else "only"
                return next((x for x in sorted(names) if x.endswith(wanted)), sorted(names)[0]), ends[n - 1]
        return short

    def texts_in(self, tokens: list[str]) -> list[tuple[str, int, int, int]]:
        """(licence, number of its text, first, end) of the texts and headers that the tokens hold."""
        at = [i for i, run in enumerate(zip(tokens, tokens[1:], tokens[2:])) if run in self.runs]
        if len(at) < 4:
            return []
        marks = {i for i, w in enumerate(tokens) if w == "copyright"}
        stretches, first, last = [], at[0], at[0]
        for i in at[1:]:
            if i - last > GAP or any(k in marks for k in range(last + 1, i + 1)):
                stretches.append((first, last))
                first = i
            last = i
        stretches.append((first, last))
        out = []
        for a, b in stretches:
            a, b = max(0, a - 6), min(len(tokens), b + 9)
            places = list(range(a, b))
            while len(places) >= 17:  # a stretch may hold one text behind another: what the best covers is taken out
                best = self._best([tokens[i] for i in places])
                if not best:
                    break
                name, k = best
                mine = self.of[k]
                covered = {j for i in range(len(places) - 2) if (tokens[places[i]], tokens[places[i + 1]], tokens[places[i + 2]]) in mine for j in (i, i + 1, i + 2)}
                out.append((name, k, places[min(covered)], places[max(covered)] + 1))
                places = [i for j, i in enumerate(places) if j not in covered]
        return out

    def _best(self, w: list[str]) -> tuple[str, int] | None:
        hit = Counter(k for run in zip(w, w[1:], w[2:]) for k in set(self.runs.get(run, ())))
        have = Counter(zip(w, w[1:]))
        best = None
        for k, n in hit.items():
            name, pairs, total, _ = self.texts[k]
            if n < 0.25 * total:
                continue
            same = sum(min(n, have[p]) for p, n in pairs.items() if p in have)
            if same >= SHARE * total:
                score = 2 * same - total
                if best is None or (score, same, name) > best[:3]:
                    best = (score, same, name, k)
        return best[2:] if best else None

    def stated(self, text: str | None) -> set[str]:
        """All that a file states: names, '?unknown' names, CONFLICT."""
        if not text:
            return set()
        out, section, xml, rest, sentences = set(), False, False, [], []
        for raw in canonical(text).split("\n"):
            low = raw.lower()
            line = raw
            if _QUOTE.match(line):
                continue
            if section and line.strip() and not re.fullmatch(r"\W+", line):
                section = False
                bare = re.sub(r"^the |\.$", "", _END.sub("", _MARK.sub("", line, count=1)).strip())
                m = _LINK.fullmatch(bare)
                if not _DENIES.search(_TAIL.sub("", bare)) and (m or len(bare) < 120):
                    if got := self.known(m["x"] if m else bare):
                        out.add(got)
                        continue
                    if m or _TITLE.fullmatch(bare):
                        out.add("?" + _unknown(m["x"] if m else bare))
                        continue
            if xml and (m := _XML_NAME.match(line)):
                out |= {x} if (x := self.resolve(m["x"])) else set()
            xml = bool(_XML.match(line)) or xml and not line.strip()
            if any(x in low for x in ("licen", "lizenz", "terms", "under", "subject", "according", "accordance", "pursuant", "govern", "cover", "appl", "comes with", "follow", "set out in", "copying", "bound by")):
                line = _END.sub("", _MARK.sub("", raw, count=1))
                if _SECTION.fullmatch(line) or _SECTION.fullmatch(raw):
                    section = True
                    continue
                tag = next((m for rx in _TAGS if (m := rx.match(line.strip().rstrip(",")))), None)
                if tag:
                    if got := self._tagged(tag["x"]):
                        out.add(got)  # the line stays: it may be part of a header too
                else:
                    sentences.append((len(rest), line.strip()))
            rest.append(line)
        tokens, begins = [], []
        for x in rest:
            begins.append(len(tokens))
            tokens += words(_MARK.sub("", x, count=1))
        begins.append(len(tokens))
        texts = self.texts_in(tokens)
        for n, line in sentences:
            if not any(self._within(tokens[begins[n] : begins[n + 1]], k) for _, k, a, b in texts if begins[n] < b and begins[n + 1] > a):
                out |= self._sentences(line)
        return out | {name for name, _, _, _ in texts}

    def _within(self, w: list[str], k: int) -> bool:
        """Are these words of a line some of a licence's text?"""
        runs = list(zip(w, w[1:], w[2:]))
        return sum(r in self.of[k] for r in runs) >= (0.5 if len(runs) > 4 else 0.9) * len(runs)

    def _tagged(self, x: str) -> str | None:
        got = self.resolve(x)
        return None if got and got.startswith("?") and len(x.split()) > 8 else got

    def _sentences(self, line: str) -> set[str]:
        """What the sentences of a line put something under."""
        out: set[str] = set()
        for x in _BREAK.split(line):
            for start, end, name in self._names_in(x):
                before, after = x[:start], x[end:]
                if m := _TAIL.match(after):
                    after = after[m.end() :]
                if _DENIES.search(before) or _DENIES.search(after):
                    continue
                if _PUTS.search(before) and _VERB.search(before) or _APPLIES.match(after):
                    out.add(name)
        return out

    def _names_in(self, x: str) -> list[tuple[int, int, str]]:
        """(start, end, licence) of what may be a licence's name in a sentence, the longest at each place; unknown ones begin with ?."""
        out, at = [], 0
        for m in re.finditer(r"(?<![\w.-])[A-Za-z]", x):
            if m.start() < at:
                continue
            rest = x[m.start() :]
            if got := self._known(rest):
                name, n = got
                at = m.start() + n
                out.append((m.start(), at, name))
            elif (t := _TITLE.match(rest) or _NAMED.match(rest)) and not self._begun(t.group()):
                at = m.start() + t.end()
                out.append((m.start(), at, "?" + _unknown(t.group())))
        return out

    def _begun(self, title: str) -> bool:
        """The beginning of a known title, of which a line may hold no more."""
        w = [x for x in words(title) if x != "the"]
        return any(list(t[: len(w)]) == w for t in self.titles)

    def known(self, text: str) -> str | None:
        """A known name or title at the beginning of the text, the longest first."""
        got = self._known(text)
        return got[0] if got else None

    def verdict(self, text: str | None) -> str | None:
        got = self.stated(text)
        if not got:
            return None
        if len(got) > 1 or CONFLICT in got:
            return CONFLICT
        name = next(iter(got))
        return UNKNOWN if name.startswith("?") else name


def _unknown(text: str) -> str:
    return " ".join(w for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in ("licenseref", "the", "version"))


def known_licences(patterns: DataFrame) -> list[tuple[str, str, str, str]]:
    """The collection as rows, behind a check of its size."""
    rows = patterns.where("license_name is not null and raw_text is not null").select("license_name", F.coalesce("license_title", "license_name"), F.coalesce("pattern_kind", F.lit("full")), "raw_text")
    size = rows.agg(F.sum(F.length("raw_text"))).first()[0] or 0
    if size > LIMIT:
        raise ValueError(f"the licence texts have {size} characters; tasks get at most {LIMIT}")
    return [tuple(r) for r in rows.orderBy("license_name", "pattern_kind", "raw_text").collect()]


@functools.lru_cache(maxsize=2)
def _licences(patterns: tuple) -> Licences:
    return Licences(list(patterns))


def _path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def own_verdicts(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file_id, repo_id, folder, scanned_at, file_path, own): own is null where a file states nothing; folder is where a licence file lies ('' the top), else null."""
    shared = files.sparkSession.sparkContext.broadcast(tuple(known_licences(patterns)))
    schema = files.select("file_id", "repo_id", "file_path", "scanned_at").schema.add("own", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _licences(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([known.verdict(t) for t in b.column(4).to_pylist()], pa.string())], names=schema.names)

    rows = spread(files.select("file_id", "repo_id", "file_path", "scanned_at", "file_content")).mapInArrow(run, schema)
    path = _path(F.col("file_path"))
    return rows.withColumn("folder", F.when(F.lower(F.regexp_extract(path, "([^/]*)$", 1)).rlike(r"^(licen[sc]e|copying)(\.[^/]*)?$"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)))


def verdicts(files: DataFrame, repositories: DataFrame, patterns: DataFrame, top_only: bool = True) -> DataFrame:
    """(subject, subject_id, verdict): a row for each row of files and of repositories.

    A file that states nothing inherits from the licence file in the nearest folder above it whose licence files state something, or
    with top_only from those at the top alone. A null repo_id is no repository: such files inherit nothing. Of a licence file read
    several times the latest counts; several licence files of a folder that differ are in conflict.
    """
    own = written(own_verdicts(files, patterns), "licences")
    at = own.where("own is not null and repo_id is not null").where(F.col("folder") == "" if top_only else F.col("folder").isNotNull())
    newest = at.groupBy("repo_id", "folder", "file_path").agg(F.max_by("own", F.struct("scanned_at", "own")).alias("own"))
    above = newest.groupBy("repo_id", "folder").agg(F.when(F.min("own") == F.max("own"), F.min("own")).otherwise(CONFLICT).alias("inherited"))
    silent = own.where("own is null").select("file_id", "repo_id", "file_path")
    if top_only:
        inherited = silent.join(above, "repo_id", "left").select("file_id", "inherited")
    else:
        parts = F.split(_path(F.col("file_path")), "/")
        folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        rows = silent.withColumn("row", F.monotonically_increasing_id()).select("row", "file_id", "repo_id", F.explode_outer(folders).alias("folder"))
        near = rows.join(above, ["repo_id", "folder"], "left").groupBy("row").agg(F.first("file_id").alias("file_id"), F.max_by("inherited", F.when(F.col("inherited").isNotNull(), F.length("folder"))).alias("inherited"))
        inherited = near.select("file_id", "inherited")
    named = own.where("own is not null").select("file_id", F.col("own").alias("inherited")).unionByName(inherited)
    of_files = named.select(F.lit("file").alias("subject"), F.col("file_id").alias("subject_id"), F.coalesce("inherited", F.lit(UNKNOWN)).alias("verdict"))
    stated = own.where("own is not null").groupBy("repo_id").agg(F.when(F.min("own") == F.max("own"), F.min("own")).otherwise(CONFLICT).alias("own"))
    of_repos = repositories.select("repo_id").join(stated, "repo_id", "left").select(F.lit("repo").alias("subject"), F.col("repo_id").alias("subject_id"), F.coalesce("own", F.lit(UNKNOWN)).alias("verdict"))
    return of_files.unionByName(of_repos)
