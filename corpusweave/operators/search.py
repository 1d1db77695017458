"""The three searches over files and patterns: exact containment, keywords, and gap-tolerant alignment."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusweave.functions import grams
from corpusweave.functions.text import versions_in_text, versions_of_name, whole_numbers

#: Most bytes of pattern texts that go to tasks at once; more go in blocks.
BROADCAST = 64_000_000
LOOKAHEAD = 5


def in_blocks(patterns: DataFrame, key: str, column: str, limit: int = BROADCAST) -> list[DataFrame]:
    """The patterns in blocks whose texts are each within about the limit; usually one block."""
    size = patterns.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n = size // max(1, limit) + 1
    return [patterns if n == 1 else patterns.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def small(patterns: DataFrame, column: str = "text", limit: int = BROADCAST) -> DataFrame:
    """The patterns, marked for broadcast if their texts are within the limit."""
    size = patterns.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return F.broadcast(patterns) if size <= limit else patterns


def occurring(files: DataFrame, patterns: DataFrame, pattern: str, alone: str | None = None, limit: int = BROADCAST) -> DataFrame:
    """(path, the columns of patterns but the pattern): each pattern that occurs in a file's text, once. Empty and null texts match nothing.

    files (path, text). The patterns are a query set that meets all files in blocks of bounded size; a block is one automaton, so a file is
    read once whatever the number of patterns. alone='word': an occurrence counts only between blanks or ends; 'letters': only
    with no letter or digit on either side.
    """
    f = files.where("text is not null and text <> ''").select("path", "text")
    names = [c for c in patterns.columns if c != pattern]
    schema = T.StructType([f.schema["path"], *[patterns.schema[c] for c in names]])
    kinds = to_arrow_schema(schema)

    def scan(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            words: dict[str, list[int]] = {}
            for i, row in enumerate(block.value):
                words.setdefault(row[0], []).append(i)
            automaton = ahocorasick.Automaton()
            for word, rows in words.items():
                automaton.add_word(word, (len(word), rows))
            if words:
                automaton.make_automaton()
            for b in batches:
                at, found = [], []
                for k, text in enumerate(b.column(1).to_pylist() if words else ()):
                    seen: set[int] = set()
                    for end, (n, rows) in automaton.iter(text):
                        if rows[0] not in seen and (not alone or _stands(text, end + 1 - n, end + 1, alone)):
                            seen.update(rows)
                    at += [k] * len(seen)
                    found += sorted(seen)
                columns = [pa.array([block.value[i][1 + c] for i in found], kinds.field(1 + c).type) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())).cast(kinds.field(0).type), *columns], names=schema.names)

        return run

    chosen = patterns.where(F.col(pattern) != "").select(pattern, *names)
    sc = files.sparkSession.sparkContext
    blocks = [sc.broadcast([tuple(r) for r in block.collect()]) for block in in_blocks(chosen, pattern, pattern, limit)]  # each within the limit
    return reduce(DataFrame.unionByName, [f.mapInArrow(scan(b), schema) for b in blocks])


def _stands(text: str, start: int, end: int, alone: str) -> bool:
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    return before in ("", " ") and after in ("", " ") if alone == "word" else not _letter(before) and not _letter(after)


def _letter(c: str) -> bool:
    return c != "" and unicodedata.category(c)[0] in "LN"


def contained(files: DataFrame, patterns: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(path, seq, name): patterns whose text is part of a file's text, whatever the token borders.

    files (path, text), patterns (seq, name, text).
    """
    return occurring(files, patterns.select("text", "seq", "name"), "text", limit=limit)


def full_matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, license_names, license_match_strength, has_full_license) of every file; names in pattern order."""
    hits = contained(files, patterns).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("hits"))
    names = F.coalesce(F.transform("hits", lambda x: x["name"]), F.array().cast("array<string>"))
    return files.select("path").join(hits, "path", "left").select(
        "path", names.alias("license_names"), F.when(F.col("hits").isNotNull(), "EXACT").alias("license_match_strength"), F.col("hits").isNotNull().alias("has_full_license")
    )


def distinct_terms(terms: DataFrame) -> DataFrame:
    """terms (category, cat_ord, term_ord, norm) with the first of equal norms of a category."""
    first = terms.where("norm <> ''").groupBy("category", "norm").agg(F.min(F.struct("cat_ord", "term_ord")).alias("o"))
    return first.select("category", "o.cat_ord", "o.term_ord", "norm")


def keywords(files: DataFrame, terms: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(path, category, cat_ord, norm, term_ord): terms that occur as whole words in the files' normalised texts.

    Words of a term must follow one another.
    """
    t = distinct_terms(terms)
    return occurring(files, t.withColumn("_term", F.col("norm")), "_term", "word", limit).select("path", "category", "cat_ord", "norm", "term_ord")


def keyword_map(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(path, keyword_matches map<category, terms in order>) of files with at least one match."""
    by = keywords(files, terms).groupBy("path", "category", "cat_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("term_ord", "norm"))), lambda x: x["norm"]).alias("terms"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("cat_ord", "category", "terms"))), lambda x: F.struct(x["category"], x["terms"]))
    return by.groupBy("path").agg(F.map_from_entries(entries).alias("keyword_matches"))


def standalone_keywords(files: DataFrame, terms: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(path, category, norm): terms that occur with no letter or digit on either side; every term, equal norms too."""
    t = terms.where("norm <> ''").select("category", "norm").distinct().withColumn("_term", F.col("norm"))
    return occurring(files, t, "_term", "letters", limit)


def align(file: list[str], pattern: list[str], i: int, j: int, anchor: int = grams.ANCHOR, ahead: int = LOOKAHEAD) -> tuple[int, int]:
    """(matches, last file position) of the greedy alignment that begins with an anchor at file i, pattern j."""
    matches, last = anchor, i + anchor - 1
    i, j = i + anchor, j + anchor
    while i < len(file) and j < len(pattern):
        if file[i] == pattern[j]:
            matches, last = matches + 1, i
            i, j = i + 1, j + 1
            continue
        in_file = next((k for k in range(1, ahead + 1) if i + k < len(file) and file[i + k] == pattern[j]), 0)
        in_pattern = next((k for k in range(1, ahead + 1) if j + k < len(pattern) and pattern[j + k] == file[i]), 0)
        if in_file and (not in_pattern or in_file <= in_pattern):
            i += in_file
        elif in_pattern:
            j += in_pattern
        else:
            i, j = i + 1, j + 1
    return matches, last


def anchor_candidates(files: DataFrame, patterns: DataFrame, n: int = grams.ANCHOR, threshold: float = 50.0) -> DataFrame:
    """(path, seq, i, j): heads of the diagonal runs of shared anchors, of which the alignments can pass the threshold.

    A hit whose predecessor on the diagonal is a hit too aligns to one match less, so only heads count; and a hit too near
    either end can't reach the threshold. Both leave every maximum as it is.
    """
    words = files.where("text <> ''").select("path", grams.tokens(F.col("text")).alias("w")).withColumn("n_file", F.size("w"))
    f = grams.anchor_rows(words, "w", ["path", "n_file"], n).withColumnRenamed("pos", "i")
    p = patterns.select("seq", grams.tokens(F.col("text")).alias("w"))
    p = small(grams.anchor_rows(p.select("seq", F.size("w").alias("n_pattern"), "w"), "w", ["seq", "n_pattern"], n).withColumnRenamed("pos", "j"), "gram")
    hits = f.join(p, "gram").select("path", "n_file", "seq", "n_pattern", "i", "j")
    diagonal = Window.partitionBy("path", "seq", F.col("i") - F.col("j")).orderBy("i")
    heads = hits.withColumn("before", F.lag("i").over(diagonal)).where("before is null or before <> i - 1")
    return heads.where(F.least(F.col("n_file") - F.col("i"), F.col("n_pattern") - F.col("j")) > F.col("n_pattern") * (threshold / 100.0)).select("path", "seq", "i", "j")


class _Anchors:
    """The patterns of a block: their words, and where each anchor is."""

    def __init__(self, rows: list[tuple], n: int):
        self.words = [row[2].split(" ") for row in rows]
        self.at: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for j in range(len(w) - n + 1):
                self.at.setdefault(tuple(w[j : j + n]), []).append((k, j))

    def heads(self, f: list[str], n: int, share: float) -> dict[int, list[tuple[int, int]]]:
        """(i, j) of the heads of shared runs, by pattern, where an alignment can pass the share."""
        out: dict[int, list[tuple[int, int]]] = {}
        before: set[tuple[int, int]] = set()
        for i, gram in enumerate(zip(*(f[k:] for k in range(n)))):
            hits = self.at.get(gram)
            if hits is None:
                before = set()
                continue
            for k, j in hits:
                if (k, j - 1) not in before and min(len(f) - i, len(self.words[k]) - j) > share * len(self.words[k]):
                    out.setdefault(k, []).append((i, j))
            before = set(hits)
        return out


def fuzzy(files: DataFrame, patterns: DataFrame, threshold: float = 50.0, n: int = grams.ANCHOR, ahead: int = LOOKAHEAD, limit: int = BROADCAST) -> DataFrame:
    """(path, seq, license_name, match_percent, start_index, end_index, matched_substring, expected_versions, found_versions).

    The best alignment of each file and pattern above the threshold; of equal ones the first in the file, then in the pattern. files
    (path, text), patterns (seq, name, text), texts normalised. Null and empty texts, and patterns shorter than an anchor, match nothing.
    A file is looked at in its own batch, with the anchors of a block of patterns of bounded size: nothing is shuffled.
    """
    f = files.where("text is not null and text <> ''").select("path", "text")
    kind = T.StructType([f.schema["path"], patterns.schema["seq"]]).add("license_name", "string").add("match_percent", "double").add("start_index", "integer").add("end_index", "integer").add("matched_substring", "string")
    types = to_arrow_schema(kind)

    def scan(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = block.value
            known = _Anchors(rows, n)
            for b in batches:
                at, of, percent, start, end, found = [], [], [], [], [], []
                for r, text in enumerate(b.column(1).to_pylist()):
                    w = text.split(" ")
                    for k, heads in known.heads(w, n, threshold / 100.0).items():
                        best = None
                        for i, j in heads:
                            matches, last = align(w, known.words[k], i, j, n, ahead)
                            if best is None or matches > best[0]:
                                best = matches, i, last
                        value = best[0] / len(known.words[k]) * 100.0
                        if value > threshold:
                            at.append(r), of.append(k), percent.append(value), start.append(best[1]), end.append(best[2]), found.append(" ".join(w[best[1] : best[2] + 1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())).cast(types.field(0).type), pa.array([rows[k][0] for k in of], types.field(1).type), pa.array([rows[k][1] for k in of], pa.string()), pa.array(percent, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found, pa.string())],
                    names=kind.names,
                )

        return run

    sc = files.sparkSession.sparkContext
    chosen = patterns.where("text <> ''").select("seq", "name", "text")
    blocks = [sc.broadcast(sorted([tuple(r) for r in block.collect()], key=lambda r: r[0])) for block in in_blocks(chosen, "seq", "text", limit)]  # each within the limit
    found = reduce(DataFrame.unionByName, [f.mapInArrow(scan(b), kind) for b in blocks])
    return found.withColumns({"expected_versions": versions_of_name(F.col("license_name")), "found_versions": whole_numbers(versions_in_text(F.col("matched_substring")))})


def agreement(expected: Column, found: Column) -> Column:
    """ALL if both are the same multiset of versions, COMMON if they overlap, else NONE; null lists are empty."""
    none = F.array().cast("array<string>")
    expected, found = F.coalesce(expected, none), F.coalesce(found, none)
    return F.when(F.array_sort(expected) == F.array_sort(found), "ALL").when(F.arrays_overlap(expected, found), "COMMON").otherwise("NONE")


def resolve(matches: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """(key, selected, match_class, winner_order, license_name, match_percent): the winner of each key's fuzzy matches.

    Only the best class counts (ALL, COMMON, NONE). In ALL matches with found versions go first, then the greatest percent, then
    order. In NONE the greatest percent, then order. In COMMON matches are taken in order, each if it finds a version that none
    before claimed; it claims the first such, and the last one taken wins. Null percents count as 0.
    """
    none = F.array().cast("array<string>")
    m = matches.select(
        key, F.col(order).alias("o"), "license_name", F.coalesce("match_percent", F.lit(0.0)).alias("match_percent"),
        agreement(F.col("expected_versions"), F.col("found_versions")).alias("class"), F.coalesce("found_versions", none).alias("found"),
    )
    m = m.withColumn("rank", F.when(F.col("class") == "ALL", 0).when(F.col("class") == "COMMON", 1).otherwise(2))
    # of COMMON matches that find the same versions no more than these versions can be taken, the first ones: so the list of a
    # key that is folded has a bound in its versions, not in its rows
    common = m.where(F.col("class") == "COMMON").distinct()
    turn = F.row_number().over(Window.partitionBy(key, "found").orderBy("o", "license_name", "match_percent"))
    common = common.withColumn("_turn", turn).where("_turn <= size(found)").drop("_turn")
    m = m.where(F.col("class") != "COMMON").unionByName(common)
    # partial aggregates, no sort by key: the best of ALL and of NONE, and COMMON's list in order
    versioned = (F.col("rank") == 0) & (F.size("found") > 0)
    named = F.struct(versioned.alias("versioned"), F.col("match_percent"), (-F.col("o")).alias("first"), F.col("license_name"), F.col("o"))
    by = m.groupBy(key).agg(
        F.min("rank").alias("rank"), F.max(F.when(F.col("rank") == 0, named)).alias("all"), F.max(F.when(F.col("rank") == 2, named)).alias("none"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("rank") == 1, F.struct("o", "license_name", "match_percent", "found"))))).alias("common"),
    )
    zero = F.expr("named_struct('best', cast(array() as array<struct<o:bigint,license_name:string,match_percent:double>>), 'claimed', cast(array() as array<string>))")

    def step(s: Column, x: Column) -> Column:
        free = F.array_except(F.transform(x["found"], lambda v: F.coalesce(v, F.lit(""))), s["claimed"])
        new = F.struct(
            F.concat(s["best"], F.array(F.struct(x["o"].cast("bigint").alias("o"), x["license_name"].alias("license_name"), x["match_percent"].alias("match_percent")))).alias("best"),
            F.concat(s["claimed"], F.slice(free, 1, 1)).alias("claimed"),
        )
        return F.when(F.size(free) > 0, new).otherwise(s)

    best = F.aggregate("common", zero, step)["best"]
    won = by.select(key, "rank", F.when(F.col("rank") == 0, F.col("all")).when(F.col("rank") == 2, F.col("none")).alias("w"), best.alias("best"))
    last = F.element_at("best", -1)
    return won.select(
        key, F.when(F.col("rank") == 1, F.transform("best", lambda x: x["license_name"])).otherwise(F.array("w.license_name")).alias("selected"),
        F.element_at(F.array(F.lit("ALL"), F.lit("COMMON"), F.lit("NONE")), F.col("rank") + 1).alias("match_class"),
        F.when(F.col("rank") == 1, last["o"]).otherwise(F.col("w.o").cast("bigint")).alias("winner_order"),
        F.when(F.col("rank") == 1, last["license_name"]).otherwise(F.col("w.license_name")).alias("license_name"),
        F.when(F.col("rank") == 1, last["match_percent"]).otherwise(F.col("w.match_percent")).alias("match_percent"),
    )


def version_groups(matches: DataFrame, key: str = "path") -> DataFrame:
    """(key, version, matches): a key's matches by the versions they found; a match counts once for each."""
    return matches.select(key, F.explode(F.array_distinct("found_versions")).alias("version")).groupBy(key, "version").agg(F.count("*").alias("matches"))


def resolve_in_order(matches: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """(key, license_name, match_percent): the older rule, one fold over a key's matches in order.

    `equal` says that a match was taken whose versions, as lists, are the expected ones or that expects none. An equal match is
    taken if its percent is above that of the equal ones so far; another, as long as none was equal, if its percent is above the best
    so far; and one that expects no versions and was not taken by that, as if it were equal. Null percents count as 0, null
    lists as empty. Keys of which no match is taken are left out.
    """
    none = F.array().cast("array<string>")
    expected, found = F.coalesce("expected_versions", none), F.coalesce("found_versions", none)
    item = F.struct(F.col(order).cast("bigint").alias("o"), (expected == found).alias("same"), (F.size(expected) == 0).alias("free"), F.coalesce("match_percent", F.lit(0.0)).alias("p"), F.col("license_name").alias("name"))
    by = matches.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l"))
    zero = F.expr("named_struct('best', 0D, 'equal_best', 0D, 'equal', false, 'name', cast(null as string), 'p', cast(null as double))")

    def step(s: Column, x: Column) -> Column:
        def taken(equal: bool) -> Column:
            return F.struct(x["p"].alias("best"), (x["p"] if equal else s["equal_best"]).alias("equal_best"), (F.lit(True) if equal else s["equal"]).alias("equal"), x["name"].alias("name"), x["p"].alias("p"))

        as_equal = F.when(x["p"] > s["equal_best"], taken(True)).otherwise(s)
        loose = ~s["equal"] & (x["p"] > s["best"])
        return F.when(x["same"], as_equal).when(loose, taken(False)).when(x["free"], as_equal).otherwise(s)

    return by.select(key, F.aggregate("l", zero, step).alias("r")).where("r.name is not null").select(key, F.col("r.name").alias("license_name"), F.col("r.p").alias("match_percent"))

