"""The queries of the library's core and the SQL they are held against, over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import grams
from corpusweave.functions import text as T
from corpusweave.operators import files as table_ops
from corpusweave.operators import search, snapshots
from corpusweave.plans import assess
from corpusweave.runtime import scratch, spread, table
from corpusweave.sinks import reports
from corpusweave.sources import archives, scan, terms
from corpusweave.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- the two snapshots

_LATEST = r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY recorded_at DESC, file_hash DESC NULLS LAST, licenses DESC NULLS LAST, t DESC NULLS LAST) rn
FROM (SELECT repo_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') file_path, file_hash, licenses, file_content_is_text t, recorded_at FROM {table})) WHERE rn = 1"""


@query(f"""
WITH p AS ({_LATEST.format(table="snapshot_primary")}), m AS ({_LATEST.format(table="snapshot_mirror")}),
j AS (SELECT coalesce(p.repo_id, m.repo_id) repo_id, coalesce(p.file_path, m.file_path) file_path, p.rn pr, m.rn mr,
  lower(p.file_hash) IS DISTINCT FROM lower(m.file_hash) dh, p.t IS DISTINCT FROM m.t dt,
  list_sort(list_distinct(coalesce(p.licenses, []))) IS DISTINCT FROM list_sort(list_distinct(coalesce(m.licenses, []))) dl
  FROM p FULL JOIN m ON p.repo_id = m.repo_id AND p.file_path = m.file_path)
SELECT repo_id, file_path, 'missing_in_mirror' difference FROM j WHERE mr IS NULL
UNION ALL SELECT repo_id, file_path, 'missing_in_primary' FROM j WHERE pr IS NULL
UNION ALL SELECT repo_id, file_path, 'file_hash' FROM j WHERE pr = 1 AND mr = 1 AND dh
UNION ALL SELECT repo_id, file_path, 'licenses' FROM j WHERE pr = 1 AND mr = 1 AND dl
UNION ALL SELECT repo_id, file_path, 'file_content_is_text' FROM j WHERE pr = 1 AND mr = 1 AND dt""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_differences(table(spark, d, "snapshot_primary"), table(spark, d, "snapshot_mirror"))


def _hash_diff(a: str, b: str) -> str:
    return f"""SELECT repo_id, file_path, file_hash, recorded_at FROM {a} n WHERE coalesce(file_hash, '') = ''
OR NOT EXISTS (SELECT 1 FROM {b} o WHERE lower(o.file_hash) = lower(n.file_hash) AND o.file_hash <> '')"""


_STATE = ["repo_id", "file_path", "file_hash", "recorded_at"]


@query(_hash_diff("snapshot_primary", "snapshot_mirror"))
def new_or_changed(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.new_or_changed(table(spark, d, "snapshot_mirror"), table(spark, d, "snapshot_primary")).select(_STATE)


@query(_hash_diff("snapshot_mirror", "snapshot_primary"))
def removed_files(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.removed(table(spark, d, "snapshot_mirror"), table(spark, d, "snapshot_primary")).select(_STATE)


# ---- text functions

_STRIP = r"""replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, '\&.', '.'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'),
 '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '[!-/:-@\[-`{{-~]', '', 'g'), chr(57344), '.')"""


@query(f"SELECT doc_id, {_STRIP.format(c='text')} AS stripped FROM documents")
def strip_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.strip_punctuation(F.col("text")).alias("stripped"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F]+', ' ', 'g'), '(\\x[0-9A-Fa-f]{2})+', ' ', 'g') AS cleaned FROM documents")
def clean_control(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_control(F.col("text")).alias("cleaned"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_fold(text: str) -> str:
    """NFKC without marks, case folded beyond ASCII. Both maps are the character database's, as text."""
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]

    def each(text: str, table: dict[str, str]) -> str:
        table = f"map([{', '.join(map(_quoted, table))}], [{', '.join(map(_quoted, table.values()))}])"
        return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE coalesce({table}[c], c) END), '')"

    apart = {c: k for c in every if (k := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)}
    folds = {c: c.casefold() for c in every if c.casefold() != c}
    return each(f"regexp_replace(nfc_normalize({each(text, apart)}), '\\pM', '', 'g')", folds)


def _sql_normalized(text: str) -> str:
    small = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    folded = f"CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN {_sql_fold(text)} ELSE {text} END"
    return f"SELECT doc_id, coalesce(trim(regexp_replace({small.format(folded)}, '[\\s\\x1c-\\x1f\\x{{85}}\\pZ]+', ' ', 'g')), '') AS normalized FROM documents"


_DIGIT = "[\\p{Nd}" + "".join(chr(c) for c in range(0x80, 0x30000) if chr(c).isdigit() and not chr(c).isdecimal()) + "]"


@query(_sql_normalized(_STRIP.format(c="text").replace("[0-9]", _DIGIT)))
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(_sql_normalized("text"))
def normalize_for_compare(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.normalize_for_compare(F.col("text")).alias("normalized"))


@query(f"SELECT pattern_id, trim(regexp_replace(lower({_STRIP.format(c='raw_text')}), '\\s+', ' ', 'g')) AS normalized FROM patterns")
def normalize_patterns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patterns").select("pattern_id", T.normalize(F.col("raw_text")).alias("normalized"))


_BASE = r"regexp_extract(file_path, '([^/]*)/*$', 1)"


@query(rf"""SELECT file_id, CASE WHEN regexp_extract(lower({_BASE}), '^\.*[^.].*?(\.[^.]*)$', 1) <> '' THEN regexp_extract(lower({_BASE}), '^\.*[^.].*?(\.[^.]*)$', 1)
ELSE lower({_BASE}) END AS extension FROM files""")
def file_extension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", T.file_extension(F.col("file_path")).alias("extension"))


@query(r"""SELECT pattern_id, split_part(regexp_replace(regexp_extract(source_path, '([^/\\]*)$', 1), '\.[^.]*$', ''), '_', 1) AS name FROM patterns""")
def licence_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patterns").select("pattern_id", T.licence_name(F.col("source_path")).alias("name"))


@query(r"SELECT pattern_id, array_to_string(regexp_extract_all(license_name, '\d+(\.\d+)?'), ',') AS versions FROM patterns")
def versions_of_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patterns").select("pattern_id", F.array_join(T.versions_of_name(F.col("license_name")), ",").alias("versions"))


_FOUND = r"regexp_extract_all({c}, '(?i)(?:\bversion\s+|\bv\.?\s*|\blicense\s+)(\d+(?:\.\d+)?)', 1)"
_DISTINCT = f"list_filter({_FOUND}, lambda x, i: list_position({_FOUND}, x) = i)"
_WHOLE = f"list_transform({_DISTINCT}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN regexp_replace(x, '^0+([0-9])', '\\1') || '.0' ELSE x END)"


@query(f"SELECT file_id, array_to_string({_WHOLE.format(c='file_content_normalized')}, ',') AS versions FROM files WHERE file_content_normalized IS NOT NULL")
def found_versions(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("file_content_normalized")
    return table(spark, d, "files").where(text.isNotNull()).select("file_id", F.array_join(T.whole_numbers(T.versions_in_text(text)), ",").alias("versions"))


@query(f"SELECT match_id, nullif({_FOUND.format(c='matched_substring')}[1], '') AS version FROM match_results")
def first_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_results").select("match_id", T.first_version(F.col("matched_substring")).alias("version"))


@query(r"""SELECT file_id, '=HYPERLINK("file:///' || replace(file_path, '\', '/') || '", "' || regexp_extract(replace(file_path, '\', '/'), '([^/]*)/*$', 1) || '")' AS link,
CASE WHEN starts_with(file_path, 'src/') THEN substr(file_path, 5) ELSE file_path END AS inside FROM files""")
def report_links(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    return table(spark, d, "files").select("file_id", T.hyperlink(path).alias("link"), T.relative(path, "src").alias("inside"))


# ---- tokens and anchors


@query("""WITH t AS (SELECT file_id, unnest(string_split(file_content_normalized, ' ')) AS word, generate_subscripts(string_split(file_content_normalized, ' '), 1) - 1 AS pos
  FROM files WHERE file_content_normalized <> '')
SELECT file_id, pos, word, lower(word) AS norm, s AS start_char, s + length(word) AS end_char FROM (
  SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM t)""")
def tokenize_spans(spark: SparkSession, d: str) -> DataFrame:
    return grams.with_spans(spread(table(spark, d, "files").select("file_id", "file_content_normalized")), "file_content_normalized", ["file_id"])


_GRAMS = "SELECT {k}, i - 1 AS pos, array_to_string({w}[i:i + 3], ' ') AS gram FROM (SELECT {k}, {w}, unnest(range(1, len({w}) - 2)) AS i FROM {t} WHERE len({w}) >= 4)"


@query(f"SELECT file_id, gram, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ({_GRAMS.format(k='file_id', w='tokens', t='file_index')}) GROUP BY ALL")
def anchor_index(spark: SparkSession, d: str) -> DataFrame:
    index = grams.anchor_index(spread(table(spark, d, "file_index").select("file_id", "tokens")), "tokens", ["file_id"])
    return index.select("file_id", "gram", F.array_join(index["positions"].cast("array<string>"), ",").alias("positions"))


# ---- hashes, duplicates, table maintenance


@query("SELECT file_id, sha256(file_content) AS sha256, md5(file_content) AS md5 FROM files")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("file_content")
    return table(spark, d, "files").select("file_id", T.digest(content).alias("sha256"), T.digest(content, "md5").alias("md5"))


@query("SELECT sha256(file_content) AS digest, count(*) AS copies, min(file_id) AS first_id FROM files WHERE file_content IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.duplicates(table(spark, d, "files"))


def _latest(files: DataFrame) -> DataFrame:
    return table_ops.upsert(files, ["repo_id", "file_path"], "scanned_at", "file_id")


@query("SELECT repo_id, file_path, file_id, scanned_at FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY scanned_at DESC, file_id DESC) = 1")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    return _latest(table(spark, d, "files").select("repo_id", "file_path", "file_id", "scanned_at"))


@query("SELECT file_id, file_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM match_results m WHERE m.file_id = f.file_id)")
def remove_matched(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.remove(table(spark, d, "files").select("file_id", "file_path"), table(spark, d, "match_results"), ["file_id"])


@query("SELECT f.* EXCLUDE (license_names, file_content, file_content_normalized) FROM files f WHERE file_path IN (SELECT file_path FROM snapshot_primary)")
def file_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").drop("license_names", "file_content", "file_content_normalized")
    return table_ops.lookup(rows, table(spark, d, "snapshot_primary"), ["file_path"])


_IGNORED = r"contains(replace(file_path, '\', '/'), 'src/test')"


@query(f"SELECT file_id, NOT {_IGNORED} AS is_released FROM files")
def release_status(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.release_status(table(spark, d, "files").select("file_id", "file_path")).select("file_id", "is_released")


@query(f"SELECT count(*) AS total_files, count(*) FILTER (NOT {_IGNORED}) AS released_files FROM files")
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.scan_counts(table(spark, d, "files"))


def _digests(order: str, where: str = "file_path IS NOT NULL") -> str:
    return f"""SELECT repo_id AS folder, sha256(string_agg(concat(file_path, chr(0), coalesce(file_content, '')), '' ORDER BY {order}, sha256(coalesce(file_content, '')))) AS digest
FROM files WHERE repo_id IS NOT NULL AND {where} GROUP BY 1"""


@query(_digests("file_path"))
def folder_digest(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.folder_digests(table(spark, d, "files"), "repo_id", "file_path", "file_content")


@query(_digests("list_transform(string_split(file_path, '/'), lambda p, i: CASE WHEN i = len(string_split(file_path, '/')) THEN '0' ELSE '1' END || p)"))
def folder_digest_by_level(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.folder_digests(table(spark, d, "files"), "repo_id", "file_path", "file_content", by_level=True)


@query(_digests("file_path", "file_path IS NOT NULL AND NOT starts_with(file_path, 'docs/') AND NOT starts_with(file_path, 'src/test/')"))
def folder_digest_excluding(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.folder_digests(table_ops.exclude(table(spark, d, "files"), "file_path", ["docs", "src/test"]), "repo_id", "file_path", "file_content")


_PART = "sum(('0x' || substr(one, {at}, 15))::HUGEINT)::VARCHAR"


@query(f"""SELECT folder, count(*) AS files, sha256(concat_ws('|', count(*)::VARCHAR, {", ".join(_PART.format(at=1 + 15 * k) for k in range(4))})) AS fingerprint
FROM (SELECT repo_id AS folder, sha256(concat(file_path, chr(0), sha256(coalesce(file_content, '')))) AS one FROM files WHERE repo_id IS NOT NULL AND file_path IS NOT NULL) GROUP BY 1""")
def folder_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table_ops.folder_fingerprints(table(spark, d, "files"), "repo_id", "file_path", "file_content")


# ---- archives: every path as it is and with the endings of archives

_ENDINGS = ["", ".tar.gz", ".TGZ", ".tar.xz", ".zip", ".jar", ".gz", ".txt.gz", ".bz2", ".lzma", ".war", "/sha256/0123456789abcdef0123456789ABCDEF"]
_PATHS = f"(SELECT file_id, file_path || e AS path FROM files, unnest([{', '.join(repr(e) for e in _ENDINGS)}]) AS u(e))"
_COMPOUND = r"'(\.tar\.gz|\.tgz|\.tar\.bz2|\.tbz2|\.tar\.xz|\.txz)$'"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", F.explode(F.array(*[F.concat("file_path", F.lit(e)) for e in _ENDINGS])).alias("path"))


@query(rf"""SELECT file_id, path, CASE WHEN regexp_matches(lower(path), {_COMPOUND}) OR regexp_matches(lower(path), '[^/]\.(zip|tar|jar)$')
  OR regexp_matches(lower(path), '(^|/)[^./][^./]*\.gz$') OR regexp_matches(lower(path), '(^|/)sha256/(.*/)?[0-9a-f]{{32,128}}$') THEN 'multi'
  WHEN regexp_matches(lower(path), '[^/]\.(bz2|xz|lzma|gz)$') THEN 'single' ELSE 'none' END AS kind FROM {_PATHS}""")
def archive_classify(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).withColumn("kind", archives.classify(F.col("path")))


@query(rf"""SELECT file_id, path, CASE WHEN regexp_matches(path, '(?i)' || {_COMPOUND}) THEN regexp_replace(path, '(?i)' || {_COMPOUND}, '')
  ELSE regexp_replace(path, '([^/])\.[^./]*$', '\1') END AS root FROM {_PATHS}""")
def archive_root(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).withColumn("root", archives.without_suffix(F.col("path")))


# ---- downloaded licence lists, made of the patterns


@query("SELECT source_path AS license_id, license_title AS name, 'https://licences.test/' || pattern_id AS details_url FROM patterns WHERE source_path <> '' AND pattern_kind = 'full'")
def licence_list(spark: SparkSession, d: str) -> DataFrame:
    """A list as one JSON document, where headers are entries that are deprecated."""
    entry = F.struct(F.col("source_path").alias("licenseId"), F.col("license_title").alias("name"), F.concat(F.lit("https://licences.test/"), F.col("pattern_id").cast("string")).alias("detailsUrl"), (F.col("pattern_kind") != "full").alias("isDeprecatedLicenseId"))
    root = scratch(spark, "list")
    table(spark, d, "patterns").agg(F.to_json(F.struct(F.collect_list(entry).alias("licenses"))).alias("value")).write.text(root)  # a fixed collection
    return scan.licence_list(spark, root)


@query("""SELECT license_name || '/' || pattern_id AS license_id, license_name || '_' || pattern_id || '.txt' AS file_name, trim(regexp_replace(lower(raw_text), '\\s+', ' ', 'g')) AS license_text,
CASE WHEN pattern_kind = 'header' THEN raw_text ELSE source_path END AS header FROM patterns""")
def licence_texts(spark: SparkSession, d: str) -> DataFrame:
    """Details as a JSON document each; those without a header have its template."""
    name = F.concat("license_name", F.lit("/"), F.col("pattern_id").cast("string"))
    header = F.when(F.col("pattern_kind") == "header", F.col("raw_text")).otherwise("")
    detail = F.to_json(F.struct(name.alias("licenseId"), F.col("raw_text").alias("licenseText"), header.alias("standardLicenseHeader"), F.col("source_path").alias("standardLicenseHeaderTemplate")))
    root = scratch(spark, "details")
    scan.write_tree(table(spark, d, "patterns").select(F.concat(F.col("pattern_id").cast("string"), F.lit(".json")).alias("path"), F.encode(detail, "UTF-8").alias("content")), root)
    return scan.licence_texts(spark, root)


# ---- searches


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "files").select(F.col("file_id").alias("path"), F.col("file_content_normalized").alias("text")))


def _patterns(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    p = table(spark, d, "patterns")
    p = p.where(F.col("pattern_kind") == kind) if kind else p
    return p.select(F.col("pattern_id").alias("seq"), F.col("license_name").alias("name"), "text")


@query("""SELECT file_id AS path, pattern_id AS seq, license_name AS name FROM files f JOIN patterns p ON contains(f.file_content_normalized, p.text) AND p.text <> ''""")
def full_license_search(spark: SparkSession, d: str) -> DataFrame:
    return search.contained(_texts(spark, d), _patterns(spark, d))


@query("""SELECT f.file_id AS path, coalesce(string_agg(p.license_name, ',' ORDER BY p.pattern_id), '') AS names, CASE WHEN count(p.pattern_id) > 0 THEN 'EXACT' END AS license_match_strength,
count(p.pattern_id) > 0 AS has_full_license FROM files f LEFT JOIN patterns p ON contains(f.file_content_normalized, p.text) GROUP BY 1""")
def full_license_matches(spark: SparkSession, d: str) -> DataFrame:
    m = search.full_matches(_texts(spark, d), _patterns(spark, d))
    return m.select("path", F.array_join("license_names", ",").alias("names"), "license_match_strength", "has_full_license")


def _sql_terms(table: dict[str, list[str]] = terms.TERMS) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(c)}, {i}, {j}, {quoted(t)})" for i, (c, ts) in enumerate(table.items()) for j, t in enumerate(ts))
    norm = f"trim(regexp_replace(lower({_STRIP.format(c='term')}), '\\s+', ' ', 'g'))"
    return f"(SELECT category, min(cat_ord) cat_ord, min(term_ord) term_ord, {norm} norm FROM (VALUES {rows}) v(category, cat_ord, term_ord, term) GROUP BY category, norm)"


@query(f"""SELECT file_id AS path, category, cat_ord, norm, term_ord FROM files JOIN {_sql_terms()} t ON contains(' ' || file_content_normalized || ' ', ' ' || norm || ' ')""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keywords(_texts(spark, d), terms.frame(spark))


@query(f"""SELECT file_id AS path, category, norm FROM files JOIN {_sql_terms(terms.PHRASES)} t ON contains(' ' || file_content_normalized || ' ', ' ' || norm || ' ')""")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keywords(_texts(spark, d), terms.frame(spark, terms.PHRASES)).select("path", "category", "norm")


@query(f"SELECT category, cat_ord, term_ord, norm FROM {_sql_terms()} t WHERE norm <> ''")
def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    return search.distinct_terms(terms.frame(spark))


@query(f"""SELECT path, string_agg(category || '=' || found, ';' ORDER BY cat_ord) AS matches FROM (
SELECT file_id AS path, category, cat_ord, string_agg(norm, '|' ORDER BY term_ord) AS found FROM files JOIN {_sql_terms()} t ON contains(' ' || file_content_normalized || ' ', ' ' || norm || ' ') GROUP BY ALL) GROUP BY 1""")
def keyword_summary(spark: SparkSession, d: str) -> DataFrame:
    m = search.keyword_map(_texts(spark, d), terms.frame(spark))
    entries = F.transform(F.map_entries("keyword_matches"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return m.select("path", F.array_join(entries, ";").alias("matches"))


@query(f"""WITH hit AS MATERIALIZED (SELECT file_id AS path, category, norm, file_content_normalized AS text FROM files JOIN {_sql_terms()} t ON contains(file_content_normalized, norm))
SELECT DISTINCT path, category, norm FROM hit WHERE regexp_matches(text, '(^|[^\\pL\\pN])' || regexp_escape(norm) || '([^\\pL\\pN]|$)')""")
def keyword_standalone(spark: SparkSession, d: str) -> DataFrame:
    return search.standalone_keywords(_texts(spark, d), terms.frame(spark))


def _sql_heads(where: str = "true") -> str:
    """CTEs f, p (words of files and patterns) and heads (file_id, pattern_id, i, j)."""
    return f"""f AS (SELECT file_id, string_split(file_content_normalized, ' ') w FROM files WHERE file_content_normalized <> ''),
p AS (SELECT pattern_id, license_name, string_split(text, ' ') w FROM patterns WHERE {where}),
fg AS ({_GRAMS.format(k="file_id", w="w", t="f")}), pg AS ({_GRAMS.format(k="pattern_id", w="w", t="p")}),
h AS (SELECT file_id, pattern_id, fg.pos i, pg.pos j FROM fg JOIN pg USING (gram)),
heads AS (SELECT h.file_id, h.pattern_id, i, j FROM h JOIN f USING (file_id) JOIN p USING (pattern_id)
WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.file_id = h.file_id AND b.pattern_id = h.pattern_id AND b.i = h.i - 1 AND b.j = h.j - 1) AND 2 * least(len(f.w) - i, len(p.w) - j) > len(p.w))"""


@query(f"WITH {_sql_heads()} SELECT file_id AS path, pattern_id AS seq, i, j FROM heads")
def anchor_candidates(spark: SparkSession, d: str) -> DataFrame:
    return search.anchor_candidates(_texts(spark, d), _patterns(spark, d))


_STEP = """SELECT *, CASE WHEN a = b THEN 0 ELSE coalesce(list_position(fw[x + 2:x + 6], b), 0) END df, CASE WHEN a = b THEN 0 ELSE coalesce(list_position(pw[y + 2:y + 6], a), 0) END dp
FROM (SELECT s.*, f.w fw, p.w pw, f.w[x + 1] a, p.w[y + 1] b FROM s JOIN f USING (file_id) JOIN p USING (pattern_id) WHERE x < len(f.w) AND y < len(p.w))"""


def _sql_fuzzy() -> str:
    """CTEs up to r: the best alignment of each file and header above half, versions as lists."""
    return f"""WITH RECURSIVE {_sql_heads("pattern_kind = 'header'")},
s AS (SELECT file_id, pattern_id, i, j, i + 4 AS x, j + 4 AS y, 4::BIGINT AS m, i + 3 AS last FROM heads
  UNION ALL SELECT file_id, pattern_id, i, j, CASE WHEN a = b THEN x + 1 WHEN df > 0 AND (dp = 0 OR df <= dp) THEN x + df WHEN dp > 0 THEN x ELSE x + 1 END,
  CASE WHEN a = b THEN y + 1 WHEN df > 0 AND (dp = 0 OR df <= dp) THEN y WHEN dp > 0 THEN y + dp ELSE y + 1 END,
  CASE WHEN a = b THEN m + 1 ELSE m END, CASE WHEN a = b THEN x ELSE last END FROM ({_STEP})),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file_id, pattern_id ORDER BY m DESC, i, j, x DESC, y DESC) = 1),
b AS (SELECT file_id AS path, pattern_id AS seq, license_name, m / len(p.w) * 100.0 AS match_percent, i::INT AS start_index, last::INT AS end_index, array_to_string(f.w[i + 1:last + 1], ' ') AS matched_substring
  FROM best JOIN f USING (file_id) JOIN p USING (pattern_id) WHERE m / len(p.w) * 100.0 > 50),
r AS (SELECT *, regexp_extract_all(license_name, '\\d+(\\.\\d+)?') AS expected_versions, {_WHOLE.format(c="matched_substring")} AS found_versions FROM b)"""


@query(f"{_sql_fuzzy()} SELECT * REPLACE (array_to_string(expected_versions, ',') AS expected_versions, array_to_string(found_versions, ',') AS found_versions) FROM r")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    m = search.fuzzy(_texts(spark, d), _patterns(spark, d, "header"))
    return m.withColumns({c: F.array_join(c, ",") for c in ("expected_versions", "found_versions")})


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_results").dropDuplicates(["match_id"]).select(F.col("file_id").alias("path"), F.col("match_id").alias("seq"), "license_name", "match_percent", "matched_substring", "expected_versions", "found_versions")


_CLASS = "CASE WHEN list_sort(coalesce(expected_versions, [])) = list_sort(coalesce(found_versions, [])) THEN 'ALL' WHEN list_has_any(coalesce(expected_versions, []), coalesce(found_versions, [])) THEN 'COMMON' ELSE 'NONE' END"
_MATCHES = "(SELECT DISTINCT ON (match_id) file_id AS path, match_id AS seq, license_name, match_percent, matched_substring, expected_versions, found_versions FROM match_results)"


@query(f"SELECT path, seq, {_CLASS} AS match_class FROM {_MATCHES}")
def version_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("path", "seq", search.agreement(F.col("expected_versions"), F.col("found_versions")).alias("match_class"))


def _sql_resolve(matches: str) -> str:
    """(path, selected list, match_class, winner_order, license_name, match_percent) of matches."""
    return f"""WITH m AS (SELECT path, seq, license_name, coalesce(match_percent, 0.0) p, coalesce(found_versions, []) found, {_CLASS} c FROM {matches}),
b AS (SELECT path, min(CASE c WHEN 'ALL' THEN 0 WHEN 'COMMON' THEN 1 ELSE 2 END) r FROM m GROUP BY 1),
u AS (SELECT m.* FROM m JOIN b USING (path) WHERE CASE c WHEN 'ALL' THEN 0 WHEN 'COMMON' THEN 1 ELSE 2 END = r),
one AS (SELECT * FROM u WHERE c <> 'COMMON' QUALIFY row_number() OVER (PARTITION BY path ORDER BY (c = 'ALL' AND len(found) > 0) DESC, p DESC, seq) = 1),
l AS (SELECT path, list(struct_pack(o := seq, n := license_name, p := p, f := found) ORDER BY seq) l FROM u WHERE c = 'COMMON' GROUP BY 1),
fold AS (SELECT path, list_reduce(list_transform(l, lambda x: struct_pack(best := [x], claimed := x.f)), lambda a, x: CASE
  WHEN len(list_filter(x.claimed, lambda v: NOT list_contains(a.claimed, v))) > 0
  THEN struct_pack(best := list_concat(a.best, x.best), claimed := list_append(a.claimed, list_filter(x.claimed, lambda v: NOT list_contains(a.claimed, v))[1])) ELSE a END,
  struct_pack(best := l[1:0], claimed := l[1].f[1:0])) s FROM l)
SELECT path, [license_name] AS selected, c AS match_class, seq AS winner_order, license_name, p AS match_percent FROM one
UNION ALL SELECT path, list_transform(s.best, lambda x: x.n), 'COMMON', s.best[-1].o, s.best[-1].n, s.best[-1].p FROM fold"""


@query(f"SELECT * REPLACE (array_to_string(selected, ',') AS selected) FROM ({_sql_resolve(_MATCHES)})")
def resolve_best(spark: SparkSession, d: str) -> DataFrame:
    return search.resolve(_matches(spark, d)).withColumn("selected", F.array_join("selected", ","))


@query(f"""WITH l AS (SELECT path, list(struct_pack(o := seq, same := coalesce(expected_versions, []) = coalesce(found_versions, []), free := len(coalesce(expected_versions, [])) = 0,
  p := coalesce(match_percent, 0.0), n := license_name) ORDER BY seq) l FROM {_MATCHES} GROUP BY 1),
f AS (SELECT path, list_reduce(list_transform(l, lambda x: struct_pack(p := x.p, same := x.same, free := x.free, n := x.n, best := 0.0::DOUBLE, equal_best := 0.0::DOUBLE, eq := false)), lambda s, x: CASE
  WHEN x.same OR (NOT (NOT s.eq AND x.p > s.best) AND x.free) THEN CASE WHEN x.p > s.equal_best THEN struct_pack(p := x.p, same := x.same, free := x.free, n := x.n, best := x.p, equal_best := x.p, eq := true) ELSE s END
  WHEN NOT s.eq AND x.p > s.best THEN struct_pack(p := x.p, same := x.same, free := x.free, n := x.n, best := x.p, equal_best := s.equal_best, eq := s.eq) ELSE s END,
  struct_pack(p := 0.0::DOUBLE, same := false, free := false, n := NULL::VARCHAR, best := 0.0::DOUBLE, equal_best := 0.0::DOUBLE, eq := false)) s FROM l)
SELECT path, s.n AS license_name, s.p AS match_percent FROM f WHERE s.n IS NOT NULL""")
def resolve_in_order(spark: SparkSession, d: str) -> DataFrame:
    return search.resolve_in_order(_matches(spark, d))


@query("SELECT path, version, count(*) AS matches FROM (SELECT file_id AS path, unnest(list_distinct(found_versions)) AS version FROM (SELECT DISTINCT ON (match_id) * FROM match_results)) GROUP BY ALL")
def found_version_groups(spark: SparkSession, d: str) -> DataFrame:
    return search.version_groups(_matches(spark, d))


# ---- reports


@query(f"""SELECT path, license_name, printf('%.2f', coalesce(match_percent, 0.0)) AS percent, array_to_string(coalesce(expected_versions, []), ', ') AS expected, array_to_string(coalesce(found_versions, []), ', ') AS found,
list_sort(coalesce(expected_versions, [])) <> list_sort(coalesce(found_versions, [])) AS version_mismatch, matched_substring FROM {_MATCHES}""")
def fuzzy_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.fuzzy_report(_matches(spark, d))


@query("SELECT file_path FROM files WHERE file_is_empty")
def empty_files(spark: SparkSession, d: str) -> DataFrame:
    return reports.empty_files(table(spark, d, "files"))


@query("SELECT file_path, array_to_string(license_names, ',') AS names FROM files WHERE has_full_license")
def full_licence_files(spark: SparkSession, d: str) -> DataFrame:
    return reports.full_licence_files(table(spark, d, "files")).select("file_path", F.array_join("license_names", ",").alias("names"))


@query("""SELECT count(*) AS files, count(*) FILTER (is_released) AS released, count(*) FILTER (file_is_empty) AS empty, count(*) FILTER (has_full_license) AS with_full_license FROM files""")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals(table(spark, d, "files"))


_JSON = """'["' || array_to_string({c}, '","') || '"]'"""


@query(f"""WITH fz AS MATERIALIZED ({_sql_fuzzy()} SELECT * FROM r), best AS ({_sql_resolve("fz")}),
exact AS (SELECT file_id, list(p.license_name ORDER BY p.pattern_id) AS names FROM files f JOIN patterns p ON contains(f.file_content_normalized, p.text) AND p.pattern_kind = 'full' GROUP BY 1),
kw AS (SELECT path, '{{' || string_agg('"' || category || '":' || found, ',' ORDER BY cat_ord) || '}}' AS words FROM (
  SELECT file_id AS path, category, cat_ord, {_JSON.format(c="list(norm ORDER BY term_ord)")} AS found FROM files JOIN {_sql_terms()} t ON contains(' ' || file_content_normalized || ' ', ' ' || norm || ' ') GROUP BY ALL) GROUP BY 1)
SELECT '=HYPERLINK("file:///' || replace(file_path, '\\', '/') || '", "' || regexp_extract(replace(file_path, '\\', '/'), '([^/]*)/*$', 1) || '")' AS "File Name",
CASE WHEN e.names IS NULL AND b.selected IS NULL THEN '[]' ELSE {_JSON.format(c="list_concat(coalesce(e.names, []), coalesce(b.selected, []))")} END AS "Licenses", b.match_percent AS "Match %", e.names IS NOT NULL AS "Full License",
file_is_empty AS "Is Empty", kw.words AS "Keywords", file_hash AS "Hash" FROM files f LEFT JOIN exact e USING (file_id) LEFT JOIN best b ON b.path = f.file_id LEFT JOIN kw ON kw.path = f.file_id""")
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole assessment of the table: three searches, resolution, report."""
    files = spread(table(spark, d, "files").select("file_id", "file_path", "file_is_empty", "file_hash", F.col("file_content_normalized").alias("text")))
    out, _ = assess.assess_table(files, _patterns(spark, d, "full"), _patterns(spark, d, "header"), terms.frame(spark), key="file_id")
    return reports.csv_rows(out)


@query("SELECT file_path, file_hash, coalesce(license_names, []) AS licenses, coalesce(file_content, '') AS content, file_content_is_text FROM files")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot that a run leaves, as JSON lines, read as the next run reads it."""
    at = scratch(spark, "snapshot", ".json")
    reports.write_snapshot(spread(table(spark, d, "files")), at, kind="json")
    return scan.read_snapshot(spark, at).select("file_path", "file_hash", "licenses", F.decode(T.decompress_b64(F.col("file_content_b64")), "UTF-8").alias("content"), "file_content_is_text")


# ---- sources: the tables' rows as trees and archives in the shared folder, read back

_AT = r"'r' || coalesce(repo_id, 0) || '/' || file_id || '-' || regexp_extract(file_path, '([^/\\]*)$', 1)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of every row of files, at a path of its own."""
    at = F.concat(F.lit("r"), F.coalesce("repo_id", F.lit(0)).cast("string"), F.lit("/"), F.col("file_id").cast("string"), F.lit("-"), F.regexp_extract("file_path", r"([^/\\]*)$", 1))
    return spread(table(spark, d, "files").select(at.alias("path"), F.encode(F.coalesce("file_content", F.lit("")), "UTF-8").alias("content")))


@query(rf"""WITH t AS (SELECT {_AT} AS file_path, coalesce(file_content, '') AS content FROM files)
SELECT file_path, content AS file_content, CASE WHEN regexp_extract(lower(b), '^\.*[^.].*?(\.[^.]*)$', 1) <> '' THEN regexp_extract(lower(b), '^\.*[^.].*?(\.[^.]*)$', 1) ELSE lower(b) END AS file_extension,
sha256(content) AS file_hash, content = '' AS file_is_empty, true AS file_content_is_text, NOT contains(file_path, 'r1/') AS is_released FROM (SELECT *, regexp_extract(file_path, '([^/]*)$', 1) AS b FROM t)""")
def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files written as a tree, walked, read, hashed and decoded; one folder is not released."""
    root = scratch(spark, "tree")
    scan.write_tree(_tree(spark, d), root)
    rows = scan.file_rows(scan.read_tree(spark, root, archives=False), ignored=("r1/",))
    return rows.select("file_path", "file_content", "file_extension", "file_hash", "file_is_empty", "file_content_is_text", "is_released")


@query(rf"SELECT 'a' || file_id || '/in/' || {_AT} AS path, sha256(coalesce(file_content, '')) AS digest, regexp_matches(lower(file_path), '[^/]\.(zip|tar|jar|tgz|tbz2|txz|gz|bz2|xz|lzma)$') AS failed FROM files")
def archive_unpack(spark: SparkSession, d: str) -> DataFrame:
    """Each file in a zip in a compressed tar, found by unpacking to any depth; what has an archive's name and is none stays a file."""
    packed = archives.packed(_tree(spark, d).withColumn("archive", F.concat(F.lit("a"), F.regexp_extract("path", "/([0-9]+)-", 1))))
    return archives.expand_rows(packed).select("path", F.sha2("content", 256).alias("digest"), F.col("extract_error").isNotNull().alias("failed"))


@query(f"SELECT license_name AS name, trim(regexp_replace(lower({_STRIP.format(c='raw_text')}), '\\s+', ' ', 'g')) AS text FROM patterns WHERE pattern_kind = 'header'")
def pattern_folder(spark: SparkSession, d: str) -> DataFrame:
    """The headers as a folder of text files, read as patterns."""
    root = scratch(spark, "patterns")
    p = table(spark, d, "patterns").where("pattern_kind = 'header'")
    scan.write_tree(p.select(F.concat("license_name", F.lit("_"), F.col("pattern_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("raw_text", "UTF-8").alias("content")), root)
    return scan.read_patterns(spark, [root]).select("name", "text")


@query("""SELECT repo_id, file_path, lower(file_hash) AS file_hash, array_to_string(coalesce(licenses, []), ',') AS licenses FROM snapshot_primary UNION ALL
SELECT repo_id, file_path, lower(file_hash), array_to_string(coalesce(licenses, []), ',') FROM snapshot_mirror""")
def snapshot_union(spark: SparkSession, d: str) -> DataFrame:
    licences = F.array_join(F.coalesce("licenses", F.array().cast("array<string>")), ",")
    both = table(spark, d, "snapshot_primary").unionByName(table(spark, d, "snapshot_mirror"))
    return both.select("repo_id", "file_path", F.lower("file_hash").alias("file_hash"), licences.alias("licenses"))


@query("SELECT file_id, coalesce(file_content, '') AS restored FROM files")
def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    packed = spread(table(spark, d, "files").select("file_id", F.encode(F.coalesce("file_content", F.lit("")), "UTF-8").alias("content"))).select("file_id", T.compress_b64(F.col("content")).alias("packed"))
    return packed.select("file_id", F.decode(T.decompress_b64(F.col("packed")), "UTF-8").alias("restored"))


@query("SELECT m.match_id, (m.end_index - m.start_index + 1) / len(p.tokens) * 100.0 AS span_percent FROM match_results m JOIN (SELECT license_name, arg_min(tokens, pattern_id) AS tokens FROM patterns GROUP BY 1) p ON lower(p.license_name) = lower(m.license_name)")
def match_span_percent(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "patterns").groupBy(F.lower("license_name").alias("name")).agg(F.min_by(F.size("tokens"), "pattern_id").alias("n"))
    m = table(spark, d, "match_results").withColumn("name", F.lower("license_name")).join(p, "name")
    return m.select("match_id", T.match_percent(F.col("end_index") - F.col("start_index") + 1, F.col("n")).alias("span_percent"))


@query("SELECT date_trunc('day', ingested_at) AS start, count(*) AS files, count(*) FILTER (file_is_empty) AS empty FROM files GROUP BY 1")
def arrivals(spark: SparkSession, d: str) -> DataFrame:
    return incremental.arrivals(table(spark, d, "files"))
