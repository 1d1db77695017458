"""The pN_ queries of the operators in this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import licences, lookalike, mixing, mojibake, neardup, secrets, spans, splitting, tokenizing
from corpusweave.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _token_lists(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "file_index").select(F.lit(0).alias("kind"), F.col("file_id").alias("id"), "tokens")
    return files.unionByName(table(spark, d, "patterns").select(F.lit(1).alias("kind"), F.col("pattern_id").alias("id"), "tokens"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_spans(_token_lists(spark, d))
    return found.where("kind = 0").select(F.col("id").alias("file_id"), F.col("start_tok").cast("long"), F.col("end_tok").cast("long"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    records = _token_lists(spark, d)
    return spans.shares(records, spans.shared_spans(records)).where("kind = 0").select(F.col("id").alias("file_id"), "n_tokens", "shared_tokens", "shared_percent")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("file_content_normalized").alias("text"))
    return files.unionByName(table(spark, d, "patterns").select(F.lit("pattern").alias("kind"), F.col("pattern_id").alias("id"), "text"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_texts(spark, d)).select(F.col("kind").alias("record_kind"), "id", "class_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(neardup.groups(_texts(spark, d))).select(F.col("kind").alias("record_kind"), "id_a", "id_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return licences.verdicts(table(spark, d, "files"), table(spark, d, "repositories"), table(spark, d, "patterns"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(table(spark, d, "files"), "file_id", "file_content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.lines(p5_redacted(spark, d), "file_id")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "files"), "file_id", "repo_id", "file_content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_repaired(spark, d).select("file_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(table(spark, d, "files"), "file_id", "file_content")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_groups(table(spark, d, "files"), "file_id", "file_content")


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_canonical(table(spark, d, "files").select("file_id", "file_content", "file_content_normalized"), ["file_content", "file_content_normalized"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode_column(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_shares": p1_shares, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p4_found": p4_found, "p4_repaired": p4_repaired, "p6_found": p6_found, "p6_groups": p6_groups, "p6_canonical": p6_canonical, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_pieces": p10_pieces}


_SHARED_SPANS = """WITH t AS (SELECT 0 AS kind, file_id AS id, tokens AS w FROM file_index UNION ALL SELECT 1, pattern_id, tokens FROM patterns),
g AS (SELECT kind, id, i, md5(array_to_string(w[i:i + 79], ' ')) AS win FROM (SELECT *, unnest(range(1, len(w) - 78)) AS i FROM t WHERE len(w) >= 80)),
s AS (SELECT kind, id, i FROM g WHERE win IN (SELECT win FROM g GROUP BY win HAVING count(DISTINCT (kind, id)) > 1)),
b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY kind, id ORDER BY i) <= 80 THEN 0 ELSE 1 END AS new FROM s),
spans AS (SELECT kind, id, min(i) - 1 AS start_tok, max(i) + 79 AS end_tok FROM (SELECT *, sum(new) OVER (PARTITION BY kind, id ORDER BY i) AS n FROM b) GROUP BY kind, id, n)"""

_SIMILAR = """WITH RECURSIVE t AS (SELECT 'file' AS k, file_id AS id, list_filter(string_split(file_content_normalized, ' '), lambda x: x <> '') AS w FROM files
  UNION ALL SELECT 'pattern', pattern_id, list_filter(string_split(text, ' '), lambda x: x <> '') FROM patterns),
g AS (SELECT DISTINCT k, id, array_to_string(w[i:i + 3], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 20)),
n AS (SELECT k, id, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.k, a.id AS a, b.id AS b, count(*) AS common FROM g a JOIN g b ON a.k = b.k AND a.run = b.run AND a.id < b.id GROUP BY ALL),
l AS (SELECT c.k, a, b FROM c JOIN n x ON x.k = c.k AND x.id = a JOIN n y ON y.k = c.k AND y.id = b WHERE common * 10 >= (x.n + y.n - common) * 6),
e AS (SELECT k, a, b FROM l UNION ALL SELECT k, b, a FROM l),
r AS (SELECT k, id AS a, id AS b FROM n UNION SELECT r.k, r.a, e.b FROM r JOIN e ON e.k = r.k AND e.a = r.b)"""


def _looks() -> str:
    """CTE s (id, text, looks): the form for comparing, by the folds as a table."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    folds = lookalike.all_folds(True)
    table = f"map([{', '.join(map(quoted, folds))}], [{', '.join(map(quoted, folds.values()))}])"
    each = f"nfc_normalize(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE coalesce({table}[c], c) END), ''))"
    return f"WITH s AS (SELECT id, text, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN {each} ELSE text END AS looks FROM (SELECT file_id AS id, file_content AS text FROM files WHERE file_content <> ''))"


def oracle_sql() -> dict[str, str]:
    """What SQL can say over whole tables; the others are tested against brute force, round trips and held-out accuracy."""
    return {
        "p1_found": f"{_SHARED_SPANS} SELECT id AS file_id, start_tok, end_tok FROM spans WHERE kind = 0",
        "p1_shares": f"""{_SHARED_SPANS}, n AS (SELECT id, sum(end_tok - start_tok)::BIGINT AS n FROM spans WHERE kind = 0 GROUP BY 1)
SELECT file_id, coalesce(len(tokens), 0)::INT AS n_tokens, coalesce(n, 0) AS shared_tokens, CASE WHEN len(tokens) > 0 THEN coalesce(n, 0) * 100.0::DOUBLE / len(tokens) ELSE 0.0 END AS shared_percent FROM file_index LEFT JOIN n ON n.id = file_id""",
        "p2_found": f"{_SIMILAR} SELECT k AS record_kind, a AS id_a, b AS id_b FROM r WHERE a < b",
        "p2_groups": f"{_SIMILAR} SELECT k AS record_kind, a AS id, min(b) AS class_id FROM r GROUP BY ALL",
        "p6_found": f"{_looks()} SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.looks = b.looks AND a.id < b.id AND a.text <> b.text",
        "p6_groups": f"""{_looks()}, c AS (SELECT looks, min(id) AS class_id FROM s GROUP BY 1 HAVING count(DISTINCT text) > 1), o AS (SELECT text, min(id) AS string_id FROM s GROUP BY 1)
SELECT id, class_id, string_id FROM s JOIN c USING (looks) JOIN o USING (text)""",
    }
