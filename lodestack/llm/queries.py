"""The pN_ queries over a catalog directory, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import encodings, new_text, packing, personal_data
from lodestack.llm.leaks import leaks
from lodestack.llm.near_duplicates import alike_groups, equal_bytes
from lodestack.llm.shared_spans import shared_spans
from lodestack.llm.split_groups import assign, related
from lodestack.llm.split_overlap import found, overlaps, report
from lodestack.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return new_text.found(table(spark, d, "exported_sample"), table(spark, d, "sample_row"))


def p1_reduced(spark: SparkSession, d: str) -> DataFrame:
    return new_text.reduced(table(spark, d, "exported_sample"), table(spark, d, "sample_row"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.found(table(spark, d, "exported_sample"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restored(table(spark, d, "exported_sample")).distinct()


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(table(spark, d, "manifest_sample"), table(spark, d, "dataset_version"), table(spark, d, "exported_sample"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return found(_overlaps(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return report(_overlaps(spark, d), table(spark, d, "manifest_sample"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return related(table(spark, d, "manifest_sample"))


def p4_sides(spark: SparkSession, d: str) -> DataFrame:
    return assign(table(spark, d, "manifest_sample"), table(spark, d, "dataset_version"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(dataset_id, size, side, groups): how many groups of each size ``p4_sides`` put on each side."""
    by = p4_sides(spark, d).groupBy("dataset_id", "group_id", "side").agg(F.count("*").alias("size"))
    return by.groupBy("dataset_id", "size", "side").agg(F.count("*").alias("groups"))


#: the key of the registered queries only; users pass a secret of their own
QUERY_KEY = b"registered queries"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.found(table(spark, d, "exported_sample"), table(spark, d, "name_list"), QUERY_KEY)


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.redacted(table(spark, d, "exported_sample"), table(spark, d, "name_list"), QUERY_KEY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "exported_sample").withColumnRenamed("sample_id", "id").select("id", "text")
    return alike_groups(samples).withColumnRenamed("id", "sample_id")


def p6_grouped(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, group_id) of samples joined by alike texts or by equal bytes under several types."""
    samples = table(spark, d, "exported_sample").withColumnRenamed("sample_id", "id").select("id", "text")
    return alike_groups(samples, also=equal_bytes(table(spark, d, "sample_row"))).withColumnRenamed("id", "sample_id")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_target"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_packed(spark, d))


def p7_conserved(spark: SparkSession, d: str) -> DataFrame:
    return packing.conserved(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    # searched within one edit; what counts as found has none
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), edits=1, exact=True)


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a stretch of an item with at most two edited characters."""
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), edits=2)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_reduced": p1_reduced,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_sides": p4_sides,
    "p4_sizes": p4_sizes,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_grouped": p6_grouped,
    "p7_packed": p7_packed,
    "p7_report": p7_report,
    "p7_conserved": p7_conserved,
    "p8_found": p8_found,
    "p8_edited": p8_edited,
    "p9_found": p9_found,
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

#: Alike texts of samples, as the plain definition has it: (a, b), a < b.
_ALIKE = f"""t AS (SELECT sample_id, min(text) AS text FROM exported_sample WHERE text IS NOT NULL GROUP BY sample_id),
  w AS (SELECT sample_id, {_WORDS} AS w FROM t),
  g AS (SELECT DISTINCT sample_id, array_to_string(w[k:k+2], ' ') AS g FROM (SELECT sample_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
  n AS (SELECT sample_id, count(*) AS n FROM g GROUP BY sample_id),
  both_of AS (SELECT x.sample_id AS a, y.sample_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.sample_id < y.sample_id GROUP BY ALL),
  alike AS (SELECT a, b FROM both_of JOIN n p ON p.sample_id = a JOIN n q ON q.sample_id = b WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9
    UNION SELECT x.sample_id, y.sample_id FROM t x JOIN t y ON x.text = y.text AND x.sample_id < y.sample_id)"""

_PAIRS = f"""{_ALIKE}, d AS (SELECT id, given_split->>'$.key' AS key, CAST(given_split->'$.holdout' AS VARCHAR[]) AS holdout, CAST(given_split->'$.val' AS VARCHAR[]) AS val FROM (SELECT id, CAST(given_split AS JSON) AS given_split FROM dataset_version WHERE given_split IS NOT NULL)),
  m AS (SELECT DISTINCT dataset_id, sample_id, CASE WHEN list_contains(holdout, v) THEN 'holdout' WHEN list_contains(val, v) THEN 'val' ELSE 'train' END AS side
    FROM (SELECT dataset_id, sample_id, holdout, val, json_extract_string(metadata, '$."' || key || '"') AS v FROM manifest_sample JOIN d ON d.id = dataset_id)),
  p AS (SELECT x.dataset_id, x.sample_id AS train_id, y.sample_id AS held_id, y.side FROM m x JOIN m y ON x.dataset_id = y.dataset_id AND x.side = 'train' AND y.side <> 'train'
    JOIN alike ON a = least(x.sample_id, y.sample_id) AND b = greatest(x.sample_id, y.sample_id))"""

_RELATED = """v AS (SELECT entry_id, dataset_id, 'author' AS k, [json_extract_string(metadata, '$.author')] AS v FROM manifest_sample UNION ALL SELECT entry_id, dataset_id, 'source_file', [json_extract_string(metadata, '$.source_file')] FROM manifest_sample
    UNION ALL SELECT entry_id, dataset_id, 'entity', CASE WHEN json_type(metadata, '$.entity') = 'ARRAY' THEN json_extract_string(metadata, '$.entity[*]') ELSE [json_extract_string(metadata, '$.entity')] END FROM manifest_sample),
  x AS (SELECT DISTINCT entry_id, dataset_id, k, lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS x FROM (SELECT entry_id, dataset_id, k, unnest(v) AS x FROM v)),
  e AS (SELECT entry_id AS a, min(entry_id) OVER (PARTITION BY dataset_id, k, x) AS b FROM x WHERE x IS NOT NULL AND x NOT IN ('', 'unknown', 'n/a')),
  l AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


def _grouped(edges: str, column: str) -> str:
    """Groups joined through links l(a, b), by closure: one row per member of a group of two or more."""
    return f"""WITH RECURSIVE {edges}, r(id, other) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)
  SELECT id AS {column}, min(other) AS group_id FROM r GROUP BY id HAVING count(*) > 1"""


SQL: dict[str, str] = {
    "p3_found": f"WITH {_PAIRS} SELECT DISTINCT dataset_id, least(train_id, held_id) AS sample_a, greatest(train_id, held_id) AS sample_b FROM p",
    "p3_report": f"""WITH {_PAIRS}, s AS (SELECT dataset_id, sample_id, min(json_extract_string(metadata, '$.collection')) AS source FROM manifest_sample GROUP BY ALL)
  SELECT p.dataset_id, side, source, count(*) AS pairs, count(DISTINCT held_id) AS held, count(DISTINCT train_id) AS train FROM p LEFT JOIN s ON s.dataset_id = p.dataset_id AND s.sample_id = held_id GROUP BY ALL""",
    "p4_found": _grouped(_RELATED, "entry_id"),
    "p4_sizes": f"""WITH RECURSIVE {_RELATED}, r(id, other) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
  j AS (SELECT entry_id, dataset_id, coalesce((SELECT min(other) FROM r WHERE r.id = entry_id), entry_id) AS grp FROM (SELECT DISTINCT entry_id, dataset_id FROM manifest_sample)),
  z AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY size DESC, grp) AS n FROM (SELECT dataset_id, grp, count(*) AS size FROM j GROUP BY ALL)),
  t AS (SELECT j.dataset_id, count(*) AS total, coalesce(greatest(0.0, max(val_ratio)), 0.0) AS val, coalesce(greatest(0.0, max(holdout_ratio)), 0.0) AS hold FROM j LEFT JOIN dataset_version v ON v.id = j.dataset_id GROUP BY ALL),
  deal(dataset_id, n, size, side, a, b, c) AS (SELECT dataset_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1, CAST(total * greatest(0.0, 1 - val - hold) AS DOUBLE), CAST(total * val AS DOUBLE), CAST(total * hold AS DOUBLE) FROM t
    UNION ALL SELECT dataset_id, n, size, side, CASE WHEN side = 0 THEN a - size ELSE a END, CASE WHEN side = 1 THEN b - size ELSE b END, CASE WHEN side = 2 THEN c - size ELSE c END
    FROM (SELECT d.dataset_id, z.n, z.size, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS side, a, b, c FROM deal d JOIN z ON z.dataset_id = d.dataset_id AND z.n = d.n + 1))
  SELECT dataset_id, size, CASE side WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'holdout' END AS side, count(*) AS groups FROM deal WHERE n > 0 GROUP BY ALL""",
    "p6_found": _grouped(f"{_ALIKE}, l AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike)", "sample_id"),
    "p6_grouped": _grouped(f"{_ALIKE}, same AS (SELECT x.id AS a, y.id AS b FROM sample_row x JOIN sample_row y ON x.checksum = y.checksum AND x.id <> y.id), l AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike UNION SELECT a, b FROM same)", "sample_id"),
    "p7_conserved": """SELECT CAST(capacity AS BIGINT) AS capacity, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, CAST(0 AS BIGINT) AS over FROM (SELECT DISTINCT capacity FROM pack_target WHERE capacity > 0)""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)), ig AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
  SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON ig.g = dg.g""",
    "p9_found": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents),
  g AS (SELECT doc_id, k, md5(array_to_string(w[k:k+24], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 23)) AS k FROM w)),
  c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 25)) AS pos FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1)),
  s AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c)
  SELECT doc_id, min(pos) AS first_word, max(pos) AS last_word FROM s GROUP BY doc_id, run""",
}
