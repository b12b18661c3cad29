"""Catalog queries over the Parquet tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import values as V
from lodestack.operators import history, selection, sync, versions, views
from lodestack.operators.selection import Mark, Spec, condition
from lodestack.sources.tables import table
from lodestack.types import Types

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def of(self, label_set: str) -> DataFrame:
        return views.of_set(self.annotation, self.label_set, label_set)


def query(sql: str | None = None):
    """Register a function of Tables as a query, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, directory: f(Tables(spark, directory))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_SET = "label_set_id = (SELECT id FROM label_set WHERE name = '{}')"
_TRIAGE, _QC, _TONE = (_SET.format(n) for n in ("triage", "qc", "tone"))
_LIVE = "SELECT id, checksum, media, subtype, metadata FROM sample_row WHERE deleted_at IS NULL"


# the read API ------------------------------------------------------------------------------------------------


@query(f"SELECT id, checksum FROM ({_LIVE}) s WHERE NOT EXISTS (SELECT 1 FROM annotation a WHERE a.sample_id = s.id AND a.superseded_at IS NULL AND {_TRIAGE})")
def unlabelled(t):
    return views.unlabelled(t.sample_row, t.of("triage")).select("id", "checksum")


@query(f"SELECT id, checksum FROM ({_LIVE}) s WHERE id IN (SELECT sample_id FROM annotation WHERE superseded_at IS NULL AND state = 'annotated' AND {_TRIAGE})")
def labelled(t):
    return views.by_state(t.sample_row, t.of("triage"), "annotated").select("id", "checksum")


@query(f"SELECT id FROM ({_LIVE}) s WHERE id IN (SELECT sample_id FROM annotation WHERE superseded_at IS NULL AND state = 'annotated' AND source = 'human' AND {_QC})")
def labelled_by_source(t):
    return views.by_state(t.sample_row, t.of("qc"), "annotated", "human").select("id")


@query(f"SELECT id FROM ({_LIVE}) s WHERE id IN (SELECT sample_id FROM annotation WHERE superseded_at IS NULL AND state = 'annotated' AND source = 'import' AND {_TRIAGE})")
def unreviewed(t):
    return views.by_state(t.sample_row, t.of("triage"), "annotated", "import").select("id")


@query(f"SELECT id FROM ({_LIVE}) s WHERE id IN (SELECT sample_id FROM annotation WHERE superseded_at IS NULL AND state = 'skipped' AND {_TRIAGE})")
def skipped(t):
    return views.by_state(t.sample_row, t.of("triage"), "skipped").select("id")


@query(f"""SELECT id FROM ({_LIVE}) s WHERE id IN (SELECT sample_id FROM annotation WHERE superseded_at IS NULL AND state = 'annotated' AND {_TRIAGE}
  AND list_contains(CAST(json_extract(value, '$.values') AS VARCHAR[]), 'keep'))""")
def with_class(t):
    rows = views.current(t.of("triage")).where("state = 'annotated'").where(F.array_contains(V.asserted(F.col("value")), "keep"))
    return views.live(t.sample_row).join(rows.select(F.col("sample_id").alias("id")), "id", "left_semi").select("id")


@query(f"SELECT id FROM ({_LIVE}) s WHERE json_type(metadata, '$.fold') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(metadata, '$.fold') AS DOUBLE) = 4 AND json_type(metadata, '$.lang') = 'VARCHAR' AND json_extract_string(metadata, '$.lang') = 'en'")
def matching_typed_eq(t):
    cond = condition({"all": [{"key": "fold", "op": "==", "value": 4}, {"key": "lang", "op": "==", "value": "en"}]})
    return views.live(t.sample_row).where(selection.compile_condition(cond, F.col("metadata"))).select("id")


@query(f"SELECT media, subtype, count(*) AS n FROM ({_LIVE}) s GROUP BY ALL")
def composition(t):
    return views.live(t.sample_row).groupBy("media", "subtype").agg(F.count("*").alias("n"))


@query(f"SELECT checksum, count(*) AS types, min(id) AS first_id FROM ({_LIVE}) s GROUP BY checksum HAVING count(*) > 1")
def by_checksum_ambiguous(t):
    return views.live(t.sample_row).groupBy("checksum").agg(F.count("*").alias("types"), F.min("id").alias("first_id")).where("types > 1")


@query(f"SELECT id, checksum FROM ({_LIVE}) s WHERE EXISTS (SELECT 1 FROM sample_collection c WHERE c.sample_id = s.id AND (c.collection = 'holm' OR starts_with(c.collection, 'holm/') OR c.collection = 'velbrook/inbox' OR starts_with(c.collection, 'velbrook/inbox/')))")
def collections_scope_prefix(t):
    return views.scoped(views.live(t.sample_row), t.sample_collection, ["holm", "velbrook/inbox"]).select("id", "checksum")


@query(f"""WITH cur AS (SELECT sample_id, max(CASE WHEN state = 'annotated' THEN 1 ELSE 0 END) AS answered FROM annotation WHERE superseded_at IS NULL AND {_TRIAGE} GROUP BY sample_id)
  SELECT CASE WHEN cur.sample_id IS NULL THEN 'unlabelled' WHEN answered = 1 THEN 'labelled' ELSE 'skipped' END AS state, count(*) AS n FROM ({_LIVE}) s LEFT JOIN cur ON cur.sample_id = s.id GROUP BY ALL""")
def three_state_partition(t):
    cur = views.current(t.of("triage")).groupBy(F.col("sample_id").alias("id")).agg(F.max((F.col("state") == "annotated").cast("int")).alias("answered"))
    state = F.when(F.col("answered").isNull(), "unlabelled").when(F.col("answered") == 1, "labelled").otherwise("skipped")
    return views.live(t.sample_row).join(cur, "id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT collection, count(*) AS memberships, count(DISTINCT sample_id) AS samples FROM sample_collection GROUP BY collection")
def stats_collections(t):
    return t.sample_collection.groupBy("collection").agg(F.count("*").alias("memberships"), F.countDistinct("sample_id").alias("samples"))


@query("SELECT id FROM sample_row s WHERE NOT EXISTS (SELECT 1 FROM sample_collection c WHERE c.sample_id = s.id)")
def uncollected(t):
    return t.sample_row.join(t.sample_collection.select(F.col("sample_id").alias("id")), "id", "left_anti").select("id")


@query("""SELECT l.name, count(DISTINCT CASE WHEN a.state = 'annotated' THEN a.sample_id END) AS annotated, count(DISTINCT CASE WHEN a.state = 'skipped' THEN a.sample_id END) AS skipped,
  count(DISTINCT CASE WHEN a.state = 'annotated' AND a.source = 'import' THEN a.sample_id END) AS awaiting
  FROM label_set l LEFT JOIN (SELECT a.* FROM annotation a JOIN sample_row s ON s.id = a.sample_id WHERE s.deleted_at IS NULL AND a.superseded_at IS NULL) a ON a.label_set_id = l.id GROUP BY l.name""")
def stats_label_sets(t):
    rows = views.current(t.annotation).join(views.live(t.sample_row).select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    joined = F.broadcast(t.label_set.select(F.col("id").alias("label_set_id"), "name")).join(rows, "label_set_id", "left")
    n = lambda c: F.countDistinct(F.when(c, F.col("sample_id")))
    answered = F.col("state") == "annotated"
    return joined.groupBy("name").agg(n(answered).alias("annotated"), n(F.col("state") == "skipped").alias("skipped"), n(answered & (F.col("source") == "import")).alias("awaiting"))


@query(f"""SELECT c.cls AS class, count(DISTINCT a.sample_id) AS n FROM (SELECT sample_id, unnest(CAST(json_extract(value, '$.values') AS VARCHAR[])) AS cls FROM annotation WHERE superseded_at IS NULL AND state = 'annotated' AND {_TONE}) a
  JOIN sample_row s ON s.id = a.sample_id JOIN (SELECT unnest(['dry', 'warm', 'curt']) AS cls) c ON c.cls = a.cls WHERE s.deleted_at IS NULL GROUP BY ALL""")
def class_counts(t):
    rows = views.current(t.of("tone")).where("state = 'annotated'").join(views.live(t.sample_row).select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    return rows.select("sample_id", F.explode(V.asserted(F.col("value"))).alias("class")).groupBy("class").agg(F.countDistinct("sample_id").alias("n"))


@query("""SELECT id AS annotation_id, cls AS class FROM (SELECT id, unnest(CAST(json_extract(value, '$.values') AS VARCHAR[])) AS cls FROM annotation WHERE json_extract_string(value, '$.kind') = 'choices'
  UNION SELECT id, unnest(flatten(CAST(json_extract(value, '$.values[*].labels') AS VARCHAR[][]))) FROM annotation WHERE json_extract_string(value, '$.kind') = 'spans'
  UNION SELECT id, unnest(json_extract_string(value, '$.values[*].label')) FROM annotation WHERE json_extract_string(value, '$.kind') = 'boxes')""")
def asserted_classes(t):
    return t.annotation.select(F.col("id").alias("annotation_id"), F.explode(V.asserted(F.col("value"))).alias("class"))


_ASSERTED = """SELECT id, unnest(CAST(json_extract(value, '$.values') AS VARCHAR[])) AS cls FROM annotation WHERE json_extract_string(value, '$.kind') = 'choices'
  UNION SELECT id, unnest(flatten(CAST(json_extract(value, '$.values[*].labels') AS VARCHAR[][]))) FROM annotation WHERE json_extract_string(value, '$.kind') = 'spans'
  UNION SELECT id, unnest(json_extract_string(value, '$.values[*].label')) FROM annotation WHERE json_extract_string(value, '$.kind') = 'boxes'"""


@query(f"""WITH r AS (SELECT a.id, a.value, json_extract_string(a.value, '$.kind') AS kind, l.label_schema AS s FROM annotation a JOIN label_set l ON l.id = a.label_set_id WHERE a.value IS NOT NULL),
  c AS ({_ASSERTED}), p AS (SELECT id, a, lag(e) OVER (PARTITION BY id ORDER BY a, e) AS b FROM (SELECT id, unnest(CAST(json_extract(value, '$.values[*].start') AS BIGINT[])) AS a, unnest(CAST(json_extract(value, '$.values[*].end') AS BIGINT[])) AS e FROM r WHERE kind = 'spans'))
  SELECT DISTINCT id, 'class' AS fault FROM r JOIN c USING (id) WHERE NOT list_contains(CAST(json_extract(s, '$.classes') AS VARCHAR[]), cls)
  UNION ALL SELECT id, 'kind' FROM r WHERE NOT coalesce(kind = CASE json_extract_string(s, '$.label_type') WHEN 'classification' THEN 'choices' WHEN 'span' THEN 'spans' WHEN 'bbox' THEN 'boxes' END, false)
  UNION ALL SELECT id, 'multiple' FROM r WHERE kind = 'choices' AND NOT coalesce(CAST(json_extract_string(s, '$.multiple') AS BOOLEAN), false) AND json_array_length(value, '$.values') > 1
  UNION ALL SELECT DISTINCT id, 'overlap' FROM r JOIN p USING (id) WHERE NOT coalesce(CAST(json_extract_string(s, '$.overlapping') AS BOOLEAN), false) AND p.a < p.b""")
def value_validation(t):
    rows = t.annotation.join(F.broadcast(t.label_set.select(F.col("id").alias("label_set_id"), "label_schema")), "label_set_id")
    return rows.select("id", F.explode(V.faults(F.col("value"), F.col("label_schema"))).alias("fault"))


@query("""SELECT id, sample_id, label_set_id, row_number() OVER w AS place, lead(created_at) OVER w AS next_at FROM annotation WINDOW w AS (PARTITION BY sample_id, label_set_id ORDER BY created_at, id)""")
def answer_history(t):
    return history.timeline(t.annotation).select("id", "sample_id", "label_set_id", F.col("place").cast("bigint").alias("place"), "next_at")


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY sample_id, label_set_id ORDER BY created_at DESC, id DESC) AS n FROM annotation WHERE source = 'human')
  SELECT a.sample_id, a.label_set_id, a.state = b.state AND a.value IS NOT DISTINCT FROM b.value AS agreed FROM h a JOIN h b ON a.sample_id = b.sample_id AND a.label_set_id = b.label_set_id AND a.n = 1 AND b.n = 2 WHERE a.superseded_at IS NULL""")
def second_looks(t):
    return history.second_looks(t.annotation)


@query("""WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, label_set_id ORDER BY created_at DESC, id DESC) AS n FROM annotation WHERE source = 'import' AND state = 'annotated') WHERE n = 1),
  s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, label_set_id ORDER BY id DESC) AS n FROM annotation WHERE superseded_at IS NULL) WHERE n = 1),
  b AS (SELECT i.label_set_id, coalesce(i.batch, '') AS batch, s.id IS NULL OR s.id = i.id OR s.source <> 'human' AS pending, s.state = 'annotated' AND s.value IS NOT DISTINCT FROM i.value AS same
    FROM i LEFT JOIN s ON s.sample_id = i.sample_id AND s.label_set_id = i.label_set_id)
  SELECT label_set_id, batch, count(*) FILTER (pending) AS pending, count(*) FILTER (NOT pending AND same) AS accepted, count(*) FILTER (NOT pending AND NOT same) AS corrected FROM b GROUP BY ALL""")
def review_counts(t):
    return history.review_counts(t.annotation)


@query("""SELECT id, CASE WHEN json_type(metadata, '$.author') IS NULL OR json_type(metadata, '$.author') = 'NULL' THEN 's:' || id ELSE 'g:' || json_extract_string(metadata, '$.author') END AS grp FROM sample_row""")
def grouping_by_author(t):
    return t.sample_row.select("id", V.grouping(F.col("metadata"), "author", F.col("id")).alias("grp"))


# the selection language ----------------------------------------------------------------------------------------

_NUM = "json_type(metadata, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_VAL = "CAST(json_extract_string(metadata, '$.{0}') AS DOUBLE)"


def _cond(sql: str, tree: dict, name: str) -> None:
    def run(t):
        return views.live(t.sample_row).where(selection.compile_condition(condition(tree), F.col("metadata"))).select("id")

    run.__name__ = name
    query(f"SELECT id FROM ({_LIVE}) s WHERE {sql}")(run)


_cond("json_type(metadata, '$.lang') = 'VARCHAR' AND json_extract_string(metadata, '$.lang') IN ('en', 'fr')", {"key": "lang", "op": "in", "value": ["en", "fr"]}, "select_in")
_cond("json_exists(metadata, '$.entity')", {"key": "entity", "op": "exists"}, "select_exists")
_cond("NOT coalesce(json_type(metadata, '$.bench') = 'VARCHAR' AND json_extract_string(metadata, '$.bench') = 'dev', false)", {"not": {"key": "bench", "op": "==", "value": "dev"}}, "select_not_missing_key")
_cond("json_exists(metadata, '$.fold') AND NOT coalesce(json_type(metadata, '$.fold') = 'VARCHAR' AND json_extract_string(metadata, '$.fold') = '7', false)", {"key": "fold", "op": "!=", "value": "7"}, "select_not_equal")
_cond(f"coalesce({_NUM.format('word_count')} AND {_VAL.format('word_count')} <= 120, false)", {"key": "word_count", "op": "<=", "value": 120}, "select_ordered_number")
_cond("coalesce(json_type(metadata, '$.arrived_as') = 'VARCHAR' AND json_extract_string(metadata, '$.arrived_as') > 'V', false)", {"key": "arrived_as", "op": ">", "value": "V"}, "select_ordered_string")

_WHERE = {"all": [{"any": [{"key": "word_count", "op": "<=", "value": 150}, {"not": {"key": "lang", "op": "==", "value": "en"}}]}, {"not": {"asserts": "reject", "label_set": "qc"}}, {"key": "fold", "op": "in", "value": [1, 2, 3, "4", 5]}]}
_SPEC = Spec(types=("text/email", "text/plain"), label_set="mail_spans", collections=("*",), sources=("human", "import", "model"), where=condition(_WHERE))
_POOL_SQL = f"""WITH ans AS (SELECT sample_id, label_set_id, max(id) AS id FROM annotation GROUP BY ALL),
  a AS (SELECT x.* FROM annotation x JOIN ans USING (id)),
  pool AS (SELECT s.id, s.media, s.subtype, s.metadata,
    coalesce({_NUM.format('word_count')} AND {_VAL.format('word_count')} <= 150, false) OR NOT coalesce(json_type(metadata, '$.lang') = 'VARCHAR' AND json_extract_string(metadata, '$.lang') = 'en', false) AS c0,
    NOT EXISTS (SELECT 1 FROM a WHERE a.sample_id = s.id AND a.state = 'annotated' AND a.{_QC} AND list_contains(CAST(json_extract(value, '$.values') AS VARCHAR[]), 'reject')) AS c1,
    coalesce({_NUM.format('fold')} AND {_VAL.format('fold')} IN (1, 2, 3, 5), false) OR coalesce(json_type(metadata, '$.fold') = 'VARCHAR' AND json_extract_string(metadata, '$.fold') = '4', false) AS c2
    FROM ({_LIVE}) s WHERE s.media = 'text' AND id IN (SELECT sample_id FROM a WHERE state = 'annotated' AND {_SET.format('mail_spans')}))"""


def _selected(t, spec: Spec = _SPEC, lists=None, mark: Mark = Mark()):
    return selection.run_selection(spec, t.sample_row, t.sample_collection, t.annotation, t.label_set, lists, mark)


@query(_POOL_SQL + " SELECT id FROM pool WHERE c0 AND c1 AND c2")
def select_where_nested(t):
    return _selected(t).members


@query(_POOL_SQL + f""" SELECT 'pool' AS what, '' AS name, count(*) AS n FROM pool UNION ALL SELECT 'selected', '', count(*) FROM pool WHERE c0 AND c1 AND c2
  UNION ALL SELECT 'rejected', '0', count(*) FROM pool WHERE NOT c0 UNION ALL SELECT 'rejected', '1', count(*) FROM pool WHERE NOT c1 UNION ALL SELECT 'rejected', '2', count(*) FROM pool WHERE NOT c2
  UNION ALL SELECT 'missing', 'fold', count(*) FROM pool WHERE NOT coalesce(json_exists(metadata, '$.fold'), false) UNION ALL SELECT 'missing', 'lang', count(*) FROM pool WHERE NOT coalesce(json_exists(metadata, '$.lang'), false)
  UNION ALL SELECT 'missing', 'word_count', count(*) FROM pool WHERE NOT coalesce(json_exists(metadata, '$.word_count'), false) UNION ALL SELECT 'candidates', '', count(*) FROM ({_LIVE}) s WHERE media = 'text'""")
def select_counts(t):
    return _selected(t).counts()


@query(_POOL_SQL + " SELECT media, subtype, count(*) AS n FROM pool WHERE c0 AND c1 AND c2 GROUP BY ALL")
def select_by_type(t):
    return _selected(t).by_type()


@query(_POOL_SQL + " SELECT collection, count(DISTINCT pool.id) AS n FROM pool JOIN sample_collection c ON c.sample_id = pool.id WHERE c0 AND c1 AND c2 GROUP BY collection")
def select_by_collection(t):
    return _selected(t).by_collection(t.sample_collection)


def _lists(t):
    rows = t.manifest_sample
    held = rows.where("split = 'holdout'").select("checksum", F.lit(None).cast("string").alias("media"), F.lit(None).cast("string").alias("subtype"))
    typed = rows.where("split = 'val'").select("checksum", F.lit("text").alias("media"), F.lit("email").alias("subtype"))
    return {"held@1": held, "val-mail@2": typed}


@query("""WITH ans AS (SELECT sample_id, label_set_id, max(id) AS id FROM annotation GROUP BY ALL), a AS (SELECT x.* FROM annotation x JOIN ans USING (id))
  SELECT s.id FROM sample_row s WHERE deleted_at IS NULL AND media = 'text' AND (subtype = 'email' OR starts_with(subtype, 'email/')) AND id IN (SELECT sample_id FROM a WHERE state = 'annotated' AND """ + _SET.format("mail_spans") + """)
  AND NOT EXISTS (SELECT 1 FROM manifest_sample m WHERE m.split = 'holdout' AND m.checksum = s.checksum)
  AND NOT (subtype = 'email' AND EXISTS (SELECT 1 FROM manifest_sample m WHERE m.split = 'val' AND m.checksum = s.checksum))""")
def select_lists(t):
    return _selected(t, Spec(types=("text/email",), label_set="mail_spans", exclude=("held@1", "val-mail@2")), _lists(t)).members


@query("""SELECT 'annotation' AS log, coalesce(max(id), 0) AS mark FROM annotation UNION ALL SELECT 'sample', coalesce(max(id), 0) FROM sample_row UNION ALL SELECT 'sample_collection', coalesce(max(id), 0) FROM sample_collection""")
def watermark(t):
    return selection.watermark({"sample": t.sample_row, "sample_collection": t.sample_collection, "annotation": t.annotation})


_AT = "(SELECT CAST(json_extract_string(watermark, '$.{}') AS BIGINT) FROM dataset_version WHERE id = 1)"


def _frozen(t) -> Mark:
    """The watermark of the first version; one row, read so that the bound on ids reaches the scans."""
    r = t.dataset_version.where("id = 1").select(*[F.get_json_object("watermark", f"$.{k}").cast("bigint").alias(k) for k in ("sample", "annotation")]).first()
    return Mark(sample=r["sample"], annotation=r["annotation"])


@query(f"""SELECT a.sample_id, a.label_set_id, a.state, a.source FROM annotation a JOIN (SELECT sample_id, label_set_id, max(id) AS id FROM annotation WHERE id <= {_AT.format('annotation')} GROUP BY ALL) USING (id)""")
def answers_asof(t):
    return selection.answers_asof(t.annotation, _frozen(t)).select("sample_id", "label_set_id", "state", "source")


@query(f"""SELECT id, subtype FROM ({_LIVE}) s WHERE media = 'text' AND (subtype = 'email' OR starts_with(subtype, 'email/')) AND id <= {_AT.format('sample')}
  AND EXISTS (SELECT 1 FROM sample_collection c WHERE c.sample_id = s.id AND (c.collection = 'holm' OR starts_with(c.collection, 'holm/')))""")
def candidates_asof(t):
    return selection.candidates_asof(t.sample_row, t.sample_collection, ["text/email"], ["holm"], _frozen(t)).select("id", "subtype")


@query(f"""WITH now AS (SELECT sample_id, label_set_id, max(id) AS id FROM annotation GROUP BY ALL), was AS (SELECT sample_id, label_set_id, max(id) AS id FROM annotation WHERE id <= {_AT.format('annotation')} GROUP BY ALL)
  SELECT coalesce(n.label_set_id, w.label_set_id) AS label_set_id, count(*) FILTER (w.id IS NULL) AS added, count(*) FILTER (n.id <> w.id) AS changed, count(*) FILTER (n.id = w.id) AS same
  FROM now n FULL JOIN was w ON n.sample_id = w.sample_id AND n.label_set_id = w.label_set_id GROUP BY ALL""")
def replay_diff(t):
    now = selection.answers_asof(t.annotation).select("sample_id", "label_set_id", F.col("id").alias("now"))
    was = selection.answers_asof(t.annotation, _frozen(t)).select("sample_id", "label_set_id", F.col("id").alias("was"))
    both = now.join(was, ["sample_id", "label_set_id"], "full")
    return both.groupBy("label_set_id").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now") != F.col("was")).alias("changed"), F.count_if(F.col("now") == F.col("was")).alias("same"))


def _events(t):
    """An event log made of the tables: tombstones, descriptions of what arrived otherwise, withdrawn model answers and imported history."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, n, kind, sample, answer, before: df.select((F.col("id") * 4 + n).alias("id"), F.lit(kind).alias("kind"), sample.alias("sample_id"), answer.alias("annotation_id"), before.alias("before"))
    was = F.to_json(F.struct(F.lit("email").alias("subtype"), F.lit('{"lang":"en"}').alias("metadata")))
    past = t.annotation.where("superseded_at is not null")
    return (
        row(t.sample_row.where("deleted_at is not null"), 0, "tombstoned", F.col("id"), none("bigint"), none("string"))
        .union(row(t.sample_row.where(V.has_key(F.col("metadata"), "arrived_as")), 1, "described", F.col("id"), none("bigint"), was))
        .union(row(past.where("source = 'model'"), 2, "withdrawn", none("bigint"), F.col("id"), none("string")))
        .union(row(past.where("source = 'import'"), 3, "arrived", none("bigint"), F.col("id"), none("string")))
    )


_EVENT = "(SELECT 2 * max(id) FROM sample_row)"
_REPLAYED = f"""WITH c AS (SELECT id, media, CASE WHEN d THEN 'email' ELSE subtype END AS subtype, CASE WHEN d THEN '{{"lang":"en"}}' ELSE metadata END AS metadata FROM
    (SELECT *, coalesce(json_exists(metadata, '$.arrived_as'), false) AND id * 4 + 1 > {_EVENT} AS d FROM sample_row WHERE id <= {_AT.format('sample')} AND NOT (deleted_at IS NOT NULL AND id * 4 <= {_EVENT}))),
  l AS (SELECT sample_id, label_set_id, max(id) AS id FROM annotation WHERE id <= {_AT.format('annotation')} AND NOT (source = 'import' AND superseded_at IS NOT NULL AND id * 4 + 3 <= {_EVENT}) GROUP BY ALL),
  a AS (SELECT x.* FROM annotation x JOIN l USING (id) WHERE NOT (x.source = 'model' AND x.superseded_at IS NOT NULL AND x.id * 4 + 2 <= {_EVENT}))"""


def _replay_mark(t) -> Mark:
    at = _frozen(t)
    return Mark(sample=at.sample, annotation=at.annotation, event=2 * t.sample_row.agg(F.max("id")).first()[0])


@query(_REPLAYED + " SELECT sample_id, label_set_id, id, state FROM a")
def answers_with_events(t):
    return selection.answers_asof(t.annotation, _replay_mark(t), _events(t)).select("sample_id", "label_set_id", "id", "state")


@query(_REPLAYED + f""" SELECT id FROM c WHERE media = 'text' AND (subtype = 'email' OR starts_with(subtype, 'email/')) AND id IN (SELECT sample_id FROM a WHERE state = 'annotated' AND {_TRIAGE})
  AND coalesce(json_type(metadata, '$.lang') = 'VARCHAR' AND json_extract_string(metadata, '$.lang') = 'en', false)""")
def replay_with_events(t):
    spec = Spec(types=("text/email",), label_set="triage", where=condition({"key": "lang", "op": "==", "value": "en"}))
    return selection.run_selection(spec, t.sample_row, t.sample_collection, t.annotation, t.label_set, None, _replay_mark(t), _events(t)).members


# digests, types, text --------------------------------------------------------------------------------------------


@query("SELECT dataset_id, count(DISTINCT checksum) AS size, sha256(string_agg(checksum || chr(10), '' ORDER BY checksum)) AS digest FROM (SELECT DISTINCT dataset_id, checksum FROM manifest_sample) GROUP BY dataset_id")
def list_digest(t):
    return V.set_digests(t.manifest_sample, "dataset_id", "checksum")


@query("""SELECT checksum, string_agg(media || '/' || subtype, ',' ORDER BY media || '/' || subtype) AS types FROM sample_row GROUP BY checksum HAVING count(DISTINCT media || '/' || subtype) > 1""")
def same_bytes_two_types(t):
    return t.sample_row.groupBy("checksum").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "media", "subtype"))), ",").alias("types"), F.countDistinct("media", "subtype").alias("n")).where("n > 1").drop("n")


@query("""SELECT DISTINCT media, subtype, CASE WHEN subtype = 'email' OR starts_with(subtype, 'email/') THEN 'text/email' WHEN media = 'text' THEN 'text/plain' ELSE media || '/plain' END AS nearest FROM sample_row""")
def type_nearest(t):
    installed = t.spark.createDataFrame([(name,) for name in Types().held], "installed string")
    kinds = t.sample_row.select("media", "subtype").distinct()
    under = kinds.withColumn("name", F.explode(F.array_append(F.transform(V.ancestors(F.col("subtype")), lambda s: F.concat_ws("/", F.col("media"), s)), F.concat(F.col("media"), F.lit("/plain")))))
    hit = under.join(F.broadcast(installed), F.col("name") == F.col("installed"))
    plain = F.col("name").endswith("/plain").cast("int")
    return hit.groupBy("media", "subtype").agg(F.max_by("name", F.struct(-plain, F.length("name"))).alias("nearest"))


@query("""SELECT doc_id, sha256(nfc_normalize(replace(replace(CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS canonical FROM documents""")
def canonical_text(t):
    return t.documents.select("doc_id", F.sha2(V.canonical_text_column(F.col("text")), 256).alias("canonical"))


@query("""SELECT id, CASE WHEN subtype = 'frames' THEN substr(checksum, 1, 2) || '/' || substr(checksum, 3, 2) || '/' || checksum || '.png' ELSE substr(checksum, 1, 2) || '/' || substr(checksum, 3, 2) || '/' || checksum || '.txt' END AS path FROM sample_row""")
def blob_paths(t):
    return t.sample_row.select("id", V.blob_path(F.col("checksum"), F.when(F.col("subtype") == "frames", ".png").otherwise(".txt")).alias("path"))


@query("""SELECT container, count(*) AS blobs, CAST(sum(length) AS BIGINT) AS bytes, max(blob_offset + length) AS reach FROM (SELECT DISTINCT container, blob_offset, length, checksum FROM sample_row) GROUP BY container""")
def shard_layout(t):
    blobs = t.sample_row.select("container", "blob_offset", "length", "checksum").distinct()
    return blobs.groupBy("container").agg(F.count("*").alias("blobs"), F.sum("length").alias("bytes"), F.max(F.col("blob_offset") + F.col("length")).alias("reach"))


@query("""WITH n AS (SELECT DISTINCT collection || '/' || sample_id AS name FROM sample_collection), c AS (SELECT DISTINCT collection FROM sample_collection)
  SELECT name, max_by(collection, length(collection)) AS collection FROM n JOIN c ON starts_with(name, collection || '/') GROUP BY name""")
def raw_resolve_longest_prefix(t):
    names = t.sample_collection.select(F.concat_ws("/", "collection", F.col("sample_id").cast("string")).alias("name")).distinct()
    return views.longest_collection(names, t.sample_collection)


# writing, merging, importing ----------------------------------------------------------------------------------

_HELD = "held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, label_set_id ORDER BY id DESC) AS n FROM annotation WHERE superseded_at IS NULL) WHERE n = 1)"
_RANK = "CASE {} WHEN 'model' THEN 0 WHEN 'import' THEN 1 WHEN 'human' THEN 2 END"
_IN = """export AS (SELECT *, row_number() OVER (PARTITION BY sample_id, label_set ORDER BY export_id DESC) AS n FROM exported_sample),
  inc AS (SELECT sample_id, l.id AS label_set_id, a.state, a.value, a.source, a.created_at FROM (SELECT sample_id, label_set, unnest(answers) AS a FROM export WHERE n = 1) JOIN label_set l ON l.name = label_set WHERE a.superseded_at IS NULL)"""


def _incoming(t):
    last = t.exported_sample.groupBy("sample_id", "label_set").agg(F.max_by("answers", "export_id").alias("answers"))
    rows = last.select("sample_id", "label_set", F.explode("answers").alias("a")).where("a.superseded_at is null")
    sets = F.broadcast(t.label_set.select(F.col("id").alias("label_set_id"), F.col("name").alias("label_set")))
    return rows.join(sets, "label_set").select("sample_id", "label_set_id", "a.state", "a.value", "a.source", "a.created_at")


@query(f"""WITH {_HELD}, {_IN}, j AS (SELECT i.state, i.value, h.id AS hid, h.state AS hstate, h.value AS hvalue, {_RANK.format('i.source')} AS r, {_RANK.format('h.source')} AS hr FROM inc i LEFT JOIN held h ON h.sample_id = i.sample_id AND h.label_set_id = i.label_set_id)
  SELECT CASE WHEN state = 'skipped' AND hid IS NULL THEN 'skipped' WHEN state = 'skipped' THEN NULL WHEN hid IS NULL THEN 'copied' WHEN hstate <> 'annotated' THEN CASE WHEN r >= hr THEN 'copied' ELSE 'outranked' END
    WHEN value IS NOT DISTINCT FROM hvalue THEN CASE WHEN r > hr THEN 'confirmed' ELSE 'agreed' END WHEN r > hr THEN 'superseded' WHEN r < hr THEN 'outranked' ELSE 'conflicted' END AS verdict, count(*) AS n FROM j GROUP BY ALL""")
def merge_report(t):
    return sync.merge_verdicts(_incoming(t), t.annotation).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_HELD}, {_IN}, j AS (SELECT i.*, h.id AS hid, h.state AS hstate, h.value AS hvalue, {_RANK.format('i.source')} AS r, {_RANK.format('h.source')} AS hr,
    EXISTS (SELECT 1 FROM annotation p WHERE p.sample_id = i.sample_id AND p.label_set_id = i.label_set_id AND p.created_at = i.created_at AND p.source = i.source AND p.state = i.state AND p.value IS NOT DISTINCT FROM i.value) AS present
    FROM inc i LEFT JOIN held h ON h.sample_id = i.sample_id AND h.label_set_id = i.label_set_id)
  SELECT sample_id, label_set_id, CASE WHEN present THEN 'already' WHEN state = 'skipped' AND hid IS NULL THEN 'copied' WHEN state = 'skipped' AND hstate = 'annotated' THEN 'skips_ignored' WHEN state = 'skipped' AND r > hr THEN 'confirmed' WHEN state = 'skipped' AND r < hr THEN 'outranked' WHEN state = 'skipped' THEN 'agreed'
    WHEN hid IS NULL THEN 'copied' WHEN hstate <> 'annotated' THEN CASE WHEN hr <= r THEN 'copied' ELSE 'outranked' END WHEN value IS NOT DISTINCT FROM hvalue THEN CASE WHEN r > hr THEN 'confirmed' ELSE 'agreed' END WHEN r > hr THEN 'superseded' WHEN r < hr THEN 'outranked' ELSE 'conflicted' END AS verdict FROM j""")
def import_verdicts(t):
    return sync.import_verdicts(_incoming(t), t.annotation).select("sample_id", "label_set_id", "verdict")


@query(f"""WITH {_HELD}, b AS (SELECT DISTINCT sample_id FROM exported_sample WHERE label_set = 'mail_spans')
  SELECT CASE WHEN h.id IS NULL OR {_RANK.format('h.source')} <= 1 THEN 'annotated' ELSE 'kept' END AS verdict, h.batch AS batch, count(*) AS n FROM b LEFT JOIN held h ON h.sample_id = b.sample_id AND h.{_TRIAGE} GROUP BY ALL""")
def annotate_many(t):
    target = F.broadcast(t.label_set.where("name = 'triage'").select(F.col("id").alias("label_set_id")))
    batch = t.exported_sample.where("label_set = 'mail_spans'").select("sample_id").distinct().join(target).select(F.col("sample_id").alias("item"), "sample_id", "label_set_id", F.lit('{"kind":"choices","values":["keep"]}').alias("value"))
    return history.write_answers(t.annotation, batch, "import").groupBy("verdict", "batch").agg(F.count("*").alias("n"))


@query("""SELECT entry_id AS item, CASE WHEN count(DISTINCT s.id) = 1 THEN min(s.id) END AS sample_id, CASE WHEN count(DISTINCT s.id) = 1 THEN 'matched' WHEN count(DISTINCT s.id) = 0 THEN 'unmatched' ELSE 'ambiguous' END AS matched
  FROM manifest_sample m LEFT JOIN sample_row s ON s.checksum = m.checksum AND s.deleted_at IS NULL AND (m.type IS NULL OR m.type = s.media || '/' || s.subtype) GROUP BY entry_id""")
def import_matching(t):
    return sync.match_samples(t.manifest_sample.select(F.col("entry_id").alias("item"), "checksum", "type"), t.sample_row)


# versions ----------------------------------------------------------------------------------------------------


@query("""SELECT m.dataset_id, m.sample_id, CASE WHEN json_type(m.metadata, '$."' || (d.given_split::JSON->>'$.key') || '"') IS NULL THEN 'train'
    WHEN list_contains(CAST(json_extract(d.given_split, '$.holdout') AS VARCHAR[]), json_extract_string(m.metadata, '$."' || (d.given_split::JSON->>'$.key') || '"')) THEN 'holdout'
    WHEN list_contains(CAST(json_extract(d.given_split, '$.val') AS VARCHAR[]), json_extract_string(m.metadata, '$."' || (d.given_split::JSON->>'$.key') || '"')) THEN 'val' ELSE 'train' END AS side
  FROM manifest_sample m JOIN dataset_version d ON d.id = m.dataset_id WHERE d.given_split IS NOT NULL""")
def given_sides(t):
    return versions.given_sides(t.manifest_sample, t.dataset_version)


def _split(t):
    """(dataset_id, id, grp, side) of the members of every version, by the ratios, the grouping key and the seed it records."""
    held = t.dataset_version.select("id", "val_ratio", "holdout_ratio", "seed", "group_by").collect()
    group = F.lit(None).cast("string")
    for key in sorted({d.group_by for d in held if d.group_by}):
        group = F.when(F.col("group_by") == key, F.nullif(F.lower(F.trim(F.get_json_object("metadata", f"$['{key}']"))), F.lit(""))).otherwise(group)
    rows = t.manifest_sample.join(F.broadcast(t.dataset_version.select(F.col("id").alias("dataset_id"), "group_by")), "dataset_id")
    members = rows.select("dataset_id", F.col("sample_id").alias("id"), group.alias("grp"), "checksum")
    sided = versions.assign_many(members, {d.id: (d.val_ratio, d.holdout_ratio, d.seed) for d in held})
    return sided.join(members.select("dataset_id", "id", "grp"), ["dataset_id", "id"])


@query()
def split_assign(t):
    return _split(t).select("dataset_id", "id", "side")


@query("""SELECT dataset_id, count(*) AS members, count(DISTINCT nullif(lower(trim(json_extract_string(metadata, '$."' || group_by || '"'))), '')) AS groups, CAST(0 AS BIGINT) AS cut
  FROM manifest_sample m JOIN dataset_version d ON d.id = m.dataset_id GROUP BY dataset_id""")
def split_group_integrity(t):
    sided = _split(t)
    by = sided.where("grp is not null").groupBy("dataset_id", "grp").agg(F.countDistinct("side").alias("sides"))
    cut = by.groupBy("dataset_id").agg(F.count("*").alias("groups"), F.count_if(F.col("sides") > 1).alias("cut"))
    members = sided.groupBy("dataset_id").agg(F.count("*").alias("members"))
    return members.join(cut, "dataset_id", "left").select("dataset_id", "members", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("cut", F.lit(0)).alias("cut"))


def _units(t, *more):
    """(version, members) of every version, members as (id, grp, checksum, and more) by its grouping key."""
    for d in t.dataset_version.join(t.manifest_sample, F.col("id") == F.col("dataset_id"), "left_semi").orderBy("id").collect():
        group = F.nullif(F.lower(F.trim(F.get_json_object("metadata", f"$['{d.group_by}']"))), F.lit("")) if d.group_by else F.lit(None).cast("string")
        yield d, t.manifest_sample.where(F.col("dataset_id") == d.id).select(F.col("sample_id").alias("id"), group.alias("grp"), "checksum", *more)


@query("""WITH RECURSIVE m AS (SELECT dataset_id, sample_id, checksum, split, coalesce('g:' || nullif(lower(trim(json_extract_string(metadata, '$."' || group_by || '"'))), ''), 's:' || sample_id) AS grp FROM manifest_sample JOIN dataset_version d ON d.id = dataset_id),
  l AS (SELECT x.dataset_id, x.sample_id AS a, y.sample_id AS b FROM m x JOIN m y ON x.dataset_id = y.dataset_id AND (x.grp = y.grp OR x.checksum = y.checksum)),
  r(dataset_id, id, other) AS (SELECT dataset_id, a, a FROM l UNION SELECT r.dataset_id, r.id, l.b FROM r JOIN l ON l.dataset_id = r.dataset_id AND l.a = r.other)
  SELECT r.dataset_id, r.id, CASE WHEN count(DISTINCT m.split) = 1 THEN min(m.split) ELSE 'train' END AS side FROM r JOIN m ON m.dataset_id = r.dataset_id AND m.sample_id = r.other WHERE m.split IS NOT NULL GROUP BY r.dataset_id, r.id""")
def split_inherited(t):
    # units with a member that an earlier materialisation put on a side keep it, those torn between sides go to train
    out = None
    for d, members in _units(t, "split"):
        inherited = members.where("split is not null").select("id", F.col("split").alias("side"))
        units = versions.split_groups(members)
        bound = units.join(inherited.select("id"), "id", "left_semi").select("unit").distinct()
        sided = versions.assign_sides(members.drop("split"), d.val_ratio, d.holdout_ratio, d.seed, inherited)
        rows = sided.join(units.join(bound, "unit", "left_semi").select("id"), "id", "left_semi").select(F.lit(d.id).cast("bigint").alias("dataset_id"), "id", "side")
        out = rows if out is None else out.union(rows)
    return out


@query("""SELECT dataset_id, count(*) AS cut FROM (SELECT dataset_id, json_extract_string(metadata, '$.author') AS grp FROM manifest_sample WHERE json_extract_string(metadata, '$.author') IS NOT NULL AND split IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY dataset_id""")
def groups_cut(t):
    rows = t.manifest_sample.select("dataset_id", F.get_json_object("metadata", "$.author").alias("grp"), "split").where("grp is not null and split is not null")
    return rows.groupBy("dataset_id", "grp").agg(F.countDistinct("split").alias("sides")).where("sides > 1").groupBy("dataset_id").agg(F.count("*").alias("cut"))


@query("SELECT dataset_id, coalesce(split, 'none') AS side, count(*) AS n FROM manifest_sample GROUP BY ALL")
def split_counts(t):
    return t.manifest_sample.groupBy("dataset_id", F.coalesce("split", F.lit("none")).alias("side")).agg(F.count("*").alias("n"))


_FEATURES = {"lang": ("metadata", "lang"), "words": ("metadata", "word_count"), "tone": ("label_set", "tone")}


@query(f"""WITH {_HELD} SELECT m.dataset_id, m.sample_id AS id, json_extract_string(s.metadata, '$.lang') AS lang, json_extract_string(s.metadata, '$.word_count') AS words, h.value AS tone
  FROM manifest_sample m LEFT JOIN sample_row s ON s.id = m.sample_id LEFT JOIN held h ON h.sample_id = m.sample_id AND h.state = 'annotated' AND h.{_TONE}""")
def features_of_versions(t):
    members = t.manifest_sample.select("dataset_id", F.col("sample_id").alias("id"))
    return versions.features(members, _FEATURES, t.sample_row, t.annotation, t.label_set).select("dataset_id", "id", *_FEATURES)


@query("""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, label_set_id ORDER BY id DESC) AS n FROM annotation WHERE superseded_at IS NULL) WHERE n = 1)
  SELECT m.dataset_id, m.sample_id, h.state, h.source, CASE WHEN h.state = 'annotated' THEN h.value END AS value, CASE WHEN h.state = 'annotated' THEN h.source = 'human' END AS reviewed
  FROM manifest_sample m JOIN dataset_version d ON d.id = m.dataset_id LEFT JOIN h ON h.sample_id = m.sample_id AND h.label_set_id = d.label_set_id""")
def members_manifest(t):
    sets = F.broadcast(t.dataset_version.select(F.col("id").alias("dataset_id"), "label_set_id"))
    held = views.current(t.annotation).groupBy("sample_id", "label_set_id").agg(F.max_by(F.struct("state", "source", "value"), "id").alias("h"))
    rows = t.manifest_sample.select("dataset_id", "sample_id").join(sets, "dataset_id").join(held, ["sample_id", "label_set_id"], "left")
    answered = F.col("h.state") == "annotated"
    return rows.select("dataset_id", "sample_id", "h.state", "h.source", F.when(answered, F.col("h.value")).alias("value"), F.when(answered, F.col("h.source") == "human").alias("reviewed"))


@query("""SELECT name, max(version) AS latest, max(version) + 1 AS next, max_by(id, version) AS id FROM dataset_version GROUP BY name""")
def latest_versions(t):
    return t.dataset_version.groupBy("name").agg(F.max("version").alias("latest"), (F.max("version") + 1).alias("next"), F.max_by("id", "version").alias("id"))


@query("""WITH k AS (SELECT checksum, id, unnest(json_keys(metadata)) AS key, metadata FROM sample_row WHERE metadata IS NOT NULL),
  v AS (SELECT checksum, key, json_extract_string(metadata, '$."' || key || '"') AS value, row_number() OVER (PARTITION BY checksum, key ORDER BY id) AS n FROM k)
  SELECT checksum, key, value FROM v WHERE n = 1""")
def combine_metadata(t):
    origins = t.sample_row.join(t.sample_row.groupBy("checksum").agg(F.min("id").alias("sample_id")), "checksum").select("sample_id", "id", "metadata", "checksum")
    folded = versions.combine(origins.drop("checksum")).select("sample_id", F.explode("metadata").alias("key", "value"))
    return folded.join(t.sample_row.select(F.col("id").alias("sample_id"), "checksum"), "sample_id").select("checksum", "key", "value")


@query("""SELECT checksum, min_by(collection, export_id) AS first, count(DISTINCT trim(regexp_replace(collection, '\\s+', ' ', 'g'))) AS inputs FROM exported_sample WHERE collection IS NOT NULL GROUP BY checksum""")
def disagreeing_inputs(t):
    origins = t.exported_sample.where("collection is not null").select(F.col("export_id").alias("id"), F.col("checksum").alias("sample_id"), F.col("collection").alias("input"))
    settled, _ = versions.settle_inputs(origins, "first")
    return settled.select(F.col("sample_id").alias("checksum"), F.col("input").alias("first"), "inputs")


@query("""SELECT sample_id, label_set_id, count(*) AS rows, count(*) FILTER (superseded_at IS NULL) AS standing FROM annotation GROUP BY ALL HAVING count(*) FILTER (superseded_at IS NULL) > 1""")
def verify_one_standing(t):
    return t.annotation.groupBy("sample_id", "label_set_id").agg(F.count("*").alias("rows"), F.count_if(F.col("superseded_at").isNull()).alias("standing")).where("standing > 1")


# sources, sinks, text ----------------------------------------------------------------------------------------


@query("""SELECT checksum, media || '/' || subtype AS type, count(a.id) AS rows, max(a.created_at) AS last FROM sample_row s JOIN annotation a ON a.sample_id = s.id WHERE s.deleted_at IS NULL AND a.""" + _SET.format("note_spans") + " GROUP BY ALL")
def export_answers(t):
    from lodestack.sources import answers

    made = answers.export_answers(t.sample_row, t.annotation, t.label_set, "note_spans", "cat-local")
    return made.select("checksum", "type", F.size("rows").cast("bigint").alias("rows"), F.array_max(F.transform("rows", lambda r: r["created_at"])).cast("timestamp_ntz").alias("last"))


_BLOBS = "(SELECT checksum, max(length) AS length, min(id) AS first_id FROM sample_row GROUP BY checksum)"


@query(f"""WITH b AS (SELECT *, 512 + CAST(ceil(length / 512.0) AS BIGINT) * 512 AS size FROM {_BLOBS}), p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY first_id, checksum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM b),
  q AS (SELECT *, CAST(floor(reach / 8388608) AS BIGINT) AS shard FROM p) SELECT checksum, length, shard, CAST(reach - min(reach) OVER (PARTITION BY shard) + 512 AS BIGINT) AS "offset" FROM q""")
def repack_plan(t):
    from lodestack.sources.files import shard_plan

    blobs = t.sample_row.groupBy("checksum").agg(F.max("length").alias("length"), F.min("id").alias("first_id"))
    return shard_plan(blobs, 8 << 20)


_INNER, _OUTER = (bytes(c ^ pad for c in b"secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"""SELECT id, 'https://blobs.example/blob/' || checksum || '.txt?exp=1800000000&sig=' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(checksum || ':1800000000')))), 1, 32) AS url FROM sample_row""")
def signed_url(t):
    from lodestack.functions.signing import signed_url as signed

    return t.sample_row.select("id", signed("https://blobs.example", b"secret", F.col("checksum"), F.lit(".txt"), 1_800_000_000).alias("url"))


@query("""WITH t AS (SELECT sample_id, max(text) AS old FROM exported_sample WHERE text IS NOT NULL GROUP BY sample_id),
  r AS (SELECT a.id AS item, old, a.source = 'human' AS moved, CASE WHEN a.source = 'human' THEN 'Note.' || chr(10) || old ELSE substring(old, 1, CAST(floor(length(old) / 2) AS BIGINT)) END AS new,
    CAST(json_extract(value, '$.values[*].start') AS BIGINT[]) AS v, CAST(json_extract(value, '$.values[*].end') AS BIGINT[]) AS e FROM annotation a JOIN t USING (sample_id) WHERE superseded_at IS NULL AND json_extract_string(value, '$.kind') = 'spans'),
  s AS (SELECT item, new, k, v[k] + CASE WHEN moved THEN 6 ELSE 0 END AS guess, substring(old, v[k] + 1, e[k] - v[k]) AS txt FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM r)),
  p AS (SELECT *, list_sort(list_transform(list_filter(range(0, length(new)), lambda x: txt <> '' AND substring(new, x + 1, length(txt)) = txt), lambda x: {'d': abs(x - guess), 'x': x}))[1].x AS place FROM s)
  SELECT r.item, coalesce(string_agg(CASE WHEN place IS NOT NULL THEN place || '-' || (place + length(txt)) END, ',' ORDER BY k), '') AS spans, count(k) FILTER (place IS NULL) AS lost FROM r LEFT JOIN p ON p.item = r.item GROUP BY r.item""")
def span_remap(t):
    # answers of people meet a text with a line before it, the others the first half of their text
    from lodestack.operators.remap import remap

    spans = views.current(t.annotation).where("get_json_object(value, '$.kind') = 'spans'")
    texts = t.exported_sample.where("text is not null").groupBy("sample_id").agg(F.max("text").alias("old_text"))
    half = F.substring("old_text", F.lit(1), F.floor(F.length("old_text") / 2).cast("int"))
    new = F.when(F.col("source") == "human", F.concat(F.lit("Note.\n"), F.col("old_text"))).otherwise(half)
    moved = remap(spans.join(texts, "sample_id").select(F.col("id").alias("item"), "value", "old_text", new.alias("new_text")))
    places = F.from_json(F.get_json_object("value", "$.values"), "array<struct<start:bigint,end:bigint>>")
    return moved.select("item", F.array_join(F.transform(places, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"), "lost")


@query("SELECT a.sample_id, a.label_set_id, a.id, a.state, a.source FROM annotation a JOIN (SELECT sample_id, label_set_id, max(id) AS id FROM annotation GROUP BY ALL) m USING (id)")
def stream_answers(t):
    from lodestack.streaming.answers import run_to_end

    return run_to_end(t.spark, t.directory).select("sample_id", "label_set_id", "id", "state", "source")


@query("""SELECT checksum, count(DISTINCT media || '/' || subtype) AS types FROM sample_row WHERE deleted_at IS NULL GROUP BY checksum HAVING count(DISTINCT media || '/' || subtype) > 1""")
def remove_torn_checksums(t):
    from lodestack.operators.lineage import torn_checksums

    return torn_checksums(t.sample_row)


@query("SELECT run_id, source, count(*) AS rows, count(DISTINCT sample_id) AS samples, min(created_at) AS first_at FROM annotation WHERE run_id IS NOT NULL GROUP BY ALL")
def run_rows(t):
    return t.annotation.where("run_id is not null").groupBy("run_id", "source").agg(F.count("*").alias("rows"), F.countDistinct("sample_id").alias("samples"), F.min("created_at").alias("first_at"))


@query("""WITH i AS (SELECT DISTINCT text FROM exported_sample WHERE text IS NOT NULL), done AS (SELECT DISTINCT text FROM exported_sample WHERE sample_id IN (SELECT sample_id FROM manifest_sample WHERE split = 'holdout')),
  todo AS (SELECT text FROM i WHERE text NOT IN (SELECT text FROM done WHERE text IS NOT NULL)), o AS (SELECT text, unnest(string_split(text, chr(10) || chr(10))) AS part FROM todo WHERE length(text) >= 200), k AS (SELECT text, part FROM o WHERE part <> '')
  SELECT (SELECT count(*) FROM i) AS inputs, (SELECT count(DISTINCT text) FROM k) AS produced, (SELECT count(*) FROM i) - (SELECT count(*) FROM todo) AS already, (SELECT count(*) FROM todo) - (SELECT count(DISTINCT text) FROM k) AS emptied,
  (SELECT count(*) FROM k) AS outputs, (SELECT count(DISTINCT nfc_normalize(part)) FROM k) AS samples""")
def prepare_counts(t):
    from lodestack.operators import lineage

    def long_enough(data, meta):
        if len(data.decode()) < 200:
            raise lineage.Drop("short")
        return [(data, meta)]

    def paragraphs(data, meta):
        return [(part.encode(), meta | {"bytes": len(part)}) for part in data.decode().split("\n\n") if part]

    texts = t.exported_sample.where("text is not null")
    inputs = texts.select(F.sha2("text", 256).alias("checksum"), F.encode("text", "UTF-8").alias("content"))
    held = t.manifest_sample.where("split = 'holdout'").select("sample_id")
    done = texts.join(held, "sample_id", "left_semi").select(F.sha2("text", 256).alias("checksum")).distinct()
    outputs = lineage.prepare(inputs, [long_enough, paragraphs], done)
    already = done.agg(F.count("*").alias("known"))
    counts = lineage.prepare_counts(outputs, 0).join(already)
    return counts.select((F.col("inputs") + F.col("known")).alias("inputs"), "produced", F.col("known").alias("already"), "emptied", "outputs", "samples")


@query("SELECT DISTINCT unnest(json_keys(metadata)) AS key FROM sample_row WHERE deleted_at IS NULL AND metadata IS NOT NULL")
def metadata_keys(t):
    return selection.metadata_keys(views.live(t.sample_row))


@query(f"SELECT DISTINCT media || '/plain' AS type FROM ({_LIVE}) s WHERE id IN (SELECT sample_id FROM annotation WHERE superseded_at IS NULL AND state = 'annotated' AND {_QC})")
def default_types(t):
    return selection.default_types(t.sample_row, t.of("qc"))


@query(f"""WITH {_HELD}, m AS (SELECT DISTINCT m.sample_id, d.label_set_id, m.value FROM manifest_sample m JOIN dataset_version d ON d.id = m.dataset_id WHERE m.value IS NOT NULL)
  SELECT m.sample_id, m.label_set_id, h.value AS kept_value, m.value AS other_value FROM m JOIN held h ON h.sample_id = m.sample_id AND h.label_set_id = m.label_set_id JOIN sample_row s ON s.id = m.sample_id
  WHERE s.deleted_at IS NULL AND h.state = 'annotated' AND h.source = 'human' AND m.value IS DISTINCT FROM h.value""")
def disputed(t):
    # what the versions recorded, as answers of a person, against what stands
    sets = F.broadcast(t.dataset_version.select(F.col("id").alias("dataset_id"), "label_set_id"))
    incoming = t.manifest_sample.where("value is not null").join(sets, "dataset_id").select("sample_id", "label_set_id", "value").distinct()
    incoming = incoming.select("sample_id", "label_set_id", F.lit("annotated").alias("state"), "value", F.lit("human").alias("source"))
    clashes = sync.merge_verdicts(incoming, t.annotation).where("verdict = 'conflicted'").withColumnRenamed("value", "other_value")
    held = views.current(t.annotation).groupBy("sample_id", "label_set_id").agg(F.max_by("value", "id").alias("kept_value"))
    return sync.disputed(clashes, t.sample_row).join(held, ["sample_id", "label_set_id"]).select("sample_id", "label_set_id", "kept_value", "other_value")


# migrations and runs -----------------------------------------------------------------------------------------


@query("SELECT entry_id, CASE WHEN split = 'val' THEN 'val' ELSE 'train' END AS side FROM manifest_sample")
def migrate_sides(t):
    from lodestack.migrations import sides_of

    return sides_of(t.manifest_sample.select("entry_id", (F.col("split") == "val").alias("val")))


@query("""WITH s AS (SELECT id, unnest(range(1, len(CAST(json_extract(value, '$.values[*].start') AS BIGINT[])) + 1)) AS k, value FROM annotation WHERE json_extract_string(value, '$.kind') = 'spans')
  SELECT id, k - 1 AS place, CAST(json_extract(value, '$.values[' || (k - 1) || '].labels') AS VARCHAR[])[1] AS label, CAST(json_extract(value, '$.values[' || (k - 1) || '].start') AS BIGINT) AS start FROM s""")
def migrate_span_labels(t):
    # there and back: spans with one label as an older catalog had them, and as they are now
    from lodestack import migrations as M

    spans = "array<struct<labels:array<string>,label:string,start:bigint,end:bigint,text:string>>"
    rows = t.annotation.where("get_json_object(value, '$.kind') = 'spans'").select("id", "value")
    one = F.transform(F.from_json(F.get_json_object("value", "$.values"), spans), lambda s: F.struct(F.slice(s["labels"], 1, 1).alias("labels"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    old = M.single_labels(rows.select("id", F.to_json(F.struct(F.lit("spans").alias("kind"), one.alias("values"))).alias("value")))
    new = old.select("id", M.label_lists(F.col("value")).alias("value"))
    return new.select("id", F.posexplode(F.from_json(F.get_json_object("value", "$.values"), spans)).alias("place", "s")).select("id", F.col("place").cast("bigint").alias("place"), F.col("s.labels")[0].alias("label"), "s.start")


@query("""SELECT id, CASE split_part(subtype, '/', 1) WHEN 'frames' THEN 'video' WHEN 'email' THEN 'thread' ELSE 'group' END AS key, container AS value, coalesce(len(json_keys(metadata)), 0) + 1 AS keys FROM sample_row WHERE container IS NOT NULL""")
def migrate_group_key(t):
    from lodestack.migrations import group_key

    made = group_key(t.sample_row.where("container is not null").select("id", "subtype", "metadata", F.col("container").alias("group_id")))
    kind = F.split("subtype", "/")[0]
    key = F.when(kind == "frames", "video").when(kind == "email", "thread").otherwise("group")
    value = F.coalesce(F.get_json_object("metadata", "$.video"), F.get_json_object("metadata", "$.thread"), F.get_json_object("metadata", "$.group"))
    return made.select("id", key.alias("key"), value.alias("value"), F.size(F.json_object_keys("metadata")).cast("bigint").alias("keys"))


@query("""WITH c AS (SELECT sample_id, label_set_id, max(created_at) AS updated_at FROM annotation WHERE created_at IS NOT NULL GROUP BY ALL)
  SELECT row_number() OVER (ORDER BY updated_at, sample_id, label_set_id) AS id, sample_id, label_set_id, updated_at AS created_at FROM c""")
def migrate_history(t):
    from lodestack.migrations import history as rows_of

    cells = t.annotation.where("created_at is not null").groupBy("sample_id", "label_set_id").agg(F.max("created_at").alias("updated_at"))
    return rows_of(cells).select("id", "sample_id", "label_set_id", "created_at")


@query("SELECT id, json_extract_string(label_schema, '$.label_type') AS label_type FROM label_set")
def migrate_label_type(t):
    from lodestack.migrations import label_type

    old = F.regexp_replace("label_schema", '"label_type"', '"task"')
    return t.label_set.select("id", F.get_json_object(label_type(old), "$.label_type").alias("label_type"))


@query(f"SELECT c.id AS annotation_id, c.cls AS class_name FROM ({_ASSERTED}) c JOIN annotation a ON a.id = c.id WHERE a.state = 'annotated'")
def migrate_class_index(t):
    from lodestack.migrations import class_index

    return class_index(t.annotation, t.label_set)


@query("SELECT row_number() OVER (ORDER BY sample_id, collection, added_at NULLS FIRST) AS id, sample_id, collection FROM sample_collection")
def migrate_membership_ids(t):
    from lodestack.migrations import membership_ids

    return membership_ids(t.sample_collection).select("id", "sample_id", "collection")


@query("""WITH l AS (SELECT m.dataset_id AS list_id, s.media, s.subtype FROM manifest_sample m LEFT JOIN sample_row s ON s.checksum = m.checksum)
  SELECT list_id, CASE WHEN count(DISTINCT media || '/' || subtype) = 1 THEN min(media) END AS media, CASE WHEN count(DISTINCT media || '/' || subtype) = 1 THEN min(subtype) END AS subtype FROM l GROUP BY list_id""")
def migrate_list_types(t):
    from lodestack.migrations import list_types

    return list_types(t.manifest_sample.select(F.col("dataset_id").alias("list_id"), "checksum"), t.sample_row)


_ORIGIN = "SELECT e.sample_id, e.text, s.checksum, s.media || '/' || s.subtype AS type FROM (SELECT sample_id, max(text) AS text FROM exported_sample GROUP BY sample_id) e LEFT JOIN sample_row s ON s.id = e.sample_id"


@query(f"""WITH o AS ({_ORIGIN}) SELECT 'cannot be read' AS problem, count(*) AS n FROM o WHERE text IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'names no input', count(*) FROM o WHERE type = 'text/email' HAVING count(*) > 0
  UNION ALL SELECT 'gives an input a role or position', count(*) FROM o WHERE type <> 'text/email' AND length(text) > 500 HAVING count(*) > 0""")
def derive_problems(t):
    # a derive run of all exported texts, in which e-mails name no input and long notes give theirs a role
    from lodestack.sources import runs

    rows = t.exported_sample.groupBy("sample_id").agg(F.max("text").alias("text")).join(t.sample_row.select(F.col("id").alias("sample_id"), "checksum", F.concat_ws("/", "media", "subtype").alias("type")), "sample_id", "left")
    role = F.when(F.length("text") > 500, "part")
    origin = F.struct("checksum", "type", role.alias("role"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("metadata"))
    origins = F.when(F.col("type") == "text/email", F.array().cast(runs.ORIGINS)).otherwise(F.array(origin))
    outputs = rows.select(F.col("sample_id").cast("string").alias("file"), origins.alias("origins"), F.lit(None).cast(runs.GENERATION).alias("generation"), F.encode("text", "UTF-8").alias("content"))
    run = runs.Run("derive", "text/note", ("notes",), "query", {"all": True})
    stored = runs.canonical_files(outputs.where("content is not null").select(F.col("file").alias("path"), "content"), Types(), run.type).withColumnRenamed("path", "file")
    problems = runs.output_problems(run, outputs, stored, Types())
    return problems.groupBy(F.regexp_replace("problem", "^[^:]*: ", "").alias("problem")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT id, metadata FROM sample_row WHERE metadata IS NOT NULL)
  SELECT CAST(id AS VARCHAR) AS name, 'fold is not a number' AS problem FROM m WHERE json_exists(metadata, '$.fold') AND json_type(metadata, '$.fold') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')
  UNION ALL SELECT CAST(id AS VARCHAR), 'entity is not a string' FROM m WHERE json_exists(metadata, '$.entity') AND json_type(metadata, '$.entity') NOT IN ('VARCHAR', 'NULL')""")
def declared_key_faults(t):
    from lodestack.sources.runs import key_faults

    return key_faults(t.sample_row.select(F.col("id").cast("string").alias("name"), "metadata"), {"fold": "number", "entity": "string"})


@query("""WITH k AS (SELECT checksum, id, unnest(json_keys(metadata)) AS key, metadata FROM sample_row WHERE metadata IS NOT NULL),
  v AS (SELECT checksum, key, json_extract(metadata, '$."' || key || '"') AS value, row_number() OVER (PARTITION BY checksum, key ORDER BY id) AS n FROM k)
  SELECT checksum, key, json_type(value) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS number, CASE WHEN json_type(value) <> 'NULL' THEN CASE WHEN json_type(value) = 'VARCHAR' THEN value->>'$' END END AS text FROM v WHERE n = 1""")
def combined_origins(t):
    from lodestack.catalog import combined

    first = t.sample_row.groupBy("checksum").agg(F.min("id").alias("sample_id"))
    folded = combined(t.sample_row.join(first, "checksum").select("sample_id", F.col("id").alias("at"), "metadata")).join(first, "sample_id")
    keys = folded.select("checksum", "metadata", F.explode(F.json_object_keys("metadata")).alias("key"))
    value = F.call_function("get_json_object", F.col("metadata"), F.concat(F.lit("$['"), F.col("key"), F.lit("']")))
    raw = F.from_json("metadata", "map<string,variant>")[F.col("key")]
    kind = F.schema_of_variant(raw)
    return keys.select("checksum", "key", kind.rlike("^(BIGINT|DOUBLE|DECIMAL)").alias("number"), F.when(kind == "STRING", value).alias("text"))
