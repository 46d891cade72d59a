"""Queries of the text algebra, profiles, filters, labels and relational steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.operators import assembly as A
from marlstone.operators import batch as B
from marlstone.operators import labels as L
from marlstone.plans import sqltext as S
from marlstone.plans.bridge import LABELS, SQL_CAPTIONS, SQL_TAG_ROWS, captions, quoted, sql_pick, table, tag_rows
from marlstone.sources import readers as R
from marlstone.sources import writers as W

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bar(x):
    return F.array_join(x, "|")


def sbar(x: str) -> str:
    return f"array_to_string({x}, '|')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


DOC = "coalesce(text, '')"


@query(f"SELECT doc_id, len(p) AS n, md5({sbar('p')}) AS digest FROM (SELECT doc_id, {S.pieces(DOC)} AS p FROM documents)")
def split_pieces(spark, d):
    return _docs(spark, d).select("doc_id", T.pieces(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(bar("p")).alias("digest"))


@query(f"SELECT doc_id, len(p) AS n, md5({sbar('p')}) AS digest FROM (SELECT doc_id, {S.sentences(DOC)} AS p FROM documents)")
def split_sentences(spark, d):
    return _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(bar("p")).alias("digest"))


@query(f"SELECT doc_id, {S.clip(DOC)} AS clip, {S.t5(DOC)} AS t5 FROM documents")
def token_counts(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.clip_tokens(t).alias("clip"), T.t5_tokens(t).alias("t5"))


@query(f"{SQL_CAPTIONS} SELECT image_id, {S.tokens('tags', 'target_backend')} AS tag_tokens, {S.tokens('prose', 'target_backend')} AS prose_tokens FROM cap")
def token_estimate_by_backend(spark, d):
    b = F.col("target_backend")
    return captions(spark, d).select("image_id", T.tokens(F.col("tags"), b).alias("tag_tokens"), T.tokens(F.col("prose"), b).alias("prose_tokens"))


@query(f"{SQL_CAPTIONS} SELECT image_id, {sbar('list_transform(s, lambda x: ' + S.without_fillers('x') + ')')} AS clean, {sbar('flatten(list_transform(s, lambda x: ' + S.fillers_of('x') + '))')} AS removed FROM (SELECT image_id, {S.sentences('prose')} AS s FROM cap)")
def filler_strip(spark, d):
    s = captions(spark, d).select("image_id", T.sentences(F.col("prose")).alias("s"))
    return s.select("image_id", bar(F.transform("s", T.without_fillers)).alias("clean"), bar(F.flatten(F.transform("s", T.fillers_of))).alias("removed"))


@query(f"{SQL_CAPTIONS} SELECT image_id, {sbar(S.normalised(S.pieces('prose')))} AS fragments FROM cap")
def normalise_fragments(spark, d):
    return captions(spark, d).select("image_id", bar(T.normalised(T.pieces(F.col("prose")))).alias("fragments"))


@query(f"{SQL_CAPTIONS} SELECT image_id, {sbar('list_sort(' + S.content('prose') + ')')} AS words, {sbar('list_sort(' + S.tag_words('tags') + ')')} AS tag_words FROM cap")
def content_words(spark, d):
    return captions(spark, d).select("image_id", bar(F.array_sort(T.content_words(F.col("prose")))).alias("words"), bar(F.array_sort(T.tag_words(F.col("tags")))).alias("tag_words"))


@query(f"""{SQL_CAPTIONS}, u AS (SELECT image_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS f FROM (SELECT image_id, {S.pieces('tags', ',')} AS p FROM cap)),
k AS (SELECT image_id, lower(f) AS k, min(i) AS i, arg_min(f, i) AS f FROM u GROUP BY ALL)
SELECT image_id, string_agg(f, '|' ORDER BY i) AS kept, count(*) AS n FROM k GROUP BY image_id""")
def dedupe_fragments(spark, d):
    k = captions(spark, d).filter("tags <> ''").select("image_id", T.dedupe(T.tag_list(F.col("tags"))).alias("k"))
    return k.select("image_id", bar("k").alias("kept"), F.size("k").cast("long").alias("n"))


@query(f"{SQL_CAPTIONS} SELECT image_id, {S.with_trigger('trigger_word', 'tags')} AS caption FROM cap")
def trigger_join(spark, d):
    return captions(spark, d).select("image_id", T.with_trigger(F.col("trigger_word"), F.col("tags")).alias("caption"))


@query(f"{SQL_CAPTIONS}, {S.PROFILE} SELECT image_id, style, category, backend, budget, round(threshold, 9) AS threshold FROM pro")
def target_profile(spark, d):
    return A.with_profile(captions(spark, d)).select("image_id", "style", "category", "backend", "budget", F.round("threshold", 9).alias("threshold"))


_NOISE = S.in_list(S.key("f"), V.NOISE_TAGS)


@query(f"{SQL_CAPTIONS}, {S.PROFILE}, {S.TAGS} SELECT image_id, {sbar(f'list_filter(tf, lambda f: NOT {_NOISE})')} AS kept, {sbar(f'list_filter(tf, lambda f: {_NOISE})')} AS removed, {sbar(f'list_filter(tf, lambda f: NOT ' + S.in_list(S.key('f'), V.NOISE_TAGS + V.IDENTITY_TAGS) + ')')} AS kept_strict FROM tl")
def noise_filter(spark, d):
    f = captions(spark, d).select("image_id", T.normalised(T.pieces(F.col("tags"))).alias("f"))
    return f.select(
        "image_id", bar(F.filter("f", lambda x: ~T.is_noise(x))).alias("kept"), bar(F.filter("f", lambda x: T.is_noise(x))).alias("removed"),
        bar(F.filter("f", lambda x: ~T.is_noise(x, True))).alias("kept_strict"),
    )


@query(f"{SQL_CAPTIONS}, {S.PROFILE}, {S.TAGS}, {S.CLAUSES} SELECT image_id, {sbar('clauses')} AS kept, {sbar('redundant')} AS redundant FROM ck")
def redundancy_filter(spark, d):
    df = A.with_profile(captions(spark, d))
    args = (F.col("prose"), F.col("tags"), F.col("threshold"))
    return df.select("image_id", bar(T.kept_clauses(*args)).alias("kept"), bar(T.redundant_clauses(*args)).alias("redundant"))


@query(f"SELECT image_id, nth, part, label, list_contains({quoted(V.FRAMING_TAGS)}, {S.key('label')}) OR list_bool_or(list_transform({quoted(V.FRAMING_TAGS)}, lambda t: contains({S.key('label')}, t))) AS framing, list_contains({quoted(V.PRIMARY_POSES)}, {S.key('label')}) AS pose FROM (SELECT DISTINCT image_id, nth, part, label FROM ({SQL_TAG_ROWS}))")
def pose_predicates(spark, d):
    rows = tag_rows(spark, d).select("image_id", "nth", "part", "label").distinct()
    return rows.select("image_id", "nth", "part", "label", T.is_framing(F.col("label")).alias("framing"), T.is_primary_pose(F.col("label")).alias("pose"))


def _scored(spark, d):
    t = tag_rows(spark, d).withColumn("score", F.when(F.col("nth") == 3, None).otherwise(F.col("score")))
    rows = F.array_sort(F.collect_list(F.struct("nth", "part", "label", "score")))
    return t.groupBy("image_id").agg(F.transform(rows, lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score"), F.lit(None).cast("string").alias("source"))).alias("t"))


_SCORED = f"(SELECT image_id, nth, part, label, CASE WHEN nth <> 3 THEN score END AS score FROM ({SQL_TAG_ROWS}))"


@query(f"SELECT image_id, coalesce(string_agg(label, ', ' ORDER BY nth, part, score NULLS FIRST) FILTER (score IS NULL OR score >= 0.5), '') AS tags FROM {_SCORED} GROUP BY image_id")
def score_threshold(spark, d):
    return _scored(spark, d).select("image_id", T.tag_string(F.col("t"), F.lit(0.5)).alias("tags"))


@query(f"SELECT image_id, count(*) AS n, count(*) FILTER (score IS NULL OR score >= 0.5) AS included, string_agg(CASE WHEN score IS NULL OR score >= 0.5 THEN '1' ELSE '0' END, '' ORDER BY nth, part, score NULLS FIRST) AS flags FROM {_SCORED} GROUP BY image_id")
def provenance_flags(spark, d):
    p = _scored(spark, d).select("image_id", L.provenance(F.col("t"), F.lit("ram"), F.lit(0.5)).alias("p"))
    flags = F.transform("p.tags", lambda t: F.when(t["included"], "1").otherwise("0"))
    return p.select("image_id", F.size("p.tags").cast("long").alias("n"), F.size(F.filter("p.tags", lambda t: t["included"])).cast("long").alias("included"), F.array_join(flags, "").alias("flags"))


@query("""WITH v AS (SELECT p_partkey AS pos, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 9 ELSE 0 END AS category FROM part),
s AS (SELECT l_orderkey AS image_id, l_partkey AS pos, max(CAST(l_quantity AS DOUBLE) / 50) AS prob FROM lineitem GROUP BY ALL)
SELECT image_id, string_agg(name, ', ' ORDER BY s.pos) AS tags FROM s JOIN v ON s.pos = v.pos WHERE prob > 0.35 AND category <> 9 GROUP BY image_id""")
def tagger_selection(spark, d):
    part = table(spark, d, "part")
    vocab = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, 9).otherwise(0).alias("category"))
    li = table(spark, d, "lineitem")
    scores = li.groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("pos")).agg(F.max(F.col("l_quantity").cast("double") / 50).alias("prob"))
    return L.select_tags(scores, vocab)


@query(f"WITH u AS (SELECT DISTINCT label FROM ({SQL_TAG_ROWS})) SELECT label, {S.lookup({'trees': 'forest', 'city street': 'street'}, 'lower(trim(label))', 'lower(trim(label))')} AS canonical FROM u")
def taxonomy_by_table(spark, d):
    synonyms = spark.createDataFrame([("trees", "forest"), ("city street", "street")], "alias string, canonical string")
    return L.canonical_by_table(tag_rows(spark, d).select("label").distinct(), "label", synonyms)


_CANON = S.lookup(V.SYNONYMS, "lower(trim(w))", "lower(trim(w))")


@query(f"""{SQL_CAPTIONS}, w AS (SELECT image_id, i, w FROM (SELECT image_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS w FROM (SELECT image_id, {S.pieces("tags || ', Automobile, car, photograph'", ',')} AS p FROM cap))),
e AS (SELECT image_id, i, unnest(range(0, 3)) AS j, unnest(list_resize(list_concat([{_CANON}], coalesce({S.lookup(V.PARENTS, _CANON)}, [])), 3)) AS l FROM w),
k AS (SELECT image_id, l, min(i * 10 + j) AS o FROM e WHERE l IS NOT NULL GROUP BY ALL)
SELECT image_id, string_agg(l, '|' ORDER BY o) AS labels FROM k GROUP BY image_id""")
def taxonomy_normalise(spark, d):
    tags = T.tag_list(F.concat("tags", F.lit(", Automobile, car, photograph")))
    return captions(spark, d).select("image_id", bar(L.normalise_labels(tags, True)).alias("labels"))


_RGB = [f"(({'{r}'} - {r}) * ({'{r}'} - {r}) + ({'{g}'} - {g}) * ({'{g}'} - {g}) + ({'{b}'} - {b}) * ({'{b}'} - {b}))" for r, g, b in V.PALETTE.values()]


@query(
    "WITH p AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part), "
    "n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(V.PALETTE.items())) + ") AS t(i, name, x, y, z)) "
    "SELECT p_partkey, arg_min(name, ((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)) * 100 + i) AS colour FROM p, n GROUP BY p_partkey"
)
def nearest_colour(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", T.nearest_colour(k * 37 % 256, k * 91 % 256, k * 53 % 256).alias("colour"))


@query(rf"""WITH a AS (SELECT p_partkey, 'It is ' || p_name || ', standing.' AS answer FROM part),
w AS (SELECT p_partkey, list_transform({S.words('lower(answer)')}, lambda x: trim(x, '.,!?;:''"()')) AS ws FROM a)
SELECT p_partkey, {S.canon(f"list_filter(ws, lambda x: {S.in_list('x', V.COLOURS)})[1]")} AS colour, list_filter(ws, lambda x: {S.in_list('x', V.POSTURES)})[1] AS posture FROM w""")
def parse_answer(spark, d):
    answer = F.concat(F.lit("It is "), "p_name", F.lit(", standing."))
    return table(spark, d, "part").select("p_partkey", T.parse_answer(F.lit("color"), answer).alias("colour"), T.parse_answer(F.lit("pose"), answer).alias("posture"))


@query("SELECT page_id, coalesce(nullif(string_split(string_split(url, '?')[1], '/')[-1], ''), 'image') AS name FROM pages")
def source_names(spark, d):
    return table(spark, d, "pages").select("page_id", R.file_name(F.col("url")).alias("name"))


# recorded captions: an asset per document, versions from the turns of a conversation with its number
_ASSETS = "WITH a AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha256, 'doc://' || doc_id AS uri FROM documents), c AS (SELECT conv_id AS asset_id, turn AS version, role AS created_at, md5(coalesce(text, '')) AS final_caption FROM conversations), q AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN sha256(coalesce(text, '')) ELSE 'none' END AS sha256, CASE WHEN doc_id % 2 = 0 THEN 'doc://' || doc_id END AS uri FROM documents)"


def _recorded(spark, d):
    docs = _docs(spark, d)
    sha, uri = F.sha2("text", 256), F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    assets = docs.select(F.col("doc_id").alias("id"), sha.alias("sha256"), uri.alias("uri"))
    caps = table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("version"), F.col("role").alias("created_at"), F.md5(F.coalesce("text", F.lit(""))).alias("final_caption"))
    want = docs.select(F.col("doc_id").alias("k"), F.when(F.col("doc_id") % 3 == 0, sha).otherwise("none").alias("sha256"), F.when(F.col("doc_id") % 2 == 0, uri).alias("uri"))
    return want, assets, caps


_BY = "SELECT a.{k} AS key, arg_max(final_caption, version * 1000 + CASE created_at WHEN 'user' THEN 3 WHEN 'system' THEN 2 ELSE 1 END) AS f FROM a JOIN c ON a.id = c.asset_id GROUP BY a.{k}"


@query(f"{_ASSETS}, s AS ({_BY.format(k='sha256')}), u AS ({_BY.format(k='uri')}) SELECT k, CASE WHEN s.key IS NOT NULL THEN 'sha256' WHEN u.key IS NOT NULL THEN 'uri' END AS matched_by, coalesce(s.f, u.f) AS caption FROM q LEFT JOIN s ON q.sha256 = s.key LEFT JOIN u ON q.uri = u.key")
def replay_lookup(spark, d):
    got = B.replay(*_recorded(spark, d))
    return got.select("k", "matched_by", F.col("final_caption").alias("caption"))


@query(f"{_ASSETS}, l AS (SELECT asset_id, max(version) AS version FROM c GROUP BY asset_id) SELECT asset_id, version FROM l")
def replay_latest(spark, d):
    return B.latest_captions(_recorded(spark, d)[2]).select("asset_id", "version")


@query(f"{_ASSETS}, s AS ({_BY.format(k='sha256')}), u AS ({_BY.format(k='uri')}) SELECT k, matched_by FROM (SELECT k, CASE WHEN s.key IS NOT NULL THEN 'sha256' WHEN u.key IS NOT NULL THEN 'uri' END AS matched_by FROM q LEFT JOIN s ON q.sha256 = s.key LEFT JOIN u ON q.uri = u.key) WHERE matched_by IS NOT NULL")
def replay_misses(spark, d):
    """Misses are left out of the replay."""
    return B.replay(*_recorded(spark, d), on_miss="skip").select("k", "matched_by")


_LAST = "SELECT a.{k} AS key, max(version) AS v, arg_max(final_caption, version * 1000 + CASE created_at WHEN 'user' THEN 3 WHEN 'system' THEN 2 ELSE 1 END) AS f FROM a JOIN c ON a.id = c.asset_id GROUP BY a.{k}"


@query(f"{_ASSETS}, s AS ({_LAST.format(k='sha256')}), u AS ({_LAST.format(k='uri')}) SELECT k, coalesce(s.f, u.f) AS caption, 'identity' AS category, 'replay' AS backend, q.sha256 AS asset_sha256, q.uri AS asset_uri, CAST(coalesce(s.v, u.v) AS BIGINT) AS caption_version FROM q LEFT JOIN s ON q.sha256 = s.key LEFT JOIN u ON q.uri = u.key WHERE s.key IS NOT NULL OR u.key IS NOT NULL")
def replay_results(spark, d):
    """Replayed rows as results: defaults for what wasn't recorded, and where each comes from."""
    got = B.replayed_results(B.replay(*_recorded(spark, d)))
    return got.select("k", F.col("final_caption").alias("caption"), F.col("selected_category").alias("category"), F.col("backend_name").alias("backend"), *[f"replay.{c}" for c in ("asset_sha256", "asset_uri", "caption_version")])


@query("WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS s, coalesce(text, '') AS t FROM documents) SELECT doc_id, length(t) AS inferred FROM h")
def batch_dedupe(spark, d):
    images = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), "text")
    done = B.infer_once(images.select("sha256", "doc_id", "text"), lambda once: once.select("sha256", F.length("text").cast("long").alias("inferred")))
    return done.select("doc_id", "inferred")


@query("SELECT source AS name, min(doc_id) AS position, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def result_last_wins(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("idx"), "lang")
    return B.last_wins(rows)


@query("""WITH r AS (SELECT o_orderkey AS idx, '/x/' || (o_custkey % 500) || '/' || (o_orderkey % 7) || CASE WHEN o_orderkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'bad' END AS error FROM orders),
s AS (SELECT *, regexp_replace(path, '\\.[a-z]+$', '') || '.txt' AS sidecar FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY sidecar, error IS NULL ORDER BY idx) AS n FROM s)
SELECT idx, sidecar, coalesce(error, CASE WHEN n > 1 THEN 'sidecar already written: ' || sidecar END) AS error FROM n""")
def sidecar_collisions(spark, d):
    return _outcomes(spark, d).select("idx", "sidecar", "error")


def _outcomes(spark, d):
    i = F.col("o_orderkey")
    path = F.concat(F.lit("/x/"), (F.col("o_custkey") % 500).cast("string"), F.lit("/./"), (i % 7).cast("string"), F.when(i % 2 == 0, ".jpg").otherwise(".png"))
    rows = table(spark, d, "orders").select(i.alias("idx"), path.alias("path"), F.when(i % 11 == 0, "bad").alias("error"))
    return B.sidecar_outcomes(rows)


@query("""WITH r AS (SELECT o_orderkey AS idx, (o_custkey % 500) * 10 + o_orderkey % 7 AS p, o_orderkey % 11 = 0 AS bad FROM orders),
n AS (SELECT *, bad OR row_number() OVER (PARTITION BY p, bad ORDER BY idx) > 1 AS failed FROM r)
SELECT count(*) AS total, count(*) FILTER (NOT failed) AS captioned, count(*) FILTER (failed) AS failed, 0 AS xmp_written FROM n""")
def batch_summary(spark, d):
    return B.summary(_outcomes(spark, d))


_KIND = "CASE {0} % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' ELSE '' END"


@query(f"""WITH a AS (SELECT o_orderkey AS pos, o_custkey || {_KIND.format('o_custkey')} AS basename, o_custkey % 4 AS m FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY basename ORDER BY pos) AS n FROM a),
h AS (SELECT c_custkey || {_KIND.format('c_custkey')} AS b FROM customer WHERE c_custkey % 3 = 0)
SELECT pos, basename, CASE WHEN n > 1 THEN 'collision' WHEN basename IN (SELECT b FROM h) THEN 'skip' ELSE 'fetch' END AS action,
  CASE WHEN n > 1 THEN NULL WHEN m = 2 THEN 'not captionable: ''.mp4'' is not a supported image type' WHEN m = 3 THEN 'not captionable: file has no extension' END AS warning FROM n""")
def pull_plan(spark, d):
    def name(k):
        return F.concat(F.col(k).cast("string"), F.expr(_KIND.format(k)))

    assets = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("albums/"), name("o_custkey")).alias("path"))
    have = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(name("c_custkey").alias("basename"))
    return B.pull_plan(assets, have).select("pos", "basename", "action", "warning")


@query("SELECT '/x/' || o_orderkey || '.png' AS path FROM orders WHERE o_custkey % 3 <> 0")
def skip_captioned(spark, d):
    i = F.col("o_orderkey").cast("string")
    orders = table(spark, d, "orders")
    done = orders.filter("o_custkey % 3 = 0").select(F.concat(F.lit("/x/"), i, F.lit(".TXT")).alias("path"))
    return B.skip_captioned(orders.select(F.concat(F.lit("/x/"), i, F.lit(".png")).alias("path")), done)


@query("SELECT source AS folder, least(count(*), 5000) AS images FROM documents GROUP BY source")
def folder_counts(spark, d):
    return B.folder_counts(table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")))


@query("""WITH f AS (SELECT CASE WHEN o_orderstatus = 'P' THEN '.P' ELSE o_orderstatus END AS name, o_orderpriority AS sub, o_orderkey % 5 <> 0 AS image FROM orders)
SELECT name, 'all/' || name AS rel_path, least(count(*) FILTER (image), 5000) AS image_count, count(DISTINCT CASE WHEN sub NOT LIKE '1%' THEN sub END) AS subfolder_count FROM f WHERE name <> '.P' GROUP BY name""")
def folder_browse(spark, d):
    """Folders of two levels; one of each level is hidden."""
    name = F.when(F.col("o_orderstatus") == "P", ".P").otherwise(F.col("o_orderstatus"))
    sub = F.concat(F.when(F.startswith("o_orderpriority", F.lit("1")), ".").otherwise(""), "o_orderpriority")
    file = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".txt").otherwise(".JPG"))
    return B.browse(table(spark, d, "orders").select(F.concat_ws("/", F.lit("all"), name, sub, file).alias("path")), "all")[0]


@query("SELECT o_orderkey AS path, row_number() OVER (ORDER BY o_orderkey) - 1 AS image_index FROM orders")
def image_index(spark, d):
    return B.image_index(table(spark, d, "orders").select(F.col("o_orderkey").alias("path")), "path")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 50 = 0) SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM a)""")
def missing_assets(spark, d):
    assets = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").cast("string").alias("id"))
    return B.wanted_assets(assets, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id")))[1]


@query("""WITH r AS (SELECT o_orderkey AS line, o_orderkey % 6 AS m FROM orders)
SELECT line, CASE m WHEN 2 THEN '/root/a/' || line || '.jpg' WHEN 0 THEN '/i/' || line || '.jpg' WHEN 4 THEN '/i/x.jpg' END AS image_path,
  CASE m WHEN 1 THEN 'line ' || line || ': invalid JSON' WHEN 5 THEN 'line ' || line || ': unsupported manifest_version' END AS fatal,
  CASE m WHEN 3 THEN 'exported_path leaves the export root' WHEN 4 THEN 'target_profile must be an object' END AS error FROM r""")
def manifest_rows(spark, d):
    i = F.col("o_orderkey").cast("string")
    cases = [
        F.concat(F.lit('{"abs_path": "/i/'), i, F.lit('.jpg", "target_profile": {"target_style": "photo"}}')), F.lit("{bad"),
        F.concat(F.lit('{"manifest_version": "2.1", "exported_path": "x/../a/'), i, F.lit('.jpg"}')), F.lit('{"exported_path": "../../etc"}'),
        F.lit('{"abs_path": "/i/x.jpg", "target_profile": 3}'), F.lit('{"manifest_version": "3.0", "abs_path": "/i/y.jpg"}'),
    ]
    value = F.element_at(F.array(*cases), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = R.curator_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), value.alias("value")), "/root")
    return rows.select("line", F.when(F.col("fatal").isNull(), F.col("image_path")).alias("image_path"), "fatal", "error")


@query(f"{SQL_CAPTIONS} SELECT image_id, {sbar(S.pieces('tags', ','))} AS keywords FROM cap")
def keywords(spark, d):
    return captions(spark, d).select("image_id", bar(W.keywords(F.col("tags"))).alias("keywords"))


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"{SQL_CAPTIONS} SELECT image_id, md5('{W.XMP_HEAD}' || array_to_string(list_transform({S.pieces('tags', ',')}, lambda k: '     <rdf:li>' || {_ESC.format('k')} || '</rdf:li>'), chr(10)) || '{W.XMP_MIDDLE}' || {_ESC.format('prose')} || ' &amp; &lt;more&gt;' || '{W.XMP_TAIL}') AS packet FROM cap"
)
def xmp_packets(spark, d):
    text = F.concat("prose", F.lit(" & <more>\x01"))
    return captions(spark, d).select("image_id", F.md5(W.xmp(text, W.keywords(F.col("tags")))).alias("packet"))


@query("SELECT e.id AS vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS cosine FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e JOIN (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings) f ON f.id = e.id - e.id % 10")
def clip_cosine(spark, d):
    from marlstone.operators.evaluation import cosine

    e = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    f = e.select(F.col("vec_id").alias("key"), F.col("v").alias("w"))
    return e.join(f, F.col("vec_id") - F.col("vec_id") % 10 == F.col("key")).select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query(f"SELECT DISTINCT label, {sql_pick(['color', 'pose'], 'nth')} AS kind, CASE WHEN nth % 2 = 0 THEN '{T.COLOUR_QUESTION[0]}' || label || '{T.COLOUR_QUESTION[1]}' ELSE '{T.POSTURE_QUESTION.replace(chr(39), chr(39) * 2)}' END AS question FROM ({SQL_TAG_ROWS})")
def verifier_questions(spark, d):
    kind = F.when(F.col("nth") % 2 == 0, "color").otherwise("pose")
    return tag_rows(spark, d).select("label", kind.alias("kind"), T.question(kind, F.col("label")).alias("question")).distinct()


assert len(LABELS) == 48
