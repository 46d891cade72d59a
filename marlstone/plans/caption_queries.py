"""Queries of caption assembly, contradictions and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.operators import assembly as A
from marlstone.operators import contradiction as C
from marlstone.operators import evaluation as E
from marlstone.plans import sqltext as S
from marlstone.plans.bridge import SQL_CAPTIONS, captions, quoted, table
from marlstone.plans.sqltext import NAMES
from marlstone.sources import writers as W

QUERIES, SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def bar(x):
    return F.array_join(x, "|")


def sbar(x: str) -> str:
    return f"array_to_string({x}, '|')"


def _bucketed(spark, d):
    return A.with_buckets(A.with_profile(captions(spark, d)), key="image_id")


@query(f"{S.BASE} SELECT cat AS category, src, count(*) AS n FROM fk WHERE NOT noise GROUP BY ALL")
def classify_counts(spark, d):
    """Fragments by category and side: a count over exploded pairs, combined before its one shuffle."""
    df = _bucketed(spark, d)

    def of(pairs: str, side: int):
        return V.each("transform", F.col(pairs), f"p -> named_struct('c', p.c, 's', {side})")

    pairs = df.select(F.explode(F.concat(of("tag_pairs", 0), of("prose_pairs", 1))).alias("p"))
    counts = pairs.groupBy(F.col("p.c").alias("c"), F.col("p.s").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.get(V.strings(NAMES), F.col("c")).alias("category"), "src", "n")


_BUCKETS = f"{S.BASE}, {S.lists('NOT noise', 'b_', 'bu')}"


@query(f"{_BUCKETS} SELECT image_id, " + ", ".join(f"{sbar('b_' + n)} AS {n}" for n in NAMES) + " FROM bu")
def bucket_fragments(spark, d):
    df = _bucketed(spark, d)
    return df.select("image_id", *[bar(f"b_{n}.f").alias(n) for n in NAMES])


# fixed values: the order in which categories are packed, what each gives to another's variant, and to the zero-shot one
ORDER = ["identity", "pose_composition", "action", "wardrobe", "lighting", "setting"]
GIVES = {"identity": 3, "pose_composition": 2, "action": 2, "wardrobe": 1, "lighting": 0, "setting": 1}
SHOT_GIVES = {"lighting": 2, "setting": 3}


def _variant_sql(name: str) -> tuple[str, str]:
    """(packing expression, what the caps leave out) of a category variant."""
    fill = "list_concat(" + ", ".join(f"b_{n}" if n == name else S.head(f"b_{n}", GIVES[n]) for n in ORDER) + ")"
    over = "list_concat(" + ", ".join(f"b_{n}[{GIVES[n] + 1}:]" for n in ORDER if n != name) + ")"
    c = next(c for c in V.CATEGORIES if c.name == name)
    limit = lambda i: f"(CASE WHEN style = 'anime' THEN {c.anime[i]} ELSE {c.photo[i]} END)"
    return S.pack_words(fill, limit(0), limit(1)), over


def _variant(name: str) -> None:
    packed, over = _variant_sql(name)
    sql = f"{_BUCKETS}, pk AS (SELECT pro.image_id, trigger_word, {packed} AS p, {over} AS o FROM pro JOIN bu ON pro.image_id = bu.image_id) SELECT image_id, {S.caption('p')} AS caption, {sbar('list_concat(o, p.r)')} AS removed FROM pk"

    @query(sql, f"variant_{name}")
    def run(spark, d):
        df = _bucketed(spark, d)
        v = A.category_variant({n: F.col(f"b_{n}") for n in NAMES}, name, F.col("lead"), F.col("style"))
        return df.select("image_id", v.alias("v")).select("image_id", "v.caption", bar("v.removed").alias("removed"))


for _n in NAMES:
    _variant(_n)

_RESTORED = S.in_list(S.key("fk.f"), V.RATING_TAGS)
_SHOT_LISTS = ", ".join(f"coalesce(list(f ORDER BY o) FILTER (cat = '{n}'), []) AS z_{n}" for n in NAMES)
_SHOT = f"""{S.BASE}, zf AS (SELECT image_id, cat, f, min((CASE WHEN noise THEN 2 ELSE src END) * 100000 + pos) AS o FROM fk WHERE NOT noise OR NOT {_RESTORED} GROUP BY ALL),
zb AS (SELECT image_id, {_SHOT_LISTS} FROM zf GROUP BY image_id)"""


def _longest(n: str) -> str:
    keyed = f"list_transform(z_{n}, lambda f, i: {{'n': -len({S.words('f')}), 'i': i, 'f': f}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.f)"


_SHOT_FILL = "list_concat(" + ", ".join(S.head(f"l_{n}", SHOT_GIVES[n]) if n in SHOT_GIVES else f"l_{n}" for n in ORDER) + ")"
_SHOT_OVER = "list_concat(" + ", ".join(f"l_{n}[{SHOT_GIVES[n] + 1}:]" for n in ORDER if n in SHOT_GIVES) + ")"
_SHOT_SQL = f"""{_SHOT}, zl AS (SELECT image_id, {", ".join(f"{_longest(n)} AS l_{n}" for n in NAMES)} FROM zb),
zp AS (SELECT pro.image_id, trigger_word, {S.pack_tokens(_SHOT_FILL, "(CASE WHEN style = 'anime' THEN 12 ELSE 10 END)")} AS p, {_SHOT_OVER} AS o FROM pro JOIN zl ON pro.image_id = zl.image_id)"""


@query(f"{_SHOT_SQL} SELECT image_id, {S.caption('p')} AS caption, {sbar('list_concat(o, p.r)')} AS removed FROM zp")
def zeroshot_variant(spark, d):
    df = _bucketed(spark, d)
    v = A.zeroshot_variant({n: F.col(f"z_{n}") for n in NAMES}, F.col("lead"), F.col("style"), F.col("budget"))
    return df.select("image_id", v.alias("v")).select("image_id", "v.caption", bar("v.removed").alias("removed"))


def _compound(nouns: str) -> str:
    both = rf"regexp_extract_all(low, '\b(\w+\s+(?:{nouns}))\b', 1)"
    first, noun = r"regexp_extract(m, '^(\w+)', 1)", r"regexp_extract(m, '(\w+)$', 1)"
    return f"list_transform({both}, lambda m: CASE WHEN {S.in_list(first, V.PROSE_STOPWORDS)} THEN {noun} ELSE {first} || '_' || {noun} END)"


_TOKENS = f"""pt0 AS (SELECT image_id, tw, unnest(range(1, len(clauses) + 1)) AS ci, lower(unnest(clauses)) AS low FROM ck),
pt1 AS (SELECT image_id, tw, ci, list_concat({", ".join(_compound(n) for n in V.COMPOUND_NOUNS)}) AS cs, list_transform({S.words('low')}, lambda w: trim(w, '.,!?;:''"()[]')) AS ws FROM pt0),
pt2 AS (SELECT image_id, ci, list_concat(
  list_filter(cs, lambda t: NOT list_contains(tw, t) AND NOT list_has_any({S.words("replace(t, '_', ' ')")}, tw)),
  list_filter(ws, lambda w: length(w) > 3 AND NOT {S.in_list('w', V.PROSE_STOPWORDS)} AND NOT list_contains(tw, w))) AS ts FROM pt1),
pt3 AS (SELECT image_id, t, min(ci * 10000 + i) AS o FROM (SELECT image_id, ci, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t FROM pt2) GROUP BY ALL),
pt AS (SELECT image_id, coalesce(list(t ORDER BY o)[1:{V.ENRICHMENT_TOKENS}], []) AS tokens FROM pt3 GROUP BY image_id)"""


@query(f"{SQL_CAPTIONS}, {S.PROFILE}, {S.TAGS}, {S.CLAUSES}, {_TOKENS} SELECT ck.image_id, coalesce({sbar('tokens')}, '') AS tokens FROM ck LEFT JOIN pt ON ck.image_id = pt.image_id")
def prose_tokens(spark, d):
    df = _bucketed(spark, d)
    return df.select("image_id", bar("enrichment.f").alias("tokens"))


def _framing(f: str) -> str:
    return f"list_bool_or(list_transform({quoted(V.FRAMING_TAGS)}, lambda t: contains({S.key(f)}, t)))"


def _filter(x: str, where: str) -> str:
    return f"list_filter({x}, lambda f: {where})"


_RESCUE = f"({S.in_list(S.key('f'), V.RESCUED_TAGS)} OR {_framing('f')})"
_PRIMARY = S.in_list(S.key("f"), V.PRIMARY_POSES)
_TRAIN_LISTS = S.lists(f"src = 0 AND NOT noise AND NOT {S.in_list(S.key('f'), V.IDENTITY_TAGS)}", "t_", "tb")
_OUT = lambda n: "image_index % 4 IN (" + ", ".join(str(i) for i, o in enumerate(V.OMISSIONS) if n in o) + ")"


def _capped(n: str, tail: bool = False) -> str:
    cap = V.TRAINING_CAPS[n]
    whole, part = (f"t_{n}", f"t_{n}[{cap + 1}:]") if tail else ("[]::VARCHAR[]", f"t_{n}[1:{cap}]")
    return part if n == "lighting" else f"(CASE WHEN {_OUT(n)} THEN {whole} ELSE {part} END)"


def _train_sql(tokens: str = "tokens") -> str:
    """The CTEs up to tp (the packed training variant); ``tokens``: what the prose adds."""
    return f"""{S.BASE}, {_TRAIN_LISTS}, {_TOKENS},
ps AS (SELECT ck.*, coalesce(tokens, []) AS tokens, {", ".join(f"coalesce(t_{n}, []) AS t_{n}" for n in NAMES)} FROM ck LEFT JOIN tb ON ck.image_id = tb.image_id LEFT JOIN pt ON ck.image_id = pt.image_id),
po AS (SELECT ps.*, list_concat(t_pose_composition, {_filter('t_identity', _RESCUE)}) AS pose FROM ps),
fi AS (SELECT po.*, list_concat({_filter('pose', _framing('f'))}, {_filter('pose', f'NOT {_framing("f")} AND {_PRIMARY}')}, {_filter('pose', f'NOT {_framing("f")} AND NOT {_PRIMARY}')},
  t_action, {_capped('wardrobe')}, {_capped('lighting')}, {_capped('setting')}, {tokens}) AS fill,
  list_concat({_capped('wardrobe', True)}, {_capped('lighting', True)}, {_capped('setting', True)}) AS over, {_filter('t_identity', f'NOT {_RESCUE}')} AS lost FROM po),
tp AS (SELECT image_id, trigger_word, over, lost, {S.pack_tokens("fill", "(CASE WHEN style = 'anime' THEN 10 ELSE 8 END)")} AS p FROM fi)"""


_TRAIN_SQL = _train_sql()


@query(f"{_TRAIN_SQL} SELECT image_id, {S.caption('p')} AS caption, {sbar('list_concat(over, p.r, lost)')} AS removed FROM tp")
def training_variant(spark, d):
    df = _bucketed(spark, d)
    trained = {n: A.trainable(F.col(f"t_{n}")) for n in NAMES}
    v = A.training_variant(trained, F.col("lead"), F.col("style"), F.col("budget"), F.col("image_index"), F.col("enrichment"))
    return df.select("image_id", v.alias("v")).select("image_id", "v.caption", bar("v.removed").alias("removed"))


@query(f"""{_train_sql("CASE WHEN image_id % 2 = 0 THEN tokens ELSE []::VARCHAR[] END")} SELECT image_id, {S.with_trigger('trigger_word', 'array_to_string(p.k, chr(44) || chr(32))')} AS training FROM tp""")
def training_unenriched(spark, d):
    """The training variant of whole compositions in which every other image doesn't want its prose's words."""
    df = A.compose(captions(spark, d).withColumn("prose_enrichment", F.col("image_id") % 2 == 0), key="image_id", variants=["training"])
    return df.select("image_id", F.col("caption_variants")["training"].alias("training"))


def _composed(spark, d, variants=("training", "zeroshot")):
    return A.compose(captions(spark, d), key="image_id", variants=variants).withColumns({"raw_tags": F.col("tags"), "raw_prose": F.col("prose")})


_ALL = ", ".join(f"va{i} AS (SELECT pro.image_id, {_variant_sql(n)[0]} AS p FROM pro JOIN bu ON pro.image_id = bu.image_id)" for i, n in enumerate(NAMES))
_SELECTED = "CASE category " + " ".join(f"WHEN '{n}' THEN {S.caption(f'va{i}.p')}" for i, n in enumerate(NAMES)) + " END"
_COMPOSED = (
    f"{_TRAIN_SQL}, {S.lists('NOT noise', 'b_', 'bu')}, {_ALL}, " + _SHOT_SQL.removeprefix(S.BASE + ", ")
    + f", co AS (SELECT pro.*, {_SELECTED} AS final_caption, {S.with_trigger('pro.trigger_word', 'array_to_string(tp.p.k, chr(44) || chr(32))')} AS training, {S.with_trigger('pro.trigger_word', 'array_to_string(zp.p.k, chr(44) || chr(32))')} AS zeroshot FROM pro "
    + " ".join(f"JOIN va{i} ON va{i}.image_id = pro.image_id" for i in range(len(NAMES))) + " JOIN tp ON tp.image_id = pro.image_id JOIN zp ON zp.image_id = pro.image_id)"
).replace("trigger_word), ''), nullif(trim(array_to_string(va", "pro.trigger_word), ''), nullif(trim(array_to_string(va")


@query(f"{_COMPOSED} SELECT image_id, category AS selected_category, final_caption, training, zeroshot FROM co")
def compose_full(spark, d):
    """The flagship: every variant of every image; line items and orders are dealt by the image below, none in the assembly."""
    v = F.col("caption_variants")
    return _composed(spark, d).select("image_id", "selected_category", "final_caption", v["training"].alias("training"), v["zeroshot"].alias("zeroshot"))


_JOINED = " ".join(f"JOIN va{i} ON va{i}.image_id = co.image_id" for i in range(len(NAMES)))
_LOST = ", ".join(f"list_concat({_variant_sql(n)[1]}, va{i}.p.r)" for i, n in enumerate(NAMES))
_FILLED = f"flatten(list_transform(list_concat({S.pieces('co.tags')}, clauses), lambda t: {S.fillers_of('t')}))"
_NOTED = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in zip(("len(noise) > 0", "len(redundant) > 0", "trimmed > 0", "stripped > 0"), A.NOTES))
_REMOVED = f"""{_COMPOSED},
nz AS (SELECT image_id, coalesce(list(f ORDER BY pos) FILTER (noise), []) AS noise, count(*) FILTER (NOT noise AND {S.in_list(S.key('f'), V.IDENTITY_TAGS)}) AS stripped FROM fk WHERE src = 0 GROUP BY image_id),
ra AS (SELECT co.image_id, final_caption, redundant, coalesce(noise, []) AS noise, coalesce(stripped, 0) AS stripped, {_FILLED} AS filled, [{_LOST}] AS cut, list_concat(tp.over, tp.p.r, tp.lost, zp.o, zp.p.r) AS rest
  FROM co {_JOINED} JOIN bu ON bu.image_id = co.image_id JOIN ck ON ck.image_id = co.image_id JOIN tp ON tp.image_id = co.image_id JOIN zp ON zp.image_id = co.image_id LEFT JOIN nz ON nz.image_id = co.image_id),
rb AS (SELECT *, len(flatten(cut)) AS trimmed, list_concat(filled, noise, list_transform(redundant, lambda r: lower(r)), flatten(cut), rest) AS every FROM ra),
rc AS (SELECT image_id, min(i) AS i, arg_min(x, i) AS x FROM (SELECT image_id, unnest(every) AS x, unnest(range(1, len(every) + 1)) AS i FROM rb) WHERE trim(x) <> '' GROUP BY image_id, lower(trim(x))),
rd AS (SELECT image_id, list(x ORDER BY i) AS gone FROM rc GROUP BY image_id),
rx AS (SELECT rb.image_id, final_caption, coalesce(gone, []) AS gone, concat_ws('|', {_NOTED}) AS notes FROM rb LEFT JOIN rd ON rd.image_id = rb.image_id)"""


@query(f"{_REMOVED} SELECT image_id, CAST(len(gone) AS INTEGER) AS n, {sbar('gone')} AS removed, notes FROM rx")
def removed_phrases(spark, d):
    return _composed(spark, d).select("image_id", F.size("removed_phrases").alias("n"), bar("removed_phrases").alias("removed"), bar("compaction_notes").alias("notes"))


@query(f"{_COMPOSED} SELECT image_id AS name, final_caption, category AS selected_category, 'bridge' AS backend_name, training, zeroshot, tags AS raw_tags, prose AS raw_prose FROM co")
def csv_projection(spark, d):
    return W.csv_rows(_composed(spark, d).withColumns({"name": F.col("image_id"), "backend_name": F.lit("bridge")}))


def _sentence(n: str) -> str:
    t = S.strip(S.with_trigger("co.trigger_word", f"array_to_string(va{NAMES.index(n)}.p.k, ', ')"))
    return f"CASE WHEN {t} = '' THEN NULL WHEN regexp_matches({t}, '[.!?]$') THEN {t} ELSE {t} || '.' END"


@query(f"{_COMPOSED} SELECT co.image_id, coalesce(nullif(concat_ws(' ', {', '.join(map(_sentence, A.CONTENT_ORDER))}), ''), final_caption) AS content FROM co {_JOINED}")
def surveillance_content(spark, d):
    return _composed(spark, d, A.CONTENT_ORDER).select("image_id", A.assembled_content(F.col("caption_variants"), F.col("final_caption")).alias("content"))


@query(f"{SQL_CAPTIONS}, {S.PROFILE.replace('ELSE CAST(CASE', 'ELSE CAST(CASE')}, {S.TAGS}, {S.CLAUSES.replace('< threshold', '< 0.5').replace('>= threshold', '>= 0.5')} SELECT image_id, concat_ws(', ', nullif(trim(tags), ''), nullif(array_to_string(clauses, ', '), '')) AS caption FROM ck")
def hybrid_captions(spark, d):
    return captions(spark, d).select("image_id", A.hybrid_string(F.col("tags"), F.col("prose")).alias("caption"))


# colours and postures by rows: tags and clauses unnested, noun variants joined
_CONTRA = rf"""{SQL_CAPTIONS},
ct AS (SELECT image_id, {S.words("replace(lower(t), '_', ' ')")} AS ws FROM (SELECT image_id, unnest({S.pieces('tags', ',')}) AS t FROM cap)),
cn AS (SELECT image_id, list_filter(ws, lambda w: NOT {S.in_list('w', V.COLOURS)} AND NOT {S.in_list('w', V.NON_NOUNS)})[-1] AS noun, list_transform(list_filter(ws, lambda w: {S.in_list('w', V.COLOURS)}), lambda w: {S.canon('w')}) AS cs FROM ct),
tc AS (SELECT image_id, noun, list_sort(list_distinct(flatten(list(cs)))) AS say FROM cn WHERE noun IS NOT NULL AND len(cs) > 0 GROUP BY ALL),
pc AS (SELECT image_id, regexp_extract_all(unnest(string_split_regex(lower(prose), '[.,;:!?]|\b(?:and|with|but|while|over|under|beside|near)\b')), '([a-z]+)', 1) AS ws FROM cap),
pn AS (SELECT tc.image_id, noun, list_sort(list_distinct(flatten(list(list_transform(list_filter(ws, lambda w: {S.in_list('w', V.COLOURS)}), lambda w: {S.canon('w')}))))) AS says
  FROM tc JOIN pc ON tc.image_id = pc.image_id AND list_has_any(ws, list_concat([noun, noun || 's', noun || 'es'], CASE WHEN noun LIKE '%s' THEN [left(noun, length(noun) - 1)] ELSE [] END)) GROUP BY ALL),
cc AS (SELECT tc.image_id, 'color' AS kind, tc.noun AS subject, say, says FROM tc JOIN pn ON tc.image_id = pn.image_id AND tc.noun = pn.noun WHERE len(says) > 0),
pp AS (SELECT image_id, 'pose' AS kind, 'posture' AS subject,
  list_sort(list_intersect({quoted(V.POSTURES)}, regexp_extract_all(lower(tags), '([a-z]+)', 1))) AS say, list_sort(list_intersect({quoted(V.POSTURES)}, regexp_extract_all(lower(prose), '([a-z]+)', 1))) AS says FROM cap),
al AS (SELECT *, NOT list_has_any(say, says) AS bad FROM (SELECT * FROM cc UNION ALL SELECT * FROM pp WHERE len(say) > 0 AND len(says) > 0)),
cx AS (SELECT cap.image_id, count(kind) AS checked, count(*) FILTER (bad) AS n FROM cap LEFT JOIN al ON cap.image_id = al.image_id GROUP BY cap.image_id)"""


def _inputs(spark, d):
    return captions(spark, d).withColumns({"raw_tags": F.col("tags"), "raw_prose": F.col("prose")})


@query(f"{_CONTRA} SELECT image_id, checked, n AS contradictions, CASE WHEN checked > 0 THEN n / checked ELSE 0.0 END AS rate FROM cx")
def contradiction_rate(spark, d):
    return C.with_contradictions(_inputs(spark, d)).select("image_id", F.col("checked").cast("long").alias("checked"), F.col("count").cast("long").alias("contradictions"), "rate")


@query(f"{_CONTRA} SELECT image_id, kind, subject, {sbar('say')} AS tags_say, {sbar('says')} AS prose_says FROM al WHERE bad")
def disputes(spark, d):
    df = _inputs(spark, d).select("image_id", F.explode(C.disputes(F.col("tags"), F.col("prose"))).alias("x"))
    return df.select("image_id", "x.kind", "x.subject", bar("x.tags_say").alias("tags_say"), bar("x.prose_says").alias("prose_says"))


@query(f"{_CONTRA} SELECT image_id, subject, say[1] AS verdict FROM al WHERE bad")
def tag_prior_verdicts(spark, d):
    df = _inputs(spark, d).select("image_id", F.explode(C.disputes(F.col("tags"), F.col("prose"))).alias("x"))
    return df.select("image_id", "x.subject", C.tag_prior(F.col("x")).alias("verdict"))


@query(rf"""{_CONTRA}, v AS (SELECT image_id, say[1] AS new, says[1] AS old FROM al WHERE bad AND kind = 'pose')
SELECT cap.image_id, CASE WHEN old IS NULL THEN prose ELSE regexp_replace(prose, '\b' || old || '\b', new, 'g') END AS prose FROM cap LEFT JOIN v ON cap.image_id = v.image_id""")
def reconcile_pose(spark, d):
    found = F.get(F.filter(C.disputes(F.col("tags"), F.col("prose")), lambda x: x["kind"] == "pose"), F.lit(0))
    df = captions(spark, d).withColumn("x", found)
    return df.select("image_id", F.when(F.col("x").isNull(), F.col("prose")).otherwise(C.reposed(F.col("prose"), F.col("x.prose_says"), C.tag_prior(F.col("x")))).alias("prose"))


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _like_old(new: str, old: str) -> str:
    return f"CASE WHEN regexp_matches({old}, '^[A-Z]') THEN upper(left({new}, 1)) || lower({new}[2:]) ELSE {new} END"


def _words_swapped(text: str, hit: str) -> str:
    """The text with the words (every second bit) for which ``hit`` holds replaced by d.now."""
    swapped = f"array_to_string(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN {hit} THEN {_like_old('d.now', 'b[i]')} ELSE b[i] END), '')"
    return _let("b", rf"string_split(regexp_replace({text}, '(\b[A-Za-z]+\b)', chr(2) || '\1' || chr(2), 'g'), chr(2))", swapped)


_NEAREST = _let(
    "w", "list_transform(range(1, len(b) // 2 + 1), lambda k: lower(b[2 * k]))",
    _let("s", "list_filter(range(1, len(w) + 1), lambda k: list_contains(d.forms, w[k]))",
         f"list_sort(list_transform(list_filter(range(1, len(w) + 1), lambda k: {S.in_list('w[k]', V.COLOURS)} AND {S.canon('w[k]')} <> d.now AND len(s) > 0), "
         "lambda k: {'d': list_min(list_transform(s, lambda p: abs(p - k))), 'k': k}))[1].k"),
)
_RECOLOURED = rf"""array_to_string(list_transform(string_split(regexp_replace(a.p, '([.,;:!?]|\b(?:and|with|but|while)\b)', chr(1) || '\1' || chr(1), 'gi'), chr(1)),
  lambda part: {_words_swapped('part', f"i = coalesce(2 * {_NEAREST}, 0)")}), '')"""
_REPOSED = _words_swapped("a.p", "i % 2 = 0 AND list_contains(d.was, lower(b[i])) AND lower(b[i]) <> d.now")
_REWRITTEN = _let("q", f"CASE WHEN d.kind = 'color' THEN {_RECOLOURED} ELSE {_REPOSED} END", "{'p': q, 'n': a.n + CAST(q <> a.p AS INTEGER)}")
# disputes in order: colours as their nouns first occur in the tags, then the posture
def reconciled(settled: str) -> str:
    """The CTEs up to rw (image_id, prose, r: the new prose p after n changes), with the disputes in al for which ``settled`` holds."""
    return f"""{_CONTRA},
co AS (SELECT image_id, noun, min(o) AS o FROM (SELECT image_id, o, list_filter(ws, lambda w: NOT {S.in_list('w', V.COLOURS)} AND NOT {S.in_list('w', V.NON_NOUNS)})[-1] AS noun, len(list_filter(ws, lambda w: {S.in_list('w', V.COLOURS)})) AS n
  FROM (SELECT image_id, o, {S.words("replace(lower(t), '_', ' ')")} AS ws FROM (SELECT image_id, unnest({S.pieces('tags', ',')}) AS t, unnest(range(len({S.pieces('tags', ',')}))) AS o FROM cap))) WHERE n > 0 AND noun IS NOT NULL GROUP BY ALL),
ds AS (SELECT al.image_id, list({{'kind': kind, 'was': says, 'now': say[1], 'forms': list_concat([subject, subject || 's', subject || 'es'], CASE WHEN subject LIKE '%s' THEN [left(subject, length(subject) - 1)] ELSE [] END)}} ORDER BY kind, coalesce(o, 0)) AS ds
  FROM al LEFT JOIN co ON al.image_id = co.image_id AND subject = noun AND kind = 'color' WHERE {settled} GROUP BY al.image_id),
rw AS (SELECT cap.image_id, prose, CASE WHEN ds IS NULL THEN {{'p': prose, 'n': 0}} ELSE list_reduce(ds, lambda a, d: {_REWRITTEN}, {{'p': prose, 'n': 0}}) END AS r FROM cap LEFT JOIN ds ON cap.image_id = ds.image_id)"""


_RECONCILED = f"{reconciled('bad')} SELECT image_id, r.p AS prose, CAST(r.n AS INTEGER) AS changes FROM rw"


@query(_RECONCILED)
def reconcile_all(spark, d):
    return C.reconcile(captions(spark, d)).select("image_id", "prose", F.size("changes").alias("changes"))


@query(_RECONCILED)
def reconcile_answered(spark, d):
    """As reconcile_all, by free answers that name the tags' value."""
    df = captions(spark, d)
    said = df.select("image_id", F.explode(C.disputes(F.col("tags"), F.col("prose"))).alias("x")).select(
        "image_id", "x.kind", "x.subject", F.concat(F.lit("Hard to say; "), F.initcap(C.tag_prior(F.col("x"))), F.lit(", I think.")).alias("answer")
    )
    answers = C.questions(df, "image_id").join(said, ["image_id", "kind", "subject"])
    return C.reconcile_answered(df, "image_id", answers).select("image_id", "prose", F.size("changes").alias("changes"))


def _measured(spark, d):
    return E.with_metrics(_composed(spark, d).withColumn("expected_tags", F.slice(T.tag_list(F.concat("tags", F.lit(", blue_sky"))), 1, 4)))


@query(f"{_COMPOSED}, tt AS (SELECT image_id, budget, {S.tokens('training', 'target_backend')} AS tokens_training, {S.tokens('zeroshot', 'target_backend')} AS tokens_zeroshot FROM co) SELECT *, tokens_training > budget OR tokens_zeroshot > budget AS any_over FROM tt")
def budget_adherence(spark, d):
    return _measured(spark, d).select("image_id", "budget", "tokens_training", "tokens_zeroshot", "any_over")


@query(f"{_REMOVED}, rk AS (SELECT image_id, CAST(len(gone) AS INTEGER) AS removed, CAST(len({S.pieces('final_caption', ',')}) AS INTEGER) AS kept FROM rx) SELECT *, CASE WHEN removed + kept > 0 THEN CAST(removed AS DOUBLE) / (removed + kept) ELSE 0.0 END AS redundancy FROM rk")
def redundancy_rate(spark, d):
    return _measured(spark, d).select("image_id", "removed", "kept", "redundancy")


_PRESENT = r"len(ws) > 0 AND list_bool_and(list_transform(ws, lambda w: regexp_matches(hay, '\b' || w || '\b')))"
_COVER = f"""{_COMPOSED}, ex AS (SELECT image_id, lower(final_caption || ' ' || tags) AS hay, unnest(({S.pieces("tags || ', blue_sky'", ',')})[1:4]) AS t FROM co),
ew AS (SELECT image_id, hay, list_filter({S.words("replace(lower(t), '_', ' ')")}, lambda w: length(w) > 1) AS ws FROM ex),
eh AS (SELECT image_id, count(*) AS total, count(*) FILTER ({_PRESENT}) AS hits FROM ew GROUP BY image_id)"""


@query(f"{_COVER} SELECT image_id, hits, total, hits / total AS recall FROM eh")
def tag_coverage(spark, d):
    return _measured(spark, d).select("image_id", F.col("coverage.hits").cast("long").alias("hits"), F.col("coverage.total").cast("long").alias("total"), "coverage.recall")


_R = lambda c: f"round({c}, 9)"
_CARD = f"""{_COVER}, cx AS (SELECT * FROM ({_CONTRA} SELECT * FROM cx)),
mt AS (SELECT co.image_id, CASE WHEN checked > 0 THEN n / checked ELSE 0.0 END AS rate, n, {S.tokens('training', 'target_backend')} > budget AS ot, {S.tokens('zeroshot', 'target_backend')} > budget AS oz, hits / total AS recall
  FROM co JOIN cx ON co.image_id = cx.image_id JOIN eh ON co.image_id = eh.image_id)"""


@query(f"{_CARD} SELECT count(*) AS n, {_R('avg(rate)')} AS contradiction_rate_mean, CAST(sum(n) AS BIGINT) AS contradiction_total, {_R('avg(CAST(n > 0 AS INTEGER))')} AS items_with_contradiction_pct, {_R('avg(CAST(ot AS INTEGER))')} AS over_budget_pct_training, {_R('avg(CAST(oz AS INTEGER))')} AS over_budget_pct_zeroshot, {_R('avg(recall)')} AS coverage_recall_mean FROM mt")
def scorecard(spark, d):
    card = E.scorecard(_measured(spark, d))
    real = ["contradiction_rate_mean", "items_with_contradiction_pct", "over_budget_pct_training", "over_budget_pct_zeroshot", "coverage_recall_mean"]
    return card.select("n", "contradiction_total", *[F.round(c, 9).alias(c) for c in real])


_BASELINE = {"contradiction_rate_mean": 0.10, "items_with_contradiction_pct": 0.30, "over_budget_pct_training": 0.0, "over_budget_pct_zeroshot": 0.9, "coverage_recall_mean": 0.95}
_GATE = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS baseline, {1 if V.GATE[m] == 'lower' else -1} AS s FROM (SELECT avg(rate) AS a, avg(CAST(n > 0 AS INTEGER)) AS b, avg(CAST(ot AS INTEGER)) AS c, avg(CAST(oz AS INTEGER)) AS e, avg(recall) AS f FROM mt)"
    for (m, b), v in zip(_BASELINE.items(), "abcef")
)


@query(f"{_CARD} SELECT metric, {_R('value')} AS value, baseline, {_R('value - baseline')} AS delta, (value - baseline) * s > 0.01 AS regressed, (value - baseline) * s < -0.01 AS improved FROM ({_GATE})")
def baseline_compare(spark, d):
    base = spark.createDataFrame([tuple(_BASELINE.values())], ", ".join(f"{m} double" for m in _BASELINE))
    got = E.compare(E.scorecard(_measured(spark, d)), base)
    return got.select("metric", F.round("value", 9).alias("value"), "baseline", F.round("delta", 9).alias("delta"), "regressed", "improved")


_NESTED = "contradiction_rate_mean double, items_with_contradiction_pct string, over_budget_pct struct<training: double, zeroshot: double>, coverage_recall_mean double"


@query("""WITH c AS (SELECT avg(CAST(l_discount AS DOUBLE)) AS a, avg(CAST(l_tax AS DOUBLE)) AS b, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS e, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS f FROM lineitem),
m AS (SELECT 1 AS pos, 'contradiction_rate_mean' AS metric, a AS v, 0.02 AS w, 1 AS s FROM c UNION ALL SELECT 3, 'over_budget_pct_training', b, 0.041, 1 FROM c UNION ALL SELECT 4, 'over_budget_pct_zeroshot', e, 0.9, 1 FROM c UNION ALL SELECT 5, 'coverage_recall_mean', f, 0.95, -1 FROM c)
SELECT CAST(pos AS BIGINT) AS pos, '  ' || CASE WHEN (v - w) * s > 0.01 THEN chr(10007) WHEN (v - w) * s < -0.01 THEN chr(10003) ELSE ' ' END || ' ' || metric || ': ' || printf('%.3f', CAST(w AS DOUBLE)) || ' ' || chr(8594) || ' ' || printf('%.3f', v) || ' (' || printf('%+.3f', v - w) || ')' AS line FROM m
UNION ALL SELECT 7, CASE WHEN bool_or((v - w) * s > 0.01) THEN '  verdict: REGRESSED' ELSE '  verdict: OK' END FROM m""")
def baseline_report(spark, d):
    """A scorecard against a recorded one with nested metrics, one of which isn't a number."""
    base = spark.createDataFrame([(0.02, "unknown", (0.041, 0.9), 0.95)], _NESTED)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    card = table(spark, d, "lineitem").agg(
        F.avg(F.col("l_discount").cast("double")).alias("contradiction_rate_mean"), F.lit(0.5).alias("items_with_contradiction_pct"), F.avg(F.col("l_tax").cast("double")).alias("over_budget_pct_training"),
        share(F.col("l_returnflag") == "R").alias("over_budget_pct_zeroshot"), share(F.col("l_linestatus") == "O").alias("coverage_recall_mean"),
    )
    return E.comparison_report(E.compare(card, E.flattened(base)))
