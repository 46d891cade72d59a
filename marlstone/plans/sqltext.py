"""The text algebra as DuckDB expressions, for checking the Spark forms."""

from __future__ import annotations

from marlstone.functions import vocab as V
from marlstone.plans.bridge import SQL_CAPTIONS, quoted

FILLERS = "|".join(V.FILLERS)


def strip(x: str, chars: str | None = None) -> str:
    return f"trim({x}, '{chars}')" if chars else rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def pieces(x: str, on: str = "[.;,]") -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '{on}'), lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    cut = rf"string_split_regex(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|;\s*')"
    return f"list_filter(list_transform({cut}, lambda p: trim(p, ' ,;.')), lambda p: p <> '')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def without_fillers(x: str) -> str:
    return rf"trim(regexp_replace({squeeze(x)}, '(?i)^(?:(?:{FILLERS})[ ,:\-]*)+', ''), ' ,.;:-')"


def fillers_of(x: str) -> str:
    head = rf"regexp_extract({squeeze(x)}, '(?i)^((?:(?:{FILLERS})[ ,:\-]*)+)', 1)"
    return f"list_transform(regexp_extract_all(lower({head}), '({FILLERS})', 1), lambda p: trim(p))"


def normalised(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda f: lower({without_fillers('f')})), lambda f: f <> '')"


def key(x: str) -> str:
    return f"replace(trim(lower({x})), ' ', '_')"


def content(x: str) -> str:
    """Distinct content words of a text."""
    long = rf"list_filter(string_split_regex({x}, '\s+'), lambda w: length(w) > 1)"
    bare = f"list_transform({long}, lambda w: trim(lower(w), '.,!?;:''\"'))"
    return f"list_distinct(list_filter({bare}, lambda w: NOT list_contains({quoted(V.STOPWORDS)}, w)))"


def tag_words(x: str) -> str:
    every = f"flatten(list_transform(string_split({x}, ','), lambda p: {content('p')}))"
    stems = (
        "list_concat([w], CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN [left(w, length(w) - 3)] ELSE [] END, "
        "CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN [left(w, length(w) - 2)] ELSE [] END, CASE WHEN w LIKE '%s' AND length(w) > 4 THEN [left(w, length(w) - 1)] ELSE [] END)"
    )
    return f"list_distinct(flatten(list_transform({every}, lambda w: {stems})))"


def count(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, '{c}', '')))"


def clip(x: str) -> str:
    return f"CAST(trunc(len({words(x)}) * CAST(1.3 AS DOUBLE)) + {count(x, ',')} + {count(x, '_')} AS INTEGER)"


def t5(x: str) -> str:
    return f"CAST(trunc(len({words(x)}) * CAST(1.1 AS DOUBLE)) + {count(x, ',')} AS INTEGER)"


def tokens(x: str, backend: str = "backend") -> str:
    return f"(CASE WHEN coalesce(trim(lower({backend})) IN ('flux', 'sd3', 'kolors', 'pixart'), false) THEN {t5(x)} ELSE {clip(x)} END)"


def with_trigger(t: str, rest: str) -> str:
    return f"concat_ws(', ', nullif(trim({t}), ''), nullif(trim({rest}), ''))"


def lookup(table: dict, x: str, default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN " + (quoted(v) if isinstance(v, (list, tuple)) else f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + f" ELSE {default} END"


def canon(x: str) -> str:
    return lookup(V.COLOUR_FOLDS, x, x)


NAMES = [c.name for c in V.CATEGORIES]
PROFILE = f"""pro AS (SELECT cap.*,
  CASE WHEN trim(lower(coalesce(target_style, ''))) IN ('photo', 'anime') THEN trim(lower(target_style))
       WHEN regexp_matches(lower(concat_ws(' ', checkpoint, target_backend)), '{V.ANIME_MARKS}') THEN 'anime' ELSE 'photo' END AS style,
  CASE WHEN list_contains({quoted(NAMES)}, translate(trim(lower(target_category)), '- ', '__')) THEN translate(trim(lower(target_category)), '- ', '__') ELSE 'identity' END AS category,
  coalesce(trim(target_backend), 'sdxl') AS backend,
  CAST({lookup(V.BUDGETS, "lower(trim(coalesce(target_backend, 'sdxl')))", "60")} AS INTEGER) AS budget,
  CASE WHEN prose_bias IS NOT NULL THEN CAST(0.15 AS DOUBLE) + least(1.0, greatest(0.0, prose_bias)) * (CAST(0.9 AS DOUBLE) - CAST(0.15 AS DOUBLE))
       ELSE CAST({lookup(V.PRESETS, "translate(trim(lower(coalesce(hybrid_preset, ''))), '- ', '__')", "0.5")} AS DOUBLE) END AS threshold
  FROM cap)"""

# every fragment with its category, scored once per distinct fragment
def classified(fragments: str) -> str:
    """CTEs sc and cl: category of each distinct f of the named relation."""
    each = ", ".join(f"list_sum(list_transform({quoted(c.hints)}, lambda h: CAST(contains(f, h) AS INTEGER))) AS s{i}" for i, c in enumerate(V.CATEGORIES))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(NAMES))) + ")"
    case = " ".join(f"WHEN s{i} = {top} THEN '{n}'" for i, n in enumerate(NAMES))
    return f"sc AS (SELECT f, {each} FROM (SELECT DISTINCT f FROM {fragments})), cl AS (SELECT f, CASE WHEN {top} = 0 THEN 'identity' {case} END AS cat FROM sc)"


def in_list(x: str, values: list[str]) -> str:
    return f"list_contains({quoted(values)}, {x})"


TAGS = f"tl AS (SELECT pro.*, {normalised(pieces('tags'))} AS tf FROM pro)"
CLAUSES = f"""sn AS (SELECT tl.*, {sentences('prose')} AS ss, {tag_words('tags')} AS tw, trim(prose) <> '' AND trim(tags) <> '' AS both_sides FROM tl),
jd AS (SELECT sn.*, list_transform(ss, lambda s: {{'s': s, 'n': len({content('s')}), 'k': len(list_filter({content('s')}, lambda w: list_contains(tw, w)))}}) AS js FROM sn),
ck AS (SELECT jd.*,
  CASE WHEN both_sides THEN list_transform(list_filter(js, lambda j: j.n > 0 AND CAST(j.k AS DOUBLE) / j.n < threshold), lambda j: j.s) ELSE ss END AS clauses,
  CASE WHEN both_sides THEN list_transform(list_filter(js, lambda j: j.n > 0 AND CAST(j.k AS DOUBLE) / j.n >= threshold), lambda j: j.s) ELSE [] END AS redundant FROM jd)"""
FRAGMENTS = f"""fr AS (
  SELECT image_id, 0 AS src, unnest(range(1, len(tf) + 1)) AS pos, unnest(tf) AS f FROM ck
  UNION ALL SELECT image_id, 1, unnest(range(1, len(pf) + 1)), unnest(pf) FROM (SELECT image_id, {normalised('clauses')} AS pf FROM ck)),
{classified('fr')},
fk AS (SELECT fr.*, cat, src = 0 AND {in_list(key('fr.f'), V.NOISE_TAGS)} AS noise FROM fr JOIN cl ON fr.f = cl.f)"""


def lists(where: str, prefix: str, name: str, order: str = "o") -> str:
    """A CTE ``name`` of list columns <prefix><category>: fragments once, first seen first."""
    cols = ", ".join(f"coalesce(list(f ORDER BY {order}) FILTER (cat = '{n}'), []) AS {prefix}{n}" for n in NAMES)
    return f"{name} AS (SELECT image_id, {cols} FROM (SELECT image_id, cat, f, min(src * 100000 + pos) AS o FROM fk WHERE {where} GROUP BY ALL) GROUP BY image_id)"


def fold(frags: str, start: str, ok: str, cost: str) -> str:
    return (
        f"list_reduce({frags}, lambda a, x: CASE WHEN {ok} THEN {{'k': list_append(a.k, x), 'u': a.u + {cost}, 'r': a.r}} "
        f"ELSE {{'k': a.k, 'u': a.u, 'r': list_append(a.r, x)}} END, {{'k': []::VARCHAR[], 'u': CAST({start} AS BIGINT), 'r': []::VARCHAR[]}})"
    )


def pack_tokens(frags: str, most: str) -> str:
    cost = f"({tokens('x')} + CASE WHEN len(a.k) > 0 THEN 1 ELSE 0 END)"
    return fold(frags, tokens("trigger_word"), f"len(a.k) < {most} AND a.u + {cost} <= budget", cost)


def pack_words(frags: str, segments: str, most: str) -> str:
    n = f"len({words('x')})"
    return fold(frags, f"len({words('trigger_word')})", f"len(a.k) = 0 OR (len(a.k) < {segments} AND a.u + {n} <= {most})", n)


def caption(packed: str) -> str:
    return with_trigger("trigger_word", f"array_to_string({packed}.k, ', ')")


BASE = f"{SQL_CAPTIONS}, {PROFILE}, {TAGS}, {CLAUSES}, {FRAGMENTS}"
EMPTY = ", ".join(f"coalesce(%s{n}, []) AS %s{n}" for n in NAMES)


def head(x: str, n: int) -> str:
    return f"{x}[1:{n}]" if n else "[]::VARCHAR[]"
