"""Caption assembly: classify fragments, pack them under budgets, compose variants.

Fragments are normalised (``functions.text.normalise``): lower case, words one space apart.
What depends on a tag or a sentence alone (its words, category, prices) is worked out
once for each distinct one where rows have a key, and in each row otherwise, by the same
expressions. The rest is Column expressions on one row per image. Packing is a fold that
skips what doesn't fit and goes on (a running sum would stop too early).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.sources.shared import settle

Cats = Sequence[V.Category]


def validate(categories: Cats) -> None:
    names = [c.name for c in categories]
    if len(set(names)) != len(names) or not {"identity", "setting"} <= set(names):
        raise ValueError("categories need distinct names, among them identity and setting")


def _category(low: str, categories: Cats) -> str:
    """SQL text: the category of a lower-case fragment. Plain sums of contains beat a lambda over a list of hints."""
    quote = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    hits = lambda c: " + ".join(["0", *(f"cast(contains({low}, {quote(h)}) as int)" for h in c.hints)])
    # the score in the high digits, the earlier category above the later in the low ones
    scores = ", ".join(f"({hits(c)}) * 1000 + {999 - i}" for i, c in enumerate(categories))
    names = ", ".join(quote(c.name) for c in categories)
    return f"transform(array(greatest({scores})), b -> CASE WHEN b >= 1000 THEN get(array({names}), 999 - b % 1000) ELSE 'identity' END)[0]"


def classify(fragment: Column, categories: Cats = V.CATEGORIES) -> Column:
    """The category with most hints inside the fragment; the first of equals, identity if none."""
    return V.each("transform", F.array(F.lower(fragment)), f"low -> {_category('low', categories)}")[0]


def fragment(f: Column, category: Column, plain: bool = False) -> Column:
    """struct of a normalised fragment (f): its category's place (c), tests, words (n), tokens by either estimate (t5, clip), ranks.

    Ranks of the training variant: 0 framing, 1 primary pose, 2 the rest, 3 identity
    traits that stay out; of a fragment of the pose bucket and of identity. ``plain``: no tag, all tests false.
    """
    no, words = F.lit(False), T.fragment_words(f)
    framing, primary = (no, no) if plain else (T.is_framing(f), T.is_primary_pose(f))
    return F.struct(
        f.alias("f"), category.cast("int").alias("c"), (no if plain else T.is_noise(f)).alias("noise"), (no if plain else T.key(f).isin(*V.RATING_TAGS)).alias("rating"),
        (no if plain else T.is_noise(f, True)).alias("out"), words.cast("int").alias("n"),
        T.tokens(f, F.lit(V.T5_BACKENDS[0]), words).cast("int").alias("t5"), T.tokens(f, F.lit(""), words).cast("int").alias("clip"),
        F.when(framing, 0).when(primary, 1).otherwise(2).alias("as_pose"),
        F.when(framing, 0).when(no if plain else ~T.is_rescued(f), 3).when(primary, 1).otherwise(2).alias("as_identity"),
    )


def fragments(texts: Column, categories: Cats = V.CATEGORIES) -> Column:
    """``fragment`` of each text that is left after normalising."""
    names = V.strings([c.name for c in categories])
    return F.transform(T.normalised(texts), lambda f: fragment(f, F.array_position(names, classify(f, categories)) - 1))


def tag_part(tag: Column, categories: Cats = V.CATEGORIES) -> Column:
    """What one tag (between commas) gives: words with stems, fragments, fillers."""
    texts = T.pieces(tag)
    return F.struct(T.tag_words(tag).alias("words"), fragments(texts, categories).alias("frags"), F.flatten(F.transform(texts, T.fillers_of)).alias("fillers"))


def sentence_part(sentence: Column, categories: Cats = V.CATEGORIES) -> Column:
    """What one sentence gives: itself (s), content words, fragments, fillers, and tokens (x) that may enrich, with their parts."""
    offered = F.transform(T.token_candidates(sentence), lambda c: F.struct(fragment(c["t"], F.lit(0), plain=True).alias("x"), c["parts"].alias("parts")))
    return F.struct(
        sentence.alias("s"), T.content_words(sentence).alias("words"), fragments(F.array(sentence), categories).alias("frags"),
        T.fillers_of(sentence).alias("fillers"), offered.alias("offered"),
    )


# distinct parts, and characters of them, that rows look up without a join (a part takes some 30 bytes for each character)
SMALL = (1 << 14, 1 << 18)
SLOTS = 1024  # maps in which they lie by hash, as a map is searched from its first key on


def _table(parts: DataFrame, name: str) -> Column:
    """A small table (piece, ``name``) as an array of maps: a scalar subquery, worked out once."""
    slot = F.pmod(F.xxhash64("piece"), F.lit(SLOTS)).alias("slot")
    lists = parts.groupBy(slot).agg(F.collect_list(F.struct("piece", name)).alias("found"))
    lists = parts.sparkSession.range(SLOTS).select(F.col("id").alias("slot")).join(lists, "slot", "left")
    in_order = F.sort_array(F.collect_list(F.struct("slot", "found")))
    return lists.agg(F.transform(in_order, lambda x: F.map_from_entries(x["found"])).alias("found")).scalar()


def _found(pieces: Column, table: Column) -> Column:
    """The parts of an array of pieces."""
    return V.let(table, lambda t: F.transform(pieces, lambda p: F.element_at(F.get(t, F.pmod(F.xxhash64(p), F.lit(SLOTS)).cast("int")), p)))


def with_parts(df: DataFrame, categories: Cats = V.CATEGORIES, key: str | None = None) -> DataFrame:
    """Adds __tags and __sentences: ``tag_part`` of each tag and ``sentence_part`` of each sentence, in order.

    With a ``key`` (no two rows share one) each distinct tag and sentence is worked out
    once, in a table of its own. A small table (``SMALL``) goes to the rows as two arrays of maps, in
    which each row finds its parts, and no row moves. A larger one is joined to the exploded
    rows by text, and these are grouped by the key; their columns go along with one of them.
    """
    tags, said = T.tag_list(F.col("tags")), T.sentences(F.col("prose"))
    if key is None:
        return df.select("*", F.transform(tags, lambda t: tag_part(t, categories)).alias("__tags"), F.transform(said, lambda s: sentence_part(s, categories)).alias("__sentences"))

    def pieces(array: Column, kind: int) -> Column:
        return V.each("transform", array, f"p -> named_struct('kind', {kind}, 'piece', p)")

    exploded = F.concat(pieces(tags, 0), pieces(said, 1))
    kind, piece = F.col("kind"), F.col("piece")
    parts = df.select(F.explode(exploded).alias("p")).select("p.kind", "p.piece").distinct()
    parts = settle(parts.select("kind", "piece", F.when(kind == 0, tag_part(piece, categories)).alias("tag"), F.when(kind == 1, sentence_part(piece, categories)).alias("sentence")), "parts")
    count, chars = parts.agg(F.count("piece"), F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()
    if count <= SMALL[0] and chars <= SMALL[1]:
        # named once each, so that the plan puts the subqueries where they are used and no row carries them
        df = df.select("*", _table(parts.filter("kind = 0"), "tag").alias("__tag_table"), _table(parts.filter("kind = 1"), "sentence").alias("__sentence_table"))
        df = df.select("*", _found(tags, F.col("__tag_table")).alias("__tags"), _found(said, F.col("__sentence_table")).alias("__sentences"))
        return df.drop("__tag_table", "__sentence_table")
    names = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = df.withColumn("__pieces", F.concat(F.expr("array(named_struct('kind', -1, 'piece', ''))"), exploded))
    rows = rows.select(F.col(key).alias("__key"), row.alias("__row"), F.posexplode("__pieces").alias("pos", "p"))
    rows = rows.select("__key", F.when(F.col("pos") == 0, F.col("__row")).alias("__row"), "pos", "p.kind", "p.piece").join(parts, ["kind", "piece"], "left")

    def listed(kind_: int, name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(kind == kind_, F.struct("pos", name))))[name]

    whole = rows.groupBy("__key").agg(F.first("__row", ignorenulls=True).alias("__row"), listed(0, "tag").alias("__tags"), listed(1, "sentence").alias("__sentences"))
    return whole.select(*[F.col("__key").alias(c) if c == key else F.col("__row")[c].alias(c) for c in df.columns], "__tags", "__sentences")


def bucket(pairs: Column, at: int) -> Column:
    """The fragments of the category at a place."""
    return V.each("filter", pairs, f"p -> p.c = {at}")


def _none(pairs: Column) -> Column:
    return F.slice(pairs, 1, 0)


def priced(texts: Column) -> Column:
    return F.transform(texts, lambda f: fragment(f, F.lit(0), plain=True))


def lead(trigger: Column, backend: Column) -> Column:
    """struct<text, words, tokens, t5>: the stripped trigger (null if blank), what it takes of a budget, and whose estimate counts."""
    return F.struct(
        F.nullif(T.strip(F.coalesce(trigger, F.lit(""))), F.lit("")).alias("text"), T.word_count(trigger).alias("words"),
        T.tokens(trigger, backend).alias("tokens"), T.uses_t5(backend).alias("t5"),
    )


def pack_tokens(texts: Column, trigger: Column, backend: Column, budget: Column, most: Column) -> Column:
    """First fit under a token budget and a number of segments; a separator costs one token."""
    return packed_tokens(priced(texts), lead(trigger, backend), budget, most)


def packed_tokens(given: Column, lead: Column, budget: Column, most: Column) -> Column:
    """``pack_tokens`` of ``fragment`` structs."""
    separator = "IF(size(acc.kept) > 0, 1, 0)"
    price = f"IF(acc.t5 = 1, x.t5, x.clip) + {separator}"
    ok = f"size(acc.kept) < acc.most AND acc.used + {price} <= acc.budget"

    def packed(g: Column) -> Column:
        sums = V.each("aggregate", F.when(lead["t5"], g["t5"]).otherwise(g["clip"]), "(a, n) -> a + n", lead["tokens"].cast("int"))
        return _first_fit(g, sums + F.greatest(F.size(g) - 1, F.lit(0)), budget, most, lead["tokens"], {"most": most, "budget": budget, "t5": lead["t5"]}, ok, price)

    return V.let(given, packed)


def _first_fit(given: Column, total: Column, limit: Column, most: Column, used: Column, limits: dict[str, Column], ok: str, price: str) -> Column:
    """struct<kept, used, removed>. Where all fragments fit together none can miss, so the fold is spared."""
    whole = F.struct(given["f"].alias("kept"), total.cast("int").alias("used"), V.empty().alias("removed"))
    return F.when((F.size(given) <= most) & (total <= limit), whole).otherwise(_fold(given, used, limits, ok, price))


def _fold(given: Column, used: Column, limits: dict[str, Column], ok: str, price: str) -> Column:
    """struct<kept, used, removed> of fragments; the limits go along, so that the fold is text."""
    zero = F.struct(V.empty().alias("kept"), used.cast("int").alias("used"), V.empty().alias("removed"), *[c.cast("int").alias(n) for n, c in limits.items()])
    along = "".join(f", '{n}', acc.{n}" for n in limits)
    take = f"named_struct('kept', array_append(acc.kept, x.f), 'used', cast(acc.used + {price} as int), 'removed', acc.removed{along})"
    leave = f"named_struct('kept', acc.kept, 'used', acc.used, 'removed', array_append(acc.removed, x.f){along})"
    finish = F.expr("acc -> named_struct('kept', acc.kept, 'used', acc.used, 'removed', acc.removed)")
    return F.call_function("aggregate", given, zero, F.expr(f"(acc, x) -> CASE WHEN {ok} THEN {take} ELSE {leave} END"), finish)


def pack_words(texts: Column, trigger: Column, segments: Column, words: Column) -> Column:
    """First fit under segments and words; the first fragment always stays."""
    return packed_words(priced(texts), lead(trigger, F.lit("")), segments, words)


def packed_words(given: Column, lead: Column, segments: Column, words: Column) -> Column:
    """``pack_words`` of ``fragment`` structs."""
    ok = "size(acc.kept) = 0 OR (size(acc.kept) < acc.segments AND acc.used + x.n <= acc.words)"

    def packed(g: Column) -> Column:
        total = V.each("aggregate", g["n"], "(a, n) -> a + n", lead["words"].cast("int"))
        return _first_fit(g, total, words, segments, lead["words"], {"segments": segments, "words": words}, ok, "x.n")

    return V.let(given, packed)


def by_priority(categories: Cats) -> list[V.Category]:
    return sorted(categories, key=lambda c: c.priority)


def cap_of(category: V.Category) -> int:
    """Fragments that a category gives to another category's variant."""
    return max(0, 4 - category.priority) if category.priority <= 4 else 1


def _join(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else V.empty()


def _head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def _tail(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def _finished(lead: Column, packed: Column, over: Column, lost: Column | None = None) -> Column:
    """struct<caption, removed> with the packing computed once; normalised fragments have no blank ends."""

    def done(p: Column) -> Column:
        removed = F.concat(over, p["removed"], *([lost] if lost is not None else []))
        return F.struct(F.concat_ws(", ", lead["text"], F.nullif(F.array_join(p["kept"], ", "), F.lit(""))).alias("caption"), removed.alias("removed"))

    return V.let(packed, done)


def category_variant(buckets: dict[str, Column], name: str, lead: Column, style: Column, categories: Cats = V.CATEGORIES) -> Column:
    """struct<caption, removed> of the variant that favours one category; buckets hold ``fragment`` structs."""
    plan = by_priority(categories)
    fill = _join([buckets[c.name] if c.name == name else _head(buckets[c.name], cap_of(c)) for c in plan])
    over = _join([_tail(buckets[c.name], cap_of(c))["f"] for c in plan if c.name != name])
    known = {c.name: c for c in V.CATEGORIES}
    limits = known.get(name, known["identity"])
    anime = style == "anime"
    packed = packed_words(
        fill, lead,
        F.when(anime, limits.anime[0]).otherwise(limits.photo[0]), F.when(anime, limits.anime[1]).otherwise(limits.photo[1]),
    )
    return _finished(lead, packed, over)


def zeroshot_variant(buckets: dict[str, Column], lead: Column, style: Column, budget: Column, categories: Cats = V.CATEGORIES) -> Column:
    """struct<caption, removed>: buckets by priority, longest fragments first, under the token budget."""

    def longest_first(a: Column) -> Column:
        return F.sort_array(V.each("transform", a, "(x, i) -> named_struct('n', -x.n, 'i', i, 'x', x)"))["x"]

    fill, over = [], []
    for c in by_priority(categories):
        ordered = longest_first(buckets[c.name])
        fill.append(ordered if c.zeroshot_cap is None else _head(ordered, c.zeroshot_cap))
        if c.zeroshot_cap is not None:
            over.append(_tail(ordered, c.zeroshot_cap)["f"])
    packed = packed_tokens(_join(fill), lead, budget, F.when(style == "anime", 12).otherwise(10))
    return _finished(lead, packed, _join(over))


def diversified(fragments: Column, name: str, key: Column, drop: float, seed: int, text=lambda f: f) -> tuple[Column, Column]:
    """(kept, dropped): hash-seeded dropping (more of short fragments) and order; the same on every run.

    ``drop`` 0 keeps the given order, which is the deterministic default. ``text`` takes an
    element to its text.
    """
    if drop <= 0:
        return fragments, _none(fragments)

    def hashed(f: Column, what: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(name), text(f), F.lit(f"{what}{seed}")), F.lit(1_000_000)) / 1_000_000

    def dropped(f: Column) -> Column:
        return hashed(f, "drop") < F.when(T.fragment_words(text(f)) <= 2, drop * 1.5).otherwise(drop * 0.3)

    kept = F.filter(fragments, lambda f: ~dropped(f))
    mixed = F.array_sort(F.transform(kept, lambda f, i: F.struct(hashed(f, "order").alias("h"), i.alias("i"), f.alias("f"))))
    return F.transform(mixed, lambda s: s["f"]), F.filter(fragments, dropped)


def trainable(pairs: Column) -> Column:
    """The fragments that are neither noise nor identity traits."""
    return V.each("filter", pairs, "x -> NOT x.out")


def training_variant(
    buckets: dict[str, Column], lead: Column, style: Column, budget: Column,
    index: Column, enrichment: Column, key: Column | None = None, drop: float = 0.0, seed: int = 0,
) -> Column:
    """struct<caption, removed> for adapter training: no identity but pose and expression, framing first.

    ``index`` modulo 4 leaves out setting and wardrobe in turn. ``drop`` > 0 adds
    the hash-seeded diversity pass on all but framing and primary poses.
    """
    cycle = F.pmod(index, F.lit(len(V.OMISSIONS)))

    def omitted(name: str) -> Column:
        turns = [i for i, left_out in enumerate(V.OMISSIONS) if name in left_out]
        return cycle.isin(*turns) if turns else F.lit(False)

    def assembled(b: Column) -> Column:
        def tier(r: int) -> Column:
            return F.concat(V.each("filter", b["pose_composition"], f"x -> x.as_pose = {r}"), V.each("filter", b["identity"], f"x -> x.as_identity = {r}"))

        removed, fill = [], [tier(0), tier(1)]
        parts = [("pose_composition", tier(2), None), ("action", b["action"], None)]
        parts += [(name, b[name], V.TRAINING_CAPS[name]) for name in ("wardrobe", "lighting", "setting")]
        for name, given, cap in parts:
            if cap is not None:
                over = _tail(given, cap)
                removed.append(F.when(omitted(name), given).otherwise(over)["f"])
                given = F.when(omitted(name), _none(given)).otherwise(_head(given, cap))
            kept, dropped = diversified(given, name, key if key is not None else F.lit(0), drop, seed, lambda x: x["f"])
            fill.append(kept)
            if drop > 0:
                removed.append(dropped["f"])
        packed = packed_tokens(F.concat(*fill, enrichment), lead, budget, F.when(style == "anime", 10).otherwise(8))
        return _finished(lead, packed, F.concat(*removed), tier(3)["f"])

    # every list is made once, however often it is named above
    return V.let(F.struct(*[buckets[n].alias(n) for n in ("identity", "pose_composition", "action", "wardrobe", "lighting", "setting")]), assembled)


# What a caption input may have, and what stands for a missing column.
DEFAULTS = {
    "tags": ("string", ""), "prose": ("string", ""), "trigger_word": ("string", ""), "target_style": ("string", None),
    "target_category": ("string", None), "target_backend": ("string", "sdxl"), "checkpoint": ("string", None),
    "token_budget_override": ("int", None), "hybrid_preset": ("string", None), "prose_bias": ("double", None),
    "prose_enrichment": ("boolean", True), "image_index": ("int", 0), "backend_name": ("string", ""),
}


def with_profile(df: DataFrame, categories: Cats = V.CATEGORIES) -> DataFrame:
    """Adds missing input columns and the resolved profile: style, category, backend, budget, threshold."""
    def known(name: str) -> Column:
        kind, value = DEFAULTS.get(name, (None, None))
        column = F.col("`" + name.replace("`", "``") + "`")
        return column if value is None else F.coalesce(column, F.lit(value).cast(kind)).alias(name)

    missing = [F.lit(value).cast(kind).alias(name) for name, (kind, value) in DEFAULTS.items() if name not in df.columns]
    df = df.select(*map(known, df.columns), *missing)
    blank = lambda c: F.nullif(T.strip(F.col(c)), F.lit(""))
    return df.select(
        "*",
        T.style_of(F.col("target_style"), F.col("checkpoint"), F.col("target_backend")).alias("style"),
        T.category_of(F.col("target_category"), [c.name for c in categories]).alias("category"),
        F.coalesce(blank("target_backend"), F.lit("")).alias("backend"),
        T.budget_of(F.col("target_backend"), F.col("token_budget_override")).alias("budget"),
        T.threshold_of(F.col("hybrid_preset"), F.col("prose_bias")).alias("threshold"),
    )


def with_buckets(df: DataFrame, categories: Cats = V.CATEGORIES, key: str | None = None) -> DataFrame:
    """Adds lead, noise, clauses, redundant, fillers, enrichment, fragments (tag_, prose_, noise_pairs) and buckets of them by category.

    Buckets: b_ of all, t_ of tags only, z_ with the noise that zero-shot captions take back.
    """
    df = with_parts(df, categories, key)
    both = (T.strip(F.col("prose")) != "") & (T.strip(F.col("tags")) != "")
    df = df.select("*", F.flatten("__tags.frags").alias("__all"), F.array_distinct(F.flatten("__tags.words")).alias("__known"), both.alias("__both"), lead(F.col("trigger_word"), F.col("backend")).alias("lead"))
    # null without content words: such a sentence is neither kept nor redundant; with an empty side all stay
    share = "size(array_intersect(s.words, __known)) / nullif(size(s.words), 0)"
    df = df.select(
        "*", V.each("filter", F.col("__sentences"), f"s -> NOT __both OR {share} < threshold").alias("__kept"),
        V.each("filter", F.col("__sentences"), f"s -> __both AND {share} >= threshold")["s"].alias("redundant"),
    )
    df = df.select(
        "*", F.col("__kept.s").alias("clauses"), V.each("filter", F.col("__all"), "x -> x.noise")["f"].alias("noise"),
        V.each("filter", F.col("__all"), "x -> NOT x.noise").alias("tag_pairs"), F.flatten("__kept.frags").alias("prose_pairs"),
        V.each("filter", F.col("__all"), "x -> x.noise AND NOT x.rating").alias("noise_pairs"),
        F.concat(F.flatten("__tags.fillers"), F.flatten("__kept.fillers")).alias("fillers"),
        F.slice(F.array_distinct(V.each("filter", F.flatten("__kept.offered"), "o -> NOT arrays_overlap(o.parts, __known)")["x"]), 1, V.ENRICHMENT_TOKENS).alias("enrichment"),
    )
    # one text has one category, so what is distinct over all buckets is so in each
    df = df.select("*", F.array_distinct(F.concat("tag_pairs", "prose_pairs")).alias("__b"), F.array_distinct("tag_pairs").alias("__t"))
    df = df.select("*", F.array_distinct(F.concat("__b", "noise_pairs")).alias("__z"))
    return df.select("*", *[bucket(F.col(f"__{k}"), i).alias(f"{k}_{c.name}") for k in "btz" for i, c in enumerate(categories)])


# fixed values: the notes of a caption result, in their order
NOTES = [
    "Stripped rating/meta tags that have no training value.",
    "Removed prose clauses that duplicated tag content.",
    "Trimmed lower-priority fragments to keep captions compact.",
    "Suppressed identity traits for training variant (learned visually).",
]
CONTENT_ORDER = ["setting", "action", "wardrobe", "pose_composition", "lighting"]


def compose(df: DataFrame, categories: Cats = V.CATEGORIES, drop: float = 0.0, seed: int = 0, key: str | None = None, variants: Sequence[str] | None = None) -> DataFrame:
    """Captions from (tags, prose) rows; all input columns stay.

    Adds caption_variants (map), final_caption, selected_category, removed_phrases,
    compaction_notes. Missing knobs take their defaults; null tags or prose count
    as empty. ``drop`` > 0 turns on the hash-seeded diversity of the training variant.
    ``key`` names a column that no two rows share (not for streams): tags and
    sentences that rows have in common are then worked out once (``with_parts``).
    ``variants``: those that the map holds, all by default; no others are packed for it.
    """
    validate(categories)
    mine = list(df.columns)
    df = with_buckets(with_profile(df, categories), categories, key)
    names = [c.name for c in categories]
    buckets = {n: F.col(f"b_{n}") for n in names}
    df = df.select("*", *[category_variant(buckets, n, F.col("lead"), F.col("style"), categories).alias(f"v_{n}") for n in names])
    trained = {n: trainable(F.col(f"t_{n}") if n in names else _none(F.col("tag_pairs"))) for n in {*names, *(c.name for c in V.CATEGORIES)}}
    enrichment = F.when(F.col("prose_enrichment"), F.col("enrichment")).otherwise(_none(F.col("enrichment")))
    shot = {n: F.col(f"z_{n}") for n in names}
    keyed = F.concat_ws("\x1f", "tags", "prose")
    df = df.select(
        "*",
        training_variant(trained, F.col("lead"), F.col("style"), F.col("budget"), F.col("image_index"), enrichment, keyed, drop, seed).alias("v_training"),
        zeroshot_variant(shot, F.col("lead"), F.col("style"), F.col("budget"), categories).alias("v_zeroshot"),
        V.each("exists", F.col("tag_pairs"), "x -> x.out").alias("stripped"),
    )
    every = [*names, "training", "zeroshot"]
    removed = F.concat(F.col("fillers"), F.col("noise"), F.transform("redundant", F.lower), *[F.col(f"v_{n}.removed") for n in every])
    trimmed = F.size(_join([F.col(f"v_{n}.removed") for n in names])) > 0
    notes = list(zip((F.size("noise") > 0, F.size("redundant") > 0, trimmed, F.col("stripped")), NOTES))
    held = F.create_map(*[x for n in every if variants is None or n in variants for x in (F.lit(n), F.col(f"v_{n}.caption"))])
    out = df.select("*", held.alias("caption_variants"), T.dedupe(removed).alias("removed_phrases"), F.filter(F.array(*[F.when(c, n) for c, n in notes]), lambda n: n.isNotNull()).alias("compaction_notes"))
    added = ["caption_variants", "final_caption", "selected_category", "removed_phrases", "compaction_notes"]
    # chosen by cases and not out of the map, so that a plan without the map packs one variant for each image
    chosen = F.lit("")
    for n in names:
        chosen = F.when(F.col("category") == n, F.col(f"v_{n}.caption")).otherwise(chosen)
    out = out.withColumn("final_caption", chosen).withColumn("selected_category", F.col("category"))
    return out.select(*[c for c in mine if c not in added], *added)


_profiles: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_profile(name: str, assemble: Callable[[DataFrame], DataFrame]) -> None:
    """Name an assembly for ``df.transform(profile(name))``."""
    if not name.strip() or name in _profiles or not callable(assemble):
        raise ValueError("a profile needs a new name and a function")
    _profiles[name] = assemble


def profile(name: str) -> Callable[[DataFrame], DataFrame]:
    return _profiles[name]


def profiles() -> list[str]:
    return sorted(_profiles)


def _training_final(df: DataFrame) -> DataFrame:
    return compose(df).withColumn("final_caption", F.col("caption_variants")["training"])


register_profile("lora_training", _training_final)


def hybrid_string(tags: Column, prose: Column) -> Column:
    """Tags and the prose that adds to them, in one string."""
    kept = F.array_join(T.kept_clauses(prose, tags, F.lit(V.PRESETS["balanced"])), ", ")
    return F.concat_ws(", ", F.nullif(T.strip(tags), F.lit("")), F.nullif(kept, F.lit("")))


def assembled_content(variants: Column, final: Column) -> Column:
    """Variants as sentences (setting, action, wardrobe, pose, lighting), or the final caption."""
    parts = []
    for n in CONTENT_ORDER:
        t = T.strip(F.coalesce(F.try_element_at(variants, F.lit(n)), F.lit("")))
        parts.append(F.when(t == "", None).when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))
    joined = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), " ")
    return F.when(joined == "", final).otherwise(joined)
