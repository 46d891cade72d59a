"""The text algebra: every function takes and returns Columns, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import vocab as V

EDGE = " ,.;:-"
# The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column, chars: str | None = None) -> Column:
    """Both ends without ``chars`` (white space by default)."""
    return F.btrim(text, F.lit(chars or WHITE))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def key(fragment: Column) -> Column:
    """Lower-case, trimmed, spaces as underscores."""
    return F.replace(strip(F.lower(fragment)), F.lit(" "), F.lit("_"))


def split_words(text: Column) -> Column:
    # taken out, not split: split compiles its pattern in every call
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


def pieces(text: Column, on: str = "[.;,]") -> Column:
    """Trimmed non-empty pieces."""
    return V.each("filter", V.each("transform", F.split(text, on), f"p -> btrim(p, {V._sql(WHITE)})"), "p -> p <> ''")


def tag_list(tags: Column) -> Column:
    return pieces(tags, ",")


def sentences(text: Column) -> Column:
    """Prose sentences; commas stay inside."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|;\s*"), lambda s: strip(s, " ,;.")), lambda s: s != "")


_FILLERS = "|".join(V.FILLERS)


def without_fillers(text: Column) -> Column:
    bare = F.regexp_replace(squeeze(text), rf"(?i)^(?:(?:{_FILLERS})[ ,:\-]*)+", "")
    return strip(bare, EDGE)


def fillers_of(text: Column) -> Column:
    """The filler prefixes that ``without_fillers`` removes, trimmed, in order."""
    head = F.regexp_extract(squeeze(text), rf"(?i)^((?:(?:{_FILLERS})[ ,:\-]*)+)", 1)
    return F.transform(F.regexp_extract_all(F.lower(head), F.lit(f"({_FILLERS})"), 1), lambda p: strip(p))


def normalise(fragment: Column) -> Column:
    return F.lower(without_fillers(fragment))


def normalised(fragments: Column) -> Column:
    return F.filter(F.transform(fragments, normalise), lambda f: f != "")


def content_words(text: Column) -> Column:
    """Distinct words longer than one character that are no stopwords."""
    return _content(F.split(text, r"(?U)\s+"))


def _content(words: Column) -> Column:
    bare = V.each("transform", V.each("filter", words, "w -> length(w) > 1"), f"w -> btrim(lower(w), {V._sql('.,!?;:' + chr(39) + chr(34))})")
    return F.array_distinct(V.each("filter", bare, f"w -> w NOT IN {V.listed(V.STOPWORDS)}"))


def _stems(word: Column) -> Column:
    def cut(end: str, least: int) -> Column:
        short = F.substr(word, F.lit(1), F.length(word) - len(end))
        return F.when(F.endswith(word, F.lit(end)) & (F.length(word) > least), F.array(short)).otherwise(V.empty())

    return F.concat(F.array(word), cut("ing", 5), cut("ed", 4), cut("s", 4))


def tag_words(tags: Column) -> Column:
    """Words of comma-separated tags with their stems; underscores don't split."""
    words = _content(F.split(tags, r"(?U)[\s,]+"))
    return F.array_distinct(F.flatten(F.transform(words, _stems)))


def dedupe(fragments: Column) -> Column:
    """First of each case-insensitive trimmed value; blanks go."""
    keys = F.transform(fragments, lambda f: strip(F.lower(f)))

    def firsts(b: Column) -> Column:
        mixed = F.filter(b["f"], lambda f, i: (F.get(b["k"], i) != "") & (F.array_position(b["k"], F.get(b["k"], i)) == i + 1))
        return F.when(b["f"] == b["k"], F.filter(F.array_distinct(b["k"]), lambda k: k != "")).otherwise(mixed)

    return V.let(F.struct(fragments.alias("f"), keys.alias("k")), firsts)


def with_trigger(trigger: Column, rest: Column) -> Column:
    return F.concat_ws(", ", F.nullif(strip(F.coalesce(trigger, F.lit(""))), F.lit("")), F.nullif(strip(rest), F.lit("")))


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def clip_tokens(text: Column) -> Column:
    n = (word_count(text) * F.lit(1.3)).cast("int") + _count(text, ",") + _count(text, "_")
    return F.when(text == "", 0).otherwise(n)


def t5_tokens(text: Column) -> Column:
    n = (word_count(text) * F.lit(1.1)).cast("int") + _count(text, ",")
    return F.when(text == "", 0).otherwise(n)


def uses_t5(backend: Column) -> Column:
    return F.coalesce(strip(F.lower(backend)).isin(*V.T5_BACKENDS), F.lit(False))


def fragment_words(fragment: Column) -> Column:
    """Words of a normalised fragment, whose words are one space apart."""
    return F.when(fragment == "", 0).otherwise(_count(fragment, " ") + 1)


def tokens(text: Column, backend: Column, words: Column | None = None) -> Column:
    """The backend's estimate; ``words`` is the word count where it is known."""
    t5, n = uses_t5(backend), word_count(text) if words is None else words
    n = (n * F.when(t5, 1.1).otherwise(1.3)).cast("int") + _count(text, ",") + F.when(t5, 0).otherwise(_count(text, "_"))
    return F.when(text == "", 0).otherwise(n)


def token_candidates(clause: Column) -> Column:
    """array<struct<t, parts>>: what a clause offers as tag-like tokens; a token is known if any of its parts is.

    Compounds of the clause come before its words. Short words and stopwords are left out.
    """
    def of(low: Column) -> Column:
        compounds = []
        for nouns in V.COMPOUND_NOUNS:
            found = F.regexp_extract_all(low, F.lit(rf"(?U)\b(\w+\s+(?:{nouns}))\b"), 1)
            first, noun = (f"regexp_extract(m, {V._sql(p)}, 1)" for p in (r"(?U)^(\w+)", r"(?U)(\w+)$"))
            compounds.append(V.each("transform", found, f"m -> CASE WHEN {first} IN {V.listed(V.PROSE_STOPWORDS)} THEN {noun} ELSE concat_ws('_', {first}, {noun}) END"))
        both = F.transform(F.concat(*compounds), lambda t: F.struct(t.alias("t"), F.concat(F.array(t), split_words(F.replace(t, F.lit("_"), F.lit(" ")))).alias("parts")))
        words = V.each("transform", split_words(low), f"w -> btrim(w, {V._sql('.,!?;:' + chr(39) + chr(34) + '()[]')})")
        words = V.each("filter", words, f"w -> length(w) > 3 AND w NOT IN {V.listed(V.PROSE_STOPWORDS)}")
        return F.concat(both, V.each("transform", words, "w -> named_struct('t', w, 'parts', array(w))"))

    return V.let(F.lower(clause), of)


def prose_tokens(clauses: Column, known: Column, most: int = V.ENRICHMENT_TOKENS) -> Column:
    """Tag-like tokens of clauses that add to the known tag words, first seen first."""
    every = F.flatten(F.transform(clauses, token_candidates))
    new = V.let(known, lambda k: F.filter(every, lambda c: ~F.arrays_overlap(c["parts"], k)))
    return F.slice(F.array_distinct(new["t"]), 1, most)


def style_of(style: Column, checkpoint: Column, backend: Column) -> Column:
    given = strip(F.lower(F.coalesce(style, F.lit(""))))
    hints = F.lower(F.concat_ws(" ", checkpoint, backend))
    return F.when(given.isin("photo", "anime"), given).when(hints.rlike(V.ANIME_MARKS), "anime").otherwise("photo")


def category_of(category: Column, names: list[str]) -> Column:
    given = F.translate(strip(F.lower(F.coalesce(category, F.lit("")))), "- ", "__")
    return F.when(given.isin(*names), given).otherwise("identity")


def budget_of(backend: Column, override: Column) -> Column:
    return F.coalesce(override, V.lookup(V.BUDGETS, strip(F.lower(F.coalesce(backend, F.lit(""))))), F.lit(V.DEFAULT_BUDGET))


def threshold_of(preset: Column, bias: Column) -> Column:
    low, high = V.BIAS_RANGE
    by_bias = F.lit(low) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), bias)) * (F.lit(high) - F.lit(low))
    named = V.lookup(V.PRESETS, F.translate(strip(F.lower(F.coalesce(preset, F.lit("")))), "- ", "__"))
    return F.when(bias.isNotNull(), by_bias).otherwise(F.coalesce(named, F.lit(V.PRESETS["balanced"])))


def _keyed(values) -> str:
    """SQL text: whether the key of f is among the values."""
    return f"replace(btrim(lower(f), {V._sql(WHITE)}), ' ', '_') IN {V.listed(values)}"


def noise(fragments: Column, identity: bool = False) -> Column:
    """The fragments that are noise, or identity traits if ``identity``."""
    return V.each("filter", fragments, f"f -> {_keyed([*V.NOISE_TAGS, *(V.IDENTITY_TAGS if identity else [])])}")


def not_noise(fragments: Column, identity: bool = False) -> Column:
    return V.each("filter", fragments, f"f -> NOT ({_keyed([*V.NOISE_TAGS, *(V.IDENTITY_TAGS if identity else [])])})")


def is_noise(fragment: Column, identity: bool = False) -> Column:
    return key(fragment).isin(*V.NOISE_TAGS, *(V.IDENTITY_TAGS if identity else []))


_FRAMING = "|".join(rf"\Q{t}\E" for t in V.FRAMING_TAGS)


def is_framing(fragment: Column) -> Column:
    return key(fragment).rlike(_FRAMING)


def is_primary_pose(fragment: Column) -> Column:
    return key(fragment).isin(*V.PRIMARY_POSES)


def is_rescued(fragment: Column) -> Column:
    return key(fragment).isin(*V.RESCUED_TAGS)


def is_rescuable(fragment: Column) -> Column:
    return is_rescued(fragment) | is_framing(fragment)


def clause_overlaps(prose: Column, tags: Column) -> Column:
    """array<struct<clause, overlap>> of the prose's sentences; overlap is null without content words."""

    def of(known: Column):
        def judge(s: Column) -> Column:
            share = V.let(content_words(s), lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, known)) / F.size(w)))
            return F.struct(s.alias("clause"), share.alias("overlap"))

        return F.transform(sentences(prose), judge)

    return V.let(tag_words(tags), of)


def judged_clauses(prose: Column, tags: Column) -> Column:
    """``clause_overlaps``; with an empty side every sentence has overlap -1, so that it stays."""
    both = (strip(prose) != "") & (strip(tags) != "")
    alone = F.transform(sentences(prose), lambda s: F.struct(s.alias("clause"), F.lit(-1.0).alias("overlap")))
    return F.when(both, clause_overlaps(prose, tags)).otherwise(alone)


def below(judged: Column, threshold: Column) -> Column:
    return F.transform(F.filter(judged, lambda c: c["overlap"] < threshold), lambda c: c["clause"])


def not_below(judged: Column, threshold: Column) -> Column:
    return F.transform(F.filter(judged, lambda c: c["overlap"] >= threshold), lambda c: c["clause"])


def kept_clauses(prose: Column, tags: Column, threshold: Column) -> Column:
    return below(judged_clauses(prose, tags), threshold)


def redundant_clauses(prose: Column, tags: Column, threshold: Column) -> Column:
    return not_below(judged_clauses(prose, tags), threshold)


def alpha_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def canon_colour(word: Column) -> Column:
    return F.coalesce(V.lookup(V.COLOUR_FOLDS, word), word)


def noun_variants(noun: Column) -> Column:
    bare = F.when(F.endswith(noun, F.lit("s")), F.substr(noun, F.lit(1), F.length(noun) - 1)).otherwise(noun)
    return F.array_distinct(F.array(noun, F.concat(noun, F.lit("s")), F.concat(noun, F.lit("es")), bare))


def detector_clauses(prose: Column) -> Column:
    """Clauses as word arrays, cut also at place words (the rewriter cuts at fewer)."""
    cut = r"[.,;:!?]|\b(?:and|with|but|while|over|under|beside|near)\b"
    return F.transform(F.split(F.lower(prose), cut), alpha_words)


def tag_present(tag: Column, haystack: Column) -> Column:
    """Whether every word of the tag (longer than one character) is a word of the haystack; no words: false."""
    words = F.filter(split_words(F.replace(F.lower(tag), F.lit("_"), F.lit(" "))), lambda w: F.length(w) > 1)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.regexp_like(haystack, F.concat(F.lit("\\b\\Q"), w, F.lit("\\E\\b"))))


def tag_string(tags: Column, min_score: Column | None = None) -> Column:
    """Labels of array<struct<label, score, ...>> with no score or at least ``min_score``."""
    if min_score is not None:
        tags = F.filter(tags, lambda t: t["score"].isNull() | (t["score"] >= min_score))
    return F.array_join(F.transform(tags, lambda t: t["label"]), ", ")


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """The palette's nearest colour by squared distance; the first of equals."""
    ranked = [
        F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).cast("double").alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n"))
        for i, (n, (x, y, z)) in enumerate(V.PALETTE.items())
    ]
    return F.array_min(F.array(*ranked))["n"]


# The questions put to a verifier.
COLOUR_QUESTION = ("What is the main colour of the ", " in this image? Answer with a single colour word.")
POSTURE_QUESTION = "What is the person's posture: standing, sitting, lying down, kneeling, or crouching? Answer with a single word."


def question(kind: Column, subject: Column) -> Column:
    colour = F.concat(F.lit(COLOUR_QUESTION[0]), subject, F.lit(COLOUR_QUESTION[1]))
    return F.when(kind == "color", colour).otherwise(F.lit(POSTURE_QUESTION))


def parse_answer(kind: Column, answer: Column) -> Column:
    """The first word of the answer that is in the kind's vocabulary; colours are folded."""
    words = F.transform(split_words(F.lower(answer)), lambda w: strip(w, ".,!?;:'\"()"))
    colour = canon_colour(F.get(F.filter(words, lambda w: w.isin(*V.COLOURS)), F.lit(0)))
    posture = F.get(F.filter(words, lambda w: w.isin(*V.POSTURES)), F.lit(0))
    return F.when(kind == "color", colour).otherwise(posture)


def xmp_text(text: Column) -> Column:
    """Without characters that XML forbids, and with & < > escaped."""
    legal = F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        legal = F.replace(legal, F.lit(a), F.lit(b))
    return legal


def mean_colour(pixels: Column) -> Column:
    """struct<r, g, b>: the mean of array<struct<r, g, b>>; null without pixels."""
    def mean(k: str) -> Column:
        return (F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, p: a + p[k].cast("bigint")) / F.size(pixels)).alias(k)

    return F.when(F.size(pixels) > 0, F.struct(mean("r"), mean("g"), mean("b")))


def region(pixels: Column, width: Column, box: Column) -> Column:
    """The pixels (by rows of ``width``) inside struct<x0, y0, x1, y1>, rounded and clamped to the image; null if that is empty."""
    height = F.floor(F.size(pixels) / width)

    def edge(k: str, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(box[k].cast("double")).cast("bigint"), most.cast("bigint")))

    x0, y0, x1, y1 = edge("x0", width), edge("y0", height), edge("x1", width), edge("y1", height)
    inside = F.filter(pixels, lambda _, i: (i % width).between(x0, x1 - 1) & F.floor(i / width).between(y0, y1 - 1))
    return F.when(box.isNotNull() & (x1 > x0) & (y1 > y0), inside)


def content_key(content: Column) -> Column:
    """The first 20 hex digits of the SHA-256 of bytes or text."""
    return F.left(F.sha2(content, 256), F.lit(20))


def data_url(content: Column, kind: Column) -> Column:
    """Bytes as a data URL; ``kind`` is the media type, image/png if null."""
    return F.concat(F.lit("data:"), F.coalesce(kind, F.lit("image/png")), F.lit(";base64,"), F.base64(content))
