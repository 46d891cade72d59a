"""Contradictions between tags and prose, and their resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.sources.shared import settle

DISPUTE = "struct<kind: string, subject: string, tags_say: array<string>, prose_says: array<string>>"


def _is_colour(w: Column) -> Column:
    return w.isin(*V.COLOURS)


def colour_map(tags: Column) -> Column:
    """map<noun, sorted colours> of the tags that name both; the head noun is the last."""

    def of(tag: Column) -> Column:
        words = T.split_words(F.replace(F.lower(tag), F.lit("_"), F.lit(" ")))
        colours = F.transform(F.filter(words, _is_colour), T.canon_colour)
        nouns = F.filter(words, lambda w: ~_is_colour(w) & ~w.isin(*V.NON_NOUNS))
        return F.struct(F.get(nouns, F.size(nouns) - 1).alias("noun"), colours.alias("colours"))

    def merged(said: Column) -> Column:
        def colours(n: Column) -> Column:
            return F.sort_array(F.array_distinct(F.flatten(F.filter(said, lambda s: s["noun"] == n)["colours"])))

        return V.let(F.array_distinct(said["noun"]), lambda nouns: F.map_from_arrays(nouns, F.transform(nouns, colours)))

    return V.let(F.filter(F.transform(T.tag_list(tags), of), lambda s: s["noun"].isNotNull() & (F.size(s["colours"]) > 0)), merged)


def prose_colours(clauses: Column, noun: Column) -> Column:
    near = V.let(T.noun_variants(noun), lambda forms: F.filter(clauses, lambda c: F.arrays_overlap(c, forms)))
    words = F.filter(F.flatten(near), _is_colour)
    return F.sort_array(F.array_distinct(F.transform(words, T.canon_colour)))


def compared(tags: Column, prose: Column) -> Column:
    """array of disputes' structs for every attribute that both sides name, agreeing or not.

    Tags and clauses are taken apart once for a row, not once for each noun, and clauses only if a tag has a colour.
    """
    def coloured(entries: Column) -> Column:
        def one(clauses: Column) -> Column:
            return F.transform(
                entries, lambda e: F.struct(F.lit("color").alias("kind"), e["key"].alias("subject"), e["value"].alias("tags_say"), prose_colours(clauses, e["key"]).alias("prose_says"))
            ).cast(f"array<{DISPUTE}>")

        return F.when(F.size(entries) > 0, V.let(T.detector_clauses(prose), one)).otherwise(F.array().cast(f"array<{DISPUTE}>"))

    def postures(text: Column) -> Column:
        return F.sort_array(F.array_intersect(T.alpha_words(text), V.strings(V.POSTURES)))

    pose = F.array(F.struct(F.lit("pose").alias("kind"), F.lit("posture").alias("subject"), postures(tags).alias("tags_say"), postures(prose).alias("prose_says")))
    both = F.concat(V.let(F.map_entries(colour_map(tags)), coloured), pose.cast(f"array<{DISPUTE}>"))
    return F.filter(both, lambda d: (F.size(d["tags_say"]) > 0) & (F.size(d["prose_says"]) > 0))


def disputes(tags: Column, prose: Column) -> Column:
    return F.filter(compared(tags, prose), lambda d: ~F.arrays_overlap(d["tags_say"], d["prose_says"]))


def with_contradictions(df: DataFrame, tags: str = "raw_tags", prose: str = "raw_prose") -> DataFrame:
    """Adds checked, count, rate and details."""
    df = df.withColumn("__c", compared(F.coalesce(tags, F.lit("")), F.coalesce(prose, F.lit(""))))
    df = df.withColumn("details", F.filter("__c", lambda d: ~F.arrays_overlap(d["tags_say"], d["prose_says"])))
    n, k = F.size("details"), F.size("__c")
    return df.select(*[c for c in df.columns if c not in ("__c", "details")], k.alias("checked"), n.alias("count"), F.when(k > 0, n / k).otherwise(0.0).alias("rate"), "details")


def _like_case(new: Column, old: Column) -> Column:
    capital = F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.lower(F.substr(new, F.lit(2))))
    return F.when(old.rlike("^[A-Z]"), capital).otherwise(new)


def recoloured(prose: Column, subject: Column, value: Column) -> Column:
    """In each clause with the subject, the wrong colour nearest to it is replaced; all else stays verbatim."""
    right = T.canon_colour(F.lower(value))
    parts = F.regexp_extract_all(prose, F.lit(r"(?is)([.,;:!?]|\b(?:and|with|but|while)\b|(?:(?![.,;:!?]|\b(?:and|with|but|while)\b).)+)"), 1)
    forms = T.noun_variants(subject)

    def clause(part: Column) -> Column:
        bits = F.regexp_extract_all(part, F.lit(r"(?s)(\b[A-Za-z]+\b|(?:(?!\b[A-Za-z]+\b).)+)"), 1)
        marked = F.transform(bits, lambda b, i: F.struct(F.lower(b).alias("w"), i.alias("i")))
        words = F.filter(marked, lambda m: m["w"].rlike("^[a-z]+$"))
        words = F.transform(words, lambda m, n: F.struct(m["w"].alias("w"), m["i"].alias("i"), n.alias("n")))
        at = F.transform(F.filter(words, lambda m: F.array_contains(forms, m["w"])), lambda m: m["n"])
        wrong = F.filter(words, lambda m: _is_colour(m["w"]) & (T.canon_colour(m["w"]) != right))
        ranked = F.transform(wrong, lambda m: F.struct(F.array_min(F.transform(at, lambda s: F.abs(s - m["n"]))).alias("d"), m["n"].alias("n"), m["i"].alias("i")))
        best = F.array_min(ranked)["i"]
        new = F.array_join(F.transform(bits, lambda b, i: F.when(i == best, _like_case(value, b)).otherwise(b)), "")
        return F.when((F.size(at) > 0) & (F.size(wrong) > 0), new).otherwise(part)

    return F.array_join(F.transform(parts, clause), "")


def reposed(prose: Column, flagged: Column, value: Column) -> Column:
    """Every flagged posture word but the target is replaced; letters beside digits or underscores aren't words."""
    bits = F.regexp_extract_all(prose, F.lit(r"(?s)(\b[A-Za-z]+\b|(?:(?!\b[A-Za-z]+\b).)+)"), 1)

    def one(b: Column) -> Column:
        w = F.lower(b)
        return F.when(F.array_contains(flagged, w) & (w != F.lower(value)), _like_case(value, b)).otherwise(b)

    return F.array_join(F.transform(bits, one), "")


# A verifier maps a dispute to a value, null to abstain.
Verifier = Callable[[Column], Column]


def tag_prior(dispute: Column) -> Column:
    """Believes the tags: their first value in sorted order."""
    return F.get(dispute["tags_say"], F.lit(0))


def answered(dispute: Column) -> Column:
    """Reads a verifier model's free answer from the dispute's field ``answer``."""
    return T.parse_answer(dispute["kind"], dispute["answer"])


def grounded(boxes: Column, pixels: Column, width: Column) -> Verifier:
    """Names the mean colour of the first box found for a dispute's subject; abstains on postures and empty boxes.

    ``boxes``: map<subject, array<struct<x0, y0, x1, y1>>>, from a grounding model;
    ``pixels``: array<struct<r, g, b>> by rows of ``width``.
    """

    def verify(dispute: Column) -> Column:
        mean = T.mean_colour(T.region(pixels, width, F.get(F.try_element_at(boxes, dispute["subject"]), F.lit(0))))
        return F.when(mean.isNotNull() & (dispute["kind"] == "color"), T.nearest_colour(mean["r"], mean["g"], mean["b"]))

    return verify


def _asked(kind: Column, subject: Column) -> Column:
    return F.concat(kind, F.lit(":"), subject)


def questions(df: DataFrame, key: str, tags: str = "tags", prose: str = "prose") -> DataFrame:
    """(key, kind, subject, question) of each dispute, for a model to answer; any number of rows at once."""
    found = df.select(key, F.explode(disputes(F.coalesce(tags, F.lit("")), F.coalesce(prose, F.lit("")))).alias("d"))
    return found.select(key, "d.kind", "d.subject", T.question(F.col("d.kind"), F.col("d.subject")).alias("question"))


def reconcile_answered(df: DataFrame, key: str, answers: DataFrame, tags: str = "tags", prose: str = "prose") -> DataFrame:
    """``reconcile`` by a model's free answers (key, kind, subject, answer); without one, or one that can't be read, nothing changes."""
    by_key = answers.filter("answer is not null").groupBy(key).agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct(_asked(F.col("kind"), F.col("subject")), "answer")))).alias("__answers")
    )
    heard = lambda d: T.parse_answer(d["kind"], F.try_element_at(F.col("__answers"), _asked(d["kind"], d["subject"])))
    return reconcile(df.join(by_key, key, "left"), heard, tags, prose).drop("__answers")


_verifiers: dict[str, Verifier] = {"tag-prior": tag_prior}


def verifier(name: str) -> Verifier:
    if name not in _verifiers:
        raise ValueError(f"no verifier {name!r}; known: {sorted(_verifiers)}")
    return _verifiers[name]


def register_verifier(name: str, verify: Verifier) -> None:
    _verifiers[name] = verify


def reconcile(df: DataFrame, verify: Verifier = tag_prior, tags: str = "tags", prose: str = "prose") -> DataFrame:
    """Rewrites the prose to the verified values; adds prose_before and changes.

    Disputes are found once and applied in order; a verdict that is null, that the
    prose already says, or that changes nothing is no change. Rows with an empty
    side stay as they are.
    """
    t, p = F.coalesce(tags, F.lit("")), F.coalesce(prose, F.lit(""))
    found = F.transform(disputes(t, p), lambda d: F.struct(d["kind"].alias("kind"), d["subject"].alias("subject"), d["prose_says"].alias("was"), verify(d).alias("now")))
    found = F.filter(found, lambda d: d["now"].isNotNull() & (d["now"] != "") & ~F.array_contains(d["was"], F.lower(d["now"])))
    df = df.withColumn("__found", F.when((t != "") & (p != ""), found))
    change = "array<struct<kind: string, subject: string, was: array<string>, now: string>>"
    zero = F.struct(p.alias("prose"), F.array().cast(change).alias("changes"))

    def step(acc: Column, d: Column) -> Column:
        new = F.when(d["kind"] == "color", recoloured(acc["prose"], d["subject"], d["now"])).otherwise(reposed(acc["prose"], d["was"], d["now"]))
        return F.struct(new.alias("prose"), F.when(new == acc["prose"], acc["changes"]).otherwise(F.array_append(acc["changes"], d)).alias("changes"))

    done = F.aggregate(F.coalesce("__found", F.array().cast(change)), zero, step)
    df = df.withColumn("__done", done)
    return df.select(*[F.col("__done.prose").alias(c) if c == prose else F.col(c) for c in df.columns if c not in ("__found", "__done")], F.col(prose).alias("prose_before"), F.col("__done.changes").alias("changes"))


_TELLING = rf"(?:^|,)\s*([^,]*?(?:{'|'.join([*V.COLOURS, *V.POSTURES])})[^,]*)"


def telling_tags(tags: Column) -> Column:
    """The tags that hold a colour's or a posture's name, in lower case: no others make a dispute, so ``disputes`` of these are the same."""
    return F.array_join(F.regexp_extract_all(F.lower(tags), F.lit(_TELLING), 1), ",")


def case_by_case(df: DataFrame, work: Callable[[DataFrame], DataFrame], tags: str = "tags", prose: str = "prose") -> DataFrame:
    """Runs ``work`` on one row of each case, that is each prose and its telling tags, and joins what it adds back to all rows.

    ``work`` gets the columns case, ``tags`` (the telling ones) and ``prose``, and keeps
    case; it is one of the reconciling steps, say. The rows come back with its columns
    in place of ``tags`` and ``prose``. They are written once; a case is a hash of both texts.
    """
    t, p = telling_tags(F.coalesce(tags, F.lit(""))), F.coalesce(prose, F.lit(""))
    rest = [c for c in df.columns if c not in (tags, prose)]
    rows = df.select(*rest, t.alias(tags), prose)
    case = F.sha2(F.concat(F.length(tags).cast("string"), F.when(F.col(prose).isNull(), ":-").otherwise(":+"), tags, p), 256)
    rows = settle(rows.withColumn("case", F.unhex(case)), "cases")
    done = settle(work(settle(rows.select("case", tags, prose).distinct(), "distinct")).drop(tags), "worked")
    return rows.select(*rest, "case").join(done, "case").drop("case")
