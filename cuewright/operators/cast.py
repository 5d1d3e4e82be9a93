"""Who is who: reading cast lists and writing the chart a translator gets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from .timing import ordered_text


def is_pronoun(source: Column, english: Column) -> Column:
    bare = F.btrim(X.strip(source), F.lit("的"))
    return bare.isin(*K.PRONOUNS_SOURCE) | F.lower(X.strip(english)).isin(*K.PRONOUNS_ENGLISH)


def is_generic(source: Column, english: Column) -> Column:
    """A common noun, a crowd label, or a name left untranslated.

    Leading letters t, h, e and spaces are trimmed one by one, not as a word.
    """
    en = F.btrim(F.lower(X.strip(english)), F.lit(".,"))
    return ((en == "") | en.isin(*K.GENERIC_NAMES) | F.ltrim(en, F.lit("the ")).isin(*K.GENERIC_NAMES)
            | (X.strip(english) == X.strip(source)) | X.source_left(english))


def gender_from_name(names: Column) -> Column:
    joined = F.array_join(names, "")
    count = lambda chars: F.length(joined) - F.length(F.translate(joined, chars, ""))
    f, m = count(K.FEMALE_NAME_CHARS), count(K.MALE_NAME_CHARS)
    return F.when(f > m, "f").when(m > f, "m").otherwise("")


def settle_gender(stated: Column, relation: Column, names: Column) -> Column:
    """The relation word decides, then the name, then the letter that was given."""
    said = F.lower(F.substring(X.strip(F.coalesce(stated, F.lit(""))), 1, 1))
    said = F.when(said.isin("f", "m"), said).otherwise("")
    w = F.regexp_extract_all(F.lower(F.coalesce(relation, F.lit(""))), F.lit("([a-z]+)"))
    female = F.arrays_overlap(w, F.array(*[F.lit(x) for x in K.FEMALE_WORDS]))
    male = F.arrays_overlap(w, F.array(*[F.lit(x) for x in K.MALE_WORDS]))
    named = gender_from_name(names)
    return F.when(female & ~male, "f").when(male & ~female, "m").when(named != "", named).otherwise(said)


def parse_cast(replies: DataFrame, *, longest_row: int | None = K.MAX_CAST_ROW, spellings_kept: int | None = K.MAX_SPELLINGS,
               longest_relation: int | None = K.MAX_RELATION) -> DataFrame:
    """ROLE|spellings|English|gender|relation rows, without pronouns and common nouns.

    Rows over ``longest_row`` characters are no cast rows; of a row's spellings the first ones are kept,
    and the beginning of its relation. None: no limit.

    replies: vid, content. The first MC row is the lead (role 'MC'); later ones are NPC.
    """
    # One pass over a reply: a filter beside the expressions would strip every row three times.
    line = lambda raw, i: X.rec(ord=i, line=F.ltrim(X.strip(raw), F.lit("-*• ")))
    fits = lambda r: F.contains(r["line"], F.lit("|")) & (F.lit(True) if longest_row is None else F.length(r["line"]) <= longest_row)
    lines = F.filter(F.transform(X.split_lines(X.strip_think(F.col("content"))), line), fits)
    body = replies.select("vid", F.explode(lines).alias("r")).select("vid", "r.*")
    field = lambda f, i: F.get(f, F.lit(i))
    spellings = lambda s: F.filter(F.transform(F.split(s, ","), X.strip), lambda x: x != "")
    fields = X.let(F.transform(F.split("line", r"\|"), X.strip), lambda f: X.rec(
        n=F.size(f), role=F.upper(field(f, 0)), names=spellings(F.coalesce(field(f, 1), F.lit(""))), en=field(f, 2),
        said=field(f, 3), relation=F.coalesce(field(f, 4), F.lit(""))))
    # Exploding one record keeps the filters below from repeating the parsing.
    rows = body.select("vid", "ord", F.explode(F.array(fields)).alias("r")).select("vid", "ord", "r.*") \
        .where((F.col("n") >= 3) & F.col("role").isin("MC", "NPC") & (F.size("names") > 0) & (F.col("en") != ""))
    first = F.get("names", F.lit(0))
    rows = rows.where(~is_pronoun(first, F.col("en")) & ~is_generic(first, F.col("en")))
    sex = settle_gender(F.col("said"), F.col("relation"), F.col("names"))
    cast = rows.select("vid", F.col("ord").cast("bigint").alias("ord"), "role", (F.col("names") if spellings_kept is None else F.slice("names", 1, spellings_kept)).alias("names"),
                       "en", sex.alias("sex"), (F.col("relation") if longest_relation is None else F.substring("relation", 1, longest_relation)).alias("relation"))
    return pick_lead(cast)


def pick_lead(cast: DataFrame) -> DataFrame:
    """The first MC row of a video is its lead; a cast list is one reply, so a window holds it. A row without a video has none."""
    lead = F.min(F.when(F.col("role") == "MC", F.col("ord"))).over(Window.partitionBy("vid"))
    return cast.withColumn("_lead", lead).withColumn(
        "role", F.when(F.col("vid").isNotNull() & (F.col("ord") == F.col("_lead")), "MC").otherwise("NPC")).drop("_lead")


def format_cast(cast: DataFrame, narrated: DataFrame, *, others: int | None = K.MAX_CHART_ROWS) -> DataFrame:
    """(vid, chart): the lead's paragraph, or the unnamed narrator's, then the first ``others`` (None: all)."""
    w = Window.partitionBy("vid").orderBy("ord")
    who = F.array_join("names", ", ")
    # Fixed formats: the audit looks for the opening words of either paragraph.
    him = F.when(F.col("sex") == "f", "she/her").otherwise("he/him")
    lead = cast.where("role = 'MC'").groupBy("vid").agg(F.min_by(F.concat(
        F.lit("THE MAIN CHARACTER is "), "en", F.lit(" - written in the source as "), who, F.lit(". "),
        F.when(F.col("relation") == "", "the narrator").otherwise(F.col("relation")),
        F.lit('. Narration is "I", "me", "my"; others speak of them as '), him, F.lit(".")), "ord").alias("lead"))
    gender = F.when(F.col("sex") == "f", "female - she/her").when(F.col("sex") == "m", "male - he/him").otherwise("?")
    rest = cast.where("role = 'NPC'")
    rest = rest if others is None else rest.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= others)
    rest = rest.withColumn("row", F.concat(F.lit("  "), who, F.lit(" = "), "en", F.lit(" ("), gender, F.lit(")"),
                                    F.when(F.col("relation") == "", "").otherwise(F.concat(F.lit(" - "), F.col("relation"))))) \
        .groupBy("vid").agg(F.concat(F.lit("\nEVERYONE ELSE:\n"), ordered_text("ord", F.col("row"), "\n")).alias("rest"))
    unnamed = F.lit("The narrator and main character of this video is never named; every narration line is theirs.")
    charts = narrated.join(lead, "vid", "left").join(rest, "vid", "left")
    first = F.when(F.col("lead").isNotNull(), F.col("lead")).when(F.coalesce("narrated", F.lit(False)), unnamed)
    return charts.select("vid", F.concat_ws("\n", first, F.col("rest")).alias("chart"))


def choose_cast(candidates: DataFrame) -> DataFrame:
    """First non-empty chart by model priority. candidates: vid, priority, chart."""
    return candidates.where("chart <> ''").groupBy("vid").agg(F.min_by("chart", "priority").alias("chart"))


def build_brief(charts: DataFrame, rules: str, notes: dict[str, str] | None = None) -> DataFrame:
    """Translator brief: rules with the language named, its note, then the chart.

    charts: vid, lang, chart. ``rules`` may hold {language}; both texts are settings.
    """
    names = F.create_map(*[F.lit(x) for kv in K.LANGUAGE_NAMES.items() for x in kv])
    language = F.coalesce(F.try_element_at(names, F.col("lang")), F.lit(K.UNKNOWN_LANGUAGE))
    text = F.replace(F.lit(rules), F.lit("{language}"), language)
    note = F.lit(None).cast("string")
    for lang, words in (notes or {}).items():
        note = F.when(F.col("lang") == lang, F.lit("ABOUT THIS LANGUAGE. " + words)).otherwise(note)
    chart = F.when(F.coalesce("chart", F.lit("")) != "", F.concat(F.lit("CAST LIST.\n"), "chart"))
    return charts.select("vid", F.concat_ws("\n\n", text, note, chart).alias("brief"))
