"""Model answers shaped into records: reviews, research, drafts, and the gates before they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.facts import once
from waymark.functions.text import strip_artifacts, word_count
from waymark.operators import schema

# fixed values
SOURCE_TYPES = ("official", "registration_platform", "aggregator", "review", "social", "news", "other")
QUOTE_WORDS, QUOTES, QUOTE_CHARS, SEO_CHARS, META_CHARS = 28, 3, 400, 70, 200
HIGHLIGHTS, WATCHOUTS, DESCRIPTION, DRAFT_SCORE = 5, 4, 220, 50
FAQ_WORDS = (30, 80)
NO_OBJECT, NO_SUMMARY, NO_DESCRIPTION, LONG_DESCRIPTION = "response was not a JSON object", "ai_summary is missing or empty", "short_description is missing or empty", "short_description is too long"
NO_PROS, NO_CONS, NO_FAQS, HALF_FAQ = "pros must be a non-empty array", "cons must be an array", "faqs must be a non-empty array", "a faq entry is missing question/answer"

#: What an answer may hold; what has another shape is null.
ANSWER = """title string, seo_title string, meta_description string, dek string, verdict string,
  rating struct<overall: double, breakdown: array<struct<label: string, score: double>>>,
  sections array<struct<heading: string, paragraphs: array<string>>>,
  sources array<struct<n: int, label: string, publisher: string, url: string, type: string>>,
  pull_quotes array<struct<quote: string, attribution: string, source_url: string>>,
  faqs array<struct<question: string, answer: string>>,
  excerpt_quotes array<struct<quote: string, attribution: string, source_url: string>>,
  highlights array<string>, watchouts array<string>, sentiment_scores struct<overall: double>, research_confidence string,
  ai_summary string, short_description string, pros array<string>, cons array<string>"""

#: What a summary's rules look at.
SUMMARY = "ai_summary string, short_description string, pros array<string>, cons array<string>, faqs array<struct<question: string, answer: string>>"


def said(x: Column) -> Column:
    """Whether a text says anything."""
    return F.coalesce(F.trim(x) != "", F.lit(False))


def parsed(answers: DataFrame, column: str = "json", fields: str = ANSWER) -> DataFrame:
    """answers with `a`, their JSON object as a record; null where there is none. A text is read once for each row, however many columns
    are made of it."""
    found = F.try_parse_json(column).isNotNull() & F.col(column).rlike(r"^\s*\{")
    return once(answers, a=F.when(found, F.from_json(column, fields)))


def _kept(items: Column, fits, shape) -> Column:
    """The well-formed items of a list in their final shape; none where there is no list."""
    made = F.transform(F.filter(items, lambda x: F.coalesce(fits(x), F.lit(False))), shape)
    return F.coalesce(made, F.slice(made, 1, 0), F.array())


def review(answers: DataFrame, as_of: str) -> DataFrame:
    """The columns of a review (X13) from `a` and the entity's entity_id, slug, name and short_description."""
    a = F.col("a")
    paragraphs = lambda s: F.filter(F.transform(F.filter(s["paragraphs"], said), strip_artifacts), lambda p: p != "")
    sections = _kept(a["sections"], lambda s: said(s["heading"]) & s["paragraphs"].isNotNull(), lambda s: F.struct(strip_artifacts(s["heading"]).alias("heading"), paragraphs(s).alias("paragraphs")))
    known = lambda t: F.when(t.isin(*SOURCE_TYPES), t).otherwise("other")
    sources = _kept(
        a["sources"], lambda s: (s["n"] > 0) & said(s["label"]) & schema.is_url(s["url"]),
        lambda s: F.struct(s["n"].alias("n"), F.trim(s["label"]).alias("label"), F.when(said(s["publisher"]), F.trim(s["publisher"])).alias("publisher"), s["url"].alias("url"), known(s["type"]).alias("type")),
    )
    quotes = _kept(
        a["pull_quotes"], lambda q: said(q["quote"]) & said(q["attribution"]) & schema.is_url(q["source_url"]) & (word_count(q["quote"]) <= QUOTE_WORDS),
        lambda q: F.struct(F.substring(F.trim(q["quote"]), 1, QUOTE_CHARS).alias("quote"), F.trim(q["attribution"]).alias("attribution"), q["source_url"].alias("source_url")),
    )
    faqs = _kept(a["faqs"], lambda f: said(f["question"]) & said(f["answer"]), lambda f: F.struct(F.trim(f["question"]).alias("question"), F.trim(f["answer"]).alias("answer")))
    marks = _kept(a["rating"]["breakdown"], lambda b: said(b["label"]) & b["score"].isNotNull(), lambda b: F.struct(F.trim(b["label"]).alias("label"), b["score"].alias("score")))
    rating = F.when(a["rating"]["overall"].isNotNull(), F.struct(a["rating"]["overall"].alias("overall"), marks.alias("breakdown")))
    cut = lambda x, n: F.when(said(x), F.substring(F.trim(x), 1, n))
    return answers.withColumns({
        "review_id": F.col("slug"), "title": F.when(said(a["title"]), F.trim(a["title"])).otherwise(F.concat("name", F.lit(" review"))),
        "seo_title": cut(a["seo_title"], SEO_CHARS), "meta_description": cut(a["meta_description"], META_CHARS),
        "dek": F.when(said(a["dek"]), F.trim(a["dek"])).otherwise(F.col("short_description")),
        "verdict": F.when(said(a["verdict"]), strip_artifacts(a["verdict"])).otherwise(""), "rating": rating,
        "sections": F.filter(sections, lambda s: F.size(s["paragraphs"]) > 0), "pull_quotes": F.slice(quotes, 1, QUOTES), "sources": sources, "faqs": faqs,
        "published_at": F.lit(as_of), "last_updated": F.lit(as_of), "status": F.lit("active"),
    })


def gate(reviews: DataFrame) -> DataFrame:
    """reviews with `outcome` (V16): without substance, with a citation of no source, invalid, or written."""
    thin = (F.size("sources") == 0) | (F.size("sections") == 0) | (F.col("verdict") == "")
    cited = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    numbers = F.flatten(F.transform(F.flatten(F.transform("sections", lambda s: s["paragraphs"])), cited))
    lost = F.size(F.array_except(numbers, F.transform("sources", lambda s: s["n"]))) > 0
    checked = schema.issues(reviews, schema.REVIEW)
    outcome = F.when(thin, "no substance").when(lost, "uncited").when(F.size("issues") > 0, "invalid").otherwise("written")
    return checked.withColumn("outcome", outcome)


def research(answers: DataFrame, as_of: str) -> DataFrame:
    """Research fields (X14) from `a`: quotes that can be attributed, highlights and watch-outs up to their number; where
    nothing is found only the date is stamped (`outcome` is `stamped`) and the old fields stay."""
    a = F.col("a")
    quotes = _kept(
        a["excerpt_quotes"], lambda q: said(q["quote"]) & q["attribution"].isNotNull() & schema.is_url(q["source_url"]),
        lambda q: F.struct(F.substring(F.trim(q["quote"]), 1, QUOTE_CHARS).alias("quote"), F.trim(q["attribution"]).alias("attribution"), q["source_url"].alias("source_url")),
    )
    strings = lambda x, n: F.slice(_kept(x, said, lambda s: F.trim(s)), 1, n)
    found = answers.withColumns({"new_quotes": quotes, "highlights": strings(a["highlights"], HIGHLIGHTS), "watchouts": strings(a["watchouts"], WATCHOUTS)})
    nothing = (F.size("new_quotes") == 0) & (F.size("highlights") == 0) & (F.size("watchouts") == 0)
    return found.withColumns({
        "outcome": F.when(nothing, "stamped").otherwise("researched"), "n_quotes": F.size("new_quotes"),
        "sentiment": F.when(~nothing & a["sentiment_scores"]["overall"].isNotNull(), a["sentiment_scores"]["overall"]),
        "confidence": F.when(~nothing, a["research_confidence"]), "research_last_updated": F.lit(as_of),
    })


def summary_problems(answers: DataFrame) -> DataFrame:
    """answers with `problems` (V15), the list of what is wrong with a summary."""
    a = F.col("a")
    low, high = FAQ_WORDS
    filled = lambda f: F.coalesce(f["question"] != "", F.lit(False)) & F.coalesce(f["answer"] != "", F.lit(False))
    # of an entry that isn't whole the number of words is null
    words = F.transform(a["faqs"], lambda f: F.when(filled(f), word_count(f["answer"])))
    entry = lambda n: F.when(n.isNull(), HALF_FAQ).when(~n.between(low, high), F.concat(F.lit("faq answer is "), n.cast("string"), F.lit(" words")))
    fixed = F.array(
        F.when(~said(a["ai_summary"]), NO_SUMMARY),
        F.when(~said(a["short_description"]), NO_DESCRIPTION).when(F.length(a["short_description"]) > DESCRIPTION, LONG_DESCRIPTION),
        F.when(F.coalesce(F.size(a["pros"]), F.lit(0)) <= 0, NO_PROS),
        F.when(a["cons"].isNull(), NO_CONS),
        F.when(F.coalesce(F.size(a["faqs"]), F.lit(0)) <= 0, NO_FAQS),
    )
    some = F.coalesce(F.transform(words, entry), F.array().cast("array<string>"))
    whole = F.array(F.lit(NO_OBJECT))
    return answers.withColumn("problems", F.when(a.isNull(), whole).otherwise(F.array_compact(F.concat(fixed, some))))


def problem_rows(answers: DataFrame) -> DataFrame:
    """(ord, problem): what is wrong with each summary, one row for each problem."""
    # the outer form, as an inner one filters by the list first, which is then made several times
    return summary_problems(answers).select("ord", F.explode_outer("problems").alias("problem")).filter("problem is not null")
