"""Data-quality rules: every rule a table (collection, key, rule, severity), united and written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.facts import once
from waymark.functions.text import CHUNK_REF, availability, is_page, near_duplicate, own_check, question_key, word_count
from waymark.operators.schema import ISO_DAY
from waymark.sources.staged import written

#: A word is frequent if it lies in more than one of so many groups of questions.
OFTEN = 100


def issues(rows: DataFrame, collection: str, key: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each rule that a record breaks; all rules in one scan."""
    broken = F.array(*(F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, bad in rules))
    return rows.select(F.lit(collection).alias("collection"), key.alias("key"), F.inline(F.array_compact(broken)))


def repeated(rows: DataFrame, collection: str, key: str, by: str, order: str, rule: str) -> DataFrame:
    """All but the first of the records that share a value."""
    w = Window.partitionBy(by).orderBy(order)
    later = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn > 1")
    return later.select(F.lit(collection).alias("collection"), F.col(key).alias("key"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"))


def deadlines(entities: DataFrame, as_of: str) -> DataFrame:
    """(entity_id, rule) of entities (date, deadline, availability) whose dates contradict their status: open though the
    deadline has passed, a deadline after the event, open without a deadline though the event is over."""
    iso = lambda c: F.coalesce(F.col(c).rlike(ISO_DAY), F.lit(False))
    is_open = F.coalesce(availability(F.col("availability"), as_of) == "open", F.lit(False))
    rules = {
        "V4.passed": iso("deadline") & is_open & (F.col("deadline") < as_of),
        "V4.order": iso("deadline") & iso("date") & (F.col("deadline") > F.col("date")),
        "V4.past": ~iso("deadline") & is_open & iso("date") & (F.col("date") < as_of),
    }
    broken = F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items())))
    return entities.select("entity_id", F.explode(broken).alias("rule"))


def near_duplicate_questions(faqs: DataFrame) -> DataFrame:
    """(owner_id, first, second) of the questions of one record that ask the same. A record's questions are compared
    inside its row."""
    w = faqs.select("owner_id", F.struct("pos", question_key(F.col("question")).alias("key")).alias("q"))
    lists = w.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct(F.col("q.pos").alias("pos"), F.col("q.key").alias("key")))).alias("qs"))
    one = lists.select("owner_id", "qs", F.posexplode("qs").alias("i", "a")).select("owner_id", "a", F.slice("qs", F.col("i") + 2, F.size("qs")).alias("rest"))
    pairs = one.select("owner_id", "a", F.explode(F.filter("rest", lambda b: near_duplicate(F.col("a")["key"], b["key"]))).alias("b"))
    return pairs.select("owner_id", F.col("a.pos").alias("first"), F.col("b.pos").alias("second"))


def repeated_questions(reviews: DataFrame, entities: DataFrame) -> DataFrame:
    """(review_id, n, first): how many FAQs of a review ask what its entity's do, and the first of them. Both: entity_id, pos,
    question (reviews: review_id too). Questions meet inside one entity's row."""
    old = entities.groupBy("entity_id").agg(F.collect_list(question_key(F.col("question"))).alias("keys"))
    asked = reviews.join(old, "entity_id").withColumn("key", question_key(F.col("question")))
    again = asked.filter(F.exists("keys", lambda k: near_duplicate(k, F.col("key"))))
    return again.groupBy("review_id").agg(F.count("*").alias("n"), F.min(F.struct("pos", "question"))["question"].alias("first"))


def unstated_years(reviews: DataFrame) -> DataFrame:
    """review_id of those that never state the year of their event. reviews: review_id, date and prose, all texts of a review."""
    year = F.regexp_extract("date", r"^(\d{4})", 1)
    return reviews.filter((year != "") & ~F.contains(F.coalesce("prose", F.lit("")), year)).select("review_id")


def baked_checks(pieces: DataFrame) -> DataFrame:
    """(key, field, said) of the prose pieces that state their own date of verification or confidence score."""
    return pieces.withColumn("said", own_check(F.col("text"))).filter("said is not null").select("key", "field", "said")


def totals(found: DataFrame) -> DataFrame:
    """(collection, n_errors, n_warnings, passed) over a table of violations."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return found.groupBy("collection").agg(errors.alias("n_errors"), warnings.alias("n_warnings"), (errors == 0).alias("passed"))


def _filters(content: Column) -> list[Column]:
    """one and two: 64-bit filters of words, each word a bit of both. What one content lacks in either, it doesn't hold."""
    bits = lambda seed: F.transform(content, lambda w: F.xxhash64(F.lit(seed), w).bitwiseAND(F.lit(63)).cast("int"))
    either = lambda acc, at: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return [F.aggregate(bits(seed), F.lit(0).cast("long"), either).alias(seed) for seed in ("one", "two")]


def same_questions(faqs: DataFrame) -> DataFrame:
    """(lead, content, n, first_owner, other, other_n, other_owner): groups of equal questions, and the groups whose
    content lies in another's, where records differ; other is the larger content, or the same one for a group of
    several records. Groups meet on the rarest word of the smaller content, and are then verified.

    What moves once for each word is its hash with the number and the filters of its group, never a content: the smaller
    content goes to its rarest word, and on to the larger ones that the filters let through. Joins are merges but for the
    few words that many groups hold, as no other side has a bound that would let every executor hold it."""
    keyed = once(faqs.select("owner_id", "question"), k=question_key(F.col("question"))).filter("size(k.content) >= 2")
    group = keyed.groupBy(F.col("k.lead").alias("lead"), F.array_sort("k.content").alias("content")).agg(
        F.count("*").alias("n"), F.min("owner_id").alias("first_owner"), F.max("owner_id").alias("last_owner")
    )
    # written, as all that follows reads it and its numbers must not change
    group = written(group.select("*", *_filters(F.col("content")), F.monotonically_increasing_id().alias("id")), "questions")
    word = F.explode(F.transform("content", lambda w: F.xxhash64("lead", w))).alias("word")
    words = group.select("id", word)
    common = words.groupBy("word").agg(F.count("*").alias("df"))
    # words of more than a hundredth of the groups are few, a hundred times the words of a group at most; their rows stay where they are
    often = F.broadcast(common.filter(F.col("df") * OFTEN > group.count()))
    counted = words.join(often, "word").unionByName(words.join(often, "word", "left_anti").join(common.hint("merge"), "word"))
    rarest = counted.groupBy("id").agg(F.min(F.struct("df", "word"))["word"].alias("word"))
    smaller = group.join(rarest.hint("merge"), "id")
    larger = group.select(F.col("id").alias("other_id"), F.col("one").alias("other_one"), F.col("two").alias("other_two"), word)
    lies = lambda x: F.col(x).bitwiseAND(F.bitwise_not(f"other_{x}")) == 0
    met = larger.join(smaller.hint("merge"), "word").filter(lies("one") & lies("two") & ((F.col("id") != F.col("other_id")) | (F.col("first_owner") != F.col("last_owner"))))
    whole = group.select(*(F.col(c).alias(f"other_{c}") for c in ("id", "lead", "content", "n", "first_owner", "last_owner")))
    found = met.drop("other_one", "other_two").join(whole.hint("merge"), "other_id").filter((F.col("lead") == F.col("other_lead")) & (F.size(F.array_except("content", "other_content")) == 0))
    differ = found.filter("not (first_owner = last_owner and other_first_owner = other_last_owner and first_owner = other_first_owner)")
    return differ.select("lead", F.array_join("content", " ").alias("content"), "n", "first_owner", F.array_join("other_content", " ").alias("other"), "other_n", F.col("other_first_owner").alias("other_owner"))


def violations(v) -> DataFrame:
    """Every rule over the derived tables v."""
    reviews, entities, faqs, sources = v.v_review, v.v_entity, v.v_faq, v.v_source
    n = word_count(F.col("answer"))
    orphans = reviews.join(entities.select("entity_id"), "entity_id", "left_anti")
    parts = [
        issues(reviews, "review", F.col("review_id"), [
            ("V11.cite", "error", F.col("body").rlike("(?i)</?cite")), ("V11.ref", "error", F.col("body").rlike(CHUNK_REF)),
            ("V11.facets", "warning", F.exists(F.split("body", "\n"), lambda p: F.regexp_count(p, F.lit(" · ")) >= 3)),
            ("V13.year", "warning", ~F.contains("body", F.lit("2024"))), ("V5.check", "warning", own_check(F.col("body")).isNotNull()),
        ]),
        orphans.select(F.lit("review").alias("collection"), F.col("review_id").alias("key"), F.lit("V10.entity").alias("rule"), F.lit("error").alias("severity")),
        issues(faqs, "faq", F.concat_ws(":", "owner_id", F.col("pos").cast("string")), [("V7.answer", "warning", ~n.between(30, 80))]),
        repeated(entities, "entity", "entity_id", "slug", "ord", "V2.slug"),
        issues(entities, "entity", F.col("entity_id"), [
            ("V1.tags", "error", F.size("tags") > 2), ("V4.deadline", "warning", (F.col("status") == "active") & (F.col("date_s") < "1996-06-01")),
        ]),
        issues(sources, "source", F.concat_ws(":", "entity_id", F.col("pos").cast("string"), "url"), [("V14.page", "warning", ~is_page(F.col("url")))]),
    ]
    return reduce(DataFrame.unionByName, parts)
