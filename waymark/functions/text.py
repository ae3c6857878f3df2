"""Column functions on dates, statuses, scores and questions: no Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
UNKNOWN = r"(?i)^(not[\s_-]*yet[\s_-]*announced|to[\s_-]*be[\s_-]*announced|tba|tbc|tbd|unknown|unconfirmed|none|n/?a)$"
CLOSED = "closed|sold out|fully booked|ended|full house"
NOT_OPEN = "not yet|not_yet|tba|to be announced|closed|pending"
NOT_YET = r"(?i)not yet (open|announced|confirmed|available|live)|\bopening soon\b|\bcoming soon\b|\bopens\b|\bwill open\b"
SUBJECT = "(?:registration|registrations|registering|entries|entry pricing|sign[- ]?ups?)"
STATUS = r"(?i)\b(open|opens|opened|opening|closed?|closes|sold out|still available|not yet|unannounced|yet to be)\b"
SENTENCE = rf"(?i)^(?:\[\d+\]\s+)?(?:[^,.]{{0,30}},\s+)?(?:[A-Za-z][\w-]*\s+){{0,2}}{SUBJECT}\b"
JOINERS = "(?:and|with|while|though|although|but|so|as|since|because)"
CLAUSE = rf"(?i)(?:[,;]\s+|\s+(?={JOINERS}\s))\s*(?:{JOINERS}\s+)?(?:the\s+|open\s+|closed\s+)?{SUBJECT}\b[^.!?;]*$"
CURRENCIES = "usd|thb|php|idr|myr|vnd|sgd|khr|lak|mmk|bnd|rm|rp"
PRICE = rf"(?i)(?:{CURRENCIES}|\$|฿|₱|€|£)\s*\d|\d[\d,.]*\s*(?:{CURRENCIES}|baht|dollars?|pesos?|ringgit|rupiah|dong)\b"
BACK = "(?i)^(that|this|these|those|it|they|there|which|both|either|such)\\b"
SIGN_UP = r"(?i)\b(registration|registrations|register|registering|sign[- ]?ups?|entries|entrants|entry)\b"
CHUNK_REF = r"\[\d+-[^\]]*\]"
OWN_CHECK = r"(?i)(?:as of the last verification[^.]*|(?:last )?verified (?:as of|on|against[^.]*?as of)[^.]*?\d{4}|confidence (?:score|rating) (?:of )?\(?\d+\)?)"
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "do", "does", "did", "can", "could", "will", "would", "should",
    "i", "you", "it", "they", "there", "this", "that", "these", "those", "to", "of", "for", "in", "on", "at", "by", "with",
    "from", "and", "or", "any", "my", "your", "get", "got", "have", "has",
]
INTERROGATIVES = ["what", "when", "where", "who", "which", "why", "how", "is", "are", "do", "does", "can", "will", "should"]


def _month_of(day: Column, pattern: str) -> Column:
    n = F.nullif(F.regexp_extract(day, pattern, 2), F.lit("")).cast("int")
    return F.when(n.between(1, 12), F.get(F.lit(MONTHS), n - 1))


def month_key(day: Column) -> Column:
    """yyyy-MM of an ISO date; null if it doesn't start with one."""
    return F.nullif(F.regexp_extract(day, r"^(\d{4}-\d{2})", 1), F.lit(""))


def month_label(day: Column) -> Column:
    """Such as August 2026; null for a month that doesn't exist."""
    return F.concat(_month_of(day, r"^(\d{4})-(\d{2})"), F.lit(" "), F.substring(day, 1, 4))


def day_month(day: Column) -> Column:
    """The badge (day, month); null if it isn't a date."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})"
    d = F.nullif(F.regexp_extract(day, pattern, 3), F.lit("")).cast("int").cast("string")
    month = F.upper(F.substring(_month_of(day, pattern), 1, 3))
    return F.when(month.isNotNull() & d.isNotNull(), F.struct(d.alias("day"), month.alias("month")))


def is_unknown(status: Column) -> Column:
    t = F.trim(F.coalesce(status, F.lit("")))
    return (t == "") | t.rlike(UNKNOWN)


def humanise(status: Column) -> Column:
    """snake_case as words with capitals; text with blanks stays."""
    parts = F.transform(F.array_remove(F.split(status, "_"), ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(F.trim(F.coalesce(status, F.lit(""))) == "", "").when(F.contains(status, F.lit(" ")), status).otherwise(F.array_join(parts, " "))


def dates_named(text: Column) -> Column:
    """ISO dates of the shapes 1 Jul 2026 and May 5, 2026."""
    names = [m[:3].lower() for m in MONTHS]
    any_month = "|".join(names)
    iso = lambda d, m, y: F.concat_ws("-", y, F.lpad(F.array_position(F.lit(names), F.lower(F.substring(m, 1, 3))).cast("string"), 2, "0"), F.lpad(d, 2, "0"))
    first = F.regexp_extract_all(text, F.lit(rf"(?i)\b(\d{{1,2}}\s+(?:{any_month})[a-z]*\s+\d{{4}})\b"), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:{any_month})[a-z]*\s+\d{{1,2}},?\s+\d{{4}})\b"), F.lit(1))
    a = F.transform(first, lambda x: iso(F.element_at(F.split(x, r"\s+"), 1), F.element_at(F.split(x, r"\s+"), 2), F.element_at(F.split(x, r"\s+"), 3)))
    b = F.transform(second, lambda x: iso(F.replace(F.element_at(F.split(x, r"\s+"), 2), F.lit(","), F.lit("")), F.element_at(F.split(x, r"\s+"), 1), F.element_at(F.split(x, r"\s+"), 3)))
    return F.concat(a, b)


def availability(status: Column, as_of: str) -> Column:
    """closed, open, not_yet_open or null; a promise dated before as_of says nothing."""
    s = F.lower(status)
    is_open = ~s.rlike(NOT_OPEN) & s.rlike(r"\bopen\b")
    late = F.exists(dates_named(status), lambda d: d < as_of)
    soon = F.regexp_replace(status, "[_-]+", " ").rlike(NOT_YET)
    return F.when(F.trim(status) == "", None).when(s.rlike(CLOSED), "closed").when(is_open, "open").when(soon & ~late, "not_yet_open")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where use names it several times or inside a list's function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_status_sentence(sentence: Column) -> Column:
    return F.trim(sentence).rlike(SENTENCE) & F.trim(sentence).rlike(STATUS)


def scrub(text: Column, allow_empty: bool = False) -> Column:
    """Text without claims about a registration's status: whole sentences that state one and no price, the follow-on
    sentence that only restates it, and a clause that ends a sentence. If nothing is left the text stays, unless it
    may be empty. A fold over the sentences carries whether the last one took the next with it."""
    cut_up = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")

    def clause(s: Column) -> Column:
        body, tail = F.regexp_extract(s, r"^([\s\S]*?)([.!?]*)$", 1), F.regexp_extract(s, r"^([\s\S]*?)([.!?]*)$", 2)
        shorter = lambda b, claim, rest: F.when(
            (claim != "") & claim.rlike(STATUS) & ~claim.rlike(PRICE) & (rest != ""), F.concat(rest, F.when(tail == "", ".").otherwise(tail))
        ).otherwise(s)
        rest = lambda b, claim: F.trim(F.substring(b, F.lit(1), F.length(b) - F.length(claim)))
        return bound(body, lambda b: bound(F.regexp_extract(b, f"({CLAUSE})", 1), lambda claim: bound(rest(b, claim), lambda r: shorter(b, claim, r))))

    def judged(s: Column, after: Column) -> Column:
        """A sentence, whether it names what a claim is about, whether it goes, and whether it takes the next one with it."""
        about = s.rlike(f"(?i){SUBJECT}")  # no claim is without it, and most sentences are
        goes = lambda follows: about & is_status_sentence(s) & ~s.rlike(PRICE) & ~(follows & ~after.rlike(SIGN_UP))
        return bound(after.rlike(BACK), lambda f: bound(goes(f), lambda g: F.struct(s.alias("s"), about.alias("about"), g.alias("goes"), (g & f).alias("takes"))))

    def step(acc: Column, x: Column) -> Column:
        keep = F.when(acc["skip"] | x["goes"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.when(x["about"], clause(x["s"])).otherwise(x["s"]))))
        return F.struct(keep.alias("kept"), (~acc["skip"] & x["takes"]).alias("skip"))

    # a sentence looks at the next one in a list that is made once, not once for each sentence
    sentences = bound(cut_up, lambda parts: F.transform(parts, lambda s, i: judged(s, F.coalesce(F.get(parts, i + 1), F.lit("")))))
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))
    out = F.trim(F.aggregate(sentences, zero, step, lambda a: F.array_join(a["kept"], " ")))
    out = out if allow_empty else bound(out, lambda o: F.when(o == "", text).otherwise(o))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", text).otherwise(out)


def is_status_question(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    return q.rlike(r"\b(registration|registrations|register|entries|entry|sign[- ]?ups?)\b") & q.rlike(
        r"\b(open|opens|opened|closed?|closes|closing|still|sold out|available|deadline)\b"
    )


def drop_status_faqs(faqs: Column) -> Column:
    """FAQs that don't ask for a status, with answers scrubbed; those left without an answer go."""
    asked = F.filter(faqs, lambda f: ~is_status_question(f["question"]))
    clean = F.transform(asked, lambda f: F.struct(f["question"].alias("question"), scrub(f["answer"], True).alias("answer")))
    return F.filter(clean, lambda f: f["answer"].isNull() | (F.trim(f["answer"]) != ""))


def without_claims(entity: DataFrame) -> DataFrame:
    """Entities without claims about a registration's status: the status itself, sentences of the summary and the description,
    pros and cons that state one, and FAQs (X5)."""
    kept = lambda c: F.filter(c, lambda x: ~F.coalesce(is_status_sentence(x), F.lit(False)))
    change = {"ai_summary": scrub, "short_description": scrub, "pros": kept, "cons": kept, "faqs": drop_status_faqs}
    return entity.withColumns({c: make(F.col(c)) for c, make in change.items() if c in entity.columns}).drop("registration_status")


def without_claims_in_reviews(reviews: DataFrame) -> DataFrame:
    """The same for reviews: standfirst, verdict, description, paragraphs and FAQs; a section left without a paragraph goes."""
    clean = lambda s: F.filter(F.transform(s["paragraphs"], lambda p: scrub(p, True)), lambda p: F.trim(p) != "")
    left = F.filter(F.transform("sections", lambda s: s.withField("paragraphs", clean(s))), lambda s: F.size(s["paragraphs"]) > 0)
    change = {c: scrub(F.col(c)) for c in ("dek", "verdict", "meta_description")} | {"sections": left, "faqs": drop_status_faqs(F.col("faqs"))}
    return reviews.withColumns({c: x for c, x in change.items() if c in reviews.columns})


def strip_score(text: Column) -> Column:
    """Without inline scores such as (85/100)."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\(\s*\d{1,3}\s*/\s*100\s*\)", ""), r"\s{2,}", " "))


def strip_artifacts(text: Column) -> Column:
    """Without leaked citation tags and references with a hyphen."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)</?cite[^>]*>", ""), r"\s*" + CHUNK_REF, ""), r"\s{2,}", " "))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), ""))


def own_check(text: Column) -> Column:
    """Where a text states its own date of verification or confidence score; null if it doesn't."""
    return F.nullif(F.regexp_extract(text, f"({OWN_CHECK})", 1), F.lit(""))


def question_key(question: Column) -> Column:
    """(lead, content): the leading interrogative, and the words that matter."""
    plain = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"[^a-z0-9\s]", " ")
    ws = F.array_remove(F.split(plain, r"\s+"), "")
    lead = F.when(F.coalesce(F.get(ws, F.lit(0)), F.lit("")).isin(INTERROGATIVES), F.get(ws, F.lit(0))).otherwise("")
    content = F.array_distinct(F.filter(ws, lambda w: ~w.isin(STOPWORDS)))
    return F.struct(F.size(ws).alias("n"), lead.alias("lead"), F.array_remove(content, lead).alias("content"))


def near_duplicate(a: Column, b: Column) -> Column:
    """Whether two question keys ask the same: one lead, and the smaller content, of two words or more, lies in the other."""
    smaller = F.least(F.size(a["content"]), F.size(b["content"]))
    inside = (F.size(F.array_intersect(a["content"], b["content"])) == smaller) & (smaller >= 2)
    return (a["n"] > 0) & (b["n"] > 0) & (a["lead"] == b["lead"]) & inside


def dedupe_faqs(faqs: Column) -> Column:
    """FAQs in order without near-duplicates of one kept before, and without those that ask nothing."""
    keyed = F.transform(F.filter(faqs, lambda f: F.coalesce(f["question"], F.lit("")) != ""), lambda f: F.struct(f.alias("faq"), question_key(f["question"]).alias("key")))
    step = lambda acc, x: F.when(F.exists(acc, lambda k: near_duplicate(k["key"], x["key"])), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(keyed, F.slice(keyed, 1, 0), step, lambda a: F.transform(a, lambda x: x["faq"]))


def without_marks(text: Column) -> Column:
    """Text decomposed (NFKD) and without its accents. The built-in functions can't decompose, so texts with other
    characters than ASCII go through one Arrow function; the others don't leave the JVM."""

    @F.pandas_udf("string")
    def decomposed(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"), na_action="ignore")

    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(decomposed(F.when(~plain, text)))


def slugify(text: Column) -> Column:
    """Lower case, accents off, other characters as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(without_marks(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_page(url: Column) -> Column:
    """Whether a url points to a page and not only to a site."""
    return F.coalesce(url.rlike(r"^https?://[^/?#]+/[^?#]*[^/?#]"), F.lit(False))
