"""Column functions on crawled pages and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values, in the order in which they are replaced
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
NUMERIC = r"&#(\d+);"
COMMENT, UNSEEN = r"(?s)<!--.*?-->", r"(?is)<(script|style|noscript|head)[^>]*>.*?</\1>"
BLOCK_END, TAG = r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "<[^>]+>"
ANCHOR = r"""(?is)<a\s+[^>]*href=["']([^"'#][^"']*)["'][^>]*>(.*?)</a>"""
CHUNK, MAX_CHUNKS, OVERLAP = 6000, 8, 200
MARK = "\n...[truncated]"


def html_to_text(html: Column) -> Column:
    """Visible text: one trimmed line for each block that has any."""
    t = F.regexp_replace(F.regexp_replace(html, COMMENT, " "), UNSEEN, " ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCK_END, "\n"), TAG, " ")
    codes, between = F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(1)), F.split(t, NUMERIC)
    # each code stands where it was found, so that what it decodes to is not decoded again
    t = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(_character(F.get(codes, i)), F.lit("")))), "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), r"^\s+|\s+$", ""))
    return F.array_join(F.array_remove(lines, ""), "\n")


def _character(code: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes; U+FFFD for what is no character."""
    said = F.regexp_replace(code, "^0+(?=.)", "")
    n = F.when(F.length(said) <= 7, said.cast("int")).otherwise(0x110000)
    n = F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), 0xFFFD).otherwise(n)
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    low = lambda s: byte(F.shiftright(n, s).bitwiseAND(F.lit(63)) + 128)
    two = F.concat(byte(F.shiftright(n, 6) + 192), low(0))
    three = F.concat(byte(F.shiftright(n, 12) + 224), low(6), low(0))
    four = F.concat(byte(F.shiftright(n, 18) + 240), low(12), low(6), low(0))
    digits = F.when(n < 0x80, byte(n)).when(n < 0x800, two).when(n < 0x10000, three).otherwise(four)
    return F.when(code.isNotNull(), F.decode(F.unhex(digits), "UTF-8"))


def links(html: Column) -> Column:
    """Array of (href, text) of the anchors that lead elsewhere and say something."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("inner"))
    clean = F.transform(both, lambda a: F.struct(a["href"].alias("href"), F.trim(F.regexp_replace(html_to_text(a["inner"]), r"\s+", " ")).alias("text")))
    return F.filter(clean, lambda a: a["text"] != "")


def _dots_removed(path: Column) -> Column:
    """A path from the root without `.` and `..` segments."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a path that ends in a dot segment means the folder
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def absolute(href: Column, base: Column) -> Column:
    """A link resolved on its page's url, as RFC 3986 says: whole urls, those without a scheme, from the root, of a query
    only, and beside the page, dot segments removed; schemes in any case. Null where neither is a web address."""
    href, site = F.trim(href), F.regexp_extract(base, r"^(?i)(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href))
        .when(site == "", None)
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), href))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )
    whole = r"^(?i)(https?://[^/?#]+)([^?#]*)(.*)$"
    clean = F.concat(F.regexp_extract(joined, whole, 1), _dots_removed(F.regexp_extract(joined, whole, 2)), F.regexp_extract(joined, whole, 3))
    return F.when(joined.rlike(whole), clean).otherwise(joined)


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(MARK))).otherwise(text)


def focus(text: Column, needle: Column, limit: int) -> Column:
    """A window of limit characters around the first mention, a third of it before; without one, the beginning."""
    at = F.instr(F.lower(text), F.lower(F.trim(needle)))
    start = F.greatest(at - 1 - limit // 3, F.lit(0))
    head = F.when(start > 0, "...[earlier content omitted]\n").otherwise("")
    tail = F.when(start + limit < F.length(text), MARK).otherwise("")
    around = F.concat(head, F.substring(text, start + 1, F.lit(limit)), tail)
    return F.when(F.length(text) <= limit, text).when(at > 0, around).otherwise(truncate(text, limit))


def chunks(text: Column, size: int = CHUNK, most: int = MAX_CHUNKS, overlap: int = OVERLAP) -> Column:
    """Array of overlapping chunks, cut at the last blank if it lies in the last tenth. Where a chunk starts depends on
    the cut before, so it is a fold whose state is the next start."""

    def step(acc: Column, _: Column) -> Column:
        start = acc["next"]
        hard = F.least(start + size, F.length(text))
        window = F.substring(text, start + 1, F.lit(size))
        blank = F.length(window) - F.locate(" ", F.reverse(window))
        cut = F.when((hard < F.length(text)) & (F.locate(" ", F.reverse(window)) > 0) & (blank > size * 0.9), start + blank).otherwise(hard)
        done = start < 0
        more = F.concat(acc["out"], F.array(F.substring(text, start + 1, cut - start)))
        after = F.when(cut >= F.length(text), F.lit(-1)).otherwise(F.greatest(cut - overlap, start + 1))
        return F.struct(F.when(done, acc["out"]).otherwise(more).alias("out"), F.when(done, start).otherwise(after).alias("next"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
    long = F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda a: a["out"])
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).when(F.length(text) <= size, F.array(text)).otherwise(long)


#: A JSON string, whatever characters it holds.
STRING = r'(?s)"(?:[^"\\]|\\.)*"'


def _escaped(string: Column) -> Column:
    """A JSON string with its control characters escaped."""
    for code in range(0x20):
        short = {10: "\\n", 13: "\\r", 9: "\\t"}.get(code, f"\\u{code:04x}")
        string = F.replace(string, F.lit(chr(code)), F.lit(short))
    return string


def answer_json(answer: Column) -> Column:
    """The JSON text in a model's answer: a fenced block if there is one, from the first bracket to its partner outside
    strings; null if it doesn't parse. A fold over the characters keeps depth and whether it is inside a string."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(answer)
    start = F.regexp_instr(body, F.lit(r"[{\[]"))
    rest = F.substr(body, start)

    def step(acc: Column, c: Column) -> Column:
        quote = (c == '"') & ~acc["escaped"]
        inside = F.when(quote, ~acc["inside"]).otherwise(acc["inside"])
        depth = F.when(acc["inside"] | quote, acc["depth"]).when(c.isin("{", "["), acc["depth"] + 1).when(c.isin("}", "]"), acc["depth"] - 1).otherwise(acc["depth"])
        n = acc["n"] + 1
        return F.struct(
            n.alias("n"), depth.alias("depth"), inside.alias("inside"), (acc["inside"] & (c == "\\") & ~acc["escaped"]).alias("escaped"),
            F.when((acc["end"] == 0) & (depth == 0), n).otherwise(acc["end"]).alias("end"),
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(rest, ""), zero, step, lambda a: a["end"])
    found = F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end))
    # one repair: control characters inside strings, each written as JSON writes it
    strings, between = F.regexp_extract_all(found, F.lit(STRING), F.lit(0)), F.split(found, STRING)
    repaired = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(_escaped(F.get(strings, i)), F.lit("")))), "")
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(found), found).when(valid(repaired), repaired)
