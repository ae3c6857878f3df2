"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps its measurements and one long whose
bit b is set if rule b failed; a policy is a versioned mask of the rules that count. Another policy, or
an ablation, is then bit arithmetic over the ledger and never touches a text again.

Defined results: a null or empty text has no words, so it fails `few_words`; a null doc_id passes through;
repeated rows are judged one by one; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import hashes, words

WINDOW = 8
#: (name, failing condition over the measurements); the position is the bit.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
)
BIT = {name: 1 << b for b, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(name for name, _ in RULES))


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows at sorted starts."""
    gap = F.transform(starts, lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(width)), F.lit(width)))
    return F.aggregate(gap, F.lit(0), lambda a, x: a + x)


def measure(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry and the measurements of each whole text. One narrow pass without a shuffle: repeated windows
    are found inside the row, by 64-bit hashes (two windows of one text collide with probability 2^-64),
    and only texts that have any are sorted."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = F.col
    first = docs.select(*carry, text.alias("text")).select(
        *carry,
        words(at("text")).alias("w"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
    )
    first = first.select(
        *carry, "word_chars", "n_symbols", "n_capitals",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes(at("w")).alias("h"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("h") - WINDOW),
        lambda i: F.xxhash64(*(F.get(at("h"), i + k) for k in range(WINDOW))),
    )
    none = F.array().cast("array<bigint>")
    second = first.withColumn("g", F.when(F.size("h") >= WINDOW, windows).otherwise(none)).drop("h")
    repeated = F.size(F.array_distinct("g")) < F.size("g")
    pairs = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    third = second.withColumn("s", F.when(repeated, pairs)).drop("g")
    same = lambda e, j: F.coalesce(F.get(at("s"), j)["x"] == e["x"], F.lit(False))
    twice = F.filter("s", lambda e, j: same(e, j - 1) | same(e, j + 1))
    fourth = third.withColumn("p", F.when(at("s").isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"])))).drop("s")
    covered = F.when(at("p").isNotNull(), _covered(at("p"), WINDOW)).otherwise(0)
    measured = fourth.withColumn("n_repeat_words", covered.cast("long")).drop("p")
    # a row for a row: Catalyst would push a later filter below the hashes and compute them anew for each element
    return measured.select(F.explode(F.array(F.struct("*"))).alias("m")).select("m.*")


def ledger(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements and `failed`, the mask of failed rules."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(docs, carry).withColumn("failed", mask.cast("long"))


def apply_policy(rows: DataFrame, policy: Policy = FULL) -> DataFrame:
    """Adds `kept` and the policy's version. The base rules reject under every policy."""
    mask = policy.mask | BASE.mask
    return rows.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(mask)) == 0,
        "policy": F.lit(policy.version),
    })


def ablation(rows: DataFrame, policy: Policy = FULL) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept
    without it. One aggregation over the ledger, of a few longs a task."""
    mask = policy.mask | BASE.mask
    failed = F.col("failed").bitwiseAND(F.lit(mask))
    names = [n for n, _ in RULES if BIT[n] & mask]
    sums = [F.count("*").alias("n_docs"), F.count_if(failed == 0).alias("n_kept")]
    for n in names:
        sums += [F.count_if(failed.bitwiseAND(F.lit(BIT[n])) != 0).alias(f"{n}_f"), F.count_if(failed == BIT[n]).alias(f"{n}_o")]
    row = F.array(*(
        F.struct(F.lit(n).alias("rule"), F.col(f"{n}_f").alias("n_failed"), F.col(f"{n}_o").alias("n_only"),
                 (F.col("n_kept") + F.col(f"{n}_o")).alias("n_kept_without"))
        for n in names
    ))
    return rows.agg(*sums).select(F.lit(policy.version).alias("policy"), "n_docs", "n_kept", F.inline(row))


def judge(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """Ledger and verdict of every document."""
    return apply_policy(ledger(docs), policy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "failed", "policy",
    )


def keep(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The rows of docs that the policy doesn't reject, with all their columns."""
    rows = ledger(docs.select(F.struct("*").alias("doc"), "text"), ("doc",))
    good = F.col("failed").bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0
    return rows.filter(good).select("doc.*")
