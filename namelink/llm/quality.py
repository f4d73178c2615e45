"""Quality rules: a bitmask ledger, native expressions only.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule.  A versioned policy is a mask over those bits, so
changing a policy or measuring what one rule costs reads the ledger and never
the texts again.

Nulls and empty texts have no words (and fail the word minimum); very long texts
are measured whole; a measure that just reaches a rule's bound does not fail it;
repeated rows get equal ledgers; an empty table gives an empty ledger; columns whose names
clash with the ledger's are left out of it unless named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, once

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Up to so many distinct repeated windows are looked up by scanning; more are found by sorting positions.
SCAN_WINDOWS = 48


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    #: SQL over the measurements; true means failed
    fails: str


#: The bit of a rule never changes; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "repeated_windows_strict", "100 * n_repeat_words > 30 * n_words"),
    Rule(7, "no_words", "n_words = 0"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {
    "base-1": BASE,
    "2024-1": Policy("2024-1", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words")),
    "2024-2": Policy("2024-2", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "repeated_windows_strict")),
    # Short texts of good quality stay: what is wrong with a text shows in the other rules.
    "2025-1": Policy("2025-1", ("no_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words")),
}
CURRENT = "2024-1"
#: For corpora that keep short documents, as the pipeline does.
SHORT_KEPT = "2025-1"


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the array holds at least twice (windows compared by 64-bit hash)."""
    hashes = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))
    )

    def covered(positions: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))

    def scanned(h: Column, twice: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return covered(F.filter(marked, lambda p: p.isNotNull()))

    def sorted_positions(h: Column) -> Column:
        entries = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def same(e: Column, neighbour: Column) -> Column:
            return F.coalesce(e["h"] == neighbour["h"], F.lit(False))

        def positions(s: Column) -> Column:
            kept = F.filter(s, lambda e, i: same(e, F.get(s, i + 1)) | same(e, F.get(s, i - 1)))
            return covered(F.transform(kept, lambda e: e["p"]))

        return let(entries, positions)

    def of_hashes(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        return let(
            twice,
            lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= SCAN_WINDOWS, scanned(h, d)).otherwise(sorted_positions(h)),
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, of_hashes)).cast("long")


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row of measurements per document, with the columns named in ``keep``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = once(
        docs.select(*keep, t.alias("_text")),
        _words=F.array_remove(F.split("_text", f"[{SPACE_CLASS}]+"), ""),
        _lines=F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
    )
    return once(
        split,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.translate("_text", WHITE, "")).cast("long"),
        n_symbols=(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("_words")),
    ).drop("_text", "_words", "_lines")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed``, a bitmask with one bit per failed rule."""
    measured = measure(docs, text, keep)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def rejects(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, and those that only it rejects; one pass over the ledger."""
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask))
    patterns = entries.groupBy(masked.alias("pattern")).agg(F.count("*").alias("n"))
    each = patterns.select("n", F.bit_count("pattern").alias("bits"), F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.getbit("pattern", F.lit(r.bit)).cast("long").alias("hit")) for r in rules])))
    return each.groupBy("rule").agg(
        F.sum(F.col("n") * F.col("hit")).alias("n_failed"), F.sum(F.col("n") * F.col("hit") * (F.col("bits") == 1).cast("long")).alias("n_only"), F.lit(policy.version).alias("policy")
    )


def keep_documents(docs: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """The rows of ``docs`` that the policy accepts, all columns as they were."""
    names = docs.columns
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"))
    kept = ledger(row.select("_row", F.col("_row.text").alias("text")), keep=("_row",)).where(~rejects(policy))
    return kept.select("_row.*")
