"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule, so that a policy
(a named set of rules) is one bitwise AND, and the effect of leaving a rule out is an aggregate over failure masks that
never goes back to the texts.

Defined results: a null text is an empty text (no words, no lines). An empty text fails ``few_words``. Rates are
compared by multiplication, so that empty texts divide by nothing. Repeated rows and ids are judged row by row. Extra
columns are left alone; the ledger's columns are ``measured`` and ``failures`` unless named otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = CAPITALS + CAPITALS.lower()
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters",
            "n_exclamations", "n_distinct_words", "n_stuttered")


@dataclass(frozen=True)
class Rule:
    """A rule fails a text where ``condition``, SQL over the measures, holds. ``bit`` is its place in the mask for ever."""

    bit: int
    name: str
    condition: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_rate", "10 * n_symbols > n_words"),
    Rule(3, "shouting", "2 * n_capitals > n_letters AND n_letters > 0"),
    Rule(4, "exclamation_rate", "5 * n_exclamations > n_words"),
    Rule(5, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule(7, "few_distinct_words", "20 * n_distinct_words < n_words"),
    Rule(8, "stuttering", "10 * n_stuttered > 3 * n_words"),
)
#: Policies by version: the rules whose failure rejects a text.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(rule.name for rule in RULES if rule.name not in ("few_distinct_words", "stuttering")),
    "v2": tuple(rule.name for rule in RULES),
}


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs at least twice. Windows are named by exact pairing of ranks."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]

    name, covered = ids, 1
    while covered < width:
        step = min(covered, width - covered)
        name = paired(name[: len(words) - covered - step + 1], name[step:] if step == covered else name[step: len(words) - covered + 1])
        covered += step
    hits = np.bincount(name)[name] > 1
    if not hits.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    size = len(raw)
    return (
        len(words),
        len(text) - (size - len(raw.translate(None, WHITE))),
        size - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        size - len(raw.translate(None, CAPITALS)),
        size - len(raw.translate(None, LETTERS)),
        raw.count(b"!"),
        len(set(words)),
        sum(map(eq, words, words[1:])),
    )


def measured(text: Column) -> Column:
    """The measures as a struct of longs, computed once per row however often it is used."""
    kind = ", ".join(f"{name}: bigint" for name in MEASURES)

    @F.arrow_udf(f"struct<{kind}>")
    def run(column: pa.Array) -> pa.Array:
        rows = [measure_text(t or "") for t in column.to_pylist()]
        columns = zip(*rows) if rows else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)

    return run.asNondeterministic()(text)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, measures: str = "measured",
           failures: str = "failures") -> DataFrame:
    """``docs`` with a struct of measurements and a mask of failed rules (bigint)."""
    df = docs.withColumn(measures, measured(F.col(f"`{text}`")))
    bits = [F.when(F.expr(_over(rule.condition, measures)), F.lit(1 << rule.bit)).otherwise(0).cast("bigint") for rule in rules]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return df.withColumn(failures, mask)


def _over(condition: str, struct: str) -> str:
    words = condition.replace("(", " ( ").replace(")", " ) ").split()
    return " ".join(f"`{struct}`.{w}" if w in MEASURES else w for w in words)


def mask_of(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << rule.bit for rule in rules if rule.name in names)


def kept(policy: str | tuple[str, ...], failures: str = "failures") -> Column:
    """Whether a row of the ledger passes every rule of the policy."""
    return F.col(failures).bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) == 0


def ablation(entries: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES, failures: str = "failures") -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail nothing else, and those kept were it left out.

    Texts are first counted by failure mask (at most 2^rules groups, combined map-side); the rest works on those counts.
    """
    mask = mask_of(policy, rules)
    chosen = [rule for rule in rules if mask >> rule.bit & 1]
    masks = entries.groupBy(F.col(failures).bitwiseAND(F.lit(mask).cast("bigint")).alias("mask")).agg(F.count("*").alias("n"))
    each = masks.select("mask", "n", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in chosen))).alias("r"))
    failed, alone = F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("mask") == F.col("r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(failed).alias("n_failed"), total(alone).alias("n_failed_alone"),
        total(F.col("mask") == 0).alias("n_kept"), total((F.col("mask") == 0) | alone).alias("n_kept_without_rule"))
