"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once per document.  The ledger row stores one failure bit per rule next to the
measurements the rules came from.  A policy is a versioned mask over those bits: applying another policy, or
asking what a rule costs (ablation), reads the ledger and never a text again.

Defined results: a null text counts as empty and has zero words; an empty table gives an empty ledger; repeated rows
stay repeated; the caller's other columns are not looked at and not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over the measurements; ``bit`` its place in the ledger's mask."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count: ``rules`` names them."""

    version: str
    rules: tuple[str, ...]


#: Ratios are compared as whole numbers, so that every engine agrees on them.  Distinct words grow with the root of the words at
#: least, however long a text is.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", 2, "100 * n_symbols > 40 * n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "10 * word_chars < 15 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
    Rule("shouting", 6, "100 * n_upper > 50 * word_chars"),
    Rule("few_distinct_words", 7, "n_distinct_words * n_distinct_words < n_words"),
)

POLICIES = (
    Policy("base", ("few_words", "repeated_windows")),
    Policy("v1", ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines")),
    Policy("v2", tuple(r.name for r in RULES)),
)

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct_words")


def policy_mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that ``policy`` looks at."""
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated(df: DataFrame, hashes: str, width: int, out: str) -> DataFrame:
    """Replace the column ``hashes`` (of a text's words) by ``out``: the positions covered by ``width``-word windows that occur twice or more.

    A window's hash and its position share one long (the position takes the bits that the document needs), so that a primitive
    sort brings equal windows together and the positions come along.  Whole hashes are compared then; only where neighbours
    share the upper bits alone, windows are sorted again as pairs of whole hash and position.
    """
    keep = [c for c in df.columns if c not in (hashes, "bits")]
    last, mask = f"size({hashes}) - {width}", "(shiftleft(1L, bits) - 1L)"
    parts = ", ".join(f"get({hashes}, i + {k})" for k in range(width))
    at = f"int({{}} & {mask})".format
    near = "get(s, j + 1)"
    whole = lambda x, y: f"(shiftright({x}, bits) = shiftright({y}, bits) AND get(f, {at(x)}) = get(f, {at(y)}))"
    steps = [
        {"f": f"CASE WHEN {last} < 1 THEN array() ELSE transform(sequence(0, {last}), i -> xxhash64({parts})) END", "bits": "bits"},
        {"s": f"sort_array(transform(f, (x, i) -> (x & ~{mask}) | i))", "f": "f", "bits": "bits"},
        {"mixed": f"exists(transform(s, (x, j) -> coalesce(shiftright(x, bits) = shiftright({near}, bits) AND get(f, {at('x')}) <> get(f, {at(near)}), false)), y -> y)", "s": "s", "f": "f", "bits": "bits"},
        {"p": f"""CASE WHEN mixed THEN
            aggregate(array(sort_array(transform(f, (x, i) -> struct(x AS h, i AS i)))), CAST(array() AS array<int>), (z, t) -> sort_array(filter(transform(t, (x, j) ->
              CASE WHEN x.h = get(t, j + 1).h OR x.h = get(t, j - 1).h THEN x.i ELSE -1 END), p -> p >= 0)))
          ELSE sort_array(filter(transform(s, (x, j) -> CASE WHEN {whole('x', near)} OR {whole('x', 'get(s, j - 1)')} THEN {at('x')} ELSE -1 END), p -> p >= 0)) END"""},
        {out: f"CASE WHEN size(p) = 0 THEN 0L ELSE aggregate(transform(p, (x, j) -> least({width}, coalesce(get(p, j + 1) - x, {width}))), 0L, (a, x) -> a + x) END"},
    ]
    for step in steps:
        df = df.select(*keep, *(F.expr(x).alias(n) for n, x in step.items()))
    return df


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements, and ``failures``, the mask of the rules that it fails.

    Null texts count as empty.  One narrow pass: nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("body"))
    split = base.select(
        "id",
        F.array_remove(F.split(F.translate("body", "\t\n\x0b\x0c\r", "     "), " "), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.octet_length(_without(x, " \t\x0b\x0c\r")) > 0).alias("lines"),
        (F.octet_length("body") - F.octet_length(_without(F.col("body"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.char_length("body") - (F.octet_length("body") - F.octet_length(_without(F.col("body"), " \t\n\x0b\x0c\r")))).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    hashed = split.select(
        "id", "n_symbols", "word_chars", "n_upper",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("words"))).alias("bits"),
    )
    measured = _repeated(hashed.withColumn("n_distinct_words", F.size(F.array_distinct("hashes")).cast("long")), "hashes", 3, "n_repeat_words")
    failures = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END)" for r in rules) or "0L"
    return measured.select(F.col("id").alias(id_col), *MEASUREMENTS, F.expr(failures).alias("failures"))


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, name: str = "kept") -> DataFrame:
    """Add ``name``: true where the document fails none of the policy's rules."""
    return rows.withColumn(name, F.col("failures").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0)


def ablation(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else of the policy, and that would be kept without it.

    The ledger is first counted by mask (at most one row per combination of bits, combined before the shuffle), so the rules
    are compared over those few rows.
    """
    mask = policy_mask(policy, rules)
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    stacked = ", ".join(f"'{r.name}', {1 << r.bit}L" for r in chosen)
    pairs = counts.selectExpr("bits", "n", f"stack({len(chosen)}, {stacked}) AS (rule, bit)")
    return pairs.groupBy("rule").agg(
        F.sum(F.when(F.expr("bits & bit") != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_only_this"),
        F.sum(F.when(F.expr("(bits & ~bit) = 0"), F.col("n")).otherwise(0)).alias("kept_without_it"),
    )


def op7_quality_rules(spark, sf_dir):
    """The ledger of all documents, with the base policy's and the production policy's verdicts."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES[-1])
    base = policy_mask(POLICIES[0])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failures",
    )


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(body, '\P{Lu}', '', 'g'))::BIGINT AS n_upper, len(list_distinct(ws))::BIGINT AS n_distinct_words
  FROM w LEFT JOIN c USING (r)),
f AS (
  SELECT *, (n_words < 50)::BIGINT | ((100 * n_repeat_words > 50 * n_words)::BIGINT << 1) | ((100 * n_symbols > 40 * n_words)::BIGINT << 2)
    | ((100 * n_dup_lines > 50 * n_lines)::BIGINT << 3) | ((10 * word_chars < 15 * n_words)::BIGINT << 4) | ((word_chars > 20 * n_words)::BIGINT << 5)
    | ((100 * n_upper > 50 * word_chars)::BIGINT << 6) | ((n_distinct_words * n_distinct_words < n_words)::BIGINT << 7) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
