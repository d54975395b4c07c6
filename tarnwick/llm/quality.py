"""Quality rules as a bitmask ledger, in DataFrame operations only.

``ledger`` evaluates every rule once per document: it stores each rule's measured
values and one bit per failed rule. A policy is a version, a mask of rules and the
number of failures it stands; ``apply_policy`` reads the stored bits, never the
text. ``ablation`` tells, for a policy and each of its rules, how many documents
that rule alone removes, with bitwise operations on the same ledger.

Defined results: a null or blank text has no words, all counts 0 and fails the
length rule; repeated rows are judged apart; extra columns are carried only if
``ledger`` is asked to keep them; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A failed rule sets bit ``bit``; ``fails`` is SQL over the ledger's measurements."""

    name: str
    bit: int
    fails: str


#: The order of bits never changes; new rules get new bits.
RULES = (
    Rule("too_short", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("duplicate_lines", 2, "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("symbols", 3, "10 * n_symbols > n_words"),
    Rule("word_length", 4, "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("no_letters", 5, "5 * n_letter_words < 4 * n_words"),
    Rule("shouting", 6, "2 * n_upper > n_letters and n_words >= 10"),
    Rule("exclaiming", 7, "5 * n_marks > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails no rule of ``hard`` and at most ``stands`` of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    stands: int = 0


POLICIES = (
    Policy("v1", ("too_short", "repeated_windows")),
    Policy("v2", ("too_short", "repeated_windows", "duplicate_lines", "symbols"), ("word_length", "no_letters", "shouting", "exclaiming"), 1),
)
BASE = Policy("base", ("too_short", "repeated_windows"))


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _repeat_words(w: str, size: int) -> str:
    """SQL: words of array ``w`` in windows of ``size`` words found twice or more.

    Windows are compared by a 64-bit hash of their words within one document. Where
    all hashes differ, which ends most texts, nothing more is done. Else (hash,
    place) pairs are sorted, those with an equal neighbour kept, and the windows'
    union measured from place to place.
    """
    at = ", ".join(f"{w}[i + {k}]" if k else f"{w}[i]" for k in range(size))
    hashes = f"transform(sequence(0, size({w}) - {size}), i -> xxhash64({at}))"
    pairs = "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))"
    repeats = "sort_array(transform(filter(s, (e, k) -> e.x = get(s, k - 1).x or e.x = get(s, k + 1).x), e -> e.i))"
    covered = f"aggregate(r, struct(0L as n, -{size} as last), (a, i) -> struct(a.n + least({size}, i - a.last) as n, i as last), a -> a.n)"
    many = f"transform(array({pairs}), s -> transform(array({repeats}), r -> {covered})[0])[0]"
    return (
        f"case when size({w}) <= {size} then 0L else transform(array({hashes}), "
        f"h -> case when size(array_distinct(h)) = size(h) then 0L else {many} end)[0] end"
    )


def measures(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    drop = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    m = docs.select(*keep, text.alias("_t"), words(text).alias("_w"), F.length(text).cast("long").alias("_n"))
    text = F.col("_t")
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = m.withColumn("_lines", with_word)
    return m.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        drop(SPACE).alias("word_chars"),
        (F.col("_n") - drop(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_w", WINDOW)).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.col("_n") - drop(r"[A-Za-z\x{C0}-\x{24F}]")).alias("n_letters"),
        (F.col("_n") - drop(r"[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]")).alias("n_upper"),
        (F.col("_n") - drop(r"[!?]")).alias("n_marks"),
        F.size(F.filter("_w", lambda x: x.rlike(r"[A-Za-z\x{C0}-\x{24F}]"))).cast("long").alias("n_letter_words"),
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, every measurement, and ``failed_bits``: one row per document."""
    bits = " | ".join(f"case when {r.fails} then {1 << r.bit}L else 0L end" for r in RULES)
    return measures(docs, keep).withColumn("failed_bits", F.expr(bits))


def passes(policy: Policy) -> Column:
    """Whether the policy keeps a row of the ledger."""
    bits = F.col("failed_bits")
    kept = bits.bitwiseAND(F.lit(mask(policy.hard))) == 0
    return kept & (F.bit_count(bits.bitwiseAND(F.lit(mask(policy.soft)))) <= policy.stands)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumn("kept", passes(policy)).withColumn("policy", F.lit(policy.version))


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule removes.

    Rows with equal bits are counted first, so at most two to the number of rules
    meet the short list of rules. ``any_bits`` is the OR over all rows.
    """
    plan = ", ".join(
        f"named_struct('policy', '{p.version}', 'rule', '{r.name}', 'bit', {1 << r.bit}L, 'hard', {mask(p.hard)}L, 'soft', {mask(p.soft)}L, 'stands', {p.stands})"
        for p in policies for r in RULES if r.name in p.hard + p.soft
    )
    counts = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n")).select("*", F.expr(f"inline(array({plan}))"))
    failed = "failed_bits & bit != 0"
    kept = "(({b}) & hard) = 0 and bit_count(({b}) & soft) <= stands"
    only = f"({failed}) and not ({kept.format(b='failed_bits')}) and ({kept.format(b='failed_bits & ~bit')})"
    return counts.groupBy("policy", "rule").agg(
        F.expr(f"sum(case when {failed} then n else 0 end)").alias("n_failed"),
        F.expr(f"sum(case when {only} then n else 0 end)").alias("n_only"),
        F.expr("bit_or(failed_bits)").alias("any_bits"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the ledger of all documents under the newest policy."""
    rows = apply_policy(ledger(documents(spark, sf_dir)), POLICIES[-1])
    base_failed = ~passes(BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "failed_bits",
    )


_LETTERS = "[A-Za-zÀ-ɏ]"
SQL = rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
p as (select doc_id, rid, i, array_to_string(w[i:i + 4], ' ') as s from
  (select *, row_number() over () as rid from w) q, unnest(range(1, len(w) - 3)) u(i)),
d as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from p) where c > 1),
g as (select rid, sum(least(5, coalesce(i - before, 5))) as n from
  (select rid, i, lag(i) over (partition by rid order by i) as before from d) group by rid),
m as (select doc_id, len(w) as n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, cast(coalesce(g.n, 0) as bigint) as n_repeat_words,
  len(l) as n_lines, length(t) - length(regexp_replace(t, '{_LETTERS}', '', 'g')) as n_letters,
  length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as n_upper,
  length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as n_marks,
  len(list_filter(w, lambda x: regexp_matches(x, '{_LETTERS}'))) as n_letter_words
  from (select *, row_number() over () as rid from w) q left join g using (rid)),
b as (select *, {" + ".join(f"(case when {r.fails} then {1 << r.bit} else 0 end)" for r in RULES)} as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (bits & {mask(BASE.hard)}) != 0 as base_failed,
  (bits & {mask(POLICIES[-1].hard)}) = 0 and bit_count(cast(bits & {mask(POLICIES[-1].soft)} as bigint)) <= {POLICIES[-1].stands} as kept,
  cast(bits as bigint) as failed_bits
from b
"""
