"""Quality rules: one table of thresholds, compiled into Spark projections of built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages, as they stand inside and at the start of sentences.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "as", "with", "be", "by", "at", "this",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "le", "la", "les", "de", "et", "un", "une", "du", "que", "est", "dans", "pour", "qui", "par", "sur", "au",
    "el", "los", "las", "del", "y", "en", "se", "por", "con", "para", "su", "una", "al", "lo",
]
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= top / bottom <= high; a ratio over nothing passes."""

    name: str
    top: str
    bottom: str
    low: float = 0.0
    high: float = float("inf")


#: Ratios are compared as products of integers and decimal thresholds, the same in any engine.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("shouts_per_word", "n_shouts", "n_words", 0.0, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("distinct_words", "n_distinct_words", "n_words", 0.05),
)


def condition(rules: tuple[Rule, ...] = RULES) -> str:
    """The rules as one SQL condition."""
    parts = []
    for r in rules:
        if r.low > 0:
            parts.append(f"1000 * {r.top} >= {round(r.low * 1000)} * {r.bottom}")
        if r.high != float("inf"):
            parts.append(f"1000 * {r.top} <= {round(r.high * 1000)} * {r.bottom}")
    return "(" + " and ".join(parts) + ")"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame) -> DataFrame:
    """docs with the columns that the rules use, as `m`: n_words, word_chars, n_symbols, n_lines, ...

    Null texts count as empty. Whole texts are measured in their row: no shuffle and no user function. Repeated
    three-word windows are found by a hash set per document; only documents that have some are sorted.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, BLANK) != "")
    stop = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    d = docs.select(
        "*",
        F.struct(
            words.alias("w"), lines.alias("l"),
            F.length(_without(t, BLANK)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(_without(t, "!"))).cast("long").alias("n_shouts"),
        ).alias("_a"),
    )
    n = F.size("_a.w")
    tri = F.transform(
        F.arrays_zip(F.slice("_a.w", F.lit(1), n - 2).alias("a"), F.slice("_a.w", F.lit(2), n - 2).alias("b"), F.slice("_a.w", F.lit(3), n - 2).alias("c")),
        lambda z: F.concat_ws(" ", z["a"], z["b"], z["c"]),
    )
    d = d.withColumn("_t", F.when(n >= 3, tri).otherwise(F.array().cast("array<string>")))
    # positions of repeated windows: equal neighbours after sorting by window
    d = d.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_t")) < F.size("_t"),
            F.array_sort(F.transform("_t", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    k = F.size("_s")
    pairs = F.arrays_zip(F.slice("_s", F.lit(1), k - 1).alias("a"), F.slice("_s", F.lit(2), k - 1).alias("b"))
    at = F.array_sort(
        F.array_distinct(F.flatten(F.transform(F.filter(pairs, lambda z: z["a"]["x"] == z["b"]["x"]), lambda z: F.array(z["a"]["i"], z["b"]["i"]))))
    )
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), at))
    steps = F.arrays_zip(F.slice("_p", F.lit(1), F.size("_p") - 1).alias("a"), F.slice("_p", F.lit(2), F.size("_p") - 1).alias("b"))
    repeated = F.when(
        F.col("_p").isNotNull(),
        F.aggregate(steps, F.lit(3).cast("long"), lambda s, z: s + F.least(F.lit(3), z["b"] - z["a"])),
    ).otherwise(F.lit(0).cast("long"))
    return d.select(
        *docs.columns,
        F.struct(
            F.size("_a.w").cast("long").alias("n_words"),
            F.col("_a.word_chars"), F.col("_a.n_symbols"), F.col("_a.n_shouts"),
            F.size("_a.l").cast("long").alias("n_lines"),
            (F.size("_a.l") - F.size(F.array_distinct("_a.l"))).cast("long").alias("n_dup_lines"),
            F.size(F.array_distinct("_a.w")).cast("long").alias("n_distinct_words"),
            F.size(F.filter("_a.w", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
            repeated.alias("n_repeat_words"),
        ).alias("_m"),
    )


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs, repeated rows included.

    Null and empty texts have no words and so fail the base. Columns besides doc_id and text are ignored.
    """
    m = measures(docs.select("doc_id", "text")).select("doc_id", "_m.*")
    return m.select("*", F.expr(BASE_FAILED).alias("base_failed")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr(f"not base_failed and {condition(rules)}").alias("kept"),
        "n_lines", "n_shouts", "n_distinct_words", "n_stop_words",
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their own columns, whatever their names."""
    whole = docs.select(F.struct("*").alias("_row"), "text")
    # a generator, so that the measures are taken once and not again for each rule that the filter reads
    once = measures(whole).select("_row", F.explode(F.array("_m")).alias("_m"))
    ok = F.expr(f"{BASE_FAILED} = false and {condition(rules)}".replace("n_", "_m.n_").replace("word_chars", "_m.word_chars"))
    return once.where(ok).select("_row.*")


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """quality_report as DuckDB SQL."""
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS + [w.capitalize() for w in STOP_WORDS])
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
a as (select r, doc_id, text,
        list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
u as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from a),
g as (select r, i, x || ' ' || lead(x, 1) over s || ' ' || lead(x, 2) over s as x from u window s as (partition by r order by i)),
d as (select r, i from g where x is not null qualify count(*) over (partition by r, x) > 1),
p as (select r, count(distinct i + k) as n_repeat_words from d, (values (0), (1), (2)) as o(k) group by r),
m as (select a.doc_id, cast(len(w) as bigint) as n_words,
        cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
        cast(len(l) as bigint) as n_lines,
        cast(length(text) - length(translate(text, '!', '')) as bigint) as n_shouts,
        cast(len(list_distinct(w)) as bigint) as n_distinct_words,
        cast(len(list_filter(w, lambda x: x in ({stop}))) as bigint) as n_stop_words
      from a left join p using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} as base_failed,
  not {BASE_FAILED} and {condition(rules)} as kept, n_lines, n_shouts, n_distinct_words, n_stop_words from m"""
