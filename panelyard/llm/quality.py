"""Operator 4: quality rules, a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text: no user functions,
no exploding and no shuffle. ``compile_rules`` turns the rows of a threshold
table into one boolean expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, table, unused, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of to and in a is that for it as was with be by on at are this or an from "
    "le la les de des du et un une en que qui est pour dans sur par au pas avec ou elle "
    "der die das und ist zu von den mit ein eine für auf nicht sich es im dem "
    "el los las y del se con por su al lo como no"
).split()
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure <= high (None: open); the rule holds for texts of at least min_words words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# The threshold table.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.05, None, 50),
    Rule("repeated_words", "adjacent_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)


def _any_of(words: list[str]) -> str:
    """A regular expression for any of the words that shares their common beginnings, so that few branches are tried."""
    rests: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        if w:
            rests.setdefault(w[0], []).append(w[1:])
    parts = "|".join(letter + _any_of(rest) for letter, rest in rests.items())
    return (f"(?:{parts})?" if "" in words else f"(?:{parts})") if parts else ""


def _covered(windows: Column, width: int) -> Column:
    """Words in windows that occur twice or more: sorted by (window, place), the repeated places, and their union's length."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)

        def at(k: Column) -> Column:
            return F.get(s, k)["h"]

        twice = F.filter(F.transform(s, lambda x, k: F.when(((k > 0) & (at(k - 1) == x["h"])) | ((k < n - 1) & (at(k + 1) == x["h"])), x["i"])), lambda p: p.isNotNull())
        return F.sort_array(twice)

    def union(p: Column) -> Column:
        gap = F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["last"])).cast("long").alias("n"), x.alias("last")))
        return gap["n"]

    # array_sum over one-element arrays binds a value to a name, so that it is computed once
    bound = F.transform(F.array(placed), repeated)
    return F.get(F.transform(bound, union), 0)


def measured(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with the counts that the measures are made of, as a struct of that name."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        five = F.when(n >= 6, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
        repeat = F.transform(F.array(five), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, 5)).otherwise(F.lit(0).cast("long")))
        same = F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.get(repeat, 0).cast("long").alias("n_repeat_words"), same.cast("long").alias("n_adjacent"))

    of = F.get(F.transform(F.array(words(text)), of_words), 0)
    # stop words: occurrences in the lower-cased text, one pass of a regular expression; only the blank before is consumed
    spaced = F.concat(F.lit(" "), F.lower(body), F.lit(" "))
    n_stop = F.regexp_count(spaced, F.lit("[ \\t\\n\\x0B\\f\\r]" + _any_of(STOP_WORDS) + "(?=[ \\t\\n\\x0B\\f\\r.,;:!?])"))
    per_line = F.get(F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))), 0)
    return docs.withColumn(name, F.struct(of.alias("w"), n_stop.cast("long").alias("n_stop"), per_line.alias("l"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(m: str) -> dict[str, Column]:
    """The measures that rules can name, from the struct m."""
    n = F.col(f"{m}.w.n_words")
    return {
        "n_words": n,
        "mean_word_chars": _ratio(F.col(f"{m}.w.word_chars"), n),
        "symbol_ratio": _ratio(F.col(f"{m}.n_symbols"), n),
        "stop_ratio": _ratio(F.col(f"{m}.n_stop"), n),
        "adjacent_ratio": _ratio(F.col(f"{m}.w.n_adjacent"), n),
        "dup_line_ratio": _ratio(F.col(f"{m}.l.n_dup_lines"), F.col(f"{m}.l.n_lines")),
        "repeat_word_ratio": _ratio(F.col(f"{m}.w.n_repeat_words"), n),
    }


def compile_rules(rules: tuple[Rule, ...], m: str) -> Column:
    """One expression over the struct m: true where every rule of the table passes."""
    known, passes = measures(m), F.lit(True)
    for r in rules:
        x, fine = known[r.measure], F.lit(True)
        if r.low is not None:
            fine = fine & (x >= F.lit(float(r.low)))
        if r.high is not None:
            fine = fine & (x <= F.lit(float(r.high)))
        passes = passes & (fine if not r.min_words else (known["n_words"] < r.min_words) | fine)
    return passes


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Null and blank texts have no words: they fail the base rule (fewer than 10 words) and are not kept. Lines compare with
    their line end's carriage return, if any. Texts of any length are taken whole. Other columns stay, whatever their
    names; those that have one of the result's names are replaced. Rows are judged one by one, so repeated rows get equal
    verdicts. An empty table gives an empty result.
    """
    m = unused("_m", docs.columns)
    n, rep = F.col(f"{m}.w.n_words"), F.col(f"{m}.w.n_repeat_words")
    failed = (n < 10) | (100 * rep > 20 * n)
    named = {"n_words": n, "word_chars": F.col(f"{m}.w.word_chars"), "n_symbols": F.col(f"{m}.n_symbols"), "n_dup_lines": F.col(f"{m}.l.n_dup_lines"), "n_repeat_words": rep, "base_failed": failed, "kept": ~failed & compile_rules(rules, m)}
    return measured(docs, m).withColumns(named).drop(m)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The threshold table as an SQL condition on the measures' names."""
    parts = []
    for r in rules:
        fine = " AND ".join([f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None))
        parts.append(f"(n_words < {r.min_words} OR ({fine}))" if r.min_words else f"({fine})")
    return " AND ".join(parts)


# One row a word: windows, repeats and stop words by window functions over the places in the text.
OP4_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 u AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
 v AS (SELECT *, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS five, word = lag(word) OVER p AS again FROM u WINDOW p AS (PARTITION BY id ORDER BY i)),
 c AS (SELECT *, five IS NOT NULL AND count(*) OVER (PARTITION BY id, five) > 1 AS twice FROM v),
 k AS (SELECT *, bool_or(twice) OVER (PARTITION BY id ORDER BY i ROWS 4 PRECEDING) AS inside FROM c),
 g AS (SELECT id, count(*) FILTER (inside) AS rep, count(*) FILTER (again) AS adj, count(*) FILTER (regexp_full_match(lower(word), '(?:{"|".join(dict.fromkeys(STOP_WORDS))})(?:[.,;:!?].*)?')) AS stops FROM k GROUP BY id),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, coalesce(adj, 0) AS adj, coalesce(stops, 0) AS stops, len(l) AS n_lines FROM d LEFT JOIN g USING (id)),
 r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
  coalesce(stops / nullif(n_words, 0), 0) AS stop_ratio, coalesce(adj / nullif(n_words, 0), 0) AS adjacent_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules_sql()} AS kept FROM r"""
