"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean expression over a document's text; a document is kept if none holds.  The
rules' order does not change the verdict, only the work: on a sample, each rule's cost (seconds a row,
without what a job costs anyway) and its verdict on each row are measured.  First comes the rule
with most rejections per second, then that with most per second among the rows that are left, and so
on, inside one CASE, so that a rejected row meets no later rule.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Rows of the sample on which costs and selectivities are estimated, and the most characters of one;
#: they decide the order alone.  The rows are taken from few partitions by a hash of the text, one in
#: SAMPLE_STEP, and come to the driver: 16 million characters at most.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_STEP = 256, 65536, 16
#: Times that the sample is evaluated in one job, so that its cost stands out from the job's.
_REPEATS = 4


@dataclass(frozen=True)
class Rule:
    """reject: SQL over _text, _words, n_words; {name} stands for a measure of MEASURES."""

    name: str
    reject: str


def _without(chars: str) -> str:
    out = "_text"
    for c in chars:
        out = f"replace({out}, '{c}', '')"
    return out


#: SQL over _text, _words and n_words.  Windows of three words are compared by 64-bit hash: sorted
#: (hash, place) pairs show repeats as equal neighbours; texts without a repeat skip the sort.
MEASURES = {
    "n_symbols": f"cast(length(_text) - length({_without('#*$%&|<>')}) as bigint)",
    "word_chars": f"cast(length({_without(' ' + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))}) as bigint)",
    "n_dup_lines": r"""cast(element_at(transform(array(filter(split(_text, '\\n'), x -> x rlike '[^ \\t-\\r]')), a -> size(a) - size(array_distinct(a))), 1) as bigint)""",
}

#: Repeats as neighbours: a place counts if its hash equals that before or after it.
MEASURES["n_repeat_words"] = """cast(case when n_words < 4 then 0 else
  element_at(transform(array(transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))), h ->
    case when size(array_distinct(h)) = size(h) then 0 else
      element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
        size(array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) ->
          case when a.h = b.h then array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2) else array() end))))), 1)
    end), 1) end as bigint)"""

BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

#: Shares are of words, where not named otherwise.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("symbols", "10 * {n_symbols} > n_words"),
    Rule("exclamations", "3 * (length(_text) - length(replace(_text, '!', ''))) > n_words"),
    Rule("word_length", "not ({word_chars} between 2 * n_words and 20 * n_words)"),
    Rule("capitals", r"2 * (length(_text) - length(regexp_replace(_text, '\\p{{Lu}}', ''))) > length(_text)"),
    Rule("same_word_runs", "5 * size(filter(zip_with(_words, slice(_words, 2, greatest(n_words, 1)), (a, b) -> coalesce(a = b, false)), x -> x)) > n_words"),
    Rule("duplicate_lines", r"2 * {n_dup_lines} > size(split(_text, '\\n'))"),
    Rule("repeated_windows", "100 * {n_repeat_words} > 50 * n_words"),
)


def _prepared(docs: DataFrame) -> DataFrame:
    """docs with _text (null: empty), _words and n_words."""
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_words", words(F.col("_text")))
    return out.withColumn("n_words", F.size("_words").cast("long"))


def _rejects(rule: Rule, known: tuple[str, ...] = ()) -> str:
    return "(" + rule.reject.format(**{k: k if k in known else v for k, v in MEASURES.items()}) + ")"


def _sample(docs: DataFrame, rows: int) -> list[tuple[str]]:
    """Some texts; no more partitions are read than it takes to find them."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(f"length(text) <= {SAMPLE_CHARS}")
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_STEP)) == 0).take(rows)
    return [tuple(r) for r in (some if len(some) >= min(rows, 16) else texts.take(rows))]


def by_rank(outcomes: list[tuple[bool, ...]], costs: list[float]) -> list[int]:
    """The order of rules by rejections per cost among the rows that the rules before leave.
    outcomes: of each row, which rules reject it.  Rules that reject none come last, cheapest first."""
    left, rest, out = list(outcomes), set(range(len(costs))), []
    while rest:
        hits = {k: sum(bool(row[k]) for row in left) for k in rest}
        best = min(rest, key=lambda k: (-hits[k] / max(costs[k], 1e-9), costs[k], k))
        out.append(best)
        rest.remove(best)
        left = [row for row in left if not row[best]]
    return out


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Rule]:
    """rules in the order of `by_rank`, as measured on a sample of docs' texts; `known` names the
    measures that are at hand when the rules run, and so cost them nothing."""
    texts = _sample(docs, sample_rows)
    if not texts:
        return list(rules)
    spark = docs.sparkSession
    frame = _prepared(spark.createDataFrame(texts, "text string").coalesce(1))
    verdicts = [F.expr(_rejects(r)).alias(f"r{i}") for i, r in enumerate(rules)]
    got = frame.select("text", *[F.expr(MEASURES[k]).alias(k) for k in known], *verdicts).collect()
    held = spark.createDataFrame([tuple(r)[: 1 + len(known)] for r in got], ", ".join(["text string", *(f"{k} long" for k in known)]))
    held = _prepared(held.coalesce(1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(_REPEATS)))))

    def seconds(rule: str) -> float:
        probe = held.agg(F.sum("n_words"), F.sum(F.expr(rule)))
        probe.first()  # compiles
        began = time.perf_counter()
        probe.first()
        return time.perf_counter() - began

    plain = min(seconds("0"), seconds("0"))
    costs = [max(seconds(f"cast({_rejects(r, known)} as int)") - plain, 1e-4) for r in rules]
    return [rules[i] for i in by_rank([tuple(r)[1 + len(known) :] for r in got], costs)]


def _cascade(rules: list[Rule], known: tuple[str, ...] = ()) -> F.Column:
    """The name of the first rule that rejects, or null."""
    return F.expr("case " + " ".join(f"when {_rejects(r, known)} then '{r.name}'" for r in rules) + " end")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns as they were.

    A null text counts as empty, and the rule on few words rejects it.  Repeated rows are judged
    alike.  An empty table gives an empty table.  Only `text` is read; the input's columns are set
    aside in one struct, so their names cannot clash with the operator's."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    # The row number keeps the filter above the projection: pushed below, it would split the text
    # anew for every word.
    verdict = _prepared(held).select("_row", _cascade(ordered(docs, rules, sample_rows)).alias("_rule"), F.monotonically_increasing_id().alias("_n"))
    return verdict.where("_rule is null and _n >= 0").select("_row.*")


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a
    row for each row of docs(doc_id, text, ...); kept is the verdict of quality_rules.

    A null text counts as empty: no words, and failed.  Repeated rows are judged alike, a null doc_id
    stays null, an empty table gives an empty table, and other columns are ignored, whatever their
    names.  All measures are wanted of all rows here, so only the verdict is short-circuited."""
    out = _prepared(docs.select("doc_id", "text"))
    known = tuple(MEASURES)
    out = out.select("doc_id", "_text", "_words", "n_words", *[F.expr(v).alias(k) for k, v in MEASURES.items()])
    out = out.withColumn("base_failed", F.expr(BASE_FAILED))
    kept = F.when(F.col("base_failed"), False).otherwise(_cascade(ordered(docs, rules, sample_rows, known), known).isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
