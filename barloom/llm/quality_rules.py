"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good or bad on a document, or abstains. Documents are counted by their votes: with m rules there are
at most 3^m kinds of votes (6,561), whatever the corpus's size. On that table expectation-maximisation estimates each
rule's accuracy on good and on bad documents and the share of good ones; every step is one aggregate, from which the
driver takes 6m numbers at most. A document is kept when the posterior probability that it is good reaches a threshold,
so that a rule of little accuracy weighs little and no single rule rejects a document. Abstentions weigh nothing.

All signals are counts of the whole text, taken in the task that reads it: texts aren't shuffled. Windows of three
words are told by 64-bit hashes; only in a text where two hashes are equal are they sorted with their places.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage, text_of

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Frequent function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = (
    "the of and to in a is that for it with as was on are be this by at or an "
    "der die das und zu den von mit sich auf ist im dem nicht ein eine als auch es "
    "le la les des et en un une du est que dans pour qui par sur "
    "el los las de y del se con una su para al lo como"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Conditions over the signals' names, in SQL that Spark and DuckDB read alike; neither: the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("word_length", "2 * word_chars >= 5 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "100 * n_symbols > 5 * n_words"),
    Rule("repeated_lines", "n_lines > 1 AND n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    Rule("repeated_words", "100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 40 * n_words"),
    Rule("capitals", "n_letters >= 20 AND 100 * n_capitals <= 15 * n_letters", "n_letters >= 20 AND 100 * n_capitals > 40 * n_letters"),
    Rule("sentence_ends", "100 * n_ends >= n_words AND 100 * n_ends <= 30 * n_words", "100 * n_ends > 50 * n_words OR (n_ends = 0 AND n_words >= 50)"),
    Rule("function_words", "100 * n_function >= 8 * n_words", "100 * n_function < 2 * n_words"),
    Rule("distinct_words", "100 * n_distinct >= 35 * n_words", "n_words >= 100 AND 100 * n_distinct < 10 * n_words"),
)
#: A document that one of these holds is dropped, whatever the votes.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
STEPS = 20
#: The first model: most documents are good, a rule seldom fails on them and finds but some kinds of bad ones. It keeps
#: the weight of so many documents against the data.
START_SHARE, START_GOOD, START_BAD, WEIGHT = 0.8, 0.95, 0.3, 10.0
THRESHOLD = 0.5
SIGNALS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_letters n_ends n_function n_distinct".split()


def _without(text: str, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _flat(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and the counts of SIGNALS (long), of the whole text; null counts as empty."""
    blanks = r"[ \t-\r]+"
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    words = F.array_remove(F.split("text", blanks), "")
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    size = F.length("text")
    rows = rows.select(
        "id",
        words.alias("words"),
        lines.alias("lines"),
        _without("text", " \t\n\x0b\x0c\r").alias("word_chars"),
        (size - _without("text", SYMBOLS)).alias("n_symbols"),
        (size - _without("text", capitals)).alias("n_capitals"),
        (size - _without("text", capitals + small)).alias("n_letters"),
        # a sentence ends where white space or the text's end follows the mark
        (F.regexp_count("text", F.lit(r"[.!?][ \t-\r]")) + F.expr("int(right(text, 1) IN ('.', '!', '?'))")).alias("n_ends"),
        F.size(F.filter(F.split(F.lower("text"), blanks), lambda w: w.isin(FUNCTION_WORDS))).alias("n_function"),
    )
    n = F.size("words")
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select(
        "id", n.alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_letters", "n_ends", "n_function",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), hashed.alias("hashed"),
    )
    places = F.when(F.col("n_words") > 2, F.sequence(F.lit(0), F.col("n_words") - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.xxhash64(F.get("hashed", i), F.get("hashed", i + 1), F.get("hashed", i + 2)))
    rows = rows.select("*", F.size(F.array_distinct("hashed")).alias("n_distinct"), windows.alias("windows"))
    told = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("told", F.when(repeats, told))
    # windows next to an equal one, in the order of their places
    alike = F.transform("told", lambda x, i: F.when(_flat(x.h == F.get("told", i - 1).h) | _flat(x.h == F.get("told", i + 1).h), x.i))
    rows = rows.withColumn("at", F.sort_array(F.array_compact(alike)))
    covered = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)))
    return rows.select(F.col("id").alias(id_col), *[F.col(c).cast("long").alias(c) for c in SIGNALS])


def votes(rules: Sequence[Rule] = RULES) -> Column:
    """The rules' votes on a row of signals, in their order."""
    return F.array(*[F.expr(f"CASE WHEN {r.bad} THEN {BAD} WHEN {r.good} THEN {GOOD} ELSE {ABSTAIN} END") for r in rules])


@dataclass(frozen=True)
class Model:
    """The share of good documents, and each rule's accuracy where it votes on good and on bad ones."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self) -> Column:
        """The probability that a row with `votes` is good."""
        # of each rule: what its vote adds to the log odds, by vote
        weights = F.array(*[F.array(*map(F.lit, (math.log((1 - g) / b), math.log(g / (1 - b)), 0.0))) for g, b in zip(self.on_good, self.on_bad, strict=True)])
        added = F.zip_with("votes", weights, lambda vote, w: F.get(w, vote))
        odds = F.aggregate(added, F.lit(math.log(self.share / (1 - self.share))), lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, m: int, steps: int = STEPS) -> Model:
    """Expectation-maximisation over rows with `votes` (m of them), which are counted by their votes first.

    Accuracies are those of all rows, drawn to the first ones with the weight of WEIGHT documents, so that they stay
    within (0, 1) whatever the rows are; without rows the model is the one that the steps start with.
    """
    kinds = stage(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions("votes"), "votes").coalesce(1)
    model = Model(START_SHARE, (START_GOOD,) * m, (START_BAD,) * m)
    rate = lambda right, every, start: (right + start * WEIGHT) / (every + WEIGHT)
    for _ in range(steps):
        weighed = kinds.select("n", "votes", (F.col("n") * model.posterior()).alias("good"))
        each = weighed.select("n", "good", F.posexplode("votes").alias("rule", "vote"))
        sums = {(r, v): (good, n - good) for r, v, good, n in each.groupBy("rule", "vote").agg(F.sum("good"), F.sum("n")).collect()}
        at = lambda j, vote, k: sums.get((j, vote), (0.0, 0.0))[k]
        every = [sum(at(0, v, k) for v in (GOOD, BAD, ABSTAIN)) for k in (0, 1)]
        model = Model(
            rate(every[0], sum(every), START_SHARE),
            tuple(rate(at(j, GOOD, 0), at(j, GOOD, 0) + at(j, BAD, 0), START_GOOD) for j in range(m)),
            tuple(rate(at(j, BAD, 1), at(j, GOOD, 1) + at(j, BAD, 1), START_BAD) for j in range(m)),
        )
    return model


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(one row per row of docs: id_col, the signals, base_failed, good (the posterior probability), kept; the model).

    Null and empty texts have no words and fail. Repeated rows are judged alike, each for itself; null identifiers are
    passed on; other columns, also of clashing names, are ignored; an empty table gives no rows. Long texts are read
    whole, in memory of some hundred bytes a word. Signals are written once and read for both passes.
    """
    rows = stage(signals(docs, id_col, text_col), "signals").withColumn("votes", votes(rules))
    model = fit(rows, len(rules), steps)
    failed = F.expr(BASE_FAILED)
    rows = rows.select(id_col, *SIGNALS, failed.alias("base_failed"), model.posterior().alias("good"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= threshold)), model


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs)[0].select("doc_id", *SIGNALS[:5], "base_failed", "kept")


def _oracle(rules: Sequence[Rule] = RULES) -> str:
    m = range(len(rules))
    odds = "ln(share / (1 - share))" + "".join(f" + CASE v{j} WHEN {GOOD} THEN ln(g{j} / (1 - b{j})) WHEN {BAD} THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j in m)
    rate = lambda right, every, start: f"(coalesce(sum({right}), 0) + {start}::DOUBLE * {WEIGHT}::DOUBLE) / (coalesce(sum({every}), 0) + {WEIGHT}::DOUBLE)"
    of = lambda v, value, what: f"CASE WHEN {v} {value} THEN {what} END"
    new = ", ".join(
        f"{rate(of(f'v{j}', f'= {GOOD}', 'q'), of(f'v{j}', f'!= {ABSTAIN}', 'q'), START_GOOD)} AS g{j}, "
        f"{rate(of(f'v{j}', f'= {BAD}', 'n - q'), of(f'v{j}', f'!= {ABSTAIN}', 'n - q'), START_BAD)} AS b{j}"
        for j in m
    )
    start = ", ".join(f"{START_GOOD}::DOUBLE AS g{j}, {START_BAD}::DOUBLE AS b{j}" for j in m)
    names = ", ".join(f"v{j}" for j in m)
    cases = ", ".join(f"CASE WHEN {r.bad} THEN {BAD} WHEN {r.good} THEN {GOOD} ELSE {ABSTAIN} END AS v{j}" for j, r in enumerate(rules))
    space = r"[ \t-\r]"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT r, doc_id, t, regexp_extract_all(t, '[^ \\t-\\r]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d),
windows AS (
    SELECT r, i, w[i:i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT i + o)::BIGINT AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
signals AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
           length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
           len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ends,
           len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in FUNCTION_WORDS)}))) AS n_function, len(list_distinct(w)) AS n_distinct
    FROM split LEFT JOIN covered c USING (r)),
voted AS (SELECT *, {cases} FROM signals),
kinds AS (SELECT {names}, count(*) AS n FROM voted GROUP BY ALL),
model AS (
    SELECT 0 AS step, {START_SHARE}::DOUBLE AS share, {start}
    UNION ALL
    SELECT step + 1, {rate('q', 'n', START_SHARE)} AS share, {new}
    FROM (SELECT *, n / (1 + exp(-({odds}))) AS q FROM model, kinds WHERE step < {STEPS}) GROUP BY step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
       NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= {THRESHOLD} AS kept
FROM voted, model WHERE step = {STEPS}
"""


ORACLE = _oracle()
