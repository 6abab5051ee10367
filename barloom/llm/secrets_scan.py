"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regex is read once on the driver and turned into a Boolean trigram query: alternatives of trigram sets
that every match must contain. The index holds the posting lists of those trigrams over all documents, sorted by
trigram: all trigrams that a rule's query names, whatever their number. Posting lists are intersected per document and
alternative; only candidates are verified with the regex, in the tasks that read their texts.
A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import stage, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length is judged (0: the match), and its least length in characters.
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: Base kinds first, in their listed order. hex runs are maximal, so that the least length may stand in the pattern.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; an empty AND means "any document"
ANY: Query = frozenset({frozenset()})
MOST_STRINGS = 32


def _either(queries: list[Query]) -> Query:
    parts = frozenset().union(*queries)
    return ANY if frozenset() in parts else parts


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b)


def _trigrams(strings: set[str]) -> Query:
    return _either([frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}) for s in strings])


def _analyse(seq) -> tuple[set[str] | None, Query]:
    """The strings that the sequence matches exactly, if few, and what every match must contain."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    query = ANY
    for op, arg in seq:
        strings, needs = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = None
        query = _both(query, _trigrams(run))
        if strings is None:
            query, run = _both(query, needs), {""}
        else:
            run = strings
    query = _both(query, _trigrams(run))
    return (run if exact is not None else None), query


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}, ANY
    if op is K.SUBPATTERN:
        return _analyse(arg[3])
    if op is K.BRANCH:
        parts = [_analyse(p) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANY
        return None, _either([q for _, q in parts])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, needs = _analyse(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low == 0:
            return None, ANY
        if strings is not None and low == high and len(strings) == 1:
            return {next(iter(strings)) * low}, ANY
        return None, (_trigrams({s * low for s in strings}) if strings is not None and len(strings) == 1 else needs)
    if op is K.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of mandatory trigrams (lower case), or None where some match needs none."""
    query = _analyse(parser.parse(pattern))[1]
    # an alternative that asks for more than another one adds nothing
    return None if frozenset() in query else frozenset(a for a in query if not any(b < a for b in query))


def build_index(rows: DataFrame, trigrams: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents as id, h; postings as trigram, id, h sorted by trigram) of rows with id, h, text."""
    low = rows.select("id", "h", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    forward = stage(low.select("id", "h", held.alias("trigrams")), "trigrams")
    postings = forward.select(F.explode("trigrams").alias("trigram"), "id", "h")
    postings = postings.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id")
    return forward.select("id", "h"), stage(postings, "postings")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, h, kinds): documents whose posting lists satisfy a rule's query."""
    terms = [(kind, i, t, len(alt)) for kind, q in queries.items() for i, alt in enumerate(sorted(q, key=sorted)) for t in sorted(alt)]
    literal = F.array(*[F.struct(*map(F.lit, row)) for row in terms])
    table = postings.sparkSession.range(1).select(F.inline(literal).alias("kind", "alt", "trigram", "needed"))
    hits = postings.distinct().join(F.broadcast(table), "trigram").groupBy("id", "h", "kind", "alt", "needed").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n = needed").groupBy("id", "h").agg(F.collect_set("kind").alias("kinds"))


def _matches(rows: DataFrame, rules: list[tuple[int, Rule]], wanted) -> DataFrame:
    """Spans of the rules in rows with id, h, text: match and gap lengths give the positions."""
    found = []
    for order, rule in rules:
        regex = F.lit(rule.regex)
        zipped = F.arrays_zip(
            F.transform(F.regexp_extract_all("text", regex, F.lit(0)), F.length).alias("size"),
            F.transform(F.regexp_extract_all("text", regex, F.lit(rule.group)), F.length).alias("judged"),
            F.transform(F.split("text", rule.regex, -1), F.length).alias("gap"),
        )
        found.append(F.when(wanted(rule), F.struct(F.lit(order).alias("ord"), zipped.alias("found"))))
    flat = rows.select("id", "h", F.explode(F.array_compact(F.array(*found))).alias("f"))
    flat = flat.select("id", "h", "f.ord", F.posexplode("f.found").alias("at", "m")).where(F.col("m.size").isNotNull())
    # equal rows (same identifier and text) give the same matches: one copy is enough
    flat = flat.select("id", "h", "ord", "at", "m.size", "m.judged", "m.gap").distinct()
    upto = Window.partitionBy("id", "h", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return flat.select(
        "id", "h", "ord", "judged", F.sum(F.col("gap") + F.col("size")).over(upto).alias("end"), "size"
    ).select("id", "h", "ord", "judged", (F.col("end") - F.col("size")).alias("start"), "end")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, h, spans (array of start, ord, end; ord is the rule's place in `rules`).

    Spans count code points, end exclusive, and are sorted by start, then rule. Null texts count as empty and have no
    spans. Repeated rows each get their spans; rows with one identifier and different texts are told apart by h, the
    text's hash. An empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    vocabulary = sorted({t for q in indexed.values() for alt in q for t in alt})
    ids, postings = build_index(rows, vocabulary)
    numbered = list(enumerate(rules))
    spans = _matches(rows, [x for x in numbered if x[1].kind not in indexed], lambda r: F.lit(True))
    if indexed:
        # written first: its size is known when the join is planned, so that few candidates are broadcast to the texts
        # where they are and only many (over spark.sql.autoBroadcastJoinThreshold) make the texts move
        held = stage(candidates(postings, indexed), "candidates")
        on = rows["id"].eqNullSafe(held["id"]) & (rows["h"] == held["h"])
        picked = rows.join(held, on).select(rows["id"], rows["h"], "text", "kinds")
        spans = spans.unionByName(
            _matches(picked, [x for x in numbered if x[1].kind in indexed], lambda r: F.array_contains("kinds", r.kind))
        )
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("ord") + 1)
    spans = spans.where(F.col("judged") >= least).groupBy(F.col("id").alias("s_id"), F.col("h").alias("s_h")).agg(
        F.array_sort(F.collect_list(F.struct("start", "ord", "end"))).alias("spans")
    )
    on = ids["id"].eqNullSafe(spans["s_id"]) & (ids["h"] == spans["s_h"])
    return ids.join(spans, on, "left").select(
        F.col("id").alias(id_col), "h", F.coalesce("spans", F.array().cast("array<struct<start:bigint,ord:int,end:bigint>>")).alias("spans")
    )


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.ord + 1), s.start.cast("string"), s.end.cast("string"))))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs, rules, id_col)
    base = [i for i, r in enumerate(rules) if r.base]
    of_base = F.filter("spans", lambda s: s.ord.isin(base))
    ords = F.transform("spans", lambda s: s.ord)
    counts = [F.size(ords).cast("long") - F.size(F.array_remove(ords, i)) for i in base]
    counts = [n.cast("long").alias(f"n_{rules[i].kind}") for n, i in zip(counts, base, strict=True)]
    return found.select(
        id_col, *counts, F.sha2(_written(of_base, rules), 256).alias("base_sha256"), _written(F.col("spans"), rules).alias("spans")
    )


def _oracle() -> str:
    quoted = [r.regex.replace("'", "''") for r in RULES]
    parts = [
        f"SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {r.least} AS least, {str(r.base).lower()} AS base, regexp_extract_all(t, '{q}') AS m, "
        f"regexp_extract_all(t, '{q}', {r.group}) AS j, string_split_regex(t, '{q}') AS g FROM d"
        for i, (r, q) in enumerate(zip(RULES, quoted, strict=True))
    ]
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
flat AS (SELECT * FROM (SELECT doc_id, o, kind, least, base, m, j, g, unnest(range(1, len(m) + 1)) AS i FROM found)),
spans AS (
    SELECT doc_id, o, kind, base,
           list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
           length(m[i]) AS n
    FROM flat WHERE length(j[i]) >= least),
told AS (
    SELECT doc_id, {counts},
           string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (base) AS b,
           string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) AS a
    FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES if r.base)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""


ORACLE = _oracle()
