"""Secret scans through a trigram inverted index, with DataFrame functions alone.

Each rule is a regular expression. Walking its parsed form derives a Boolean query over trigrams that every text with a
match must meet: what must stand in a row, with all its alternatives, means all trigrams of one of these; parts that
follow each other are all needed. A rule without a mandatory trigram scans all texts.

The index holds, for each block of documents and each trigram that a rule asks for, the postings: the block's documents
with it, found by one pass of one expression over each text. Blocks are of bounded size, so no posting list grows with the corpus, however common its trigram. The queries
intersect and unite a block's lists; the documents that come out are verified with the expression itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import islice, product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import shuffle_partitions, with_columns_of, written


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression that Java and Python read alike; group: whose length counts; least: characters it must have.

    base: one of the fixed kinds, whose spans always stay.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


# Fixed patterns.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # the expression [0-9a-f]+ with its shorter matches left out: greedy runs, so the rest are the same
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1, base=False),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 20, base=False),
)
#: Kinds in the order that breaks ties of spans.
ORDER = tuple(r.kind for r in RULES)
#: Rows of a block of the index, about.
BLOCK_ROWS = 4096
#: Matches of a text whose places are added up in one go.
RUN = 512

#: Alternatives of what stands in a row, at most; more are not told apart.
MOST_WAYS = 64
#: Alternatives, each a set of trigrams that are all needed; and all of several such.
Clause = frozenset[frozenset[str]]
Query = list[Clause]


def _clause(strings: set[str]) -> Clause | None:
    """What a text must have that has one of these; None if one is too short to tell."""
    ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in ways else frozenset(w for w in ways if not any(x < w for x in ways))


def _either(queries: list[Query]) -> Query:
    """Any of them: a clause of each, alternatives side by side."""
    if not queries or not all(queries):
        return []
    return [frozenset().union(*parts) for parts in islice(product(*queries), MOST_WAYS)]


def _derived(parsed) -> tuple[set[str] | None, Query]:
    """Of a parsed expression all its matches, lower-cased, if they are few, else None; and what each of them needs."""
    run, query, whole = {""}, [], True

    def ended() -> None:
        nonlocal run
        query.extend(c for c in [_clause(run)] if c)
        run = {""}

    for kind, arg in parsed:
        own, needs = _part(kind, arg)
        if own is not None and len(own) * len(run) <= MOST_WAYS:
            run = {a + b for a in run for b in own}
            continue
        whole = False
        ended()
        if own is not None:
            run = own
        query.extend(needs)
    if whole:
        return run, [c for c in [_clause(run)] if c]
    ended()
    return None, query


def _part(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(arg).lower()}, []
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, []
    if kind is op.IN:
        found: set[str] = set()
        for what, x in arg:
            if what is op.LITERAL:
                found.add(chr(x).lower())
            elif what is op.RANGE and x[1] - x[0] < MOST_WAYS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (found, []) if len(found) <= MOST_WAYS else (None, [])
    if kind is op.SUBPATTERN:
        return _derived(arg[3])
    if kind is op.BRANCH:
        parts = [_derived(p) for p in arg[1]]
        own = None if any(o is None for o, _ in parts) else set().union(*[o for o, _ in parts])
        return (own if own is not None and len(own) <= MOST_WAYS else None), _either([q for _, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = arg
        own, needs = _derived(inner)
        if own is not None and most == 1:
            return own | ({""} if least == 0 else set()), [] if least == 0 else needs
        if own is not None and least == most and len(own) ** least <= MOST_WAYS:
            return {"".join(x) for x in product(own, repeat=least)}, []
        if own is not None and len(own) == 1 and least:
            return None, [c for c in [_clause({next(iter(own)) * least})] if c]
        return None, needs if least else []
    return None, []


def trigram_query(rule: Rule) -> Query:
    """The query derived from the rule's expression; empty: no trigram is mandatory."""
    return list(dict.fromkeys(_derived(parser.parse(rule.pattern))[1]))


def _terms(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r) for way in clause for g in way})


def _any_of(terms: list[str]) -> str:
    """An expression for each place where a term stands, as a tree of their characters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in terms:
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    one = lambda cs: re.escape(cs[0]) if len(cs) == 1 else "[" + "".join(map(re.escape, cs)) + "]"
    branches = [re.escape(a) + "(?:" + "|".join(re.escape(b) + one(cs) for b, cs in bs.items()) + ")" for a, bs in tree.items()]
    return "(?=" + one(list(tree)) + ")(?=(" + "|".join(branches) + "))"


def postings(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(block, trigram, rows) of rows (block, row_id, text): a block's rows that have the trigram, in either case."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(terms)), F.lit(1)))
    return rows.select("block", "row_id", F.explode(found).alias("trigram")).groupBy("block", "trigram").agg(F.collect_set("row_id").alias("rows"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_id, rules): of each row that meets some rule's query, these rules' kinds."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("of"))
    none = F.array().cast("array<long>")

    def rows_of(rule: Rule) -> Column:
        clauses = [[reduce(F.array_intersect, [F.coalesce(F.element_at("of", g), none) for g in sorted(way)]) for way in sorted(clause, key=sorted)] for clause in trigram_query(rule)]
        return reduce(F.array_intersect, [reduce(F.array_union, ways) for ways in clauses])

    each = [F.struct(F.lit(r.kind).alias("kind"), rows_of(r).alias("rows")) for r in rules if trigram_query(r)]
    pairs = lists.select(F.explode(F.array(*each)).alias("e")).select("e.kind", F.explode("e.rows").alias("row_id"))
    return pairs.groupBy("row_id").agg(F.collect_set("kind").alias("kinds"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(rule: Rule, text: Column) -> Column:
    """Spans of a rule: between a text's matches lie the parts that splitting at it leaves, so lengths give places.

    Places are sums of lengths, within runs of RUN matches first and then over the runs, as adding to an array copies it:
    the work is in proportion to the matches.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    named = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    empty = F.array().cast(SPANS)
    span = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["own"]
        fits = F.array_append(state["spans"], F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["counted"] >= rule.least, fits).otherwise(state["spans"]).alias("spans"))

    def placed(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(span)
        return _bound(F.transform(numbers, lambda c: F.aggregate(F.slice(steps, c * RUN + 1, F.lit(RUN)), start, step)), joined)

    def joined(runs: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        starts = F.aggregate(runs, first, lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])
        moved = lambda r, at: F.transform(r["spans"], lambda x: F.struct(F.lit(rule.kind).alias("kind"), (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), F.lit(rule.base).alias("base")))
        return F.flatten(F.zip_with(runs, starts, moved))

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
        steps = F.arrays_zip(F.transform(gaps, lambda g: F.length(g).cast("long")).alias("gap"), F.transform(found, lambda w: F.length(w).cast("long")).alias("own"), F.transform(named, F.length).alias("counted"))
        return F.when(F.size(found) > 0, _bound(steps, placed)).otherwise(empty)

    return _bound(whole, spans)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets) of every row of docs (doc_id, text): spans by start, then kind; code points, ends exclusive.

    A null or empty text has none. Repeated rows, and rows of a null doc_id, are searched each for itself; an empty
    table has no rows. Other columns are not read. Added spans are those of the rules that are not base.
    """
    spark = docs.sparkSession
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    # equal rows share an id, and so their candidates; a row's id is its content's hash
    rows = rows.withColumn("row_id", F.xxhash64("doc_id", "text"))
    blocks = max(4 * shuffle_partitions(spark), rows.count() // BLOCK_ROWS + 1)
    blocked = rows.filter(F.length("text") > 0).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row_id"), F.lit(blocks)))
    found = candidates(postings(blocked, _terms(rules)), rules)
    return _verified(rows, written(found, "secret-candidates"), rules)


def _verified(rows: DataFrame, found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    indexed = [r for r in rules if trigram_query(r)]
    scanned = [r for r in rules if not trigram_query(r)]
    named = rows.join(found, "row_id", "left")
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast(SPANS)
    spans = [F.when(F.array_contains("kinds", r.kind), _matches(r, text)).otherwise(empty) for r in indexed] + [_matches(r, text) for r in scanned]
    order = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    keyed = F.transform(F.flatten(F.array(*spans)), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    out = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return named.select("doc_id", out.alias("secrets"))
