"""Secret scans over a trigram inverted index, in DataFrame functions only.

From every rule's regular expression a Boolean query over trigrams is derived that holds for each text the rule can match.
The index lists, for the trigrams that the queries name, the distinct texts that hold them; a rule's candidates are the
texts whose postings satisfy its query, and only they are matched. A rule without a mandatory trigram scans every text.

Defined results: a null text is empty; an empty text has no spans, and the SHA-256 of nothing; equal texts share their
postings; repeated rows are rows of their own; columns other than those named are not read. Ties in the start of a span go
by the order of the rules.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two private-use characters; no rule matches either.
MARK, OTHER = "\ue000", "\ue001"


@dataclass(frozen=True)
class Rule:
    """kind and pattern; a match counts if its group has least characters. base rules come first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query is True, a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _join(kind: str, parts: list[Query]) -> Query:
    idle = kind == "and"
    if any(p is (not idle) for p in parts):
        return not idle
    parts = sorted({p for p in parts if p is not idle}, key=str)
    return idle if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _query_of(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(items, most: int = 64) -> tuple[set[str] | None, Query]:
    """Of a parsed pattern: all strings that it matches, if they are few, and a query that every match satisfies."""
    exact: set[str] | None = {""}
    run, found = {""}, []
    for op, arg in items:
        name, strings, query = str(op), None, True
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            strings = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            strings, query = _walk(arg[3], most)
        elif name == "BRANCH":
            ways = [_walk(b, most) for b in arg[1]]
            strings = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
            query = _join("or", [w[1] for w in ways])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            strings, query = _walk(inner, most)
            if (low, high) == (0, 1) and strings is not None:
                strings, query = strings | {""}, True
            elif low == 0:
                strings, query = None, True
            elif (low, high) != (1, 1):
                strings = None
        elif name == "AT":
            continue
        joined = None if strings is None else {a + b for a, b in product(run, strings)}
        if joined is not None and len(joined) <= most:
            run = joined
            exact = None if exact is None else run
            continue
        found.append(_query_of(run))
        found.append(query)
        run = {""} if strings is None or len(strings) > most else strings
        exact = None
    query = _join("and", [*found, _query_of(run)])
    return exact, query


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-case trigrams that holds for every text in which the pattern has a match."""
    return _walk(parser.parse(pattern))[1]


def _names(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_names, query[1]))


def _holds(query: Query, held: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_holds(q, held) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def index(texts: DataFrame, trigrams: list[str], text: str = "text", digest: str = "digest") -> DataFrame:
    """Postings (trigram, digest) of the distinct texts, for the given lower-case trigrams."""
    low = texts.select(F.col(digest).alias("digest"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("digest", F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(digest, kinds): the postings of a text intersected, and the rules whose query they satisfy."""
    held = postings.groupBy("digest").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("held")), F.lit(k)) for k, q in queries.items()]))
    return held.select("digest", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """All counting matches of a rule, as (start, number, end, kind) in code points, end exclusive.

    Each match is put between two marks; the pieces between marks are then gap, match, gap and so on, and their lengths
    give the places. The mark cannot occur in the text, where a sign that no rule matches stands for it. Runs of one
    character class are looked for in full length only, which finds the same matches."""
    pattern = re_least(rule)
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        gap, match = F.element_at(pieces, i), F.element_at(pieces, i + 1)
        start = acc["at"] + F.char_length(gap)
        end = start + F.char_length(match)
        size = F.char_length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.group else F.char_length(match)
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(size >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    firsts = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    return F.when(F.size(pieces) > 2, F.aggregate(firsts, zero, step)["spans"]).otherwise(zero["spans"])


def re_least(rule: Rule) -> str:
    """The pattern with the least length of a whole match inside it, where a match is a run of one class at its end."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{rule.least - rule.pattern.index('[')},}}"
    return rule.pattern


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, spans): spans array of (start, number, end, kind) sorted by start and rule."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(c) for c in keep], body.alias("__text"), F.unhex(F.md5(body)).alias("__digest"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    names = sorted(set().union(*map(_names, queries.values())))
    found = candidates(index(rows, names, "__text", "__digest"), queries)
    told = rows.join(found.select(F.col("digest").alias("__digest"), F.col("kinds").alias("__kinds")), "__digest", "left")
    clean = F.when(F.col("__text").contains(MARK), F.replace("__text", F.lit(MARK), F.lit(OTHER))).otherwise(F.col("__text"))
    told = told.withColumn("__text", clean)
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    each = [F.when(F.array_contains("__kinds", r.kind), _spans(F.col("__text"), r, i)).otherwise(none) if r.kind in queries else _spans(F.col("__text"), r, i) for i, r in enumerate(rules)]
    return told.select(*keep, F.array_sort(F.concat(*each)).alias("spans"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = sum(r.base for r in RULES)
    count = lambda i: F.size(F.filter("spans", lambda s: s["number"] == i)).cast("long")
    own = F.filter("spans", lambda s: s["number"] < base)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text_of(own), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def secrets_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same by plain matching of every rule."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cut, spans = [], []
    for i, r in enumerate(rules):
        cut.append(f"string_split(regexp_replace(x, {q(r.pattern)}, chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS p{i}")
        size = f"length(regexp_extract(m.m, {q(r.pattern)}, {r.group}))" if r.group else "length(m.m)"
        each = f"list_transform(range(1, (len(p{i}) - 1) // 2 + 1), lambda i: {{'s': CAST(list_sum(list_transform(p{i}[1:2*i-1], lambda z: length(z))) AS BIGINT), 'k': {i}, 'n': {q(r.kind)}, 'm': p{i}[2*i]}})"
        spans.append(f"list_filter({each}, lambda m: {size} >= {r.least})")
    base = sum(r.base for r in rules)
    joined = lambda a: f"array_to_string(list_transform({a}, lambda m: m.n || ':' || m.s || ':' || (m.s + length(m.m))), ',')"
    return f"""
WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS x FROM {table}),
pieces AS (SELECT doc_id, {', '.join(cut)} FROM t),
found AS (SELECT doc_id, list_sort({' || '.join(spans)}) AS a FROM pieces)
SELECT doc_id, CAST(len(list_filter(a, lambda m: m.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(a, lambda m: m.k = 1)) AS BIGINT) AS n_access,
       CAST(len(list_filter(a, lambda m: m.k = 2)) AS BIGINT) AS n_hex,
       sha256(coalesce({joined(f'list_filter(a, lambda m: m.k < {base})')}, '')) AS base_sha256, coalesce({joined('a')}, '') AS spans
FROM found"""


OP3_SQL = secrets_sql()
