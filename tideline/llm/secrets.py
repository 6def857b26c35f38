"""Secret scans through an inverted index of trigrams; DataFrame functions only.

From each rule's regex follows a Boolean query over the trigrams that any match must hold. The index has
the postings of those trigrams. Postings are intersected by counting, candidates are verified by
the regex itself. A rule whose regex forces no trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alternatives of one regex, and trigrams of one alternative, that a query takes up; a weaker query finds more candidates.
ALTERNATIVES, TRIGRAMS = 64, 6


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # Java and Python read it alike
    least: int  # characters that the group has at least
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),  # a run is maximal, so shorter ones need not be matched first
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)

GAP = None


def _strings(tokens) -> list[list[str | None]]:
    """What a regex matches, as alternatives of characters and gaps."""
    found: list[list[str | None]] = [[]]
    for kind, arg in tokens:
        if kind is op.LITERAL:
            more = [[chr(arg).lower()]]
        elif kind is op.IN and len(arg) <= 5 and all(k is op.LITERAL for k, _ in arg):
            more = [[chr(c).lower()] for _, c in arg]
        elif kind is op.BRANCH:
            more = [s for branch in arg[1] for s in _strings(branch)]
        elif kind is op.SUBPATTERN:
            more = _strings(arg[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and (arg[0] >= 1 or arg[1] == 1):
            once = _strings(arg[2])
            more = once if arg[0] == arg[1] == 1 else [[], *once] if arg[0] == 0 else [[*s, GAP, *s] for s in once]
            more = [[*s, GAP] if arg[1] not in (arg[0], 1) and arg[0] == 0 else s for s in more]
        elif kind is op.AT:
            more = [[]]
        else:
            more = [[GAP]]
        crossed = [a + b for a, b in product(found, more)]
        found = crossed if len(crossed) <= ALTERNATIVES else [[*a, GAP] for a in found]
    return found


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Sets of trigrams, in small letters: any match holds all of one set. None if nothing is sure."""
    query = set()
    for string in _strings(regex_parser.parse(regex)):
        sure = list(dict.fromkeys("".join(string[i : i + 3]) for i in range(len(string) - 2) if GAP not in string[i : i + 3]))
        if not sure:
            return None
        query.add(tuple(sure))
    least = [s for s in query if not any(set(x) < set(s) for x in query)]  # A or (A and B) is A
    return sorted({frozenset(s[:: -(-len(s) // TRIGRAMS)]) for s in least}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], keys: list[str], text_col: str = "text") -> DataFrame:
    """(trigram, keys): the inverted index of the given trigrams over whole texts, letters in either case."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    present = F.transform(F.array(F.lower(F.col(text_col))), lambda text: F.filter(wanted, lambda t: F.contains(text, t)))[0]
    return docs.select(F.explode(present).alias("trigram"), *keys)


def candidates(index: DataFrame, rules: tuple[Rule, ...], keys: list[str]) -> DataFrame:
    """(keys, rule): rows in the postings of all trigrams of one of the rule's sets."""
    wanted = [(r.kind, n, t, len(s)) for r in rules for n, s in enumerate(trigram_query(r.regex) or []) for t in sorted(s)]
    if not wanted:
        return index.select(*keys, F.lit("").alias("rule")).limit(0)
    sets = index.sparkSession.createDataFrame(wanted, "rule string, alternative int, trigram string, size int")
    met = index.join(F.broadcast(sets), "trigram").groupBy(*keys, "rule", "alternative", "size").count()
    return met.where(F.col("count") >= F.col("size")).select(*keys, "rule").distinct()


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """array<(start, number, stop, kind)> in code points: leftmost matches, then those with a long enough group."""
    whole, pattern = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.lit(rule.regex)
    valued = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    shape = "array<struct<start:int,number:int,stop:int,kind:string>>"
    # What lies between the matches and the matches themselves add up to the positions.
    pieces = F.arrays_zip(F.split(text, rule.regex, -1).alias("before"), whole.alias("match"), valued.alias("value"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("found"))

    def step(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + F.length(piece["before"])
        stop = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        fits = F.coalesce(F.length(piece["value"]) >= rule.least, F.lit(False))
        return F.struct(stop.alias("at"), F.when(fits, F.array_append(so_far["found"], span)).otherwise(so_far["found"]).alias("found"))

    spans = F.aggregate(pieces, first, step, lambda done: done["found"])
    return F.when(text.rlike(rule.regex), spans).otherwise(F.array().cast(shape))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, number, stop, kind>>): the spans of all rules in order of start, then rule.

    A null text is empty. Rows without an id and repeated rows are kept, one row out for each row in; rows
    that are equal in id and text share their spans. The texts of candidates, no others, are asked for
    again after the index; that join is an inner one, so Spark may filter its scan at run time.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    numbered = list(enumerate(rules))
    indexed = [(n, r) for n, r in numbered if trigram_query(r.regex)]
    everywhere = [spans_of(F.col("text"), r, n) for n, r in numbered if not trigram_query(r.regex)]
    shape = "array<struct<start:int,number:int,stop:int,kind:string>>"
    scanned = rows.select("id", "th", (F.concat(*everywhere) if everywhere else F.array().cast(shape)).alias("full"))
    if not indexed:
        return scanned.select("id", F.array_sort("full").alias("spans"))
    trigrams = sorted({t for _, r in indexed for s in trigram_query(r.regex) for t in s})
    index = postings(rows, trigrams, ["id", "th"])
    of = candidates(index.distinct(), tuple(r for _, r in indexed), ["id", "th"]).groupBy("id", "th").agg(F.collect_set("rule").alias("rules"))
    of = of.select(F.col("id").alias("of"), F.col("th").alias("of_th"), "rules")
    texts = rows.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    verified = F.concat(*[F.when(F.array_contains("rules", r.kind), spans_of(F.col("text"), r, n)).otherwise(F.array().cast(shape)) for n, r in indexed])
    hits = texts.select("of", "of_th", verified.alias("part")).where(F.size("part") > 0).dropDuplicates(["of", "of_th"])
    joined = scanned.join(hits, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left")
    return joined.select("id", F.array_sort(F.concat("full", F.coalesce("part", F.array().cast(shape)))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base rules, a digest of their spans, and all spans as a string."""
    base = [n for n, r in enumerate(rules) if r.base]
    of_base = F.filter("spans", lambda s: s["number"].isin(base))
    count_of = lambda n: F.size(F.filter("spans", lambda s: s["number"] == n)).cast("bigint")
    counts = [count_of(n).alias(f"n_{rules[n].kind}") for n in base]
    return found.select("id", *counts, F.sha2(joined_spans(of_base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for ``digest(scan(documents))``; its regexes spell out letters in either case."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    tables = []
    for n, r in enumerate(RULES):
        pattern = r.regex.replace("(?i:password|passwd|secret|token|api_?key)", either).replace("'", "''")
        tables.append(f"""
  SELECT doc_id, {n} AS number, '{r.kind}' AS kind, len(v) AS size,
         coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS start, len(m[i]) AS width
  FROM (SELECT doc_id, p, m, i, regexp_extract(m[i], '{pattern}', {r.group}) AS v FROM (
    SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS p, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, unnest(range(1, len(regexp_extract_all(coalesce(text, ''), '{pattern}')) + 1)) AS i FROM documents))
  WHERE len(v) >= {r.least}""")
    base = [n for n, r in enumerate(RULES) if r.base]
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + width AS BIGINT)"
    keep = f"number IN ({', '.join(map(str, base))})"
    counts = ", ".join(f"CAST(count(*) FILTER (number = {n}) AS BIGINT) AS n_{RULES[n].kind}" for n in base)
    return f"""
WITH found AS ({' UNION ALL '.join(tables)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY start, number) FILTER ({keep}), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY start, number) FILTER (number IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""
