"""Secret scans through a trigram inverted index, with Spark expressions alone.

Each rule's regular expression is turned into a Boolean query over trigrams that any
match must hold (lower-cased). The index has a posting (trigram, document) for each
trigram of any query; postings are intersected per document, and only the candidates of a
rule are verified with its expression. Rules without mandatory trigrams (hexadecimal
keys) scan every document.

Spans are in code points, end exclusive. The base kinds are assign, access and hex; the
other rules of RULES add spans of their own kinds.

Edge cases: a null text counts as empty and has no spans; texts of any length are scanned
whole; rows with equal ids share candidates and are verified each; null ids are an id; an
empty table gives an empty result; `scan` leaves further columns unread, `redact` keeps them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import broadcastable, fresh, running_maxima, running_starts, staged


@dataclass(frozen=True)
class Rule:
    """Matches of `regex` whose group `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

#: Strings that a part of an expression may be spelled out to, and clauses of a query.
SPELLED, CLAUSES = 64, 64

Clauses = frozenset[frozenset[str]]
ALWAYS: Clauses = frozenset([frozenset()])


def _both(a: Clauses, b: Clauses) -> Clauses:
    """a AND b; if that gets too long, the shorter of the two, which is weaker but sound."""
    if len(a) * len(b) > CLAUSES:
        return min((x for x in (a, b) if x != ALWAYS), key=len, default=ALWAYS)
    return _least(frozenset(x | y for x in a for y in b))


def _least(clauses: Clauses) -> Clauses:
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


def _of_strings(strings: frozenset[str]) -> Clauses:
    return _least(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _of_nodes(nodes) -> tuple[frozenset[str] | None, Clauses]:
    """(all strings that the nodes match, or None if there are too many; what holds of any match)."""
    spelled, held, whole = frozenset([""]), ALWAYS, True
    for op, arg in nodes:
        strings, must = _of_node(op, arg)
        if strings is not None and len(spelled) * len(strings) <= SPELLED:
            spelled = frozenset(a + b for a in spelled for b in strings)
            continue
        held, whole = _both(held, _of_strings(spelled)), False
        held = _both(held, must)
        spelled = strings if strings is not None else frozenset([""])
    return (spelled, ALWAYS) if whole else (None, _both(held, _of_strings(spelled)))


def _of_node(op, arg) -> tuple[frozenset[str] | None, Clauses]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ALWAYS
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < SPELLED:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ALWAYS
        return (frozenset(chars), ALWAYS) if len(chars) <= 5 else (None, ALWAYS)
    if op is sre.SUBPATTERN:
        return _of_nodes(arg[3])
    if op is sre.BRANCH:
        parts = [_of_nodes(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            strings = frozenset().union(*(s for s, _ in parts))
            return (strings, ALWAYS) if len(strings) <= SPELLED else (None, _of_strings(strings))
        return None, _least(frozenset().union(*(_of_strings(s) if s is not None else m for s, m in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, sub = arg
        strings, must = _of_nodes(sub)
        if strings is not None and least == 0 and most == 1:
            return strings | {""}, ALWAYS
        return None, (ALWAYS if least == 0 else must if strings is None else _of_strings(strings))
    if op is sre.AT:
        return frozenset([""]), ALWAYS
    return None, ALWAYS


def trigram_query(regex: str) -> Clauses:
    """Trigrams (lower-cased) that a match must hold: one clause's all, of any clause. ALWAYS: nothing is known."""
    strings, must = _of_nodes(_parser.parse(regex))
    return _of_strings(strings) if strings is not None else must


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index over `grams`: a row (gram, doc_id) for each that a document's lower-cased text holds."""
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("doc_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rules: for each document with any, the kinds whose trigram query its postings satisfy."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != ALWAYS}
    grams = sorted(set().union(*(c for q in asked.values() for c in q)))
    #: a document's postings meet in bit sets of 60 trigrams each, which map-side partial aggregates keep small
    at = {g: (k // 60, k % 60) for k, g in enumerate(grams)}
    bits = [
        F.bit_or(F.coalesce(F.create_map(*(x for g, (w, b) in at.items() if w == word for x in (F.lit(g), F.lit(1 << b))))[F.col("gram")], F.lit(0))).alias(f"w{word}")
        for word in range(-(-len(grams) // 60))
    ]
    met = postings(docs, grams, id_col, text_col).groupBy("doc_id").agg(*bits)

    def holds(clause: frozenset[str]) -> Column:
        out = F.lit(True)
        for word in sorted({at[g][0] for g in clause}):
            need = sum(1 << at[g][1] for g in clause if at[g][0] == word)
            out = out & (F.col(f"w{word}").bitwiseAND(F.lit(need)) == F.lit(need))
        return out

    kinds = []
    for kind, clauses in asked.items():
        any_of = F.lit(False)
        for c in sorted(clauses, key=sorted):
            any_of = any_of | holds(c)
        kinds.append(F.when(any_of, F.lit(kind)))
    return met.select("doc_id", F.array_compact(F.array(*kinds)).alias("rules")).where(F.size("rules") > 0)


def _verified(rows: DataFrame, text: str, rule: Rule, may: Column) -> DataFrame:
    """rows with a column spans_KIND: [{start, kind, end}] of the rule's matches in `text` where `may` holds.

    The pieces between matches and the matches alternate, so their lengths give the offsets.
    """
    k = rule.kind
    none = F.expr("cast(array() as array<string>)")
    regex = F.lit(rule.regex)
    hit = may & F.col(text).rlike(rule.regex)
    rows = rows.withColumn(f"m_{k}", F.when(hit, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none))
    some = F.size(f"m_{k}") > 0
    rows = rows.withColumn(f"p_{k}", F.when(some, F.split(text, rule.regex, -1)).otherwise(none))
    if rule.group:
        rows = rows.withColumn(f"g_{k}", F.when(some, F.regexp_extract_all(text, regex, F.lit(rule.group))).otherwise(none))
    part = f"g_{k}" if rule.group else f"m_{k}"
    rows = rows.withColumn(f"s_{k}", F.expr(f"transform(m_{k}, (m, i) -> cast(length(p_{k}[i]) + length(m) as bigint))"))
    rows = rows.withColumn(f"a_{k}", F.expr(running_starts(f"s_{k}")))
    order = [r.kind for r in RULES].index(k) if rule in RULES else len(RULES)
    spans = (
        f"filter(transform(m_{k}, (m, i) -> if(length({part}[i]) >= {rule.least}, "
        f"named_struct('start', a_{k}[i] + length(p_{k}[i]), 'rank', {order}, 'kind', '{k}', 'end', a_{k}[i] + length(p_{k}[i]) + length(m)), null)), x -> x is not null)"
    )
    return rows.withColumn(f"spans_{k}", F.expr(spans)).drop(*(f"{x}_{k}" for x in "mpgsa"))


def spans_of(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with a column `out`: all spans by start, then by the rules' order."""
    cand_id, cand = fresh(docs, "_cand_id"), fresh(docs, "_cand")
    found = staged(candidates(docs, rules, id_col, text_col).select(F.col("doc_id").alias(cand_id), F.col("rules").alias(cand)), "candidates")
    # texts stay where they are while the candidates' ids are few enough to broadcast; beyond, they are shuffled once
    found = F.broadcast(found) if broadcastable(found) else found
    rows = docs.join(found, F.col(id_col).eqNullSafe(F.col(cand_id)), "left")
    rows = rows.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(cand).alias("_cand"))
    for rule in rules:
        may = F.coalesce(F.array_contains("_cand", rule.kind), F.lit(False)) if trigram_query(rule.regex) != ALWAYS else F.lit(True)
        rows = _verified(rows, "_text", rule, may)
    spans = F.sort_array(F.flatten(F.array(*(F.col(f"spans_{r.kind}") for r in rules))))
    return rows.select("_row.*", spans.alias(out))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = spans_of(rows, rules, out="found")
    base = "filter(found, x -> x.kind in ('assign', 'access', 'hex'))"
    return got.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS),
        F.expr(f"sha2(cast({_joined(base)} as binary), 256)").alias("base_sha256"),
        F.expr(_joined("found")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by `mark`; overlapping spans give one mark. Null texts stay null."""
    name = fresh(docs, "_found")
    got = spans_of(docs, rules, id_col, text_col, out=name)
    text = f"`{text_col}`"
    # every value that is used more than once is bound to a name, so that it is computed once
    clean = _bound(
        {"t": text, "x": name},
        "if(size(v.x) = 0, v.t, " + _bound(
            {"x": "v.x", "to": "transform(v.x, x -> cast(x.end as bigint))", "b": _blocks("v.t"), "n": "cast(length(v.t) as bigint)"},
            _bound(
                {"x": "v.x", "to": "v.to", "b": "v.b", "n": "v.n", "before": running_maxima("v.to")},
                _bound(
                    # a mark begins where a span begins at or after all earlier ends, and ends with the last of them
                    {"b": "v.b", "n": "v.n", "first": "filter(transform(v.x, (x, i) -> if(x.start >= v.before[i], cast(x.start as bigint), null)), x -> x is not null)",
                     "last": "concat(array(0L), slice(filter(v.before, (m, i) -> v.x[i].start >= m), 2, size(v.x)), array(array_max(v.to)))"},
                    f"array_join(transform(concat(v.first, array(v.n)), (s, i) -> {_cut('v.b', 'v.last[i]', 's')}), '{mark}')",
                ),
            ),
        ) + ")",
    )
    return got.withColumn(text_col, F.expr(clean)).select(*docs.columns)


def _bound(values: dict[str, str], then: str) -> str:
    """SQL `then`, in which v.NAME stands for each of the values, computed once."""
    fields = ", ".join(f"'{k}', {x}" for k, x in values.items())
    return f"transform(array(named_struct({fields})), v -> {then})[0]"


#: Code points of a block, and of the stretches that are cut into blocks: a power of two, and some of it.
BLOCK, STRETCH = 1 << 12, 1 << 18


def _blocks(text: str) -> str:
    """SQL for the blocks of a text; cut in two steps, since substring counts from the beginning of its text."""
    cut = lambda x, size: f"transform(sequence(0, greatest(0, length({x}) - 1) div {size}), k -> substring({x}, cast(k * {size} + 1 as int), {size}))"
    return f"flatten(transform({cut(text, STRETCH)}, y -> {cut('y', BLOCK)}))"


def _cut(blocks: str, start: str, end: str) -> str:
    """SQL for the code points from `start` to before `end` of a text in blocks."""
    first, last, at = f"cast({start} div {BLOCK} as int)", f"cast({end} div {BLOCK} as int)", f"cast({start} % {BLOCK} + 1 as int)"
    return (
        f"if({first} = {last}, coalesce(substring(get({blocks}, {first}), {at}, cast({end} - {start} as int)), ''), "
        f"concat(substring(get({blocks}, {first}), {at}), array_join(slice({blocks}, {first} + 2, {last} - {first} - 1), ''), coalesce(substring(get({blocks}, {last}), 1, cast({end} % {BLOCK} as int)), '')))"
    )


def brute_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, str, int]]:
    """What `scan` must find, by Python's own regular expressions; for tests."""
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.regex, text, re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, r.kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(out)]
