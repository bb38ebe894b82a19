"""Operator 10: personal data by weak supervision (DataFrame and SQL functions only).

Candidate spans come from the base patterns and from stricter and looser alternates. Five labelers vote on each
candidate for, against, or not at all, each by something else: `form` (the shape of a well-written one: groups of a card, dots of an address), `checksum` (Luhn,
parts of an ip, number of a phone's digits; mail has none), `gazetteer` (top-level domains, calling codes, card issuers, reserved networks), `context` (words before the span) and
`border` (characters beside it). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is personal data; a logistic span classifier is then trained on these
probabilities and applied as an expression. Base spans always stay; an alternate candidate is added where the
classifier gives 0.5 or more and it overlaps no base span of its kind.

Only counts of vote patterns (at most 4 * 3 * 3^5) reach the driver. Matches are found with two built-in functions: the matches of
a pattern and the gaps between them, whose lengths give code-point offsets. Patterns are written with possessive
repeats and left guards, so that long texts neither recurse nor backtrack, and match what the plain patterns match. What runs over the spans of a text in order runs
block by block, so its cost stays near their number.

Defined results: null and empty texts have no spans. Very long texts are read whole. Rows repeat as they do in docs, each with its own spans; ties (spans of several kinds at one
place) are all given, by kind and start. Offsets are code points, end exclusive. An empty table gives an empty table, and its model adds no span. Other columns are kept as they are, but `candidates`,
`base_spans` and `all_spans` are names of results and replace columns so named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns, guarded; the plain forms stand in PLAIN and are used by tests.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ALTERNATE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "email_alternate": "at"}

# Gazetteers and context words. A domain of two letters is a country's; calling codes, issuers and networks are given as patterns of their numbering plans.
DOMAINS = ("aero", "app", "biz", "cat", "com", "coop", "dev", "edu", "gov", "info", "int", "jobs", "mil", "mobi", "museum", "name", "net", "online", "org", "post", "pro", "shop", "site", "store", "tech", "tel", "travel", "xyz")
CALLING_CODE = "^(1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9])"
ISSUER = "^(4([0-9]{12}|[0-9]{15}|[0-9]{18})|(5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12,14}|3[47][0-9]{13}|(30[0-5]|36|38|39)[0-9]{11,16}|35(2[89]|[3-8][0-9])[0-9]{12,15}|(6011|64[4-9]|65|62|50|5[6-8])[0-9]{9,17})$"
RESERVED_NETWORK = "^0*(0|127|22[4-9]|2[3-5][0-9])[.]|^169[.]254[.]|^192[.]0[.]2[.]|^198[.]51[.]100[.]|^203[.]0[.]113[.]"
PRIVATE_NETWORK = "^10[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^192[.]168[.]"
FORM = {
    "email": "^[A-Za-z0-9][A-Za-z0-9_%+-]*([.][A-Za-z0-9_%+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?[.])+[A-Za-z]{2,24}$",
    "ip": "^(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}$",
    "card": "^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){2,3}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$",
    "phone": "^[+][0-9]{1,3}[ .-]?([(][0-9]{1,4}[)][ .-]?)?[0-9]{1,4}([ .-]?[0-9]{2,5}){1,4}$",
}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write|schreib",
    "ip": "\\bip\\b|address|host|server|login|adresse",
    "card": "card|visa|master|amex|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|anruf|telefon|contact",
}
AGAINST = "version|release|section|isbn|issn|serial|sha|token|order no|invoice"

MOST_FORM = 254  #: characters of a well-written one of any kind
STRIDE = 128  #: matches whose positions are built together

LABELERS = ("form", "checksum", "gazetteer", "context", "border")
SPAN = "struct<kind:int,start:int,end:int,source:int,votes:array<int>>"


def occurrences(text: str, pattern: str, condition: str) -> str:
    """SQL: array of (value, start, before, after) of the leftmost non-overlapping matches of a pattern."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raw = "cast(array() as array<struct<value:string,start:int,before:string,after:string>>)"
    block = f"sequence(k * {STRIDE} + 1, least(size(x.m), (k + 1) * {STRIDE}))"
    step = (
        "named_struct('pos', a.pos + length(x.g[i - 1]) + length(x.m[i - 1]), 'out', concat(a.out, array(named_struct('value', x.m[i - 1], "
        "'start', a.pos + length(x.g[i - 1]), 'before', right(x.g[i - 1], 32), 'after', left(x.g[i], 1)))))"
    )
    # Positions are running sums of lengths; they are built block by block, so that the cost of a text with many matches stays near their number.
    sums = f"transform(sequence(0, (size(x.m) - 1) div {STRIDE}), k -> aggregate({block}, 0, (a, i) -> a + length(x.g[i - 1]) + length(x.m[i - 1])))"
    bases = f"aggregate({sums}, named_struct('pos', 0, 'out', cast(array() as array<int>)), (a, s) -> named_struct('pos', a.pos + s, 'out', concat(a.out, array(a.pos))), a -> a.out)"
    blocks = f"flatten(transform({bases}, (base, k) -> aggregate({block}, named_struct('pos', base, 'out', {raw}), (a, i) -> {step}, a -> a.out)))"
    walk = f"if(size(x.m) = 0, {raw}, {blocks})"
    return f"case when {condition} then transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))), x -> {walk})[0] else {raw} end"


def _vote(yes: str, no: str = "false") -> str:
    return f"case when {yes} then 1 when {no} then 0 else -1 end"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a short string of digits passes the Luhn check."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + case when i % 2 = 1 then cast(substring(reverse({digits}), i, 1) as int) "
        f"when cast(substring(reverse({digits}), i, 1) as int) > 4 then 2 * cast(substring(reverse({digits}), i, 1) as int) - 9 else 2 * cast(substring(reverse({digits}), i, 1) as int) end) % 10 = 0"
    )


def checks(kind: str, v: str) -> str:
    """SQL: whether a match of the base pattern counts."""
    d = _digits(v)
    return {
        "email": "true",
        "ip": f"forall(split({v}, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(p, 3) as int) <= 255)",
        "card": f"case when length({d}) between 13 and 19 then {luhn(d)} else false end",
        "phone": f"length({d}) between 9 and 15",
    }[kind]


def _candidates(kind: str, source: str) -> str:
    """SQL: array<SPAN> of a kind; source 1: base rule holds, 0: it does not, 2: alternate."""
    pattern = (BASE if source == "base" else ALTERNATE)[kind]
    need = NEEDS.get(kind if source == "base" else f"{kind}_{source}", NEEDS.get(kind) if kind == "phone" else None)
    found = occurrences("text", pattern, f"contains(text, '{need}')" if need else "true")
    v, d = "o.value", _digits("o.value")
    good = checks(kind, v) if source == "base" or kind != "email" else "true"
    last = f"lower(regexp_extract({v}, '([A-Za-z0-9-]+)$', 1))"
    gazetteer = {
        "email": _vote(f"{last} in ({', '.join(repr(x) for x in DOMAINS)}) or {last} rlike '^[a-z]{{2}}$'", f"{last} rlike '^([0-9]+|.)$'"),
        "ip": _vote(f"not ({v} rlike '{RESERVED_NETWORK}') and not ({v} rlike '{PRIVATE_NETWORK}')", f"{v} rlike '{RESERVED_NETWORK}'"),
        "card": _vote(f"{d} rlike '{ISSUER}'", f"left({d}, 1) in ('0', '1', '7', '8', '9')"),
        "phone": _vote(f"{d} rlike '{CALLING_CODE}'", f"left({d}, 1) = '0'"),
    }[kind]
    context = _vote(f"lower(o.before) rlike '{CONTEXT[kind]}'".replace("\\", "\\\\"), f"lower(o.before) rlike '{AGAINST}'")
    border = _vote("o.before = '' or o.before rlike '[\\\\s:;,(<|]$'", "o.before rlike '[A-Za-z0-9_=/\"#-]$' or o.after rlike '[A-Za-z0-9_/\"]'")
    # An alternate pattern is a form by itself, so `form` says nothing on its matches; mail has no checksum.
    form = _vote(f"length({v}) <= {MOST_FORM} and {v} rlike '{FORM[kind]}'", "true") if source == "base" else "-1"
    checksum = "-1" if kind == "email" else "case when w.good then 1 else 0 end"
    votes = f"array({form}, {checksum}, {gazetteer}, {context}, {border})"
    row = f"named_struct('kind', {KINDS.index(kind)}, 'start', o.start, 'end', o.start + length(o.value), 'source', {'case when w.good then 1 else 0 end' if source == 'base' else '2'}, 'votes', {votes})"
    return f"transform({found}, o -> transform(array(named_struct('good', {good})), w -> {row})[0])"


def detect(docs: DataFrame) -> DataFrame:
    """docs with `candidates`, an array of SPAN; the text is not null any more. A column of that name is replaced."""
    own = docs.withColumn("text", F.coalesce("text", F.lit("")))
    parts = [_candidates(k, "base") for k in KINDS] + [_candidates(k, "alternate") for k in ALTERNATE]
    return own.withColumn("candidates", F.expr(f"concat({', '.join(parts)})"))


class Model:
    """Labeler reliabilities from EM, and the weights of the span classifier."""

    def __init__(self, prior: float, hit: list[list[float]], false: list[list[float]], weights: list[float]):
        self.prior, self.hit, self.false, self.weights = prior, hit, false, weights


def _features(kind: int, source: int, votes: tuple[int, ...]) -> list[int]:
    """Positions of the ones of a one-hot row: intercept, kind, source, and each labeler's vote."""
    at = [0, 1 + kind, 1 + len(KINDS) + source]
    return at + [1 + len(KINDS) + 3 + 3 * i + v + 1 for i, v in enumerate(votes)]


N_FEATURES = 1 + len(KINDS) + 3 + 3 * len(LABELERS)


def fit(detected: DataFrame, rounds: int = 60) -> Model:
    """Reliabilities and classifier from the counts of vote patterns over all candidates."""
    c = F.col("c")
    seen = detected.select(F.explode("candidates").alias("c")).groupBy(c["kind"].alias("kind"), c["source"].alias("source"), c["votes"].alias("votes")).agg(F.count("*").alias("n")).collect()
    rows = sorted((r["kind"], r["source"], tuple(r["votes"]), r["n"]) for r in seen)
    total = sum(r[3] for r in rows)
    prior, m = 0.5, len(LABELERS)
    hit = [[0.2, 0.2, 0.6] for _ in range(m)]  # chances of votes -1, 0, 1 where it is personal data
    false = [[0.2, 0.5, 0.3] for _ in range(m)]
    post = [0.5] * len(rows)
    for _ in range(rounds if rows else 0):
        for k, (_, _, votes, _) in enumerate(rows):
            a, b = math.log(prior), math.log(1 - prior)
            for i, v in enumerate(votes):
                a, b = a + math.log(hit[i][v + 1]), b + math.log(false[i][v + 1])
            post[k] = 1 / (1 + math.exp(max(-500.0, min(500.0, b - a))))
        weight = sum(p * r[3] for p, r in zip(post, rows, strict=True))
        prior = min(0.99, max(0.01, (weight + 1) / (total + 2)))
        for i in range(m):
            yes, no = [0.5, 0.5, 1.0], [0.5, 1.0, 0.5]  # pseudo-counts keep a labeler on the side of its votes
            for p, (_, _, votes, n) in zip(post, rows, strict=True):
                yes[votes[i] + 1] += p * n
                no[votes[i] + 1] += (1 - p) * n
            hit[i], false[i] = [x / sum(yes) for x in yes], [x / sum(no) for x in no]
    weights = [0.0] * N_FEATURES
    own = [_features(kind, source, votes) for kind, source, votes, _ in rows]
    for _ in range(300 if rows else 0):
        grad = [0.01 * w for w in weights]
        for p, at, (_, _, _, n) in zip(post, own, rows, strict=True):
            miss = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[j] for j in at))))) - p)
            for j in at:
                grad[j] += miss
        weights = [w - 2.0 * g / len(LABELERS) for w, g in zip(weights, grad, strict=True)]
    if not rows:
        weights[0] = -10.0
    return Model(prior, hit, false, weights)


def _let(name: str, value: str, then: str) -> str:
    """SQL: `then`, in which name stands for value."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _block_size(xs: str) -> str:
    return f"greatest({STRIDE}, cast(sqrt(size({xs})) as int))"


def _maxima(xs: str, value: str) -> str:
    """SQL: for each element x of an array the greatest `value` (bigint, of x) before it, or the least bigint; block by block, so that no long array grows by one."""
    low = "cast(-9223372036854775807 as bigint)"
    none = "cast(array() as array<bigint>)"
    block = "slice(v.xs, cast(k * v.b + 1 as int), v.b)"
    tops = f"transform(sequence(0, (size(v.xs) - 1) div v.b), k -> aggregate({block}, {low}, (a, x) -> greatest(a, {value})))"
    bases = f"aggregate({tops}, named_struct('m', {low}, 'out', {none}), (a, t) -> named_struct('m', greatest(a.m, t), 'out', concat(a.out, array(a.m))), a -> a.out)"
    inner = f"aggregate({block}, named_struct('m', base, 'out', {none}), (a, x) -> named_struct('m', greatest(a.m, {value}), 'out', concat(a.out, array(a.m))), a -> a.out)"
    return _let("v", f"named_struct('xs', {xs}, 'b', {_block_size(xs)})", f"if(size(v.xs) = 0, {none}, flatten(transform({bases}, (base, k) -> {inner})))")


#: Places of all kinds on one line: those of a kind come after all of the kinds before.
_SHIFT = 1 << 40


def label(detected: DataFrame, model: Model) -> DataFrame:
    """detected with `base_spans` and `all_spans`, arrays of (kind, start, end) by kind, then start; without candidates."""
    w = [repr(float(x)) + "D" for x in model.weights]
    k, m = 1 + len(KINDS), len(LABELERS)
    parts = [w[0], f"array({', '.join(w[1:k])})[c.kind]", f"array({', '.join(w[k : k + 3])})[c.source]"]
    parts += [f"array({', '.join(w[k + 3 + 3 * i : k + 6 + 3 * i])})[c.votes[{i}] + 1]" for i in range(m)]
    held = f"array_sort(transform(filter(candidates, c -> c.source = 1 or (c.source = 2 and {' + '.join(parts)} >= 0)), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'added', int(c.source = 2))))"
    place = lambda end: f"x.kind * {_SHIFT}L + x.{end}"
    before = _maxima("y", f"if(x.added = 0, {place('end')}, -9223372036854775807L)")
    after = f"reverse({_maxima('reverse(y)', f'if(x.added = 0, -({place("start")}), -9223372036854775807L)')})"
    free = f"filter(y, (x, i) -> x.added = 0 or (z.before[i] <= {place('start')} and -z.after[i] >= {place('end')}))"
    slim = "transform({}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"
    found = _let("y", held, f"named_struct('base', {slim.format('filter(y, x -> x.added = 0)')}, 'whole', if(exists(y, x -> x.added = 1), {_let('z', f"named_struct('before', {before}, 'after', {after})", slim.format(free))}, {slim.format('y')}))")
    own = detected.withColumn("candidates", F.expr(found))
    return own.withColumns({"base_spans": F.col("candidates.base"), "all_spans": F.col("candidates.whole")}).drop("candidates")


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)))")


def digests(labelled: DataFrame) -> DataFrame:
    """The contract's columns from label()."""
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return labelled.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))


def redact(labelled: DataFrame) -> DataFrame:
    """labelled with each span of text replaced by its kind in angle brackets; spans that overlap are one, of the kind that starts first. Span columns are dropped.
    The text is cut to blocks of many spans first, as finding a place in it costs its length."""
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    by_start = "array_sort(transform(all_spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    ends = _maxima("y", "cast(x.end as bigint)")
    heads = "filter(transform(y, (x, i) -> named_struct('start', x.start, 'kind', x.kind, 'from', cast(greatest(e[i], 0) as int))), h -> h.start >= h.from)"
    block = "slice(p.h, cast(k * p.b + 1 as int), p.b)"
    cut = "substring(text, h[0].from + 1, element_at(h, -1).start - h[0].from)"
    pieces = f"transform(h, x -> concat(substring(t, x.from - h[0].from + 1, x.start - x.from), array({names})[x.kind]))"
    parts = f"flatten(transform(sequence(0, (size(p.h) - 1) div p.b), k -> {_let('h', block, _let('t', cut, pieces))}))"
    whole = f"concat(array_join({parts}, ''), substring(text, array_max(transform(y, x -> x.end)) + 1))"
    text = _let("y", by_start, _let("e", ends, _let("p", f"named_struct('h', {heads}, 'b', {_block_size('y')})", whole)))
    return labelled.withColumn("text", F.expr(f"case when size(all_spans) = 0 then text else {text} end")).drop("base_spans", "all_spans")
