"""Personal data by weak-supervision aggregation, in DataFrame expressions only.

Base kinds (email, ip, card, phone) are found by pattern and check; they always
stay. The method looks at more candidates: the base patterns' matches that fail
the check, telephone numbers without a plus, identity numbers and secrets.
Labelers vote on every candidate (1, -1, or 0 for no opinion):

* regex: the form is right and passes the kind's check, or fails it;
* gazetteer: a word for such data, or a word for other numbers, stands shortly before;
* context: the span is set off by blanks or punctuation, or is part of something longer;
* spread: its characters vary as such data do, or repeat;
* assignment: it follows a colon, an equals sign or a quote, or a currency or ordinal sign.

Expectation-maximisation estimates each labeler's reliability (how it votes on
true and on false candidates) from the counts of vote patterns over the whole
corpus; there are at most 3^5 patterns a kind and shape, counted by Spark, and
every step is an aggregate over that small table. The final classifier is then
trained on the posteriors: log-odds of votes, kind and length. A candidate is
added at probability ``ACCEPT``, unless it overlaps a base span.

Positions are code points, the end exclusive. A match is found with its place
by splitting the text at the matches and adding up the lengths of the pieces.

Defined results: a null text is empty and has no spans. Null and repeated ids
stay as they are. Without candidates nothing is learnt and nothing added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import packed
from parlance.session import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "secret")
ROUNDS, ACCEPT = 12, 0.9
BEFORE = 24  # characters before a match that the labelers see

# A run is entered at its start or right after a match, and possessively, so a long run is read once.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOCAL = r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}"

# Words that announce such data, and words that announce other numbers.
_NAMES = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "ip|host|server|address|client|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax|contact|whatsapp",
    "ssn": "ssn|social|security|identity|passport|tax",
    "secret": "token|key|secret|password|passwd|pwd|bearer|credential|auth",
}
_OTHERS = "version|order|invoice|isbn|page|commit|sha1|sha256|md5|checksum|serial|ticket"
_EMPTY = "cast(array() as array<struct<kind:int,start:int,end:int,value:string,valid:boolean,before:string,after:string>>)"
VOTES = ("v_regex", "v_gazetteer", "v_context", "v_spread", "v_assignment")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _check(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column, use: Callable[[Column], Column]) -> Column:
    """Array of ``use(block)`` for blocks of consecutive items, as many items a block as there are blocks."""
    def cut(a: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        starts = F.filter(F.sequence(F.lit(0), wide - 1), lambda i: i * wide < F.size(a))
        return F.transform(starts, lambda i: use(F.slice(a, i * wide + 1, wide)))

    return _let(items, cut)


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``out`` of a fold whose state has an array ``out``.

    Appending copies the array, so a block collects its own and hands it on
    whole: n items cost n^1.5 copies, not n^2.
    """
    empty = F.slice(start["out"], 1, 0)

    def block(acc: Column, part: Column) -> Column:
        first = acc.withField("out", empty)
        return F.aggregate(part, first, step, lambda b: b.withField("out", F.concat(acc["out"], b["out"])))

    return F.aggregate(_blocks(items, lambda part: part), start, block)["out"]


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """kind, start, end, value, valid, before, after of every match of a pattern, from left to right.

    Places and surroundings come from the pieces between the matches, in one
    pass; the text is not entered anew at each match.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(values.alias("v"), pieces.alias("g"))
    # A match is followed by the next piece or, where that is empty, by the next match.
    both = _let(both, lambda a: F.transform(a, lambda x, i: F.struct(
        x["v"].alias("v"), x["g"].alias("g"),
        F.substr(F.concat(F.coalesce(F.get(a, i + 1)["g"], F.lit("")), F.coalesce(F.get(a, i + 1)["v"], F.lit(""))), F.lit(1), F.lit(1)).alias("after"),
    )))
    both = F.filter(both, lambda x: x["v"].isNotNull())
    start = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("tail"),
        F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        before = F.right(F.concat(acc["tail"], x["g"]), F.lit(BEFORE))
        span = F.struct(
            begin.alias("start"), (begin + F.length(x["v"])).alias("end"), x["v"].alias("value"),
            before.alias("before"), x["after"].alias("after"),
        )
        return _let(span, lambda s: F.struct(
            s["end"].alias("at"), F.right(F.concat(s["before"], s["value"]), F.lit(BEFORE)).alias("tail"),
            F.concat(acc["out"], F.array(s)).alias("out"),
        ))

    details = F.transform(_scan(both, start, step), lambda s: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["value"].alias("value"), _check(kind, s["value"]).alias("valid"),
        s["before"].alias("before"), s["after"].alias("after"),
    ))
    return F.when(text.rlike(pattern), details).otherwise(F.expr(_EMPTY))


def _votes(span: Column) -> Column:
    """The span with the labelers' votes and its shape."""
    before, value = F.lower(span["before"]), span["value"]
    named = F.lit(False)
    for k, kind in enumerate(KINDS):
        named = named | ((span["kind"] == k) & before.rlike(rf"(?:^|[^a-z])(?:{_NAMES[kind]})[^a-z]"))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    solid = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    variety = F.size(F.array_distinct(F.split(solid, "")))
    return F.struct(
        span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["valid"].alias("valid"),
        vote(span["valid"], ~span["valid"]).alias("v_regex"),
        vote(named, before.rlike(rf"(?:^|[^a-z])(?:{_OTHERS})[^a-z]")).alias("v_gazetteer"),
        vote(
            before.rlike(r"(?:^|[\s\"'(\[<:=,;|])$") & span["after"].rlike(r"^$|^[^A-Za-z0-9]"),
            before.rlike(r"[a-z0-9_]$") | span["after"].rlike(r"^[A-Za-z0-9_]"),
        ).alias("v_context"),
        vote(variety >= 6, variety <= 3).alias("v_spread"),
        vote(before.rlike(r"[:=]\s*[\"']?$|[\"']$"), before.rlike(r"[$€£#№]\s*$")).alias("v_assignment"),
        F.least(F.floor(F.length(solid) / 8), F.lit(6)).cast("int").alias("shape"),
    )


def candidates(text: Column) -> Column:
    """Array of all candidate spans of a text with their votes; base kinds first, each from left to right."""
    text = F.coalesce(text, F.lit(""))
    found = [
        ("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE),
        ("phone", _LOCAL), ("ssn", _SSN), ("secret", _SECRET),
    ]
    groups = []
    for number, (kind, pattern) in enumerate(found):
        base = F.lit(number < len(BASE))
        # A run of fewer than nine digits is no candidate for a card.
        group = _matches(text, kind, pattern)
        if kind == "card":
            group = F.filter(group, lambda s: F.length(_digits(s["value"])).between(13, 19))
        groups.append(F.transform(group, lambda s: F.struct((base & s["valid"]).alias("base"), _votes(s).alias("s"))))
    return F.flatten(F.array(*groups))


class Reliabilities:
    """What expectation-maximisation and the classifier have learnt; a few numbers."""

    def __init__(self, odds: dict[str, dict[int, float]], prior: float):
        self.odds, self.prior = odds, prior

    def log_odds(self, span: Column) -> Column:
        total = F.lit(self.prior)
        for name, table in self.odds.items():
            value = F.lit(0.0)
            for v, weight in table.items():
                value = F.when(span[name] == v, F.lit(weight)).otherwise(value)
            total = total + value
        return total


def learn(spans: DataFrame) -> Reliabilities | None:
    """Reliabilities from rows ``s`` (candidate spans with votes) of the whole corpus."""
    fields = [*VOTES, "kind", "shape"]
    patterns = spans.groupBy(*[F.col(f"s.{f}").alias(f) for f in fields]).agg(F.count("*").alias("n"))
    patterns = materialize(patterns, "vote-patterns")
    if patterns.isEmpty():
        return None
    # The first posteriors are those of the plain vote.
    belief: Column = 1 / (1 + F.exp(-sum((F.col(v) for v in VOTES), F.lit(0.0))))
    for _ in range(ROUNDS):
        sums = _sums(patterns, belief, {v: (-1, 0, 1) for v in VOTES})
        odds, prior = _odds(sums, {v: (-1, 0, 1) for v in VOTES})
        belief = 1 / (1 + F.exp(-Reliabilities(odds, prior).log_odds(_Row())))
    # The classifier: votes, kind and length, trained on the last posteriors.
    values = {v: (-1, 0, 1) for v in VOTES} | {"kind": range(len(KINDS)), "shape": range(7)}
    return Reliabilities(*_odds(_sums(patterns, belief, values), values))


class _Row:
    """Columns of the pattern table by name, as a span's fields are."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def _sums(patterns: DataFrame, belief: Column, values: dict) -> dict:
    rows = patterns.withColumn("p", belief * F.col("n")).withColumn("q", F.col("n") - F.col("p"))
    parts = [F.sum("p").alias("p"), F.sum("q").alias("q")]
    for name, options in values.items():
        for v in options:
            here = F.col(name) == v
            parts += [F.sum(F.when(here, F.col("p")).otherwise(0.0)).alias(f"p {name} {v}"),
                      F.sum(F.when(here, F.col("q")).otherwise(0.0)).alias(f"q {name} {v}")]
    return rows.agg(*parts).head().asDict()


def _odds(sums: dict, values: dict) -> tuple[dict, float]:
    """Log-odds of every value, and of a candidate as such; one is added to each count."""
    odds = {}
    for name, options in values.items():
        k = len(list(options))
        odds[name] = {
            v: math.log((sums[f"p {name} {v}"] + 1) / (sums["p"] + k)) - math.log((sums[f"q {name} {v}"] + 1) / (sums["q"] + k))
            for v in options
        }
    return odds, math.log((sums["p"] + 1) / (sums["q"] + 1))


def accepted(found: Column, learnt: Reliabilities | None) -> Column:
    """kind, start, end of base spans and added ones, by kind and start.

    Base spans lie in blocks by their start; a candidate is held only against
    the spans of blocks that it reaches.
    """
    span = lambda c: F.struct(c["s"]["kind"].alias("kind"), c["s"]["start"].alias("start"), c["s"]["end"].alias("end"))
    base = F.transform(F.filter(found, lambda c: c["base"]), span)
    if learnt is None:
        return F.array_sort(base)
    cut = math.log(ACCEPT / (1 - ACCEPT))
    places = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    blocks = _blocks(places, lambda part: F.struct(
        F.get(part, F.lit(0))["start"].alias("start"), F.array_max(part["end"]).alias("end"), part.alias("spans")
    ))

    def added(blocks: Column) -> Column:
        meet = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])
        taken = lambda c: F.exists(blocks, lambda k: meet(k, c) & F.exists(k["spans"], lambda b: meet(b, c)))
        sure = lambda c: ~c["base"] & c["s"]["valid"] & (learnt.log_odds(c["s"]) >= cut)
        return F.transform(F.filter(found, lambda c: sure(c) & ~taken(c["s"])), span)

    return F.array_sort(F.concat(base, _let(blocks, added)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = materialize(docs.select("doc_id", candidates(F.col("text")).alias("found")), "candidates")
    learnt = learn(found.select(F.explode("found").alias("c")).select("c.s"))
    base = F.transform(F.filter("found", lambda c: c["base"]), lambda c: F.struct(
        c["s"]["kind"].alias("kind"), c["s"]["start"].alias("start"), c["s"]["end"].alias("end")
    ))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rows = found.select("doc_id", base.alias("base"), accepted(F.col("found"), learnt).alias("all"))
    return rows.select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, if there, counts anew."""
    rows = packed(docs, docs["text"].alias("text")).withColumn("found", candidates(F.col("text")))
    learnt = learn(rows.select(F.explode("found").alias("c")).select("c.s"))
    spans = F.array_sort(F.transform(accepted(F.col("found"), learnt), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
    )))
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(region: Column, begin: Column) -> Callable[[Column, Column], Column]:
        def one(acc: Column, s: Column) -> Column:
            """A span inside the last one is gone with it; one that reaches further adds its own name."""
            tail = F.concat(
                acc["out"], F.substr(region, acc["at"] - begin + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.lit("["), F.get(names, s["kind"]), F.lit("]"),
            )
            fresh = s["end"] > acc["at"]
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, tail).otherwise(acc["out"]).alias("out"))

        return one

    def block(acc: Column, part: Column) -> Column:
        """A block of spans is written from its own region of the text: places in a long text are found by counting."""
        region = F.substr(F.col("text"), acc["at"] + 1, F.greatest(F.array_max(part["end"]) - acc["at"], F.lit(0)))
        first = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))
        return _let(region, lambda r: F.aggregate(
            part, first, step(r, acc["at"]), lambda b: b.withField("out", F.concat(acc["out"], b["out"]))
        ))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1))

    clean = F.when(F.size("spans") > 0, F.aggregate(_blocks(F.col("spans"), lambda part: part), start, block, end)).otherwise(F.col("text"))
    out = rows.withColumn("spans", spans).withColumn("clean", clean)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("clean").alias("text"))
        elif name == "n_chars":
            kept = F.col("_row")[name]
            columns.append(F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[name].dataType)).otherwise(kept).alias(name))
        else:
            columns.append(F.col("_row")[name].alias(name))
    return out.select(*columns)
