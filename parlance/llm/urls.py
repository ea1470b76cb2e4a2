"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix; it fits the host, all its subdomains, and
every path that starts with the prefix. The candidate keys of a url are its
host's suffixes at label bounds, each with the prefixes of its path in the
lengths that the rules have. The distinct candidate keys of the whole corpus
are the key universe. For the block rules and for the allow rules a cascade is
built over it: level 0 holds the listed keys, level 1 the universe's keys that
level 0 lets through wrongly, level 2 the listed keys that level 1 holds
wrongly, and so on until a level lets nothing through. Membership of every key
of the universe is then exact, so pages are judged by reading a few bits, with
no join. The longest listed candidate is the rule; a url without one gets the
method's own verdict for keys outside the list, ``allow``.

The levels are bit strings of ``BITS_A_KEY`` bits a key. They are sent with the
plan, so their size is checked: over ``MOST_BITS`` bits is an error, never a
shorter list.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits no rule. Repeated rows stay; a null page_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize

BITS_A_KEY, HASHES = 12, 5
MOST_BITS = 1 << 28
DEFAULT = "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys (host suffix followed by path prefix) by which a rule could fit."""
    labels = F.split(host, "\\.")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(
        suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))
    ))
    return F.when(host != "", keys).otherwise(F.expr("cast(array() as array<string>)"))


def _positions(key: Column, level: int, bits: int) -> Column:
    """Bit numbers of a key at a level, from two hashes."""
    first, second = F.xxhash64(F.lit(level), key), F.xxhash64(key, F.lit(level)).bitwiseOR(F.lit(1))
    # Halves, so that the sums stay inside 64 bits.
    first, second = F.shiftright(first, 8), F.shiftright(second, 8)
    return F.array(*[F.pmod(first + F.lit(i) * second, F.lit(bits)) for i in range(HASHES)])


def _holds(level: int, bits: int, data: bytes, key: Column) -> Column:
    """Whether a level's bit string has all bits of the key."""
    body, masks = F.lit(bytearray(data)), F.array(*[F.lit(1 << i) for i in range(8)])

    def on(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(body, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.get(masks, (p % 8).cast("int")).bitwiseAND(byte) != 0

    return F.forall(_positions(key, level, bits), on)


def _level(keys: DataFrame, level: int, most_bits: int) -> tuple[int, bytes] | None:
    """Bits and bit string of one level; None for no keys."""
    n = keys.count()
    if not n:
        return None
    bits = 64
    while bits < BITS_A_KEY * n:
        bits *= 2
    if bits > most_bits:
        raise ValueError(f"level {level} needs {bits} bits, over the bound of {most_bits}")
    places = keys.select(F.explode(_positions(F.col("key"), level, bits)).alias("p"))
    mask = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("p") % 8).cast("int"))
    packed = places.groupBy((F.col("p") / 8).cast("int").alias("at")).agg(F.bit_or(mask).alias("byte"))
    data = bytearray(bits // 8)
    for row in packed.collect():
        data[row["at"]] = row["byte"]
    return bits, bytes(data)


class Cascade:
    """Exact membership of the universe's keys in the listed ones."""

    def __init__(self, listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS):
        """``listed`` and ``universe``: distinct strings ``key``."""
        self.levels: list[tuple[int, bytes]] = []
        inside = listed.select("key")
        outside = universe.select("key").join(inside, "key", "left_anti")
        while (level := _level(inside, len(self.levels), most_bits)) is not None:
            self.levels.append(level)
            # What the new level lets through of the other side is the next level's set.
            held = _holds(len(self.levels) - 1, *level, F.col("key"))
            inside, outside = materialize(outside.where(held), "cascade"), inside

    def has(self, key: Column) -> Column:
        """Walks the levels: the first one that lacks the key decides by its number's parity."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(_holds(k, *self.levels[k], key), verdict).otherwise(F.lit(k % 2 == 1))
        return verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; ``rules``: (verdict, host, path prefix)."""
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    keys = candidates(F.col("host"), F.col("path"), lengths)
    universe = materialize(rows.select(F.explode(keys).alias("key")).distinct(), "universe")
    longest = lambda test: F.array_max(F.transform(
        F.filter("keys", test), lambda k: F.struct(F.length(k).alias("length"), k.alias("key"))
    ))
    found = {}
    for verdict in ("block", "allow"):
        names = [(h + p,) for v, h, p in rules if v == verdict]
        listed = spark.createDataFrame(names, "key string").distinct()
        found[verdict] = longest(Cascade(listed, universe, most_bits).has)
    rows = rows.withColumn("keys", keys).select(
        "page_id", "host", "path", found["block"].alias("block"), found["allow"].alias("allow")
    )
    block, allow = F.col("block"), F.col("allow")
    wins = block.isNotNull() & (allow.isNull() | (block["length"] > allow["length"]))
    return rows.select(
        "page_id", "host", "path", F.when(wins, block["key"]).otherwise(allow["key"]).alias("rule"),
        F.when(wins, "block").when(allow.isNotNull(), "allow").otherwise(DEFAULT).alias("verdict"),
    )
