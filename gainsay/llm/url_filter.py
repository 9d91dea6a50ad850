"""URL filters: host and path rules, and listed URLs found by a blocked Bloom filter and an exact join.

The filter is a table of blocks of eight 32-bit words, filled by one aggregate over the list.  A URL looks at one block.
Only possible hits go on to the join with the list, which removes false positives, so most URLs are never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import quoted

#: Bits of the filter per listed URL (about 0.5 % false positives), and the largest filter that is broadcast.
BITS_PER_URL, BROADCAST_BYTES = 12, 32 << 20
WORDS, WORD_BITS = 8, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def canonical(url: Column) -> Column:
    """Host without "www." and path without a closing slash; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Host and path of the longest rule (verdict, host, path) that fits, or null; the earlier of equally long ones."""
    out = F.lit(None).cast("string")
    for _, rule_host, rule_path in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, rule_host + rule_path).otherwise(out)
    return out


def masks(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    return [F.call_function("shiftleft", F.lit(1), F.pmod(F.xxhash64(key, F.lit(w)), F.lit(WORD_BITS)).cast("int")) for w in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``block`` and the words ``w0`` to ``w7`` of the filter over ``listed.key``; blocks without keys are left out."""
    placed = listed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks(F.col("key")))])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judged(urls: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", id_cols: Sequence[str] = ("page_id",)) -> DataFrame:
    """``id_cols``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``urls``.

    ``rules`` is a short list of (verdict, host, path); ``listed`` has a column ``key`` of canonical URLs to block.  Where no
    rule fits, a listed URL is blocked and any other allowed.  A null URL, or one without "://", has an empty host and
    path, fits no rule and is allowed.  Nulls and repeated keys in the list are ignored; repeated rows are judged alike.
    """
    keys = listed.select("key").where("key IS NOT NULL AND key <> ''").distinct()
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (WORDS * WORD_BITS)))
    filled = bloom(keys, blocks)
    if blocks * 8 * (WORDS + 2) <= BROADCAST_BYTES:
        filled = F.broadcast(filled)
    url = urls[quoted(url_col)]
    rows = urls.select(*[urls[quoted(c)] for c in id_cols], host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(v) for verdict, host, path in rules for v in (host + path, verdict)]) if rules else None
    ruled = rows.where("rule IS NOT NULL").withColumn("verdict", verdicts[F.col("rule")]) if rules else rows.limit(0).withColumn("verdict", F.lit(""))
    free = rows.where("rule IS NULL").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    tested = free.join(filled, "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    tested = tested.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])
    known = keys.withColumn("listed", F.lit(True))
    exact = tested.where("possible").join(known, "key", "left").withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    clear = tested.where("NOT possible").withColumn("verdict", F.lit("allow"))
    shown = [*id_cols, "host", "path", "rule", "verdict"]
    return ruled.select(*shown).unionByName(exact.select(*shown)).unionByName(clear.select(*shown))
