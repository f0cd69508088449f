"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host with its subdomains and the start of a path, or is a pattern over
host + path in the usual syntax of filter lists; either way it has the literal tokens
that any matching address must hold. The index files a rule under the one of its tokens
that is rarest in the addresses at hand; an address fetches only the rules filed under
its own tokens, and only those are tried: host rules by comparison, patterns by their
regular expression. Everything is a DataFrame operation: no Python runs on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host rules as (verdict, host, path): the longest that fits wins.
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Whole tokens of host or path that mark addresses of no use for training.
BLOCKED_TOKENS = ["doubleclick", "adserver", "adservice", "casino", "porn", "xxx", "torrent", "malware", "phishing"]

#: Up to so many rules the index is broadcast; beyond, it is joined by token in a shuffle.
BROADCAST_RULES = 200_000
Rule = tuple[str, str, str | None, str | None, str | None, int, list[str]]
#: Up to so many rules stand in the plan itself.
LITERAL_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def tokens_of(text: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def _closed_tokens(literal: str, open_start: bool, open_end: bool) -> list[str]:
    """The tokens that a literal holds whole, whatever the address has before (``open_start``) and after it."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z0-9]+", literal.translate(_FOLD))]
    return sorted({t for start, end, t in found if not (open_start and start == 0) and not (open_end and end == len(literal))})


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and the start of a path: (rule, verdict, host, path, pattern, length, tokens)."""
    literal = host.translate(_FOLD) + path
    return literal, verdict, host.translate(_FOLD), path, None, len(literal), _closed_tokens(literal, False, bool(path))


def token_rule(verdict: str, token: str) -> Rule:
    """A rule for any address that holds ``token`` as a whole token; host rules come before it."""
    return f"*{token}*", verdict, None, None, f"(?i)(?:^|[^a-z0-9]){_quoted(token.lower())}(?:[^a-z0-9]|$)", 0, [token.lower()]


def list_rule(line: str) -> Rule | None:
    """A line of a filter list; None for comments and for what isn't about addresses.

    ``||host`` starts at a host or one of its subdomains, ``|`` is the start or end of
    host + path, ``*`` anything, ``^`` a separator - neither letter, digit nor one of
    ``_-.%`` - or the end. ``@@`` makes an exception (allow). Options after ``$`` must
    be absent; case doesn't matter.
    """
    line = line.strip()
    if not line or line[0] in "![" or "##" in line or "#@#" in line or "$" in line:
        return None
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    start = r"^(?:[^/]*\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
    end = "$" if body.endswith("|") and body.strip("|") else ""
    text = body.strip("|")
    pieces = re.split(r"([*^])", text)
    pattern = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(x, _quoted(x)) for x in pieces)
    tokens: set[str] = set()
    for i in range(0, len(pieces), 2):
        before, after = pieces[i - 1] if i else "", pieces[i + 1] if i + 1 < len(pieces) else ""
        tokens |= set(_closed_tokens(pieces[i], before == "*" or not before and not start, after == "*" or not after and not end))
    return line, verdict, None, None, f"(?i){start}{pattern}{end}", 0, sorted(tokens)


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_ -])", r"\\\1", literal)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table (rule, verdict, host, path, pattern, length, tokens).

    A rule fits its ``host`` and its subdomains if the address's path starts with
    ``path``, or (host null) the addresses whose host + path ``pattern`` finds.
    ``length`` ranks rules that fit, the longest first; every address that matches
    holds all of ``tokens`` (none: the rule is tried on every address).
    """
    schema = "rule string, verdict string, host string, path string, pattern string, length int, tokens array<string>"
    names = [field.split()[0] for field in schema.split(", ")]
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(names[:-1], r)], F.array(*map(F.lit, r[-1])).cast("array<string>").alias("tokens")) for r in rules]
    if len(rows) > LITERAL_RULES:
        return spark.createDataFrame(list(rules), schema)
    table = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(*[F.lit(None).alias(c) for c in names])
    return table.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_table(spark, [*(host_rule(*r) for r in HOST_RULES), *(token_rule("block", t) for t in BLOCKED_TOKENS)])


def _small(table: DataFrame, broadcast: bool) -> DataFrame:
    return F.broadcast(table) if broadcast else table


def index_rules(rules: DataFrame, addresses: DataFrame, broadcast: bool = True) -> DataFrame:
    """``rules`` with the token that each is filed under: that of its tokens that is rarest in ``addresses`` (host_path).

    Only tokens that rules hold are counted; ties go to the smaller token. A rule
    without tokens is filed under the empty token, which every address has.
    """
    filed = rules.withColumn("token", F.explode_outer("tokens")).drop("tokens").withColumn("token", F.coalesce("token", F.lit("")))
    wanted = _small(filed.select("token").distinct(), broadcast)
    seen = addresses.select(F.explode(tokens_of(F.col("host_path"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    ranked = filed.join(_small(seen, broadcast), "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    best = ranked.groupBy("rule", "verdict", "host", "path", "pattern", "length").agg(F.min(F.struct("seen", "token")).alias("best"))
    return best.select(F.col("best.token").alias("token"), "rule", "verdict", "host", "path", "pattern", "length")


def filter_urls(df: DataFrame, rules: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge the address in every row: the input's columns, then host, path, rule, verdict.

    ``rule`` and ``verdict`` are the longest host rule's that fits; a fitting pattern
    of length 0 gives a verdict but no rule name, and ``default`` holds where nothing
    fits. Rules of equal length: ``allow`` before ``block`` for patterns, which makes
    exceptions work, ``block`` before ``allow`` for hosts, then the larger name.

    Null addresses, and those without ``://``, have empty host and path and so the
    default verdict. Repeated rows come back as often as they came. Columns named
    like the four added ones are replaced. Pass only the columns to be carried
    through: rows are grouped by all of them, copies collapse before the shuffle, so
    a third of rows with one address is one row a task. Up to ``BROADCAST_RULES``
    rules (counted) the index is broadcast; more are joined by token.
    """
    spark = df.sparkSession
    rules = default_rules(spark) if rules is None else rules
    broadcast = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    carried = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    found = df.select(F.struct(*carried).alias("__row"), host_of(df[url]).alias("__host"), path_of(df[url]).alias("__path"))
    addresses = found.select(F.concat("__host", "__path").alias("host_path"))
    # the first rule fits every address and is the least of all
    none = spark.range(1).select(F.lit("").alias("token"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "pattern")], F.lit(-1).alias("length"))
    index = index_rules(rules, addresses, broadcast).unionByName(none).withColumnRenamed("token", "__token")
    address = F.concat("__host", "__path")
    candidates = found.withColumn("__token", F.explode(F.concat(F.array(F.lit("")), tokens_of(address)))).join(_small(index, broadcast), "__token")
    on_host = ((F.col("__host") == F.col("host")) | F.endswith(F.col("__host"), F.concat(F.lit("."), "host"))) & F.startswith(F.col("__path"), F.col("path"))
    fits = candidates.where(F.when(F.col("length") < 0, True).when(F.col("host").isNotNull(), on_host).otherwise(F.expr("regexp_like(concat(__host, __path), pattern)")))
    before = F.when(F.col("length") > 0, F.col("verdict") == "block").otherwise(F.col("verdict") == "allow")
    judged = fits.groupBy("__row", "__host", "__path").agg(
        F.max(F.struct("length", before.alias("before"), F.when(F.col("length") > 0, F.col("rule")).alias("rule"), "verdict")).alias("best"),
        F.sum((F.col("length") < 0).cast("int")).alias("copies"),
    )
    judged = judged.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return judged.select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
