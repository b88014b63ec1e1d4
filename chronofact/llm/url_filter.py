"""URL filter: pattern rules found through their rarest literal token.

A rule is a regular expression over a normal form of the URL together with the
literal tokens that any URL it fits must hold whole.  Each rule is filed under
whichever of its tokens is rarest over all URLs of the table; a URL's tokens
fetch the candidate rules, and only those run their expressions.  Rules without
a whole token are candidates for every URL, so none is missed.

Everything is DataFrame functions.  Rules are filed in an array of buckets by a
checksum of their token.  Up to ``INDEX_BYTES`` the array is one constant: the
plan does not grow with the rules, a look-up costs the same however many they
are, and no row is exploded or shuffled.  Beyond that, tokens of URLs are joined
to a table of the rules.
"""

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved

INDEX_BYTES, PART_BYTES = 16 << 20, 1 << 20
FILED = "t string, site boolean, size int, at int, name string, action string, pattern string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is what a match reports; ``site`` rules outrank the others, then
    the longest name wins, then the earlier rule."""

    action: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``.

    The last token of a path that does not end in a separator may go on in the
    URL, so it is no whole token.
    """
    tokens = re.findall("[A-Za-z0-9]+", host)
    inner = re.sub("[A-Za-z0-9]+$", "", path)
    tokens += re.findall("[A-Za-z0-9]+", inner)
    return Rule(action, host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def word_rule(action: str, word: str) -> Rule:
    """Fits URLs in which ``word`` stands between separators."""
    return Rule(action, word, rf"(?:^|[^A-Za-z0-9]){re.escape(word)}(?:[^A-Za-z0-9]|$)", (word,))


# Site rules of the contract.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
# Words of advertising, tracking, gambling and adult addresses.
WORD_RULES = tuple(word_rule("block", w) for w in "ads adserver adservice affiliate banner bannerads bet betting casino clickbait doubleclick escort gambling hentai jackpot lottery malware phishing poker popunder porn porno roulette slots spam telemetry torrent tracker tracking viagra warez webcam xxx xxxvideos".split())


def pattern_rule(action: str, pattern: str) -> Rule:
    """Fits URLs in which ``pattern`` is found.  Its whole tokens are its runs of
    letters and digits that stand between literal separators; a run beside
    anything else may go on in the URL."""
    bare = pattern.replace("(?:[/.]|$)", "/")
    bare = re.sub(r"\[[^\]]*\]|\(\?:[^()]*\)[?*+]?|\{[^}]*\}", "*", bare).replace("\\", "")
    return Rule(action, pattern, pattern, tuple(re.findall(r"(?<=[/._-])[A-Za-z0-9]+(?=[/._$-])", bare)))


# Paths that hold no text of their own: forms, feeds, endless lists, downloads.
PATTERN_RULES = tuple(
    pattern_rule("block", p)
    for p in (
        r"/login(?:[/.]|$)", r"/logout(?:[/.]|$)", r"/signin(?:[/.]|$)", r"/signup(?:[/.]|$)", r"/register(?:[/.]|$)", r"/checkout(?:[/.]|$)", r"/cart(?:[/.]|$)",
        r"/wp-admin(?:[/.]|$)", r"/wp-login\.php$", r"/xmlrpc\.php$", r"/cgi-bin/", r"/phpmyadmin(?:[/.]|$)",
        r"/calendar/[0-9]{4}/[0-9]{1,2}(?:[/.]|$)", r"/tag/[^/]+/page/[0-9]+(?:[/.]|$)", r"/search/page/[0-9]+(?:[/.]|$)", r"/feed/?$", r"/rss\.xml$", r"/atom\.xml$", r"/sitemap[0-9]*\.xml$",
        r"/print/[0-9]+(?:[/.]|$)", r"/share/[^/]+(?:[/.]|$)", r"\.exe$", r"\.apk$", r"\.dmg$", r"\.iso$", r"\.zip$", r"\.mp4$", r"\.jpg$", r"\.png$", r"\.gif$", r"\.css$", r"\.js$",
    )
)
DEFAULT_RULES = SITE_RULES + WORD_RULES + PATTERN_RULES
DEFAULT_ACTION = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.split(address, "[^A-Za-z0-9]+"))


def address_of(url: Column) -> Column:
    return F.concat(host_of(url), path_of(url))


def constant(rows: list, schema: str) -> Column:
    """``rows`` as one array<struct<schema>>, folded to a constant when planned."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def rows_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """``rows`` as a table, from constants of ``PART_BYTES`` or so each."""
    size = max(1, PART_BYTES // max(1, len(json.dumps(rows[:64])) // max(1, len(rows[:64]))))
    out = None
    for at in range(0, max(len(rows), 1), size):
        part = spark.range(1).select(F.inline(constant(rows[at : at + size], schema)))
        out = part if out is None else out.unionByName(part)
    return out


def token_counts(urls: DataFrame, url: str, rules) -> dict[str, int]:
    """How many rows of ``urls`` hold each token of ``rules``; what comes back is
    at most one row a token."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    wanted = rows_of(urls.sparkSession, [{"t": t} for t in names], "t string")
    small = sum(map(len, names)) <= INDEX_BYTES
    found = urls.select(F.explode(_tokens(address_of(F.col(url)))).alias("t")).join(F.broadcast(wanted) if small else wanted, "t")
    return dict.fromkeys(names, 0) | {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}


ANY = "*"  # no token: rules without one are filed under it


def filed(rules, counts: dict[str, int]) -> list[dict]:
    """Each rule with the rarest of its tokens."""
    return [
        {"t": min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else ANY, "site": r.site, "size": len(r.name), "at": -i, "name": r.name, "action": r.action, "pattern": r.pattern}
        for i, r in enumerate(rules)
    ]


def in_buckets(rows: list[dict]) -> list[list[dict]]:
    out = [[] for _ in range(2 * len(rows) + 1)]
    for r in rows:
        out[zlib.crc32(r["t"].encode()) % len(out)].append(r)
    return out


def decision(best: Column, default: str) -> dict[str, Column]:
    return {"rule": F.when(best["site"], best["name"]), "verdict": F.coalesce(best["action"], F.lit(default)), "matched_by": best["name"]}


RANKED = ("site", "size", "at", "name", "action", "pattern")


def match_rules(urls: DataFrame, rules=DEFAULT_RULES, url: str = "url", default: str = DEFAULT_ACTION, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``urls`` with host, path, rule, verdict and matched_by.

    ``rule`` is the winning site rule or null, ``verdict`` its action, else that
    of the winning other rule, else ``default``; ``matched_by`` names whichever
    rule decided.  A null URL, or one without ``://``, has empty host and path
    and gets what rules that fit an empty address say, else ``default``.
    Columns of ``urls`` with these names are replaced.  Repeated rows stay.
    """
    rows = filed(rules, token_counts(urls, url, rules))
    out = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    address = F.concat("host", "path")
    tokens = F.array_append(_tokens(address), F.lit(ANY))
    if len(json.dumps(rows)) > index_bytes:
        return by_join(out, address, tokens, rows, default)
    buckets = in_buckets(rows)
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{FILED}>>>")
    own = lambda t: F.filter(F.get(index, F.crc32(t) % len(buckets)), lambda r: r["t"] == t)
    fitting = F.filter(F.flatten(F.transform(tokens, own)), lambda r: F.rlike(address, r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(*[r[c].alias(c) for c in RANKED])))
    return out.withColumn("__best", best).withColumns(decision(F.col("__best"), default)).drop("__best")


def by_join(out: DataFrame, address: Column, tokens: Column, rows: list[dict], default: str) -> DataFrame:
    """``match_rules`` for rules too many for a constant: what is shuffled is a
    row for each token of a URL, and a row for each URL that a rule fits."""
    out = saved(out.withColumn("__row", F.monotonically_increasing_id()))
    table = saved(rows_of(out.sparkSession, rows, FILED))
    hits = out.select("__row", address.alias("__address"), F.explode(tokens).alias("t")).join(table, "t").where(F.rlike("__address", F.col("pattern")))
    best = hits.groupBy("__row").agg(F.max(F.struct(*RANKED)).alias("__best"))
    return out.join(best, "__row", "left").withColumns(decision(F.col("__best"), default)).drop("__best", "__row")
