"""URL filter by rules that are indexed by their rarest literal token (operator 2).

Host rules (host, path) fit a host and its subdomains where the url's path
starts with the rule's; the longest wins. Pattern rules are regular expressions
with literal tokens. Both go into one index: each rule under that of its literal
tokens that the fewest urls hold, by a count over all urls. A url's tokens fetch
candidate rules; only those are compared or run as regular expressions.

Pattern rules say which hosts, paths and query keys crawlers should leave alone:
ad servers, traps of calendars, tags and facets, log-in and session pages, spam.
Their literal tokens are whole tokens of every url that they match (the patterns
say so with their borders), so the index loses no match. A host
rule's tokens come from its host: a fitting url's host ends with those labels. A
path prefix may end inside a token, so a rule's path gives no token of its own.

Verdict: the longest host rule's, else block where a pattern rule matches, else
allow. A null url or one without ``://`` has empty host and path, no rule, and
verdict allow; repeated rows give repeated rows; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyplan.llm.common import per_text, raw_texts, slices

#: (verdict, host, path). Fixed values.
HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Words that stand alone, or between hyphens, in a label of a blocked host. Fixed values.
HOST_WORDS = ["casino", "escort", "gambling", "keygen", "malware", "payday", "phishing", "poker", "porn", "torrent", "viagra", "warez", "xxx"]
#: (name, pattern, literal tokens). A pattern runs over what follows the first ``://`` up to ``#``, in lower case, and one
#: ``#`` as its end. A literal token is bordered by something else than letters and digits wherever the pattern matches.
PATTERN_RULES = [(f"host-{w}", rf"^(?:[^/?#]*[.-])?{w}(?:-[^./?#]*)?[./?#]", [w]) for w in HOST_WORDS] + [
    ("ad-server", r"^(?:[^/?#]*\.)?(?:[a-z0-9]+-)?adserver\.", ["adserver"]),
    ("add-to-cart", r"[?&]add-to-cart=[0-9]+[&#]", ["add", "to", "cart"]),
    ("calendar-trap", r"/calendar/[0-9]{4}/[0-9]{1,2}[/?#]", ["calendar"]),
    ("cheap-drugs", r"^(?:[^/?#]*\.)?cheap-(?:pills|meds|drugs)\.", ["cheap"]),
    ("comment-reply", r"[?&]replytocom=[0-9]+[&#]", ["replytocom"]),
    ("deep-tag-page", r"/tag/[^/?#]+/page/[0-9]{2,}[/?#]", ["tag", "page"]),
    ("executable", r"/[^/?#]+\.exe[?#]", ["exe"]),
    ("faceted-list", r"[?&]sort=[^&#]*&(?:[^#]*&)?order=", ["sort", "order"]),
    ("free-money", r"/(?:[^/?#]*-)?free-(?:money|cash|gift)[-/?#]", ["free"]),
    ("login-bait", r"^(?:[^/?#]*\.)?secure-(?:login|account)[.-]", ["secure"]),
    ("print-version", r"/print/?[?#]", ["print"]),
    ("script-folder", r"/cgi-bin/", ["cgi", "bin"]),
    ("session-id", r"[?&;]phpsessid=[0-9a-z]{8,}[&#]", ["phpsessid"]),
    ("spam-farm", r"^(?:[^/?#]*\.)?spam-farm\.", ["spam", "farm"]),
    ("wordpress-login", r"/wp-login\.php[?#]", ["wp", "login", "php"]),
]

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile(r"[a-z0-9]+")
HOST_END, PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def host_and_path(url: str) -> tuple[str, str]:
    """Host in lower case, and path, of a url; both empty without ``://``."""
    _, sign, rest = url.partition("://")
    if not sign:
        return "", ""
    end = HOST_END.search(rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    end = PATH_END.search(rest)
    return host.translate(LOWER), rest[: end.start()] if end else rest


def matched_part(url: str) -> str:
    """What patterns run over; empty without ``://``."""
    _, sign, rest = url.partition("://")
    return rest.partition("#")[0].translate(LOWER) + "#" if sign else ""


def tokens(part: str) -> set[str]:
    return set(TOKEN.findall(part))


def literal_tokens() -> list[list[str]]:
    """Of the host rules, then of the pattern rules."""
    return [TOKEN.findall(host) for _, host, _ in HOST_RULES] + [own for _, _, own in PATTERN_RULES]


class Index:
    """Rare token -> rules."""

    def __init__(self, held: dict[str, int]):
        self.host_rules, self.pattern_rules = defaultdict(list), defaultdict(list)
        compiled = [*HOST_RULES, *((name, re.compile(p)) for name, p, _ in PATTERN_RULES)]
        for rule, own in zip(compiled, literal_tokens(), strict=True):
            rarest = min(own, key=lambda t: (held.get(t, 0), t))
            (self.host_rules if len(rule) == 3 else self.pattern_rules)[rarest].append(rule)

    def judge(self, host: str, path: str, part: str) -> tuple[str | None, str, str | None]:
        """Rule, verdict, name of the pattern rule that matched (the first of several)."""
        best: tuple[int, str, str] | None = None
        name = None
        for token in tokens(part):
            for verdict, suffix, prefix in self.host_rules.get(token, ()):
                if (host == suffix or host.endswith(f".{suffix}")) and path.startswith(prefix):
                    best = max(best or (0, "", ""), (len(suffix + prefix), suffix + prefix, verdict))
            for rule, pattern in self.pattern_rules.get(token, ()):
                if (name is None or rule < name) and pattern.search(part):
                    name = rule
        if best:
            return best[1], best[2], name
        return None, "block" if name else "allow", name


def token_counts(pages: DataFrame, url: str = "url") -> dict[str, int]:
    """In how many urls each rule token occurs; as long as the rules' tokens."""
    known = {t for own in literal_tokens() for t in own}

    def run(batches):
        held = Counter()
        for batch in slices(batches, 4096):
            for x in raw_texts(batch.column(0)):
                held.update(known & tokens(matched_part(x.decode("utf-8", "replace"))))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "held"])

    rows = pages.select(url).mapInArrow(run, "token string, held long").groupBy("token").agg(F.sum("held").alias("held")).collect()
    return {r.token: r.held for r in rows}


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, pattern of every url."""
    held = token_counts(pages, url)

    def row():
        index = Index(held)

        def of(raw: bytes) -> tuple:
            url = raw.decode("utf-8", "replace")
            host, path = host_and_path(url)
            return host, path, *index.judge(host, path, matched_part(url))

        return of

    return per_text(pages, key, url, "host string, path string, rule string, verdict string, pattern string", row)


def oracle() -> str:
    """DuckDB SQL for the same rows."""
    fits = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
        for _, host, path in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{host}{path}' THEN '{verdict}'" for verdict, host, path in HOST_RULES)
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    named = " ".join(f"WHEN regexp_matches(part, '{p}') THEN '{name}'" for name, p, _ in sorted(PATTERN_RULES))
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         contains(url, '://') AS named FROM pages
), cuts AS (
  SELECT page_id, CASE WHEN named THEN translate(regexp_extract(rest, '^[^#]*'), {low}) || '#' ELSE '' END AS part, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE {fits} END AS rule, CASE {named} END AS pattern FROM cuts
)
SELECT page_id, host, path, rule,
       COALESCE(CASE rule {verdicts} END, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
FROM ruled"""
