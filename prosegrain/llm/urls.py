"""URL filters by an index of rules over their rarest token.

A rule is a pattern over a url from its host up to its fragment, in lower case: ``*`` stands for anything, ``^`` for one separator
(neither letter nor digit) or an end, ``||`` at the start for the start of the host or of one of its parent domains. Runs
of letters and digits between separators are its tokens. Spark counts the rules' tokens over all urls, each rule is
filed under its rarest one, and a url's tokens fetch the rules to try; only those run their regular expression.
A rule without a whole token runs on urls that hold its longest literal.

Host rules (``example.com/en/``) decide first, the longest that fits winning, equal lengths by text; then the general patterns
block. What nothing fits is allowed. Rules are a list that the caller holds, so the index is no larger than that list.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; a null page_id is kept;
repeated rows are judged each; a url of any length is judged whole; an empty table gives no rows; other columns are not read,
in particular not the page itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.llm import common

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile("[0-9a-z]+")

#: Rules of the contract's form: (verdict, host and path).
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# What is blocked beyond the host rules.
ADVERTISING = ("^ad^", "^ads^", "^adserver^", "^adservice^", "^advert*^", "^banner*^", "^doubleclick^", "^popunder^", "^sponsored^", "/click?*url=", "/redirect?*url=", "?*affiliate=", "?*aff_id=")
TRACKING = ("^beacon^", "^pixel.gif", "^tracker^", "^tracking^", "?*clickid=", "?*utm_medium=cpc", "?*utm_campaign=*utm_term=")
ADULT = ("^adult^", "^escort*^", "^porn*^", "^sex-*^", "^webcam*girls^", "^xxx^")
GAMBLING = ("^bets^", "^casino^", "^jackpot^", "^online-*poker^", "^poker-*^", "^slots^", "^sportsbook*^")
DRUGS = ("^cheap-*meds^", "^cialis^", "^pills^", "^viagra^")
FRAUD = ("^crack*download^", "^hacked^", "^keygen^", "^login-*verify^", "^phish*^", "^spam^", "^warez^", "/wp-login.php", ".exe^")
TRAPS = ("/calendar/*/calendar/", "/cgi-bin/*.pl?", "/checkout^", "^jsessionid^", "?*sessionid=", "?*sort=*&sort=")
PATTERNS = ADVERTISING + TRACKING + ADULT + GAMBLING + DRUGS + FRAUD + TRAPS


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # as the result shows it
    pattern: str
    named: bool = False  # a host rule

    def regex(self) -> str:
        body = self.pattern.removeprefix("||")
        parts = {"*": ".*", "^": "(?:[^0-9a-z]|^|$)"}
        return ("^(?:[^/]*[.])?" if body != self.pattern else "") + "".join(parts.get(c, re.escape(c)) for c in body)

    def tokens(self) -> list[str]:
        """Runs of letters and digits that stand whole in every url that the rule fits."""
        edged = ("." if self.pattern.startswith("||") else "*") + self.pattern.removeprefix("||").translate(_LOWER) + "*"
        return re.findall(r"(?<=[^0-9a-z*])[0-9a-z]+(?=[^0-9a-z*])", edged)


    def literal(self) -> str:
        """The longest run without a sign of the pattern language; it stands in every url that the rule fits."""
        return max(re.split("[*^]", self.pattern.removeprefix("||").translate(_LOWER)), key=len)


def rules(hosts: Sequence[tuple[str, str]] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> list[Rule]:
    return [Rule(v, t, f"||{t}", True) for v, t in hosts] + [Rule("block", p, p) for p in patterns]


def rarest(pages: DataFrame, given: Sequence[Rule]) -> dict[str, list[Rule]]:
    """The rules by their rarest token over all urls; those without one under the empty string."""
    wanted = sorted({t for r in given for t in r.tokens()})
    spark = pages.sparkSession
    token = F.explode(F.split(F.lower(F.coalesce("url", F.lit(""))), "[^0-9a-z]+")).alias("token")
    known = spark.createDataFrame([(t,) for t in wanted], "token string")  # no longer than the list in hand
    counts = dict(map(tuple, pages.select(token).join(F.broadcast(known), "token").groupBy("token").count().collect())) if wanted else {}
    index: dict[str, list[Rule]] = {}
    for r in given:
        index.setdefault(min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and query."""
    at = (url or "").find("://")
    if at < 0:
        return "", "", ""
    m = re.match(r"([^/?#]*)([^?#]*)([^#]*)", url[at + 3 :])
    return m[1].translate(_LOWER), m[2], m[3]


def _judged(batches: Iterator[pa.RecordBatch], index: dict[str, list[Rule]]) -> Iterator[pa.RecordBatch]:
    compiled = {t: [(re.compile(r.regex(), re.S), r) for r in rs] for t, rs in index.items()}
    for batch in batches:
        out = []
        for url in batch.column(1).to_pylist():
            host, path, query = parts(url)
            plain, low = host + path, host + (path + query).translate(_LOWER)
            best = None
            found = [x for token in set(_TOKEN.findall(low)) for x in compiled.get(token, ())]
            for among, tried in ((compiled.get("", ()), True), (found, False)):
                for regex, r in among:
                    if tried and r.literal() not in low:
                        continue
                    if regex.search(plain if r.named else low) and (best is None or (not r.named, -len(r.text), r.text) < (not best.named, -len(best.text), best.text)):
                        best = r
            out.append((host, path, best.text if best and best.named else None, best.verdict if best else "allow"))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def judge(pages: DataFrame, given: Sequence[Rule]) -> DataFrame:
    """One row per page: its host, path, the host rule that decided, and the verdict."""
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"])
    index = rarest(pages, given)
    return pages.mapInArrow(lambda b: _judged(b, index), SCHEMA)


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages", "page_id", "url"), rules())


OP2_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path, translate(regexp_extract(rest, '^[^#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM b
), rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
d AS (
  SELECT *, (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN (SELECT min(verdict) FROM rules WHERE h || p = rule)
  WHEN regexp_matches(low, '(^|[^0-9a-z])(ads?|adserver|adservice|advert.*|banner.*|doubleclick|popunder|sponsored|beacon|tracker|tracking)([^0-9a-z]|$)', 's')
    OR regexp_matches(low, '(^|[^0-9a-z])(adult|escort.*|porn.*|sex-.*|webcam.*girls|xxx|bets|casino|jackpot|online-.*poker|poker-.*|slots|sportsbook.*)([^0-9a-z]|$)', 's')
    OR regexp_matches(low, '(^|[^0-9a-z])(cheap-.*meds|cialis|pills|viagra|crack.*download|hacked|keygen|login-.*verify|phish.*|spam|warez|jsessionid)([^0-9a-z]|$)', 's')
    OR regexp_matches(low, '(^|[^0-9a-z])pixel[.]gif|/(click|redirect)[?].*url=|[?].*(affiliate|aff_id|clickid|sessionid)=|[?].*utm_medium=cpc|[?].*utm_campaign=.*utm_term=', 's')
    OR regexp_matches(low, '/wp-login[.]php|[.]exe([^0-9a-z]|$)|/calendar/.*/calendar/|/cgi-bin/.*[.]pl[?]|/checkout([^0-9a-z]|$)|[?].*sort=.*&sort=', 's')
  THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
