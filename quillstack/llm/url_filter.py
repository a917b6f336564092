"""URL filter: host and path rules first, a weighted vocabulary for the rest.

Every url is scanned once by an Aho-Corasick automaton over all terms.  A hit counts only
between boundaries (neither neighbour is a letter or digit of ASCII), each different term once.  A term has a weight: a
strict one weighs ``LIMIT`` and rejects the url alone, soft ones weigh less and reject it when several
different ones add up to ``LIMIT``.  A longer-matching rule outranks the vocabulary.  The vocabulary may be a list or a table (term, weight),
whose terms are lower-cased; a table must have ``MOST_TERMS`` terms at most, since every task holds the automaton.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule
and is scanned as it is (null: as empty, so allowed).  Repeated rows are judged
each.  An empty table gives an empty result.  Null or empty terms and null weights are left out; of a repeated term the largest weight holds.  Columns other than
the id and the url are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LIMIT, MOST_TERMS = 2, 1_000_000
#: Terms that reject a url alone.
STRICT = (
    "adultfriend camgirl camgirls camsex casino cialis cracks escort escorts fetish hentai hookup jackpot keygen keygens levitra malware milf nude nudes nulled onlyfans "
    "phishing poker porn porno pornos pron roulette serialz sexcam sexcams shemale slots spam sportsbook steroids tramadol viagra warez webcamsex xanax xnxx xvideos xxx"
).split()
#: Terms that reject a url when several different ones occur.
SOFT = (
    "ad ads adult affiliate amateur auction bargain bet bets betting bingo bitcoin bonus buy cam cams cash cheap cheats clearance click clickbait coupon coupons crack cracked credit crypto "
    "dating deal deals diet discount discounts download downloads earn fake farm fast forex free freebie gamble gambling gambler gift giveaway hack hacks hot hottest income investor "
    "keto lingerie loan loans lottery lotto mature money mp3 offer offers payday pharmacy pill pills prize profit promo promos replica rich seo sex sexy singles sweepstakes torrent "
    "torrents trial unlimited wager weightloss win"
).split()
VOCABULARY = (*((term, LIMIT) for term in STRICT), *((term, 1) for term in SOFT))

_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_for(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits."""
    fits = [(len(h + p), verdict, h + p) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


@lru_cache(maxsize=8)
def automaton(vocabulary: tuple[tuple[str, int], ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term, weight in vocabulary:
        made.add_word(term, (term, weight))
    if vocabulary:
        made.make_automaton()
    return made


def term_hits(url: str, vocabulary: tuple[tuple[str, int], ...]) -> dict[str, int]:
    """Weights of the different terms that stand between boundaries."""
    text = url.translate(_UPPER)
    inside = lambda c: c.isascii() and c.isalnum()
    found = {}
    for end, (term, weight) in automaton(vocabulary).iter(text) if vocabulary and text else ():
        start = end - len(term)
        if (start < 0 or not inside(text[start])) and (end + 1 == len(text) or not inside(text[end + 1])):
            found[term] = weight
    return found


def terms_of(vocabulary: DataFrame | Iterable[tuple[str, int]]) -> tuple[tuple[str, int], ...]:
    """Lower-cased terms with their largest weights, in order."""
    if isinstance(vocabulary, DataFrame):
        rows = vocabulary.select("term", F.col("weight").cast("int").alias("weight")).limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
        vocabulary = ((x.term, x.weight) for x in rows)
    best: dict[str, int] = {}
    for term, weight in vocabulary:
        if term and weight is not None:
            low = term.translate(_UPPER)
            best[low] = max(weight, best.get(low, weight))
    return tuple(sorted(best.items()))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: tuple = RULES, vocabulary: DataFrame | Iterable[tuple[str, int]] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits, weight), one row per input row; a narrow job."""
    terms = df.sparkSession.sparkContext.broadcast(terms_of(vocabulary))  # MOST_TERMS at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                found, ruled = term_hits(url or "", known), rule_for(host, path, rules)
                weight, n_strict = sum(found.values()), sum(w >= limit for w in found.values())
                verdict = ruled[0] if ruled else "block" if weight >= limit else "allow"
                rows.append((host, path, ruled[1] if ruled else None, verdict, n_strict, len(found) - n_strict, weight))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(url_col).cast("string").alias("url")).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight int")


def oracle_sql() -> str:
    """The same verdicts over ``pages`` as SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    count = lambda terms: " + ".join(f"CAST(regexp_matches(t, '(^|[^a-z0-9]){x}([^a-z0-9]|$)') AS INTEGER)" for x in terms)
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
    WITH cut AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS t,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, t, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
    hits AS (SELECT *, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM parts)
    SELECT page_id, host, path, CASE {rule} END AS rule,
        CASE {ruled} WHEN {LIMIT} * strict_hits + soft_hits >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
        CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits,
        CAST({LIMIT} * strict_hits + soft_hits AS INTEGER) AS weight FROM hits"""
