"""Text as columns: normalisers, tokens and whole-phrase tests.

Letters are folded by a translation table made from Unicode's decompositions and
case folding, so this stays in generated code; plain ASCII is only put into
lower case. Characters that become several go through a map, in the rows that
have any, Hangul syllables through arithmetic. norm_exact() is the Arrow path by
Unicode's own functions, with the same results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import fixed_values as V


def _base(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _table() -> tuple[str, str, dict[str, str]]:
    """(characters that become one other or none, what they become, characters
    that become several), from those that F.lower alone leaves wrong."""
    one, none, several = {}, [], {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20))):  # no Hangul syllables, no surrogates
        to = _base(c).casefold()
        if to != c.lower():
            if len(to) == 1:
                one[c] = to
            elif to:
                several[c] = to
            else:
                none.append(c)
    return "".join(one) + "".join(none), "".join(one.values()), several


_FROM, _TO, _SEVERAL = _table()
#: The usual ones of these are replaced at once.
_USUAL = {c: _SEVERAL.pop(c) for c in "ß…"}


#: Syllables are in order of their leading consonant, vowel and, of 28, none or
#: a trailing consonant.
HANGUL, HANGUL_END, VOWELS, TRAILING = 0xAC00, 0xD7A4, 21, 28
_LEADS, _VOWELS, _TRAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, VOWELS), (0x11A8, TRAILING - 1)))


def _jamo(x: Column) -> Column:
    """A Hangul syllable's letters."""
    n = F.ascii(x) - HANGUL
    of = lambda letters, i: F.substr(F.lit(letters), i, F.lit(1))
    last = F.pmod(n, F.lit(TRAILING))
    whole = lambda a, b: F.floor(a / b).cast("int")
    lead, vowel = whole(n, VOWELS * TRAILING), F.pmod(whole(n, TRAILING), F.lit(VOWELS))
    return F.concat(of(_LEADS, lead + 1), of(_VOWELS, vowel + 1), F.when(last > 0, of(_TRAILS, last)).otherwise(""))


def _plain() -> str:
    """The long runs of characters of which none becomes several, for a regular
    expression, the usual ones first."""
    edges = [-1, *sorted([*map(ord, _SEVERAL), *range(HANGUL, HANGUL_END)]), 0x110000]
    runs = [(a + 1, b - 1) for a, b in zip(edges, edges[1:], strict=False) if b - a > (8 if b <= 0x2070 else 500)]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


#: Rows with any other character are looked at one by one.
_MAY_BE_SEVERAL = f"[^{_plain()}]"


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def folded(c: Column | str) -> Column:
    """Lower case without accents."""
    v = text(c)
    several = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")  # a constant once planned
    plain = F.when(v.rlike(_MAY_BE_SEVERAL), F.array_join(F.transform(F.split(v, ""), lambda x: F.when(F.ascii(x).between(HANGUL, HANGUL_END - 1), _jamo(x)).otherwise(F.coalesce(F.try_element_at(several, x), x))), "")).otherwise(v)
    for one, to in _USUAL.items():
        plain = F.replace(plain, F.lit(one), F.lit(to))
    return F.when(F.octet_length(v) == F.length(v), F.lower(v)).otherwise(F.lower(F.translate(plain, _FROM, _TO)))


def norm(c: Column | str) -> Column:
    """Words of letters, digits, + and #, one space between them."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}+#]+", " "))


@F.pandas_udf(T.StringType())
def _norm_exact(values: pd.Series) -> pd.Series:
    import regex

    other = regex.compile(r"[^\p{L}\p{N}+#]+")
    return values.map(lambda v: other.sub(" ", _base(v or "").casefold()).strip())


def norm_exact(c: Column | str) -> Column:
    ship()
    return _norm_exact(c)


def classifiability_norm(c: Column | str) -> Column:
    """Folded, with its punctuation."""
    return clean(F.replace(folded(c), F.lit("’"), F.lit("'")))


def audit_norm(c: Column | str) -> Column:
    """As the audits compare: + and # are no part of words, _ is."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}_]+", " "))


def clean(c: Column | str) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def tokens(normalised: Column) -> Column:
    """The words that count, in order."""
    return F.filter(F.split(normalised, " "), lambda t: (F.length(t) > 1) & ~t.isin(*V.STOPWORDS))


def has_phrase(value: Column, phrase: Column | str) -> Column:
    """Whether a normalised value has a normalised phrase as whole words."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (value != "") & (phrase != "") & F.contains(pad(value), pad(phrase))


def has_any_phrase(value: Column, phrases: Sequence[str]) -> Column:
    """Whether a normalised value has one of these (plain) phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(value, norm_text(p))
    return out


def norm_text(value: str | None) -> str:
    """norm() of a value at hand."""
    kept = "".join(c if c in "+#" or unicodedata.category(c)[0] in "LN" else " " for c in _base(value or "").casefold())
    return " ".join(kept.split())


def token_list(value: str | None) -> list[str]:
    return [t for t in norm_text(value).split() if len(t) > 1 and t not in V.STOPWORDS]


def development_track(normalised: Column) -> Column:
    out = F.lit(False)
    for track in V.DEVELOPMENT_TRACKS:
        out = out | F.contains(normalised, F.lit(track))
    return out


def once(value: Column) -> Column:
    """value, as a column that the optimizer neither copies into filters nor
    moves: what is costly is worked out once a row. The condition always holds,
    which the optimizer doesn't know."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def if_any(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


_EDGES = " -–:()[]"


_SCALE = r"(?iU)^(.*?\b(?:echelle|échelle)\s*\d+)\b.*$"
_EMPLOYER = rf"(?iU)\s+(?:{'|'.join(V.EMPLOYER_WORDS)})\b.*$"
#: Java names a group without the P.
_ROLES = [f"(?iU){p.replace('(?P<', '(?<')}" for p in V.LISTING_ROLES]


def with_listing_role(df: DataFrame, title: str, out: str) -> DataFrame:
    """df with the advertised role in a listing's title, "" if there is none: up
    to its pay scale, or else up to its employer. Each step is a column, so it is
    worked out once."""
    steps = [f"{out}_{x}" for x in ("whole", "plain", "a0", "a1", "b0", "b1", "n0", "n1")]
    whole, plain, *rest = steps
    df = df.withColumn(whole, clean(title))
    hits = {rest[i]: clean(F.btrim(F.regexp_extract(whole, p, 1), F.lit(_EDGES))) for i, p in enumerate(_ROLES)}
    df = df.withColumns(hits | {plain: norm(whole)})
    scaled = {rest[2 + i]: F.regexp_extract(rest[i], _SCALE, 1) for i in (0, 1)}
    df = df.withColumns(scaled)
    roles = {rest[i]: F.btrim(F.when(F.col(rest[2 + i]) != "", F.col(rest[2 + i])).otherwise(F.regexp_replace(rest[i], _EMPLOYER, "")), F.lit(_EDGES)) for i in (0, 1)}
    df = df.withColumns(roles)
    df = df.withColumns({rest[4 + i]: norm(rest[i]) for i in (0, 1)})
    found = [F.when((F.col(rest[4 + i]) != "") & (F.col(rest[4 + i]) != F.col(plain)), F.col(rest[i])) for i in (0, 1)]
    return df.withColumn(out, F.coalesce(*found, F.lit(""))).drop(*steps)
