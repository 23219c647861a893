"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for search.
STOP_WORDS = ["a", "an", "and", "are", "at", "did", "do", "for", "from", "in", "is", "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "with"]
# Full-text queries leave this out too.
SEARCH_STOP_WORDS = [*STOP_WORDS, "date"]
# A word after one of these may be a name.
ENTITY_CUES = ["for", "about", "did", "does", "with", "from"]
# A word before one of these may be a name.
NAME_FOLLOWERS = ["moved", "move", "owns", "owned", "launch", "launched"]
# Words that are never names.
ENTITY_NOISE = ["city", "date", "owner", "owns", "launch", "public", "project", "beta", "deployment", "readiness", "timeline", "status", "updates", "update", "report", "checklist", "signoff", "team", "health", "allergic"]
# Phrases of texts that only look like answers, for search and for answers.
SEARCH_DISTRACTORS = ["weekly report", "checklist", "signoff", "allergic", "distractor", "draft memo", "tentative", "pending approval"]
ANSWER_DISTRACTORS = ["no authoritative", "weekly report", "checklist", "signoff", "distractor"]
# Phrases of dates that aren't settled.
TENTATIVE = ["tentative", "draft", "proposed", "pending approval", "target is", "target date", "could be", "estimate"]

WORD = r"[\p{L}\p{N}]+"
#: Spaces of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
MAX_SEARCH_TOKENS = 16
MAX_PHRASES = 4


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column, lower: bool = True) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORD), F.lit(0))


def _plain_letters() -> dict[str, str]:
    """Letters with marks (up to U+2FFF) and the letter that canonical decomposition leaves of each."""
    found = {}
    for c in map(chr, range(0x80, 0x3000)):
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(rest) == 1 and rest != c and unicodedata.category(c)[0] == "L":
            found[c] = rest
    return found


_PLAIN = _plain_letters()


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of the first plane with a compatible form: of one character, and longer forms of letters."""
    one, more = {}, {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xE000, 0x10000)]):
        form = unicodedata.normalize("NFKC", c)
        if form != c and len(form) == 1:
            one[c] = form
        elif form != c and unicodedata.category(c)[0] == "L" and form.isascii():
            more[c] = form
    return one, more


_ONE, _MORE = _compatible()


def compatible(text: Column) -> Column:
    """Text with compatible characters (full width, ligatures, ..) in their plain form; longer forms only for letters."""
    out = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    rare = out
    for c, form in _MORE.items():
        rare = F.replace(rare, F.lit(c), F.lit(form))
    return F.when(out.rlike(f"[{''.join(_MORE)}]"), rare).otherwise(out)


def without_marks(text: Column) -> Column:
    """Text without diacritics: letters lose their marks, and marks of their own go.  ASCII (a byte for each character) has none."""
    plain = F.regexp_replace(F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values())), r"\p{M}+", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(plain)


def index_words(text: Column) -> Column:
    """Words as full-text search compares them: lower case, without diacritics."""
    return once(F.lower(text), lambda t: words(without_marks(t), lower=False))


def stem(token: Column) -> Column:
    """Light stemming of a lower-case token: -ies, -ing, -ed, -es, -s, the first that fits."""
    n = F.length(token)

    def without(end: str, longer: int) -> Column:
        return token.endswith(end) & (n > longer)

    def cut(k: int) -> Column:
        return F.substring(token, F.lit(1), n - k)

    return F.when(n <= 3, token).when(without("ies", 4), F.concat(cut(3), F.lit("y"))).when(without("ing", 5), cut(3)).when(without("ed", 4), cut(2)).when(without("es", 4), cut(2)).when(without("s", 4), cut(1)).otherwise(token)


def without_words(tokens: Column, drop: list[str]) -> Column:
    """Tokens outside a list; repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(drop))


def terms(text: Column) -> Column:
    """Stemmed words without stop words: what matching and reranking compare."""
    return without_words(F.transform(words(text), stem), STOP_WORDS)


def search_tokens(text: Column, most: int = MAX_SEARCH_TOKENS, *, marks: bool = True) -> Column:
    """The first distinct words of a query that full-text search uses; without ``marks`` as the index has them."""
    return F.slice(F.array_distinct(without_words(words(text) if marks else index_words(text), SEARCH_STOP_WORDS)), 1, most)


def letters_only(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$")


def digits_only(token: Column) -> Column:
    return token.rlike(r"^\p{N}+$")


def entity_terms(text: Column) -> Column:
    """Sorted name-like terms: mixes of letters and digits, a word glued to the number after it, and words
    that are capitalised, follow a cue or precede a name's verb."""
    def of(raw: Column, low: Column) -> Column:
        mixed = F.filter(low, lambda t: t.rlike(r"\p{N}") & t.rlike(r"\p{L}"))
        pair = F.zip_with(low, F.slice(low, 2, F.greatest(F.size(low) - 1, F.lit(0))), lambda a, b: F.when(digits_only(b) & letters_only(a), F.concat(a, b)))
        numbered = F.when(F.lower(text).rlike(r"\p{N}"), F.concat(mixed, pair)).otherwise(F.array().cast("array<string>"))

        def named(token: Column, i: Column) -> Column:
            t = F.lower(token)
            before = F.when(i > 0, F.element_at(low, i))  # element_at counts from 1
            after = F.when(i + 2 <= F.size(low), F.element_at(low, i + 2))
            cue = F.coalesce(before.isin(ENTITY_CUES), F.lit(False)) & (F.length(t) >= 4)
            follower = F.coalesce(after.isin(NAME_FOLLOWERS), F.lit(False)) & (F.length(t) >= 4)
            plain = letters_only(t) & (F.length(t) >= 3) & ~t.isin(STOP_WORDS) & ~t.isin(ENTITY_NOISE)
            return F.when(plain & (token.rlike(r"\p{Lu}") | cue | follower), t)

        return F.array_sort(F.array_distinct(F.array_compact(F.concat(numbered, F.transform(raw, named)))))

    # Words are found once a text: inside the lambdas they would be found again for every word.
    return once(words(text, lower=False), lambda raw: once(words(text), lambda low: of(raw, low)))


def year_terms(text: Column) -> Column:
    """Sorted distinct four-digit tokens."""
    return F.array_sort(F.array_distinct(F.filter(words(text, lower=False), lambda t: t.rlike(r"^\d{4}$"))))


def quoted_phrases(text: Column, most: int = MAX_PHRASES) -> Column:
    """Contents of quotation marks in order, trimmed, without repeats (case apart)."""
    inside = F.transform(F.regexp_extract_all(text, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda p: F.trim(F.substring(p, F.lit(2), F.length(p) - 2)))
    inside = F.filter(inside, lambda p: p != "")
    low = F.transform(inside, F.lower)
    return F.slice(F.filter(inside, lambda p, i: F.array_position(low, F.lower(p)) == i + 1), 1, most)


def phrase_key(phrase: Column) -> Column:
    """Comparable form of a phrase: its first eight words, lower case."""
    return F.array_join(F.slice(words(phrase), 1, 8), " ")


def trimmed(text: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def collapsed(text: Column) -> Column:
    """Without highlight brackets, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\[\]]", ""), r"\s+", " "))


def punctuation_split(text: Column) -> Column:
    """Split on white space and ASCII punctuation; empty parts are left out."""
    return F.filter(F.split(text, r"[\s!-/:-@\[-`{-~]+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Split on . ! ? and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def segments(text: Column) -> Column:
    """Sentences that keep their delimiter (. ! ? ; or line end), after white space is collapsed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.filter(F.transform(F.regexp_extract_all(flat, F.lit(r"[^.!?;]*[.!?;]|[^.!?;]+$"), F.lit(0)), lambda x: F.btrim(x, F.lit(SPACES))), lambda s: s != "")


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\r\n|\n|\r"), 1, n), "\n")


def preview(text: Column, most: int = 512) -> Column:
    """The first bytes of a text; null if they cut a character."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, most)
    return F.try_validate_utf8(head.cast("string")) if hasattr(F, "try_validate_utf8") else head.cast("string")


def byte_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within a number of bytes: up to three bytes are given back."""
    raw = F.encode(text, "UTF-8")
    tries = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, F.lit("")))


def contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def query_type(query: Column) -> Column:
    """temporal, factual, semantic or exploratory: the first rule that fits."""
    q = F.lower(query)
    temporal = contains_any(q, ["when", "yesterday", "today", "last ", "recent", "latest", "before ", "after ", "between "])
    factual = q.startswith("what is") | q.startswith("what are") | q.startswith("who is") | q.startswith("who are") | contains_any(q, ["define ", "definition of", "meaning of"])
    semantic = contains_any(q, ["how ", "why ", "explain", "describe", "relate"])
    return F.when(temporal, "temporal").when(factual, "factual").when(semantic, "semantic").otherwise("exploratory")


def intents(query: Column) -> dict[str, Column]:
    """What a question asks for."""
    q, t = F.lower(query), terms(query)
    place = contains_any(q, ["city", "where", "moved", "moving"]) | F.array_contains(t, "move") | F.array_contains(t, "mov")
    date = contains_any(q, ["date", "when", "launch", "timeline"])
    owner = contains_any(q, ["who", "owner", "owns", "deployment readiness"])
    count = place.cast("int") + date.cast("int") + owner.cast("int")
    return {"asks_location": place, "asks_date": date, "asks_ownership": owner, "multi_hop": q.contains(" and ") & (count > 1)}


def specificity(query: Column) -> Column:
    """0 to 1: length, names or numbers, quotation marks."""
    parts = F.filter(F.split(query, r"[\s\p{P}]+"), lambda t: t != "")
    named = query.rlike(r"\p{Nd}") | F.exists(parts, lambda t: t.rlike(r"^\p{Lu}"))
    score = F.least(F.size(parts) / 8.0, F.lit(0.4)) + F.when(named, 0.35).otherwise(0.0) + F.when(query.contains('"'), 0.25).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as a signed integer, by exact decimal arithmetic; for short keys."""
    raw = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        # h * 1099511628211 modulo 2^64 = (h << 40) + h * 435; products of longs would overflow under ANSI.
        x = h.bitwiseXOR(b)
        low, high = x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32)
        a = low * 435
        b_ = (high * 435 + F.shiftrightunsigned(a, 32)).bitwiseAND(0xFFFFFFFF)
        return (F.shiftleft(b_, 32).bitwiseOR(a.bitwiseAND(0xFFFFFFFF)), F.shiftleft(x, 40))

    def add(pair) -> Column:
        p, q = pair
        low = p.bitwiseAND(0xFFFFFFFF) + q.bitwiseAND(0xFFFFFFFF)
        high = F.shiftrightunsigned(p, 32) + F.shiftrightunsigned(q, 32) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))

    return F.aggregate(raw, F.lit(-3750763034362895579), lambda h, b: add(step(h, b)))
