"""Column expressions over entity names: normal form, words, similarity, type rules.

All are built-in expressions.  Keyword tests look for each word by itself, which takes a
fraction of the time of one pattern of all; higher-order functions are used only where
words of a name are compared with each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Legal endings that mark a registered entity.
ENTITY_ENDINGS = (
    "LLC", "L.L.C.", "Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "Ltd", "Ltd.",
    "Limited", "PLC", "P.L.C.", "GmbH", "AG", "SA", "S.A.", "BV", "B.V.", "NV", "N.V.", "KG",
    "SAS", "S.A.S.", "SARL", "S.A.R.L.", "Pty", "LP", "L.P.", "LLP", "L.L.P.", "NA", "N.A.",
    "Co.", "SE", "AB", "AS", "A/S", "Sdn Bhd", "K.K.", "SpA", "S.p.A.",
)
# Words that carry no meaning in a name; the type rules ignore one more.
NOISE_WORDS = (
    "inc", "inc.", "corp", "corp.", "corporation", "llc", "l.l.c.", "ltd", "ltd.", "limited", "co", "co.",
    "company", "plc", "lp", "l.p.", "s.a.", "sa", "ag", "gmbh", "b.v.", "bv", "s.r.l.", "srl", "n.v.", "nv",
    "pty", "pte", "se", "s.e.", "the", "de", "and", "&", "of", "a", "an", "la", "el", "las", "los", "del",
    "des", "le", "du", "ii", "iii", "iv",
)
TYPE_NOISE_WORDS = (*NOISE_WORDS, "l.l.c")
# Keyword groups of the type rules.
JOINT_VENTURE = ("joint venture", " jv ", " jv,", "(jv)", "jv-")
GENERIC = ("trust", "funding", "finance co", "financing", "capital co", "receivables", "securitization", "limited partnership", "national association", "statutory trust", "grantor trust")
FUNCTIONAL = ("holding", "properties", "realty", "real estate", "insurance", "leasing", "mortgage", "investments", "asset", "credit", "lending", "services")
GEOGRAPHIC = (
    "america", "europe", "asia", "pacific", "canada", "uk", "japan", "china", "india", "brazil", "mexico", "australia",
    "north", "south", "east", "west", "international", "global", "usa", "u.s.", "latin", "middle east", "africa",
    "delaware", "texas", "california", "new york", "nevada",
)
STRUCTURAL = ("holdings", "group", "holding")
STANDALONE = ("inc", "inc.", "corp", "corp.", "corporation", "co.", "company")
# Keyword groups of the training features.
FEATURE_FUNCTIONAL = ("trust", "funding", "finance", "holding", "properties", "realty", "real estate", "insurance", "leasing", "mortgage", "investments", "asset", "credit", "lending", "services")
FEATURE_GEOGRAPHIC = ("america", "europe", "asia", "pacific", "canada", "uk", "japan", "china", "india", "brazil", "international", "global")


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words anywhere."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def has_any(col: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (col.contains(w) for w in words))


def trimmed(col: Column) -> Column:
    """Without white space (as Unicode knows it) at either end."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(col: Column) -> Column:
    """Lower-cased and trimmed: the key under which spellings are one child."""
    return F.lower(trimmed(col))


def has_entity_suffix(col: Column) -> Column:
    return col.rlike("(?i) (?:" + any_of(ENTITY_ENDINGS) + ")$")


def meaningful_words(col: Column, noise: tuple[str, ...] = NOISE_WORDS) -> Column:
    """Lower-cased words without outer ``.,()``, noise and single characters, in order."""
    # Split at blanks, which takes no pattern; empty words go with the short ones.
    blank = F.translate(norm(col), WHITE_SPACE, " " * len(WHITE_SPACE))
    words = F.transform(F.split(blank, " "), lambda w: F.btrim(w, F.lit(".,()")))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*noise))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 0 if either is empty."""
    common = lambda a, b: F.size(F.array_intersect(a, b))
    share = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common(a, b) / F.size(F.array_union(a, b)))
    return let(a, lambda x: let(b, lambda y: share(x, y)))


def first_word(col: Column) -> Column:
    """First word at any white space, lower-cased; null if there is none."""
    return F.nullif(F.regexp_extract(norm(col), r"(?U)^(\S+)", 1), F.lit(""))


def brand_token(col: Column) -> Column:
    """What stands before the first blank, lower-cased."""
    return F.lower(F.substring_index(col, " ", 1))


def suffix_type(col: Column) -> Column:
    low = F.lower(col)
    return (
        F.when(F.regexp_replace(low, r"\.+$", "").rlike("(inc|corp|corporation)$"), "inc_corp")
        .when(low.rlike(r"llc|l\.l\.c"), "llc")
        .when(low.rlike(r"lp|l\.p\."), "lp")
        .when(low.rlike("ltd|limited"), "ltd")
        .when(low.contains("trust"), "trust")
        .otherwise("other")
    )


def is_active(time_out: Column) -> Column:
    return time_out.startswith("Active")


def infer_type(child: Column, parent: Column, first_seen: Column, first_filing: Column, batch_size: Column, cross_parent: Column) -> Column:
    """The relationship type by ordered rules over the two names and the filing signals.

    Dates are ISO strings or null.  Rules in order: joint-venture marks; the
    parent's leading word in the child's name; a name several parents share; purpose
    words; then, by overlap of words, whether the child looks like a company of its own.
    """
    return infer_type_by_words(child, words_of_parent(parent), first_seen, first_filing, batch_size, cross_parent)


def words_of_parent(parent: Column) -> Column:
    """A parent's words as the type rules read them."""
    return meaningful_words(F.coalesce(parent, F.lit("")), TYPE_NOISE_WORDS)


def infer_type_by_words(child: Column, parent_words: Column, first_seen: Column, first_filing: Column, batch_size: Column, cross_parent: Column) -> Column:
    """:func:`infer_type` with :func:`words_of_parent`, which are worked out once a parent."""
    signals = (first_seen, first_filing, batch_size, cross_parent)
    # Words are used by many rules, so they are worked out before.
    words = lambda sub, pw: let(meaningful_words(sub, TYPE_NOISE_WORDS), lambda sw: _ruled(sub, sw, pw, *signals))
    return let(norm(F.coalesce(child, F.lit(""))), lambda sub: let(parent_words, lambda pw: words(sub, pw)))


def _ruled(sub: Column, sw: Column, pw: Column, first_seen: Column, first_filing: Column, batch_size: Column, cross_parent: Column) -> Column:
    """The rules of :func:`infer_type` over a child's name and words and the parent's words."""
    core = F.coalesce(F.get(pw, F.lit(0)), F.lit(""))
    stem = F.substring(core, 1, 4)

    def near(w: Column) -> Column:
        return F.array_contains(pw, w) | F.exists(pw, lambda p: (F.length(p) >= 4) & (p.contains(w) | w.contains(p)))

    structural = F.arrays_overlap(sw, F.array(*map(F.lit, STRUCTURAL)))
    far_structural = lambda far: F.arrays_overlap(far, F.array(*map(F.lit, STRUCTURAL)))
    has_parent = (F.length(core) >= 3) & (sub.contains(core) | ((F.length(stem) >= 4) & sub.contains(stem)))
    original = F.coalesce((first_seen != "") & (first_filing != "") & (first_seen <= first_filing), F.lit(False))
    batch = F.coalesce(batch_size, F.lit(0))
    generic, functional, geographic = has_any(sub, GENERIC), has_any(sub, FUNCTIONAL), has_any(sub, GEOGRAPHIC)
    ends = "|".join(re.escape(w) for w in STANDALONE)
    standalone = sub.rlike(f"(?:{ends})$| (?:{ends}) ")
    joint, inner, outer, restructured = (F.lit(x) for x in ("Joint Venture", "Internal Creation", "External Acquisition", "Restructuring"))
    outside = standalone & ~original & ~batch.between(1, 2) & ~functional & ~geographic
    rules = lambda far: (
        F.when(has_any(sub, JOINT_VENTURE), joint)
        .when(has_parent & (far_structural(far) | ((F.size(far) == 0) & structural)), restructured)
        .when(has_parent, inner)
        .when(F.coalesce(cross_parent, F.lit(False)) & ~generic, outer)
        .when(generic, inner)
        .when((F.length(core) >= 3) & (F.size(far) == F.size(sw)), F.when(outside, outer).otherwise(inner))
        .when(F.length(core) >= 3, F.when(structural, restructured).otherwise(inner))
        .when(original | functional, inner)
        .when(batch >= 10, outer)
        .otherwise(inner)
    )
    return let(F.filter(sw, lambda w: ~near(w)), rules)
