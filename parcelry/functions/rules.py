"""Keyword rules that settle clear cases without a model, as ordered boolean columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from parcelry.functions.text import NON_WORD, NON_WORD_INLINE, as_col, strip

# ---- Fixed values: rule set in force --------------------------------------------------------
EXCLUSION_KEYWORDS = {
    "tulajdoni hányad": "Tulajdoni hányad",
    "bérleti jog": "Bérleti jog (nem eladás)",
    "önkormányzati ingatlan": "Önkormányzati ingatlan",
    "ingatlancsere": "Ingatlancsere (nem eladás)",
    "cserélhető": "Csere (nem eladás)",
    "cserélném": "Csere (nem eladás)",
    "haszonélvezet": "Haszonélvezet",
    "haszonélvezettel": "Haszonélvezet",
}
NEGATIONS = [
    "tehermentes",
    "per- és tehermentes",
    "per és tehermentes",
    "nincs haszonélvezet",
    "törölve",
    "megszüntetve",
    "nincs",
    "nem terhelt",
    "teljes tulajdon",
    "1/1 tulajdon",
    "magántulajdon",
    "magánszemély tulajdonban",
]
FRACTION_PATTERN = r"osztatlan közös tulajdon[^\n]*?\p{Nd}+/\p{Nd}+"
FRACTION_REASON = "Osztatlan közös tulajdon (törtszám)"
RULE_PREFIX = "Worker előszűrés: "
UNDECIDED_REASON = "Worker nem tudta eldönteni - LLM szükséges"

# ---- Fixed values: earlier rule set ---------------------------------------------------------
EARLIER_KEYWORDS = {
    "osztatlan közös": "Osztatlan közös tulajdon",
    "tulajdoni hányad": "Tulajdoni hányad",
    "bérleti jog": "Bérleti jog (nem eladás)",
    "haszonélvezet": "Haszonélvezet",
    "önkormányzati": "Önkormányzati tulajdon",
    "csere": "Csere (nem eladás)",
    "nyaraló": "Ingatlan típusa: Nyaraló",
    "ikerház": "Ingatlan típusa: Ikerház",
    "családi ház": "Ingatlan típusa: Családi ház",
    "üzlethelyiség": "Ingatlan típusa: Üzlethelyiség",
    "iroda": "Ingatlan típusa: Iroda",
    "csak készpénz": "Csak készpénzes vevő (jogi kockázat)",
}
EARLIER_NEGATIONS = ["tehermentes", "nincs haszonélvezet", "törölve"]
EARLIER_AMBIGUOUS = "haszonélvezet"
EARLIER_PREFIX = "Rule-based: "
SHORT_TEXT_REASON = "Short or missing description and title, assumed relevant"


def literal(phrase: str) -> str:
    """Escape what both regex dialects treat as special."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", phrase)


def whole_word_pattern(phrase: str) -> str:
    return f"(^|{NON_WORD}){literal(phrase)}({NON_WORD}|$)"


def near_pattern(keyword: str, negations: Sequence[str], window: int) -> str:
    """A negation within ``window`` characters of the keyword, either side, on the same line.

    Both phrases start and end on word characters, so the gap is a non-word character or a stretch
    with one at each end. That says "word boundary" without look-around.
    """
    gap = f"({NON_WORD_INLINE}|{NON_WORD_INLINE}[^\\n]{{0,{window - 2}}}{NON_WORD_INLINE})"
    negation = "(" + "|".join(literal(n) for n in negations) + ")"
    word = literal(keyword)
    return f"(^|{NON_WORD})({negation}{gap}{word}|{word}{gap}{negation})({NON_WORD}|$)"


@dataclass(frozen=True)
class RuleSet:
    """Ordered keywords with reasons, the words that cancel them, and a leading pattern."""

    keywords: Mapping[str, str]
    negations: Sequence[str] = ()
    window: int = 50
    prefix: str = RULE_PREFIX
    first_pattern: str | None = None
    first_reason: str = ""


CURRENT_RULES = RuleSet(EXCLUSION_KEYWORDS, tuple(NEGATIONS), 50, RULE_PREFIX, FRACTION_PATTERN, FRACTION_REASON)


def keyword_hit(text: Column, keyword: str) -> Column:
    """Plain substring search first; the regex only runs on texts that contain the phrase."""
    return F.contains(text, F.lit(keyword)) & text.rlike(whole_word_pattern(keyword))


def exclusion_reason(text: str | Column, rules: RuleSet = CURRENT_RULES) -> Column:
    """Reason of the first rule that fires on lower-cased ``text``; null when none does."""
    text = as_col(text)
    branches = []
    if rules.first_pattern:
        lead = re.match(r"[^\\\[(.*+?]+", rules.first_pattern)
        fires = text.rlike(rules.first_pattern)
        if lead:
            fires = F.contains(text, F.lit(lead.group(0))) & fires
        branches.append(F.when(fires, F.lit(rules.prefix + rules.first_reason)))
    for keyword, reason in rules.keywords.items():
        fires = keyword_hit(text, keyword)
        if rules.negations:
            fires = fires & ~text.rlike(near_pattern(keyword, rules.negations, rules.window))
        branches.append(F.when(fires, F.lit(rules.prefix + reason)))
    return F.coalesce(*branches)


def earlier_exclusion_reason(text: str | Column) -> Column:
    """The earlier cascade: one ambiguous word next to any negation leaves everything undecided."""
    text = as_col(text)
    negated = F.lit(False)
    for negation in EARLIER_NEGATIONS:
        negated = negated | F.contains(text, F.lit(negation))
    ambiguous = F.contains(text, F.lit(EARLIER_AMBIGUOUS)) & negated
    rules = RuleSet(EARLIER_KEYWORDS, prefix=EARLIER_PREFIX)
    return F.when(~ambiguous, exclusion_reason(text, rules))


def routed_text(title: str | Column, description: str | Column, min_description: int = 100, min_title: int = 10) -> Column:
    """Description when long enough, else the title alone when that is, else null."""
    title, description = as_col(title), as_col(description)
    return F.when(F.length(strip(description)) >= min_description, description).when(
        F.length(strip(title)) > min_title, F.concat(F.lit("Cím: "), title, F.lit("\n"))
    )
