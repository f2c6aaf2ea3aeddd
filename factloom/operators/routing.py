"""Which way a question goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import Domain
from ..functions import text as tx


def vocabulary(domain: Domain) -> tuple[set[str], set[str]]:
    """The words of the synonyms: short ones whole, long ones by their first five letters."""
    import re

    words = {w for pair in domain.synonyms.items() for term in pair for w in re.findall("[a-zа-я0-9]+", term.lower().replace("ё", "е"))}
    return {w for w in words if len(w) <= 4}, {w[:5] for w in words if len(w) > 4}


def off_topic(question: Column, domain: Domain | None = None) -> Column:
    """A short question without digits in which no word is of the domain. Errs on the side of answering."""
    domain = domain or Domain()
    exact, starts = vocabulary(domain)
    folded = F.translate(F.lower(F.trim(F.coalesce(question, F.lit("")))), "ё", "е")
    stem = "^(" + "|".join(domain.stems) + ")"
    known = lambda w: F.when(F.length(w) <= 4, w.isin(*exact) if exact else F.lit(False)).otherwise((F.substring(w, 1, 5).isin(*starts) if starts else F.lit(False)) | w.rlike(stem))
    return F.when(folded == "", True).when(folded.rlike(r"\p{Nd}") | (F.length(folded) > 80), False).otherwise(~F.exists(tx.tokens(folded), known))


def needs_full_path(question: Column, filters: bool = False) -> Column:
    """Digits, words of comparison or explicit filters ask for the full path."""
    folded = F.translate(F.lower(F.coalesce(question, F.lit(""))), "ё", "е")
    return F.lit(filters) | folded.rlike(r"\p{Nd}") | folded.rlike("сравн|отлич| vs |против")
