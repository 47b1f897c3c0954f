"""Routing of questions: about the corpus as a whole (global) or about named things (local)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.text import keyword_terms

# Patterns that mark a question about the whole corpus.
GLOBAL_CUES = [
    r"\bsummar(?:y|ies|ise|ize|ising|izing|isation|ization)\b",
    r"\b(?:overall|overview|synopsis|gist|tl;?dr)\b",
    r"\bbig[\s-]picture\b",
    r"\bhigh[\s-]level\b",
    r"\bbird'?s[\s-]eye\b",
    r"\bat a glance\b",
    r"\bas a whole\b",
    r"\bin general\b",
    r"\bgenerally\b",
    r"\bbroadly\b",
    r"\bacross (?:all|the|these|every|my)\b",
    r"\b(?:throughout|among) (?:all|the|these|every|my)\b",
    r"\b(?:whole|entire) (?:corpus|graph|dataset|collection|knowledge base)\b",
    r"\bevery (?:document|doc|file|paper)s?\b",
    r"\ball (?:the )?(?:documents|docs|files|papers)\b",
    r"\b(?:themes?|topics?)\b",
    r"\b(?:main|key|central|core|common|major|recurring|overarching|dominant)\s+(?:ideas?|concepts?|subjects?|points?|takeaways?|findings?|insights?|patterns?|trends?)\b",
    r"\bwhat (?:is|are) (?:this|these|the) (?:document|documents|corpus|data|graph|knowledge base|papers?|files?)\b",
]
# Words that only ask for the wide view.
CUE_WORDS = (
    "main key central core common major recurring dominant overarching theme themes topic topics idea ideas concept concepts subject subjects point points takeaway "
    "takeaways finding findings insight insights pattern patterns trend trends overall overview synopsis gist summary summaries summarize summarise summarizing "
    "summarising general generally broadly big picture high level glance whole entire everything across throughout among all every document documents doc docs file "
    "files paper papers corpus dataset data collection knowledge base graph covered cover covers discussed discuss contain contains content contents list give "
    "provide show brief briefly please important most these there"
).split()

_ANY = "|".join(f"(?:{p})" for p in GLOBAL_CUES)
ROUTE_SQL = "regexp_matches(lower(text), '" + _ANY.replace("'", "''") + "')"


def is_global(question: Column, enabled: bool = True) -> Column:
    return F.coalesce(F.lower(question).rlike("(?U)" + _ANY), F.lit(False)) if enabled else F.lit(False)


def is_broad(question: Column) -> Column:
    """No keyword beside cue words is left to search for."""
    return F.size(F.array_except(keyword_terms(question), F.array(*[F.lit(w) for w in CUE_WORDS]))) == 0
