"""The query modules of this package."""

from quorate.llm import queries_text, queries_votes

MODULES = [queries_votes, queries_text]
