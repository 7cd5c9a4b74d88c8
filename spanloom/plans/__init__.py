"""The query catalogue; importing it registers every module of queries."""

from . import catalogue, edits, ledgers, listening, refreshes, seams, speech, stories

__all__ = ["catalogue", "edits", "ledgers", "listening", "refreshes", "seams", "speech", "stories"]
