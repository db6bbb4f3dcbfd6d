"""Closed vocabularies and thresholds of the posting domain. Names and numbers that results depend on."""

from __future__ import annotations

STATUSES = (
    "unseen", "liked", "passed", "to_apply", "to_research", "to_network", "skipped", "unsure",
    "applied", "test_task", "interview", "declined", "accepted", "expiring", "archived",
)
APPLICATION = ("applied", "test_task", "interview", "declined", "accepted")
DECIDED = (*APPLICATION, "liked", "to_apply", "to_research", "to_network", "passed", "skipped")
PROTECTED = (*DECIDED, "archived", "unsure")
CLOSED = ("passed", "skipped", "declined", "accepted", "archived", "expiring")
KINDS = ("job", "programme", "advising", "consulting", "grant", "course")
REPORT_KINDS = ("research", "grant", "company", "sector", "other")
CONTACT_STATUSES = ("planned", "contacted", "replied", "met", "declined")

PROTECT_SCORE = 60
APPLYABLE_SCORE = 60
SLA_DAYS = 7
STALE_DAYS = 14
CATALOGUE_SCORE = 40
TOMBSTONE_DAYS = 90
HOT_SCORE = 55
SIMILAR_TITLES = 0.85
TIERS = (("S", 82), ("A", 70), ("B", 55))
TIER_BLEND = (0.70, 0.30)
