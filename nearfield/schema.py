"""Column contracts and numeric conventions shared by every operator."""

from __future__ import annotations

# A range is inclusive: an answer counts when its distance, rounded to nine
# places, is at most the radius. Comparing against radius + half a unit of the
# ninth place says the same without rounding each candidate.
ANSWER_TOLERANCE = 5e-10

# Every pruning test is loosened by this share of the distances it compares (and
# by this much near zero), so float error in the triangle inequality can only
# ever keep a candidate, never lose one.
PRUNE_SLACK = 1e-9

# Distances are ordered on this many places before ties fall to the id.
RANK_PLACES = 9
