"""Metaphone codes as column expressions.

Capitals are letters still to be read, small letters and the digit 0 are codes that were written. A stage that reads a
neighbour therefore runs before the stage that would replace this neighbour, and vowels go last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules of the original Metaphone, as pattern and replacement, in order.
STAGES = (
    ("GG+", "k"),
    ("([ABD-FH-Z])\\1+", "$1"),
    ("^(?:[GKP](?=N)|A(?=E)|W(?=R))", ""),
    ("^X", "s"),
    ("^WH", "W"),
    ("(?<=M)B$", ""),
    ("SCH", "sk"),
    ("T(?=CH)", ""),
    ("CIA", "xIA"),
    ("CH", "x"),
    ("SC(?=[IEY])", "s"),
    ("C(?=[IEY])", "s"),
    ("C?K|C", "k"),
    ("DG(?=[EIY])", "j"),
    ("G(?=H[^AEIOU])", ""),
    ("G(?=N(?:ED)?$)", ""),
    ("G(?=[IEY])", "j"),
    ("SH|S(?=I[OA])", "x"),
    ("TH", "0"),
    ("T(?=I[OA])", "x"),
    ("PH", "f"),
    ("(?<=[AEIOU])H(?![AEIOU])", ""),
    ("[WY](?![AEIOU])", ""),
    ("X", "ks"),
    ("(?<!^)[AEIOU]", ""),
)
# Letters that a code stands for without a rule.
PLAIN = ("ABDEFGHIJLMNOPQRSTUVWYZ", "abtefkhijlmnopkrstufwys")


def metaphone(text: Column) -> Column:
    """The code of a whole text, read as one word of its letters A to Z; empty where there are none."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    staged = reduce(lambda made, rule: F.regexp_replace(made, *rule), STAGES, letters)
    return F.translate(staged, *PLAIN)
