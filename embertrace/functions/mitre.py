"""Rule tags to technique, tactic and attack stage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import lookup, title_case
from embertrace.schemas import UNKNOWN_STAGE

# --- fixed values: tactic (dashed, lower case) to attack stage ---------------
STAGE_BY_TACTIC = {
    "reconnaissance": "Reconnaissance",
    "initial-access": "Initial Access",
    "execution": "Execution",
    "persistence": "Persistence",
    "privilege-escalation": "Privilege Escalation",
    "defense-evasion": "Defense Evasion",
    "credential-access": "Credential Access",
    "discovery": "Discovery",
    "lateral-movement": "Lateral Movement",
    "collection": "Collection",
    "exfiltration": "Exfiltration",
    "command-and-control": "Command & Control",
    "impact": "Impact",
}
TECHNIQUE_TAG = r"^attack\.t[0-9]{4}(\.[0-9]{3})?$"
GROUP_OR_SOFTWARE_TAG = r"^attack\.[gs][0-9]{4}$"
# --- end of fixed values ------------------------------------------------------


def technique_of(tags: Column) -> Column:
    """Technique id named by the last technique tag."""
    hits = F.filter(tags, lambda tag: F.lower(tag).rlike(TECHNIQUE_TAG))
    last = F.try_element_at(hits, F.lit(-1))
    return F.upper(F.regexp_replace(F.lower(last), r"attack\.", ""))


def tactic_of(tags: Column, config: EngineConfig) -> Column:
    """Tactic named by the last ``attack.`` tag that is not a technique.

    Documented semantics skip group and software tags (attack.g0001, attack.s0002).
    """

    def is_tactic(tag: Column) -> Column:
        low = F.lower(tag)
        keep = low.startswith("attack.") & ~low.startswith("attack.t")
        if config.documented:
            keep = keep & ~low.rlike(GROUP_OR_SOFTWARE_TAG)
        return keep

    last = F.try_element_at(F.filter(tags, is_tactic), F.lit(-1))
    return title_case(F.regexp_replace(F.lower(last), r"attack\.", ""))


def stage_of(tactic: Column) -> Column:
    dashed = F.translate(F.lower(tactic), " ", "-")
    return F.coalesce(lookup(STAGE_BY_TACTIC, dashed, UNKNOWN_STAGE), F.lit(UNKNOWN_STAGE))
