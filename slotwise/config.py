"""Settings of the card model; all of them can be overlaid."""

from __future__ import annotations

from dataclasses import dataclass, field

# Card types as (days to live, importance, body limit, volatile).
TYPES = {
    "profile": (730, 0.70, 600, False),
    "preference": (365, 0.60, 600, False),
    "environment": (180, 0.85, 800, True),
    "project": (120, 0.85, 1200, True),
    "procedure": (365, 0.80, 1400, False),
    "lesson": (540, 0.75, 1200, False),
    "decision": (365, 0.90, 1200, False),
    "episode": (90, 0.40, 900, True),
}
TYPE_FIELDS = ("ttl_days", "importance", "body_limit", "volatile")
UNKNOWN_TYPE = (365, 0.6, 1200, False)
# States, relations of links, weights and penalties of search, cut-offs of similarity.
STATUSES = ("active", "superseded", "expired", "disputed", "archived")
RELATIONS = ("extends", "supports", "contradicts", "refines", "supersedes", "derived_from", "example_of")
WEIGHTS = {"lexical": 1.0, "slot_exact": 1.5, "alias_hit": 1.2, "tag_hit": 0.6, "importance": 0.8, "confidence": 0.4, "recency": 0.3, "reuse": 0.25}
PENALTIES = {"active": 0.0, "disputed": -0.6, "expired": -1.5, "superseded": -2.0, "archived": -2.0}
HALF_LIFE_DAYS = 180.0
IDENTICAL, NEAR, ENRICHMENT = 0.93, 0.88, 0.70
# Phrases by which a claim says that it replaces another, and that it holds from now on.
CHANGE = r"(不再|不用|不要|改为|换成|改成|已经?不|stop|no longer|switch(ed)? to|instead of)"
RESTATE = r"(现在|目前|从现在起| henceforth|going forward|as of)"
# Types that are never archived, and when others are.
PROTECTED = ("profile", "preference", "decision")
ARCHIVE_IDLE_DAYS, ARCHIVE_IMPORTANCE = 90, 0.25


@dataclass(frozen=True)
class Config:
    types: dict = field(default_factory=lambda: dict(TYPES))
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    penalties: dict = field(default_factory=lambda: dict(PENALTIES))
    half_life_days: float = HALF_LIFE_DAYS

    def overlaid(self, over: dict) -> Config:
        """This configuration with settings replaced, nested ones one by one.

        A type is a dict of ttl_days, importance, body_limit and volatile, of
        which any may be given, or all four in a row; a new type takes the
        others from UNKNOWN_TYPE.
        """
        types = dict(self.types)
        for name, new in over.get("types", {}).items():
            if isinstance(new, dict):
                new = tuple(new.get(k, v) for k, v in zip(TYPE_FIELDS, types.get(name, (*UNKNOWN_TYPE,)), strict=True))
            types[name] = tuple(new)
        return Config(types, self.weights | over.get("weights", {}), self.penalties | over.get("penalties", {}), over.get("half_life_days", self.half_life_days))


DEFAULT = Config()
