"""Front pages: sections filled in order under diversity limits, and the older homepage."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import fixed
from tickerloom.operators.ranking import lookup

SECTIONS = ["lead", "wire", *fixed.DESK_ORDER, "now"]
#: Sections that draw from all sports.
MIXED = ("wire", "now")
SLATE = "edition string, section string, position int, cluster_id long, skipped string"


def _column_for(items: pd.DataFrame, section: str) -> pd.Series:
    """Which items may stand in a section at all."""
    if f"{section}_ok" in items.columns:
        return items[f"{section}_ok"].astype(bool)
    return (items["desk"] == section) & items["desk_ok"].astype(bool)


def _queues(items: pd.DataFrame) -> dict[str, pd.DataFrame]:
    """Each section's items in the order in which they are offered; one that an editor forced into a fitting section is offered there only."""
    may = pd.DataFrame({s: _column_for(items, s) for s in SECTIONS})
    bound = pd.Series([bool(f in may.columns and may.at[i, f]) for i, f in items["forced_section"].items()], index=items.index)
    ordered = items.assign(pin_first=~items["pinned"].astype(bool), weight=items["sport"].map(fixed.SPORT_WEIGHT).fillna(0))
    ordered = ordered.sort_values(["pin_first", "score", "weight", "cluster_id"], ascending=[True, False, False, True])
    return {s: ordered[(may[s] & (~bound | (items["forced_section"] == s))).reindex(ordered.index)] for s in SECTIONS}


def _overlap(a, b) -> tuple[int, float]:
    """Common entities, and the share of common among all words."""
    words = set(a.tokens) | set(b.tokens)
    return len(set(a.entities).intersection(b.entities)), len(set(a.tokens).intersection(b.tokens)) / max(len(words), 1)


def _tells_the_same(item, page: list[tuple]) -> bool:
    """Whether a placed item of the sport, within a day (or of unknown time), is about the same event."""
    for _, other in page:
        if other.sport != item.sport or abs((other.newest_at - item.newest_at).total_seconds()) > 86_400:
            continue
        common, share = _overlap(other, item)
        if common >= fixed.DIVERSITY["same_event"] or share >= (0.3 if common else 0.4):
            return True
    return False


def _team_is_full(item, page: list[tuple], section: str) -> bool:
    """Whether a team of the item stands in this section or on the page as often as it may."""
    per_team = [(sum(team in o.teams for s, o in page if s == section), sum(team in o.teams for _, o in page)) for team in item.teams]
    return any(here >= fixed.DIVERSITY["team_section"] or all_over >= fixed.DIVERSITY["team_slate"] for here, all_over in per_team)


def _share_is_full(field: str, limit: str):
    """A test whether a mixed section holds its share of items with this item's ``field``."""

    def full(item, page: list[tuple], section: str) -> bool:
        value = getattr(item, field)
        if section not in MIXED or not value:
            return False
        room = max(1, math.ceil(fixed.SLATE_DEPTH[section] * fixed.DIVERSITY[limit]))
        return sum(getattr(o, field) == value for s, o in page if s == section) >= room

    return full


def _outranks_limits(item) -> bool:
    """Pinned, breaking, or developing with many sources: shares and teams do not count against it."""
    return bool(item.pinned) or item.urgency == "breaking-candidate" or (item.urgency != "normal" and item.domains >= fixed.DIVERSITY["dominant_sources"])


#: (reason, what frees an item from the rule, test), the first that applies is given as the reason.
RULES = (
    ("same-event", lambda item: bool(item.pinned), lambda item, page, section: _tells_the_same(item, page)),
    ("team", _outranks_limits, _team_is_full),
    ("sport", _outranks_limits, _share_is_full("sport", "sport_share")),
    ("event-type", _outranks_limits, _share_is_full("event_type", "type_share")),
)


def fill_sections(items: pd.DataFrame) -> list[tuple]:
    """(section, position, cluster_id, skipped) for one edition. Every choice depends on the page so far, a list of (section, item)."""
    page: list[tuple] = []
    out = []
    for section, queue in _queues(items).items():
        on_page = {o.cluster_id for _, o in page}
        free = fixed.SLATE_DEPTH[section]
        for item in queue[~queue["cluster_id"].isin(on_page)].itertuples(index=False):
            if not free:
                break
            if section == "now" and not item.pinned and item.score < fixed.DIVERSITY["now_floor"]:
                continue
            reason = next((why for why, exempt, applies in RULES if not exempt(item) and applies(item, page, section)), None)
            if reason is None:
                free -= 1
                page.append((section, item))
            out.append((section, None if reason else fixed.SLATE_DEPTH[section] - free, item.cluster_id, reason))
    return out


def build_slates(items: DataFrame, edition: str = "edition", pool: int = 1000) -> DataFrame:
    """A slate for each edition, with what was skipped and why. The pool (the best ``pool`` items, pinned and forced ones always) is the
    feature's own limit; it is taken by a window before grouping, so that a group has a bounded number of rows."""
    usable = items.filter("state <> 'ineligible' and headline is not null and item_status not in ('held', 'rejected', 'published')")
    best = Window.partitionBy(edition).orderBy(F.col("pinned").desc(), (F.col("forced_section").isNotNull()).desc(), F.col("score").desc(), "cluster_id")
    bounded = usable.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= pool).drop("__n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf[edition].iloc[0], *r) for r in fill_sections(pdf)]
        return pd.DataFrame(rows, columns=["edition", "section", "position", "cluster_id", "skipped"]).astype({"position": "Int32"})

    return bounded.groupBy(edition).applyInPandas(run, SLATE)


def story_score(s: DataFrame, now: Column) -> Column:
    """The older story score; an editor's override replaces it."""
    latest = F.coalesce("updated_at", "published_at")
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(latest)) / 3.6e9)
    computed = (
        lookup(fixed.SPORT_WEIGHT, F.col("sport"), 45) * lookup(fixed.LEGACY_TIER, F.col("tier"), 1.0)
        + F.greatest(F.lit(0.0), 36 - hours)
        + lookup(fixed.LEGACY_URGENCY, F.col("urgency"), 0)
        + lookup(fixed.LEGACY_CREDIBILITY, F.col("credibility"), 0)
        + 20 * F.coalesce("significance", F.lit(0))
        + 1.5 * F.least(F.coalesce("source_count", F.lit(1)), F.lit(10))
        + F.when(F.col("pinned"), fixed.LEGACY_PIN).otherwise(0)
    )
    return F.coalesce(F.col("manual_override").cast("double"), computed)


#: The older homepage's sections, their depth and what they take, in order; a story may be used twice.
HOMEPAGE = [
    ("lead", 1, lambda s: True), ("lead.supporting", 2, lambda s: True), ("wire", 8, lambda s: s.urgency in ("breaking", "developing")),
    ("now", 8, lambda s: True), ("run", 4, lambda s: s.sport == "basketball"), ("huddle", 4, lambda s: s.sport == "football"),
    ("cut", 1, lambda s: s.sport == "other"), ("diamond", 3, lambda s: s.sport == "baseball"),
    ("fight-desk", 3, lambda s: s.sport in ("boxing", "mma")), ("world-game", 3, lambda s: s.sport == "soccer"),
    ("across-the-board", 5, lambda s: s.sport in ("hockey", "tennis", "golf", "motorsports", "olympics")), ("most-read", 5, lambda s: True),
]


def fill_homepage(stories: pd.DataFrame) -> list[tuple]:
    """(section, position, story_id): each section takes the best stories that still may be used; "now" goes by time."""
    by_score = sorted(stories.itertuples(index=False), key=lambda s: (-s.score, s.sport != "basketball", -s.published_at.value, s.story_id))
    by_time = sorted(by_score, key=lambda s: -s.latest_at.value)
    used: dict[int, int] = {}
    lead, out = None, []
    for section, depth, fits in HOMEPAGE:
        pool = [s for s in (by_time if section == "now" else by_score) if used.get(s.story_id, 0) < 2 and not (section == "lead.supporting" and s.story_id == lead)]
        taken = [s for s in pool if fits(s)][:depth]
        if section == "cut" and not taken:
            taken = [s for s in pool if s.story_type in ("visual-feature", "analysis") and s.sport not in ("basketball", "football")][:depth]
        for place, s in enumerate(taken, 1):
            used[s.story_id] = used.get(s.story_id, 0) + 1
            lead = s.story_id if section == "lead" else lead
            out.append((section, place, s.story_id))
    return out


def build_homepages(stories: DataFrame, edition: str = "edition", per_sport: int = 60) -> DataFrame:
    """A homepage for each edition from its best and newest stories of each sport and urgency; no section reaches deeper than these."""
    ranked = stories.withColumn("latest_at", F.coalesce("updated_at", "published_at"))
    keys = [edition, "sport", "urgency", "story_type"]
    n = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = ranked.withColumn("__s", n(F.col("score").desc(), F.col("published_at").desc(), "story_id")).withColumn("__t", n(F.col("latest_at").desc(), F.col("score").desc(), "story_id"))
    bounded = ranked.filter((F.col("__s") <= per_sport) | (F.col("__t") <= per_sport)).drop("__s", "__t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf[edition].iloc[0], *r) for r in fill_homepage(pdf)], columns=["edition", "section", "position", "story_id"])

    return bounded.groupBy(edition).applyInPandas(run, "edition string, section string, position int, story_id long")
