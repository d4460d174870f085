"""Feature sets and declared constants."""

from __future__ import annotations

# Names of the feature sets, in contract order.
FS_3 = (
    "hoursSinceLastSeen", "firstSeenSaturation", "eventCount7d", "eventCount30d", "daysSeen7d", "sessionCount7d", "categoryShare30d",
    "priorReturnRate", "priorSessionRate", "sessionEventCount", "sessionCategoryCount", "categoryEventsInSession", "hourOfDay", "dayOfWeek",
)
FS_2 = tuple({"firstSeenSaturation": "hoursSinceFirstSeen", "priorSessionRate": "priorSessionCount"}.get(name, name) for name in FS_3)
AS_2N = (
    "dwellLevel", "lastDwellRatio", "meanRatio", "sessionPosition", "isSessionStart", "sameAsPrevious", "hourSin", "hourCos", "isWeekend",
    "domainVisits", "domainShare", "isDailyDomain", "domainDwellLevel", "prevSameDomain", "prevDwellRatio",
)
PR_1 = ("hourSin", "hourCos", "isWeekend", "minutesSinceLast", "visitsLastHour", "visitsLastSixHours", "sameHourRate7d", "activeHourShare7d")
BS_1 = ("prevAbove", "lastRatio", "streakAbove", "daysSinceAbove", "medianLevel", "activeRate10", "topicShare10", "totalRatio", "dayOfWeekSin", "dayOfWeekCos")

# Saturation scales.
DWELL_SECONDS, POSITION, DOMAIN_VISITS, STREAK, MEDIAN_LEVEL = 30.0, 10.0, 20.0, 3.0, 5.0
LAST_VISIT_MINUTES, VISITS_LAST_HOUR, VISITS_LAST_SIX_HOURS = 60.0, 5.0, 30.0
FIRST_SEEN_HOURS, PRIOR_SESSION_RATE = 168.0, 1.0
VISIT_COUNT, DOMAIN_COUNT, DURATION_MINUTES = 20.0, 8.0, 15.0

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds

# The features of each set that may be null.
NULLABLE = {
    "fs_2": ("hoursSinceLastSeen", "hoursSinceFirstSeen", "categoryShare30d", "priorReturnRate"),
    "fs_3": ("hoursSinceLastSeen", "firstSeenSaturation", "categoryShare30d", "priorReturnRate"), "bs_1": ("daysSinceAbove",),
    "as_2n": ("domainDwellLevel", "prevDwellRatio"), "pr_1": ("sameHourRate7d",),
}
SETS = {"fs_2": FS_2, "fs_3": FS_3, "as_2n": AS_2N, "pr_1": PR_1, "bs_1": BS_1}


def feature_names(feature_set: str) -> tuple[str, ...]:
    """The columns of a feature set, in contract order; an unknown one raises ValueError."""
    if feature_set not in SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; one of {', '.join(sorted(SETS))}")
    return SETS[feature_set]


def design_columns(feature_set: str) -> tuple[str, ...]:
    """The columns of a design matrix: the features, then an indicator for each that may be null."""
    return (*feature_names(feature_set), *(f"{name}__missing" for name in NULLABLE[feature_set]))
