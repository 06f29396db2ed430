"""Fixed label texts of the reports. These values must stay exactly as
written: reports and their consumers compare on them."""

# Target status (sales vs target).
TARGET_HIT = "HIT ✓"
TARGET_MISS = "MISS ✗"
HIT = "HIT"
MISS = "MISS"

# Pareto groups.
PARETO_TOP = "Top 80% Revenue Drivers"
PARETO_REST = "Remaining 20%"

# RFM segments, in the order their rules are tried.
RFM_CHAMPIONS = "Champions"
RFM_LOYAL = "Loyal Customers"
RFM_NEW = "New Customers"
RFM_POTENTIAL = "Potential Loyalists"
RFM_AT_RISK = "At Risk"
RFM_LOST = "Lost"
RFM_NEEDS_ATTENTION = "Needs Attention"

# RFM segment rules, tried in order; lowest and highest score
# of each axis (recency, frequency, monetary).
RFM_RULES = (
    (RFM_CHAMPIONS, {"r": (4, 4), "f": (4, 4), "m": (4, 4)}),
    (RFM_LOYAL, {"r": (3, 4), "f": (3, 4)}),
    (RFM_NEW, {"r": (4, 4), "f": (1, 2)}),
    (RFM_POTENTIAL, {"r": (3, 4), "f": (1, 2), "m": (3, 4)}),
    (RFM_AT_RISK, {"r": (1, 2), "f": (3, 4)}),
    (RFM_LOST, {"r": (1, 1), "f": (1, 1)}),
)

# Customer-lifetime-value quartile names, quartile 1 .. 4.
CLV_SEGMENTS = ("High Value", "Mid-High Value", "Mid-Low Value", "Low Value")

# RFM reference date (recency scores are ordered by days
# since this date; any date gives the same order).
RFM_AS_OF = "2019-03-31"

# The histogram bar character.
HISTOGRAM_MARK = "*"

# Percent of revenue that the top Pareto group covers.
PARETO_THRESHOLD = 80
