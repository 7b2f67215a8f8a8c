"""Closed sets of the data model."""

# Verdicts from worst to best, the order that breaks ties.
WORST_FIRST = ("unsupported", "contradicted", "absent", "unverifiable", "overstated", "partial", "faithful", "error")
# The sides that verdicts stand on.
SUPPORTED = ("faithful", "partial")
NOT_SUPPORTED = ("overstated", "absent", "contradicted", "unsupported")
# Judgements of tree nodes by severity, and the one outside the order.
SEVERITY = ("holds", "weakened", "open", "fails")
OPINION = "opinion"
# Schemes of edges and kinds of defeaters.
SCHEMES = ("practical", "survey", "example", "trend", "classification")
DEFEATERS = ("population", "condition", "definition")
