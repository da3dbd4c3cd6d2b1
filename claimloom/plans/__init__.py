

from . import deltas, exports, feeds, lifecycle, performance, queries, ranges, rulesets, searches, sqlfunctions  # noqa: F401  the others add their queries to the registry
