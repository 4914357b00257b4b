"""Query plans: named, whole-table queries over the test tables with their SQL twins."""
