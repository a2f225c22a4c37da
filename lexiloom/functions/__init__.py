"""Column functions: text, word forms, statistics, judge replies."""
