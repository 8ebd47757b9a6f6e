"""DataFrame operators: matching, selection, statistics, fits, splits, search, reports."""
