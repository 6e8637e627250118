"""DataFrame-to-DataFrame operators: curate, derive, compare, summarise, report."""
