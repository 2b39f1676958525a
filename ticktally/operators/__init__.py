"""Report aggregates, ticks, counters, and the general data-processing operators."""
