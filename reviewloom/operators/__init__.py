"""DataFrame jobs: counting, ordering, weighting, rules, models."""
