"""DataFrame operators: sides, split, metrics, models, profile, drift, catalog, ledger, runs."""
